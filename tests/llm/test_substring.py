import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docsleuth.llm import substring

from .conftest import prose


def chunk_texts(text: str) -> list[str]:
    raw = text.encode()
    starts = substring.units(raw)[0]
    at = [*starts[substring.boundaries(raw, starts)[:-1]].tolist(), len(raw)] if len(starts) else []
    return [raw[a:b].decode().strip() for a, b in zip(at, at[1:], strict=False)]


def test_chunks_follow_content():
    text = prose(1, 300)
    whole, moved = chunk_texts(text), chunk_texts("an insertion " + text)
    assert whole[4:] == moved[-len(whole[4:]) :]
    assert chunk_texts(text.replace(" ", " \n ")) == [c.replace(" ", " \n ") for c in whole]
    assert 40 <= len(whole) <= 90 and max(len(c.split()) for c in chunk_texts("same " * 1000)) <= substring.MOST_WORDS
    for odd in ("漢字" * 2000, "", "a", "é" * 5000, " \n"):
        assert "".join("".join(c.split()) for c in chunk_texts(odd)) == "".join(odd.split())


@given(st.lists(st.sampled_from(["a", "bb", "ccc", "dddd", "é"]), max_size=200))
@settings(max_examples=60, deadline=None)
def test_groups_hold_whole_chunks(words):
    text = " ".join(words).encode()
    starts, _, _, begins, ends, own = substring.groups(text)
    at = set(substring.boundaries(text, starts).tolist()) if len(starts) else set()
    assert all(a in at and b in at and b - a >= substring.LEAST_WORDS for a, b in zip(begins.tolist(), ends.tolist(), strict=True))
    by_words = {}
    for a, b, d in zip(begins.tolist(), ends.tolist(), own.tolist(), strict=True):
        assert by_words.setdefault(d, words[a:b]) == words[a:b]


def test_passages(spark):
    passage = prose(77, 70)
    texts = {1: prose(1, 90) + " " + passage + " " + prose(2, 40), 2: passage + " " + prose(3, 100), 3: prose(4, 80), 4: prose(5, 60) + " " + passage, 5: prose(6, 30) + " " + " ".join(prose(77, 70).split()[:40]), 6: (prose(8, 60) + " ") * 3}
    found = {r["doc_id"]: r for r in substring.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(found[i]["text"] == texts[i] and found[i]["n_removed_words"] == 0 for i in (1, 3, 5, 6))
    assert found[2]["n_removed_words"] == found[4]["n_removed_words"] == 70
    assert found[2]["text"] == prose(3, 100) and found[4]["text"].strip() == prose(5, 60)


def test_rows(docs, no_docs, rows):
    found = substring.deduplicated(docs)
    assert found.columns[: len(docs.columns)] == docs.columns and found.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in found.collect()}
    assert kept[1] == rows[0][1] and len(kept[2]) < 60 and kept[5] is None and kept[6] == "" and kept[8] == "one" and kept[10] == rows[10][1] and kept[None] == "no id here at all"
    assert substring.deduplicated(no_docs).count() == 0


def test_whole_passages_go(spark):
    """Every passage of 50 words or more goes with its ends, whatever stands around it; so does text without spaces."""
    texts, left = {}, {}
    for i in range(120):
        words = prose(1000 + i, 50 + i % 35)[:-1].replace("w", "p").split()
        a, b, c, d = (" ".join(f"{x}{i}n{j}" for j in range(30)) for x in "abcd")
        texts[2 * i], texts[2 * i + 1] = f"{a} {' '.join(words)} {b}", f"{c}\n{'  '.join(words)} {d}"
        left[2 * i], left[2 * i + 1] = texts[2 * i], f"{c}\n{d}"
    han = "".join(chr(0x4E00 + (i * i * 7 + i) % 5003) for i in range(120))
    texts |= {900: "甲乙" + han + "丙", 901: "one " + han + "丁 two"}
    left |= {900: texts[900], 901: "one 丁 two"}
    found = {r["doc_id"]: r["text"] for r in substring.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == left


def test_runs_follow_one_source(spark):
    """A word 300 times stays where an earlier document has it eight times; so do six repeats of ten words from several documents."""
    parts = [" ".join(f"s{i}n{j}" for j in range(10)) for i in range(6)]
    texts = [(i, f"{p} " + " ".join(f"x{i}n{j}" for j in range(30))) for i, p in enumerate(parts)] + [(7, " ".join(parts)), (8, "one two " + "bar " * 8 + "end"), (9, "bar " * 300)]
    found = {r["doc_id"]: r["text"] for r in substring.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == dict(texts)


def brute(texts: dict[int, list[str]]) -> dict[int, tuple[str, int]]:
    """Each document without the words in any MIN_WORDS consecutive words that a document with a smaller id has too, and their number."""
    seen: dict[tuple, int] = {}
    out = {}
    for i, words in texts.items():
        hit = np.zeros(len(words), bool)
        for p in range(len(words) - substring.MIN_WORDS + 1):
            if seen.setdefault(tuple(words[p : p + substring.MIN_WORDS]), i) != i:
                hit[p : p + substring.MIN_WORDS] = True
        out[i] = (" ".join(w for w, h in zip(words, hit, strict=True) if not h), int(hit.sum()))
    return out


def test_brute_force(spark):
    """Parts of passages that an earlier document has whole go exactly; where earlier documents have only parts, nothing goes that doesn't repeat."""
    rng = np.random.default_rng(4)
    pool = [[f"p{k}x{j}" for j in range(int(rng.integers(60, 120)))] for k in range(25)]
    fresh = lambda: [f"u{rng.integers(1 << 40)}" for _ in range(20)]
    for whole_first in (True, False):
        texts = {k: fresh() + own + fresh() for k, own in enumerate(pool)} if whole_first else {}
        for i in range(100, 220):
            words: list[str] = []
            for _ in range(int(rng.integers(1, 5))):
                own = pool[int(rng.integers(len(pool)))]
                words += own[int(rng.integers(0, 20)) : len(own) - int(rng.integers(0, 20))] if rng.random() < 0.6 else []
                words += fresh()[: 20 if whole_first else 2]
            texts[i] = words
        want = brute(texts)
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
        found = {r["doc_id"]: (" ".join(r["text"].split()), r["n_removed_words"]) for r in substring.deduplicated(df).collect()}
        assert sum(n for _, n in want.values()) > 4000
        assert found == want if whole_first else all(found[i][1] <= want[i][1] and set(want[i][0].split()) <= set(found[i][0].split()) for i in texts)
