import re

from docsleuth.llm import decontam, licenses
from docsleuth.llm.suffix_automaton import SuffixAutomaton, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    windows = {}
    for name, item in items:
        w = split(item)
        for s in [tuple(w[i : i + 13]) for i in range(len(w) - 12)] if len(w) >= 13 else [tuple(w)] if w else []:
            windows.setdefault(s, set()).add(name)
    w, hit, found = split(text), set(), set()
    for n in {len(s) for s in windows}:
        for i in range(len(w) - n + 1):
            if (s := tuple(w[i : i + n])) in windows:
                hit |= set(range(i, i + n))
                found |= windows[s]
    return len(w), len(hit), sorted(found)


def test_words():
    assert words("A-b Ünï\x00c9".encode()) == [x.encode() for x in split("A-b Ünï\x00c9")]


def test_matching_statistics():
    auto = SuffixAutomaton([b"a b c a b d".split(), b"b c b".split()])
    grams = {tuple(s[i:j]) for s in (b"a b c a b d".split(), b"b c b".split()) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = b"a b c b d a b d d c a b c a".split()
    sizes = [n for _, n in auto.walk(auto.known(text).tolist())]
    for i in range(len(text)):
        assert sizes[i] == max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in grams), default=0)


def test_decontamination(spark, docs, no_docs, rows, monkeypatch):
    monkeypatch.setattr(decontam, "PASS_BLOCKS", 2)
    base = next(t for i, t, *_ in rows if i == 4)
    items = [("a", " ".join(base.split()[10:40])), ("b", " ".join(base.split()[20:33])), ("c", "one"), ("c2", "ONE"), ("d", ""), ("e", None), ("f", "no id"), ("g", "code 漢字")]
    table = spark.createDataFrame(items, "item_id string, text string")
    for block in (decontam.BLOCK_WORDS, 20):
        found = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["items"]) for r in decontam.matches(docs, table, block_words=block).collect())
        assert found == sorted((i or -1, *brute(t, items)) for i, t, *_ in rows)
    assert decontam.matches(no_docs, table).count() == 0
    assert {r["n_hit"] for r in decontam.matches(docs, table.limit(0)).collect()} == {0}
    cut = {r["doc_id"]: r["text"] for r in decontam.without_spans(docs, table).collect()}
    assert cut == {r["doc_id"]: r["text"] for r in decontam.without_spans(docs, table, block_words=3).collect()}  # as many passes as it takes
    assert brute(cut[4], items[:1])[1] == 0 and cut[1] == rows[0][1] and cut[5] is None


def test_licenses(spark, docs, no_docs):
    more = ["Under the MIT license; under the mit license", "cc-by-nc 4.0 and Apache License, Version 2.0", "this work is licensed under xx the gnu general public license version 3", "This work is licensed under the GNU General Public License, version 3. " * 500, "under the mit", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.digests(licenses.scan(df)).collect()}
    for i, t in enumerate(more):
        w = split(t)
        places = sorted((k, v) for p, v in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in places}))
    assert [found[i]["labels"] for i in (2, 3, 4, 5)] == ["gpl-3", "gpl-3", "", ""] and found[3]["score"] == 1.0 and len(found[3]["spans"]) == 500
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(no_docs).count() == 0


def test_items_of_one_id_count_once(spark):
    docs = spark.createDataFrame([(1, "a b c x d e f"), (2, "d e f"), (3, "c x d")], "doc_id int, text string")
    items = spark.createDataFrame([("k", "a b c"), ("k", "d e f"), ("l", "c x d")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"]) for r in decontam.digests(decontam.matches(docs, items)).collect()}
    assert got == {1: (7, 2, ["k", "l"]), 2: (3, 1, ["k"]), 3: (3, 1, ["l"])}
    # several passes, their broadcasts given up in between
    assert {r["doc_id"]: r["n_hit"] for r in decontam.matches(docs, items.unionByName(items).unionByName(items), block_words=3).collect()} == {1: 7, 2: 3, 3: 3}
