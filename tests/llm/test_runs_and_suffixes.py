"""Periodic runs, repeated byte strings and resampling, each against its plain definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from docsleuth.llm import periods, queries, resample, suffixes
from docsleuth.llm.suffix_automaton import words


def plain_runs(w, exponent=4, least=6):
    out = []
    for q in range(1, len(w)):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, exponent * q) and not any(all(w[t] == w[t + r] for t in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_any_kind():
    rnd = random.Random(1)
    for _ in range(800):
        n, letters = rnd.randrange(150), rnd.choice([1, 2, 3, 12])
        w = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randrange(3) if n else 0):
            a, p = rnd.randrange(n), rnd.randrange(1, 36)
            for i in range(a, min(n, a + rnd.randrange(200))):
                w[i] = w[a + (i - a) % p]
        for exponent, least in ((4, 6), (3, 5), (2, 10), (5, 2)):
            assert periods.runs(np.array(w, np.int64), exponent, least) == plain_runs(w, exponent, least)


def test_seed_lengths_cover_their_periods():
    for exponent, least in ((4, 6), (3, 3), (2, 9)):
        at = 1
        for low, k in periods.levels(5000, exponent, least):
            assert low == at and all(max(least, exponent * q) - q >= k >= q for q in range(low, k + 1))
            at = k + 1
        assert exponent * at > 5000


def test_long_run_is_extended_once():
    """A run of a million words takes no more extension than its length, in spite of a seed at every word."""
    found = periods.runs(np.arange(1_000_000) % 7)
    assert found == [(0, 1_000_000, 7)]


def test_words_of_texts_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(periods, "_PIECE", 5)
    text = "  ein zwei\tdrei\nzwei  x ein ".encode()
    ids, names = periods.numbered(text)
    assert [names[i] for i in ids] == text.split()


def periodic(rows, alter=None):
    out = Counter()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        if alter:
            w = [w[i] for i in alter(r[0], np.arange(len(w)))]
        found = plain_runs(w)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        collapsed = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(r[0], len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())] += 1
    return out


def test_periodic_runs_of_a_table(spark, rows, docs, no_docs):
    short = [r for r in rows if r[4] < 5000] + [(i, " ".join(f"w{k % i}" for k in range(9 * i)) + " end", "en", "s", 0, "x", "y", "z", "i", "m") for i in (20, 21, 30, 57)]
    df = spark.createDataFrame(short, docs.schema)
    assert Counter(tuple(r)[:8] for r in periods.periodic_runs(df).collect()) == periodic(short)
    assert Counter(map(tuple, periods.periodic_runs(df, alter=queries.planted, outputs=False).collect())) == periodic(short, queries.planted)
    kept = {r["doc_id"]: r for r in periods.periodic_runs(df).collect()}
    assert kept[20]["collapsed"] == " ".join(f"w{k}" for k in range(20)) + " end" and tuple(kept[20]["runs"][0]) == (0, 180, 20)
    assert periods.periodic_runs(no_docs).count() == 0 and periods.periodic_runs(docs).count() == len(rows)


def plain_removal(rows, length):
    """By the definition: strings by document and start; rows of one id are one document."""
    first, out = {}, {}
    places = sorted((i, p, t[p : p + length]) for i, t in {(r[0], (r[1] or "").encode()) for r in rows if r[0] is not None} for p in range(len(t) - length + 1))
    for i, p, s in places:
        at = first.setdefault(s, (i, p))
        if at < (i, p):
            out.setdefault(i, set()).update(range(p, p + length))
    result = Counter()
    for r in rows:
        t = (r[1] or "").encode()
        gone = out.get(r[0], set()) if r[0] is not None else set()
        own = [k for k in range(len(t)) if k in gone]
        spans = sum(k == 0 or k - 1 not in gone for k in own)
        result[(r[0], len(t), len(own), spans, bytes(b for k, b in enumerate(t) if k not in gone))] += 1
    return result


def removal(df, length=suffixes.LENGTH):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.deduplicated(df, length=length).collect())


def passages(seed=2):
    """Texts that share passages whole and in part, over one another, inside one document, with periods and with bytes beyond ASCII."""
    rnd = random.Random(seed)
    prose = lambda n: " ".join(rnd.choice(("alpha", "beta", "gamma", "délta", "漢字", "omega", "zeta", "eta")) + str(rnd.randrange(60)) for _ in range(n))
    shared = [prose(60) for _ in range(5)]
    out = []
    for i in range(60):
        s = shared[rnd.randrange(5)]
        a = rnd.randrange(len(s) // 2)
        out.append(prose(rnd.randrange(25)) + s[a : a + rnd.randrange(60, 400)] + rnd.choice(("", " ", "x")) + rnd.choice(shared)[rnd.randrange(90) :] * rnd.randrange(2))
    out += [shared[0] * 2, "ab" * 400, "b" + "ab" * 300, "a" * 100, "a" * 99, "a" * 101, out[0], out[0]]
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_removal_is_the_definition(spark, docs, length):
    rows = [(i, t, "en", "s", 0, "x", "y", "z", "i", "m") for i, t in enumerate(passages())]
    rows += [(None, rows[0][1], *rows[0][2:]), (3, None, *rows[0][2:]), (70, rows[5][1], *rows[0][2:]), (70, rows[5][1], *rows[0][2:]), (70, rows[6][1], *rows[0][2:])]
    random.Random(4).shuffle(rows)
    assert removal(spark.createDataFrame(rows, docs.schema).repartition(5), length) == plain_removal(rows, length)


def test_removal_of_a_table(rows, docs, no_docs):
    assert removal(docs) == plain_removal(rows, 100)
    assert removal(no_docs) == Counter()


def test_blocks_of_long_texts(spark, monkeypatch):
    rnd = random.Random(8)
    text = bytes(rnd.choice(b"abcdefgh ") for _ in range(9000)).decode()
    rows = [(1, text), (2, "x" + text[100:8000] + "y"), (3, text[4000:6000] * 3)]
    want = plain_removal(rows, 100)
    assert removal(spark.createDataFrame(rows, "doc_id long, text string")) == want
    monkeypatch.setattr(suffixes, "BLOCK", 1500)  # the driver's own, as the tasks' workers have the module's
    strings = sum(int(p[3].sum()) for p in suffixes.positions([text.encode(), b"short", (text[:1200]).encode()]))
    assert strings == 9000 - 99 + 1200 - 99


def test_spans_are_maximal():
    spans = suffixes.removed(50, np.array([40, 0, 5, 20]), np.array([1, 1, 3, 1]), 10)
    assert spans.tolist() == [[0, 17], [20, 30], [40, 50]]


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain_draw(rows, targets, share=10, least=20, low=1, high=1, buckets=10_000):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER).decode())
    feats = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for r in rows:
        s.update(feats(find(r[1])))
    for x in targets:
        t.update(feats(find(x)))
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + buckets) / ((s[k] + 1) * (t.total() + buckets)))) for k in range(buckets)]
    out = []
    for r in rows:
        w = find(r[1])
        weight = sum(gain[f] for f in feats(w))
        h = int(hashlib.sha256(f"2024:{r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(w), len(feats(w)), weight, None if r[0] is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((x for x in out if x[0] is not None and x[1] >= least), key=lambda x: (-x[4], x[0]))
    for k, x in enumerate(may[: share * len(may) // 100], 1):
        x[5] = k
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("share", "low", "high", "buckets"), [(10, 1, 1, 10_000), (50, 1, 2, 64), (100, 2, 3, 1000), (0, 1, 1, 10)])
def test_draw_is_the_definition(spark, docs, rows, monkeypatch, share, low, high, buckets):
    monkeypatch.setattr(resample, "RANKED_ROWS", 7)  # several ranges
    more = [(100 + i, " ".join(f"w{(i * 31 + k * k) % 97}" for k in range(i % 60)), "en", "s", 0, "x", "y", "z", "i", "m") for i in range(160)]
    more += [(7, more[30][1], *more[0][2:])] * 3
    targets = ["w1 W2 w3 w5", None, "", "w96 " * 9]
    df, target = spark.createDataFrame(rows + more, docs.schema), spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id int, text string")
    got = resample.resampled(df, target, low=low, high=high, buckets=buckets, share_percent=share)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())) == plain_draw(rows + more, targets, share, 20, low, high, buckets)


def test_cutoff_among_ties(spark):
    scores = spark.createDataFrame([(i, s) for s, n in ((5, 3), (2, 40), (-9, 10), (1 << 40, 1)) for i in range(1000 * (s % 7), 1000 * (s % 7) + 3 * n, 3)], "id bigint, score bigint")
    order = sorted(((r["score"], -r["id"]) for r in scores.collect()), reverse=True)
    for wanted in (1, 2, 4, 5, 20, 44, 45, 54):
        score, last = resample.cutoff(scores, wanted)
        assert order[wanted - 1] == (score, -last)


def test_draw_from_nothing(spark, no_docs):
    none = spark.createDataFrame([], "item_id int, text string")
    assert resample.resampled(no_docs, none).count() == 0
    assert words(b"A-b \xc3\x9c9") == [b"a", b"b", b"\xc3\x9c9"]
