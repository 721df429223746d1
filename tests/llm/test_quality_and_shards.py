import hashlib
import math
import random
import re
import zlib
from collections import Counter

from docsleuth.llm import quality, sharding


def figures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality(spark, docs, no_docs, rows):
    odd = ["a b c a b c a b c", "x\nx\n \n \nx", "# * $ %% &|<> " * 20, "a a a a a", "    é"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for df, want in ((docs, [(r[0], r[1]) for r in rows]), (more, [(100 + i, t) for i, t in enumerate(odd)])):
        found = quality.scored(df).collect()
        got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found)
        assert got == sorted((i or -1, *figures(t)) for i, t in want)
        assert all(not (r["base_failed"] and r["kept"]) and 0 <= r["quality"] <= 1 for r in found)
    assert quality.scored(no_docs).count() == 0


def test_quality_is_native(docs):
    plan = quality.measured(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_accuracies_from_agreement():
    patterns = [((0, 0, None), 40), ((None, None, 1), 200), ((0, None, 1), 4), ((None, 0, None), 6)]
    prior, accuracy = quality.fit(patterns)
    assert quality.posterior((0, 0, None), prior, accuracy) < 0.4 < 0.9 < quality.posterior((None, None, 1), prior, accuracy)
    assert quality.fit([]) == (quality.FIRST_PRIOR, [])


def uniform(key, k):
    return (int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_sharding(docs, no_docs, rows):
    weights = [1.0, 2.0, 0.0, 1.0, 0.5]
    found = sharding.assign(docs, weights=weights).collect()
    for r in found:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        score = {k: -w / math.log(uniform(key, k)) for k, w in enumerate(weights) if w}
        assert r["shard"] == max(score, key=score.get)
        assert r["grown_shard"] in (r["shard"], 5)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.assign(no_docs).count() == 0


def test_expectation_maximisation_row_by_row():
    """fit() over vote patterns equals the same maximisation over single rows; simulated accuracies come back where bounds allow."""
    rng = random.Random(5)
    truth = [0.95, 0.9, 0.85]
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.8
        rows.append(tuple(None if rng.random() < 0.2 else int(good if rng.random() < a else not good) for a in truth))
    prior, accuracy = quality.FIRST_PRIOR, [quality.FIRST_ACCURACY] * 3
    for _ in range(quality.ROUNDS):
        post = []
        for votes in rows:
            g, b = prior, 1 - prior
            for v, a in zip(votes, accuracy, strict=True):
                if v is not None:
                    g, b = g * (a if v else 1 - a), b * (1 - a if v else a)
            post.append(g / (g + b))
        prior = min(quality.MOST_GOOD, max(0.5, sum(post) / len(rows)))
        for i in range(3):
            right = sum(q if v[i] else 1 - q for q, v in zip(post, rows, strict=True) if v[i] is not None) + 10 * quality.FIRST_ACCURACY
            accuracy[i] = min(0.99, max(quality.LEAST_ACCURACY, right / (sum(v[i] is not None for v in rows) + 10)))
    found = quality.fit(sorted(Counter(rows).items(), key=str))
    assert abs(found[0] - prior) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(found[1], accuracy, strict=True))
    assert abs(prior - 0.8) < 0.03 and all(abs(a - b) < 0.03 for a, b in zip(accuracy, truth, strict=True))
