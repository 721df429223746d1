import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from docsleuth.llm import toxicity

from .conftest import prose


def brute(emissions, trans):
    """Marginals, log of 1 / P(no toxic word), expected entries, leavings and stays over all tag sequences between clean words."""
    n = len(emissions)
    p, z, counts = np.zeros(n), 0.0, np.zeros(3)
    for y in itertools.product((0, 1), repeat=n):
        steps = list(itertools.pairwise((0, *y, 0)))
        own = np.array([steps.count(x) for x in ((0, 1), (1, 0), (1, 1))])
        w = np.exp(sum(e for e, s in zip(emissions, y, strict=True) if s) + own @ trans)
        z += w
        p += w * np.array(y)
        counts += w * own
    return p / z, np.log(z), counts / z


def test_marginals():
    rng = np.random.default_rng(0)
    trans = rng.normal(size=3)
    runs = [rng.normal(size=n) * 2 for n in (7, 7, 5, 3, 1)]
    padded = np.zeros((7, 5))
    for k, r in enumerate(runs):
        padded[: len(r), k] = r
    p, z, counts = toxicity.passes(padded, np.array([7, 7, 5, 3, 1]), trans)
    for k, r in enumerate(runs):
        want = brute(r, trans)
        assert np.allclose(p[: len(r), k], want[0]) and np.isclose(z[k], want[1]) and np.allclose(counts[:, k], want[2])


def test_runs_end_at_unknown_words_and_documents():
    nan = np.nan
    values = np.array([nan, 1, 2, nan, 3, 4, 5, nan, 6])
    starts, sizes = toxicity.runs_of(values, np.array([0, 2, 5, 5, 9]))
    assert starts.tolist() == [1, 2, 4, 5, 8] and sizes.tolist() == [1, 1, 1, 2, 1]
    p, z = toxicity.score_runs(values, starts, sizes, np.array([0.3, -0.2, 0.5]))
    assert np.allclose(p[[5, 6]], brute(values[5:7], np.array([0.3, -0.2, 0.5]))[0]) and p[0] == p[3] == p[7] == 0 and len(z) == 5


def test_latent_tags():
    """Of two words that stand in toxic documents, one of them in clean ones too, the other gets the blame; staying pays where toxic words come in pairs."""
    rng = np.random.default_rng(1)
    runs, labels = toxicity.Runs([], [], [], []), []
    for d in range(400):
        bad = d % 4 == 0
        labels.append(int(bad))
        words = [0] * int(rng.integers(1, 3)) + ([1, 1] if bad else []) + [2] * int(rng.integers(0, 2))
        runs.which += words
        runs.n_features += [1] * len(words)
        runs.sizes.append(len(words))
        runs.documents.append(d)
    w, bias, trans = toxicity.fit_field(runs, np.array(labels), np.zeros(3), np.ones(400))
    assert w[1] + bias > 0 > max(w[0], w[2]) + bias + 1 and trans[2] > 0


def test_learned_field(spark):
    rows = []
    for i in range(600):
        text = prose(i, 60)
        text = "".join(chr(ord("a") + int(c)) if c.isdigit() else c for c in text)
        bad = i % 4 == 0
        if bad:
            w = text.split()
            w[10:10] = ["zorgul" + "xyz"[i % 3], "nastywort"][: 1 + i % 2]
            text = " ".join(w)
        rows.append((i, text, int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i]["held_out"] == (i in held) for i in range(600))
    assert np.mean([found[i]["predicted"] == rows[i][2] for i in held]) > 0.97
    hit = next(r for i, r in found.items() if i in held and r["predicted"])
    text = rows[hit["doc_id"]][1]
    assert any(text[s["start"] : s["end"]].startswith(("zorgul", "nastywort")) for s in hit["spans"])
    assert found[900]["score"] == found[901]["score"] < 0.5


def test_without_labels(docs, no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.scored(docs, model).where(F.col("predicted") == 1).count() == 0
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.scored(no_docs, model).count() == 0


def test_scores_keep_the_prior_when_classes_are_sampled(spark):
    """With fewer documents a class than labels, the mean score stays the share of toxic labels."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2400):
        bad = i % 8 == 0
        words = ["".join(chr(ord("a") + int(c)) if c.isdigit() else c for c in w) for w in prose(i, 30).split()]
        if rng.random() < (0.7 if bad else 0.1):
            words[5:5] = ["nastywort"]
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, per_class=200)
    assert abs(toxicity.scored(docs, model).agg(F.avg("score")).first()[0] - 0.125) < 0.05
