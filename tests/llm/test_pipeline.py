"""Every stage against brute force on the smallest table; the toxicity stage against its own scores."""

import numpy as np
import pytest

import corpus_pipeline
from docsleuth.llm import simhash, toxicity

from .test_simhash import roots, slow_fingerprint
from .test_text_scans import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.toPandas())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    for kept in stages[1:-1]:
        assert list(kept.columns) == list(stages[0].columns)


def test_toxic_documents_go(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.scored(docs, model).where("predicted = 1").collect()}
    assert set(stages[0].doc_id) - set(stages[1].doc_id) == bad


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    prints = [slow_fingerprint(t) for t in before.text]
    distinct = np.array(sorted(set(prints)), np.uint64)
    group = dict(zip(distinct.tolist(), roots(distinct), strict=True))
    least = {}
    for i, p in zip(before.doc_id, prints, strict=True):
        least[group[p]] = min(least.get(group[p], 1 << 60), i)
    assert set(after.doc_id) == set(least.values()) and simhash.RADIUS == 3


def test_passages_go_and_nothing_else(stages):
    before, after = stages[2].set_index("doc_id"), stages[3].set_index("doc_id")
    assert set(before.index) == set(after.index)
    for i, text in after.text.items():
        assert len(text) == after.n_chars[i] and set(text.split()) <= set(before.text[i].split())


def test_contaminated_documents_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = []
    for i, text in zip(stages[3].doc_id, stages[3].text, strict=True):
        n, hit, _ = brute(text, items)
        if not (hit and 20 * hit >= n):
            kept.append(i)
    assert sorted(stages[4].doc_id) == sorted(kept)


def test_tokens(stages):
    assert sorted(stages[5].doc_id) == sorted(stages[4].doc_id) and (stages[5].n_tokens == stages[5].token_ids.map(len)).all()
