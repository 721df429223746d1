"""Toxicity by a linear-chain conditional random field over words.

Only documents are labelled, so the words' tags are latent: the field is fitted to the likelihood of the documents' labels.
A document is toxic where at least one word is; the likelihood of a clean label is the probability that forward
passes give to the sequence without a toxic word, that of a toxic label the rest. Its gradient needs the marginals of the
forward and backward passes and nothing else. So a word that stands in toxic documents beside a better sign of toxicity gets
no weight, and one that alone explains a document does. A share of the labels may be wrong (NOISE).

Features are words and their beginnings, those that stand in toxic training documents more often than chance explains (a likelihood ratio of at least the logarithm of the number of features tried). A word without any
such feature is clean; what lies between such words is a run, and the field's sequences are the runs of whole documents,
with transitions for entering, staying in and leaving a toxic span. For every document the marginals aggregate to the odds that any word
is toxic, the expected number and share of toxic words; a logistic model of these, fitted on the training documents, gives the
score. Words with a marginal of at least one half are joined into the offending spans.

Training takes about PER_CLASS documents of each class, whole, chosen by a hash of their ids; equal texts of one class count
once. Runs of over TRAINED_RUN words with features are cut for training only. Where a class is larger than PER_CLASS, its documents weigh the more in
the field and the document model, so that both see the classes' ratio among all training labels. Scoring covers every document, whole. Null and empty texts
have no words and get the model's base score; without labels of both classes every score is the share of toxic
labels, or 0.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsleuth.llm.common import by_hash, slices, utf8, written

PER_CLASS = 4000
BEGINNINGS = (4, 5, 6, 7)
#: Training documents that a feature must stand in; how likely a label is wrong; the variance that weights may have.
LEAST_DOCUMENTS, NOISE, SPREAD = 2, 0.02, 1.0
ROUNDS = 150
#: Training sequences are cut after so many words; scored ones are not.
TRAINED_RUN = 64
HELD_OUT = 5
#: Cells of padded runs scored together, and bytes of texts: what a worker holds of a piece is some fifty times that.
CELLS, SCORED_BYTES = 500_000, 2 << 20

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    w = word.lower()
    return ["w" + w, *(f"{n}{w[:n]}" for n in BEGINNINGS if len(w) > n)]


def held_out(id_col: str) -> Column:
    """Whether labels of this id may not be learned: crc32 of its text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % HELD_OUT == 0


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    #: log potentials of entering, leaving and staying in a toxic span; staying clean has 0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: of 1, the log odds of any toxic word, log(1 + expected toxic words), their share
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def emission(self, word: str) -> float:
        """The log odds of toxic by itself; not a number for a word without a known feature, which is clean."""
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return self.bias + sum(found) if found else np.nan


def passes(emissions: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs (columns, sorted by falling size; rows: words) each word's probability of toxic, the log of 1 / P(no toxic word), and the expected numbers of entries, leavings and stays.

    Before and after a run stands a clean word.
    """
    enter, leave, stay = (float(t) for t in transitions)
    steps, n = emissions.shape
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # runs longer than the step
    clean, toxic = np.zeros_like(emissions), np.full_like(emissions, -np.inf)
    toxic[0] = enter + emissions[0]
    for k in range(1, steps):
        a = live[k]
        c, t = clean[k - 1, :a], toxic[k - 1, :a]
        clean[k, :a] = np.logaddexp(c, t + leave)
        toxic[k, :a] = emissions[k, :a] + np.logaddexp(c + enter, t + stay)
    last = (sizes - 1, np.arange(n))
    z = np.logaddexp(clean[last], toxic[last] + leave)
    p, counts = np.zeros_like(emissions), np.zeros((3, n))
    after_c, after_t = np.zeros(n), np.full(n, leave)  # log potentials of what follows a clean, a toxic word
    for k in range(steps - 1, -1, -1):
        a = live[k]
        p[k, :a] = np.exp(toxic[k, :a] + after_t[:a] - z[:a])
        if k:
            c, t, e = clean[k - 1, :a], toxic[k - 1, :a], emissions[k, :a]
            counts[0, :a] += np.exp(c + enter + e + after_t[:a] - z[:a])
            counts[1, :a] += np.exp(t + leave + after_c[:a] - z[:a])
            counts[2, :a] += np.exp(t + stay + e + after_t[:a] - z[:a])
            after_c[:a], after_t[:a] = np.logaddexp(after_c[:a], enter + e + after_t[:a]), np.logaddexp(leave + after_c[:a], stay + e + after_t[:a])
    counts[0] += p[0]
    counts[1] += p[last]
    return p, z, counts


def score_runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the values, and z of each run (see passes); runs of similar length are padded together."""
    p, z = np.zeros(len(values)), np.zeros(len(starts))
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = int(sizes[order[at]])
        block = order[at : at + max(1, min(20_000, CELLS // longest))]
        own = sizes[block]
        cells = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        columns = np.repeat(np.arange(len(block)), own)
        places = starts[block][columns] + cells
        padded = np.zeros((longest, len(block)))
        padded[cells, columns] = values[places]
        found, z[block], _ = passes(padded, own, transitions)
        p[places] = found[cells, columns]
        at += len(block)
    return p, z


def runs_of(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the stretches of numbers among values, which also end where documents do."""
    known = ~np.isnan(values)
    first = known.copy()
    first[1:] &= ~known[:-1]
    inner = ends[(ends > 0) & (ends < len(values))]
    first[inner] |= known[inner]
    starts = np.flatnonzero(first)
    stop = np.flatnonzero(~known)
    stop = np.append(stop, len(values))[np.searchsorted(stop, starts)]
    follow = np.append(starts[1:], len(values))
    return starts, np.minimum(stop, follow) - starts


@dataclass
class Runs:
    """Training runs: each word's features and their number, each run's size and document, in order."""

    which: np.ndarray
    n_features: np.ndarray
    sizes: np.ndarray
    documents: np.ndarray


def fit_field(runs: Runs, labels: np.ndarray, prior: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions that make the documents' labels likeliest, with normal priors, those of the features' weights around prior; weight: of each document."""
    n_features = len(prior)
    sizes, owner = np.array(runs.sizes), np.array(runs.documents)
    which, word = np.array(runs.which), np.repeat(np.arange(len(runs.n_features)), runs.n_features)
    begins = np.cumsum(sizes) - sizes
    groups = []  # runs of similar size are padded together: run numbers, sizes, and of each word its place
    for _, members in itertools.groupby(np.argsort(-sizes, kind="stable").tolist(), key=lambda k: int(sizes[k] - 1).bit_length()):
        own = np.array(list(members))
        n = sizes[own]
        cells = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        columns = np.repeat(np.arange(len(own)), n)
        groups.append((own, n, cells, columns, begins[own][columns] + cells, np.zeros((int(n[0]), len(own)))))
    sign = np.where(labels == 1, 1.0, -1.0) * weight * (1 - 2 * NOISE)
    centre = np.concatenate((prior, [-4.0, 0.0, 0.0, 0.0]))
    spread = np.concatenate((np.full(n_features, SPREAD), [4.0, 1.0, 1.0, 1.0]))
    params = centre.copy()
    m, v = np.zeros_like(params), np.zeros_like(params)
    p, z, counts = np.zeros(len(runs.n_features)), np.zeros(len(sizes)), np.zeros((3, len(sizes)))
    run_of_word = np.repeat(np.arange(len(sizes)), sizes)
    for r in range(1, rounds + 1):
        emissions = params[n_features] + np.bincount(word, params[which], len(p))
        for own, n, cells, columns, places, padded in groups:
            padded[cells, columns] = emissions[places]
            found, z[own], counts[:, own] = passes(padded, n, params[n_features + 1 :])
            p[places] = found[cells, columns]
        clean = np.exp(-np.bincount(owner, z, len(labels)))  # the probability of no toxic word
        seen = np.where(labels == 1, (1 - clean) * (1 - NOISE) + clean * NOISE, clean * (1 - NOISE) + (1 - clean) * NOISE)
        push = (sign * clean / seen)[owner]  # of each run, what a unit more of expected counts brings
        moved = p * push[run_of_word]
        gradient = np.concatenate((np.bincount(which, moved[word], n_features), [moved.sum()], counts @ push)) - (params - centre) / spread
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        params = params + 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return params[:n_features], float(params[n_features]), params[n_features + 1 :]


def aggregates(p: np.ndarray, z: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log odds of any toxic word, log(1 + expected toxic words), their share; of documents with the sums p and z and so many words."""
    odds = np.clip(np.where(z > 0, np.log(np.expm1(np.maximum(np.minimum(z, 30), 1e-12))), -8.0), -8.0, 8.0)
    return np.column_stack((odds, np.log1p(p), p / np.maximum(words, 1)))


def fit_document(x: np.ndarray, y: np.ndarray, rounds: int = 40, weight: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton's method with a small penalty; weight: of each row."""
    v = np.ones(len(x)) if weight is None else weight
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (v * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (v * (y - p)) - 0.05 * w)
    return w


def training_rows(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """y, text, key (a hash of the text) of about per_class documents of each class, equal texts of a class once, written once, as three passes follow; the classes' weights.

    A class weighs its training labels over those chosen, so 1 if all are; the smaller weight is scaled to 1.
    """
    own = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("y"))
    own = own.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))  # an id counts once, however often it is labelled
    chosen, weights = None, {}
    for y in (0, 1):
        every = own.where(F.col("y") == y)
        part = by_hash(every, "id", per_class)
        weights[y] = every.count() / max(1, part.count()) or 1.0
        chosen = part if chosen is None else chosen.union(part)
    texts = documents.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "y", "text")  # 2 x per_class rows of two numbers

    rows = written(found.groupBy("y", "text").agg(F.count(F.lit(1)).alias("n")).select("y", "text", F.xxhash64("text").alias("key")))
    return rows, {y: v / min(weights.values()) for y, v in weights.items()}


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    rows, weights = training_rows(documents, labels, id_col, text_col, label_col, per_class)
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        share = float(sizes.get(1, 0) > 0)
        return Model(document=np.array([-20.0 if not share else 20.0, 0.0, 0.0, 0.0]))
    pos, neg = sizes[1], sizes[0]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[y].update({f for w in set(_WORD.findall(t.decode("utf-8", "replace"))) for f in features(w)})
            keys = list(total[0] | total[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[1][k] for k in keys], pa.int64()), pa.array([total[0][k] for k in keys], pa.int64())], names=["f", "p", "n"])

    counts = rows.mapInArrow(counted, "f string, p bigint, n bigint").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(F.col("p") >= LEAST_DOCUMENTS)
    both = F.col("p") + F.col("n")
    ratio = 2 * (F.col("p") * F.log(F.col("p") / (both * pos / (pos + neg))) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (both * neg / (pos + neg)))).otherwise(0.0))
    more = F.col("p") * neg > F.col("n") * pos
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    counts = written(counts)
    least = float(np.log(max(counts.count(), 2)))  # about as much as the luckiest of so many features reaches by chance
    found = sorted(tuple(r) for r in counts.where((ratio >= least) & more).select("f", (odds * (1 - least / ratio)).alias("odds")).collect())
    telling = [f for f, _ in found]
    numbers = {f: i for i, f in enumerate(telling)}
    # a word's features share its odds, less what chance may have brought
    prior = np.array([o / (1 + sum(f[0] != "w" or len(f) - 1 > n for n in BEGINNINGS)) for f, o in found])

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for t in batch.column(1).to_pylist():
                which, n, sizes = [], [], [0]
                for w in _WORD.findall(t.decode("utf-8", "replace")):
                    own = [numbers[f] for f in features(w) if f in numbers]
                    if not own or sizes[-1] == TRAINED_RUN:
                        sizes.append(0)
                    if own:
                        which += own
                        n.append(len(own))
                        sizes[-1] += 1
                for x, y in zip(out, (which, n, [k for k in sizes if k]), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.list_(pa.int32())) for x in out), batch.column(0), batch.column(2)], names=["which", "n", "sizes", "y", "key"])

    # the order of rows is no one's choice
    found = rows.mapInArrow(sequences, "which array<int>, n array<int>, sizes array<int>, y int, key bigint").toArrow().sort_by("key")
    flat = lambda c: pc.list_flatten(found[c].combine_chunks()).to_numpy()
    labels = found["y"].to_numpy()
    runs = Runs(flat("which"), flat("n"), flat("sizes"), np.repeat(np.arange(len(labels)), pc.list_value_length(found["sizes"]).to_numpy()))
    model = Model()
    if len(runs.sizes):
        w, model.bias, model.transitions = fit_field(runs, labels, prior, np.array([weights[y] for y in labels.tolist()]))
        model.weights = dict(zip(telling, w.tolist(), strict=True))
    own = marks(rows.select(F.lit(0).alias("id"), "text", "y"), model, keep="y").collect()
    own = np.array(sorted((r["odds"], r["mass"], r["share"], r["y"]) for r in own))
    model.document = fit_document(own[:, :3], own[:, 3], weight=np.where(own[:, 3] == 1, weights[1], weights[0]))
    return model


def marks(df: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """id, odds, mass, share, spans for rows of id and text (UTF-8); keep: one more column of whole numbers to carry along."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # weights of features that a bounded sample of documents has
    rows = df.select("id", "text", *([keep] if keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[str, float] = {}
        for batch in slices(batches, size=SCORED_BYTES):
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            values = []
            for t in texts:
                words = _WORD.findall(t)
                if fresh := set(words).difference(known):
                    if len(known) > 200_000:
                        known.clear()
                        fresh = set(words)
                    known.update((w, own.emission(w)) for w in fresh)
                values.append(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
            sizes = np.array([len(x) for x in values])
            ends = np.cumsum(sizes)
            every = np.concatenate(values)
            starts, lengths = runs_of(every, ends)
            p, z = score_runs(every, starts, lengths, own.transitions)
            of_word, of_run = np.repeat(np.arange(len(texts)), sizes), np.searchsorted(ends, starts, side="right")
            sums = aggregates(np.bincount(of_word, p, len(texts)), np.bincount(of_run, z, len(texts)), sizes)
            parts = np.split(p, ends[:-1])
            spans = [spans_of(t, x) if len(x) and x.max() >= 0.5 else [] for t, x in zip(texts, parts, strict=True)]
            columns = [batch.column(0), *(pa.array(sums[:, i]) for i in range(3)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column(2)] if keep else [])], names=["id", "odds", "mass", "share", "spans", *([keep] if keep else [])])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, odds double, mass double, share double, spans array<struct<start: bigint, end: bigint, probability: double>>"
    return rows.mapInArrow(run, schema + (f", {keep} {rows.schema[keep].dataType.simpleString()}" if keep else ""))


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Neighbouring words of at least one half, as character offsets with their largest marginal."""
    out: list[dict] = []
    last = -2
    for i, (m, q) in enumerate(zip(_WORD.finditer(text), p.tolist(), strict=True)):
        if q >= 0.5:
            if last == i - 1:
                out[-1]["end"] = m.end()
                out[-1]["probability"] = max(out[-1]["probability"], q)
            else:
                out.append({"start": m.start(), "end": m.end(), "probability": q})
            last = i
    return out


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, spans: one row per input row, without a shuffle."""
    found = marks(df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), model)
    w = [float(x) for x in model.document]
    logit = F.lit(w[0]) + w[1] * F.col("odds") + w[2] * F.col("mass") + w[3] * F.col("share")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit))))
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), "spans")
