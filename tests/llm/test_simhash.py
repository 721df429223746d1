import re

import numpy as np
import xxhash

from docsleuth.llm import simhash
from docsleuth.operators.graph import components


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def near(seed, groups, spread):
    rng = np.random.default_rng(seed)
    out = set()
    for x in rng.integers(0, 2**63, groups, dtype=np.uint64):
        for _ in range(int(rng.integers(1, spread))):
            y = int(x)
            for k in rng.integers(0, 64, int(rng.integers(0, 6))):
                y ^= 1 << int(k)
            out.add(y)
    return np.array(sorted(out), np.uint64)


def roots(bits, radius=3):
    root = list(range(len(bits)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if bin(int(bits[i]) ^ int(bits[j])).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(bits))]


def test_kernels():
    bits = near(1, 20, 30)
    keys = np.sort(np.random.default_rng(2).integers(0, 9, len(bits)))
    for radius in (0, 1, 2, 3):
        left, right = simhash.neighbours(keys, bits, radius)
        want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if keys[i] == keys[j] and bin(int(bits[i]) ^ int(bits[j])).count("1") <= radius}
        assert set(zip(left.tolist(), right.tolist(), strict=True)) == want
    assert simhash.large_bucket(bits, 3).tolist() == roots(bits)


def test_links_lose_nothing(spark, monkeypatch):
    bits = near(3, 60, 25)
    rows = spark.createDataFrame([(int(b) - (1 << 64) if b >> np.uint64(63) else int(b),) for b in bits], "bits long")
    for hot in (simhash.HOT, 1):  # the second deals every bucket out again
        monkeypatch.setattr(simhash, "HOT", hot)
        found = {r["node"]: r["root"] for r in components(simhash.links(rows)).collect()}
        signed = bits.view(np.int64).tolist()
        same = {}
        for i, r in enumerate(roots(bits)):
            same.setdefault(r, []).append(signed[i])
        for group in same.values():
            assert {found.get(x, x) for x in group} == {min(group)} or len(group) == 1


def test_rows(docs, no_docs, rows):
    found = {(r["doc_id"], r["bits"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, slow_fingerprint(t or "")) for i, t, *_ in rows]
    distinct = np.array(sorted({p for _, p in prints}), np.uint64)
    group = dict(zip(distinct.tolist(), roots(distinct), strict=True))
    least = {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(least.get(group[p], 1 << 60), i)
    assert found == {(i, p, least.get(group[p])) for i, p in prints}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
