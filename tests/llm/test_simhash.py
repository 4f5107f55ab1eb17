from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from duskwire.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= bits):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, f"{fp:016x}", least.get(c)) for (i, _), fp, c in zip(rows, fps, comp, strict=True)), key=str)


@pytest.mark.parametrize("table", ["documents", "clashing"])
def test_against_all_pairs(request, table):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str) == expected(rows)


def test_no_documents(empty):
    assert simhash.simhash_components(empty).collect() == []
    assert simhash.deduplicate(empty).collect() == []


def clustered(n, seed=3):
    """Fingerprints in chains and clumps of few differing bits, and loose ones."""
    rng = np.random.default_rng(seed)
    out = set()
    while len(out) < n:
        fp = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, 30))):
            out.add(fp)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                fp ^= 1 << int(b)
    return sorted(out)[:n]


def test_links_join_what_all_pairs_join(spark):
    fps = clustered(3000)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()
    at = {x: i for i, x in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        i, j = root(at[a % 2**64]), root(at[b % 2**64])
        parent[max(i, j)] = min(i, j)
    assert [root(i) for i in range(len(fps))] == plain_components(fps)


@pytest.mark.parametrize(("n", "block"), [(2, 10**6), (3, 4), (600, 1000), (9000, 10**6)])
def test_lists_of_any_length(monkeypatch, n, block):
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", block)
    rng = np.random.default_rng(1)
    free = rng.integers(0, 2**32, n - n // 3, dtype=np.uint64)
    near = free[: n // 3] ^ np.uint64(1 << 5) ^ (np.uint64(1) << rng.integers(0, 32, n // 3).astype(np.uint64))
    fps = np.unique(np.concatenate([free, near]))  # the four upper bytes are shared: one list, of the set (0, 1, 2, 3)
    assert simhash.KEYS[0] == (0, 1, 2, 3)
    a, b = simhash.list_links(np.zeros(len(fps), np.int64), fps)
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(p), root(q)
        parent[max(p, q)] = min(p, q)
    comp = plain_components(fps.tolist())
    assert [root(int(x)) for x in fps] == [int(fps[c]) for c in comp]


def test_a_pair_of_four_shared_bytes_is_not_tallied():
    a, b = simhash.list_links(np.zeros(2, np.int64), np.array([0, 0x01010101], np.uint64))
    assert len(a) == len(b) == 0


def test_one_of_each_group_stays(clashing):
    kept = simhash.deduplicate(clashing)
    assert kept.columns == clashing.columns
    rows = [tuple(r) for r in clashing.select("doc_id", "text").collect()]
    want = {}
    for (i, t), c in zip(rows, plain_components([plain_fingerprint(t) for _, t in rows]), strict=True):
        want.setdefault(c, []).append((i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(min(v) for v in want.values())


def test_kept_ids_on_documents(documents):
    comp = simhash.simhash_components(documents)
    assert {r.doc_id for r in simhash.deduplicate(documents).collect()} == {r.component_id for r in comp.select("component_id").distinct().collect()}
    assert comp.where(F.col("component_id") > F.col("doc_id")).count() == 0


@pytest.mark.parametrize("bound", [None, (0, 0)])
def test_components_of_a_hub_and_chains(spark, monkeypatch, bound):
    """A node with most edges, chains, cycles and repeats; minima broadcast, and joined by a shuffle."""
    from duskwire.llm import common

    if bound:
        monkeypatch.setattr(common.broadcast_if_small, "__defaults__", bound)
    edges = [(0, k) for k in range(1, 800)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2001, 2000), (5, 5), (-7, 2002)]
    have = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {k: 0 for k in range(800)} | {1000 + k: 1000 for k in range(41)} | {k: -7 for k in (-7, 2000, 2001, 2002)}
    assert have == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_staged_tables_can_be_deleted(spark, documents):
    import os

    from duskwire.llm import common

    rows = common.staged(documents.select("doc_id"), "x")
    (path,) = {f.rsplit("/", 1)[0].removeprefix("file://") for f in rows.inputFiles()}
    assert os.path.isdir(path)
    common._drop(rows)
    assert not os.path.isdir(path) and os.path.isdir(common._own_dir(spark))
