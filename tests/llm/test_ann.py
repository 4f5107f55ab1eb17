from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwire.llm import ann


def usable(rows):
    out = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        out.append((i, np.array(v, np.float64)))
    return out


def exact(rows, k, mod):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % mod == 0 and i not in out:
            s = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(have, want, k=20):
    assert have.keys() == want.keys() and all(len(v) == k for v in have.values())
    for q, w in want.items():
        truth = dict(w)
        assert all(s == truth[i] for i, s in have[q] if i in truth)
        assert have[q] == sorted(have[q], key=lambda x: (-x[1], x[0]))
    return sum(len({i for i, _ in have[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = exact(usable([tuple(r) for r in df.select("vec_id", "embedding").collect()]), 20, 20)
    assert recall(found(ann.search(df)), want) >= 0.9


def made(kind, n=20_000, dim=64, seed=5):
    """Vectors without any structure, or in 200 clusters."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    return x if kind == "loose" else rng.normal(size=(200, dim))[rng.integers(0, 200, n)] + 0.3 * x


@pytest.mark.parametrize(("kind", "most"), [("loose", 0.5), ("clustered", 0.05)])
def test_recall_and_visited_share(spark, monkeypatch, kind, most):
    x = made(kind)
    walks = []
    measured = ann.measured_walk

    def noted(index, *rest):
        walks.append(measured(index, *rest) / index.rows)
        return int(walks[-1] * index.rows)

    monkeypatch.setattr(ann, "measured_walk", noted)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    have = found(ann.search(df))
    want = exact(list(enumerate(x)), 20, 20)
    assert recall(have, want) >= 0.9 and walks[0] <= most


def test_finer_cells_on_larger_tables():
    assert [ann.centroids_for(n) for n in (1, 500, 2_000, 10_000, 50_000, 10**6, 10**10)] == [16, 16, 32, 128, 256, 512, 512]


def test_groups_and_copies_change_nothing(spark, monkeypatch):
    """Cells over several groups, and groups copied for many queries, give what one group gives."""
    x = np.repeat(made("clustered", 900, 8), 3, axis=0)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    whole = found(ann.search(df, recall=1.0))
    monkeypatch.setattr(ann, "GROUP_ROWS", 7)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 5)
    assert found(ann.search(df, recall=1.0)) == whole == exact(list(enumerate(x)), 20, 20)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(100)]
    rows += [(100, None), (120, [0.0] * 6), (140, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (160, [float("nan")] * 6), (180, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (101, rows[3][1]), (102, rows[3][1]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("g", F.lit("x")).withColumn("v", F.lit(0))
    have = found(ann.search(df, recall=1.0))
    assert have == exact(usable(rows), 20, 20)


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert {q: [i for i, _ in v] for q, v in found(ann.search(df)).items()} == {0: [1, 20], 20: [0, 1]}
    assert ann.search(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_come_in_order_and_once(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=9), rng.normal(size=7)
    cells = ann.traverse(a, b, np.ones(63, np.int64), 63)
    near = [a[c // 7] + b[c % 7] for c in cells]
    runs = ann.traverse(a, b, np.arange(63) % 3, 10**6, run=4)
    assert sorted(runs.tolist()) == [c for c in range(63) if c % 3]
    assert sorted(cells.tolist()) == list(range(63)) and all(x >= y - 1e-12 for x, y in zip(near, near[1:], strict=False))
