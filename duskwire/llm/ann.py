"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, and a vector is filed under its
pair of centroids, a *cell*. A query walks the cells by summed nearness with a heap and
scores exactly what is filed there. How much of the table the walk visits is measured
and not set: a sample of the queries is searched exactly over all rows, and the walk is
as long as those need for the recall asked for. Clustered vectors need a hundredth of
the table, vectors without any structure a third, less as the cells become finer.
"""

from __future__ import annotations

import heapq
from math import ceil, floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwire.llm.common import staged

#: Vectors that the centroids are fitted on, at most; the index holds every vector.
FIT_ROWS = 20_000
#: Queries that the length of the walk is measured on, at most, and the share of their nearest that it reaches.
MEASURED, RECALL = 128, 0.95
#: Centroids of a half: the square root of the rows, as a power of two within these, so cells grow finer with the table.
LEAST_CENTROIDS, MOST_CENTROIDS = 16, 512
#: Neighbours in a half's order of nearness that the heap takes as one step.
RUN = 4
#: Vectors of a group of cells, and queries that meet one copy of a group.
GROUP_ROWS, GROUP_QUERIES = 4_096, 65_536
#: Queries that are scored together.
BATCH = 256


def centroids_for(rows: int) -> int:
    return min(MOST_CENTROIDS, max(LEAST_CENTROIDS, 1 << floor(log2(max(rows, 1)) / 2 + 0.5)))


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        for j in range(len(c)):
            own = near == j
            if own.any():
                c[j] = x[own].mean(axis=0)
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)


def traverse(s1: np.ndarray, s2: np.ndarray, sizes: np.ndarray, enough: int, run: int = 1) -> np.ndarray:
    """Cells with rows in order of summed nearness of their two centroids, best first,
    until they hold ``enough`` rows; ``run`` centroids next to each other in a half's
    order are one step. A heap holds the frontier of the grid that the two sorted lists
    span; a pair enters it once both pairs before it have left."""
    o1, o2 = np.argsort(-s1, kind="stable"), np.argsort(-s2, kind="stable")
    a, b = s1[o1[::run]].tolist(), s2[o2[::run]].tolist()
    grid = sizes.reshape(len(s1), len(s2))[o1][:, o2]
    held = np.add.reduceat(np.add.reduceat(grid, np.arange(0, len(o1), run), axis=0), np.arange(0, len(o2), run), axis=1).tolist()
    done = [0] * len(a)  # how many pairs of each row have left; rows are left to right
    heap, steps, total = [(-(a[0] + b[0]), 0, 0)], [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        if held[i][j]:
            steps.append((i, j))
            total += held[i][j]
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
    if not steps:
        return np.empty(0, np.int64)
    at = np.array(steps)
    near = np.arange(run)
    i = np.minimum((at[:, 0] * run)[:, None, None] + near[None, :, None], len(o1))
    j = np.minimum((at[:, 1] * run)[:, None, None] + near[None, None, :], len(o2))
    i, j = (x.reshape(-1) for x in np.broadcast_arrays(i, j))
    inside = (i < len(o1)) & (j < len(o2))
    cells = o1[i[inside]] * len(s2) + o2[j[inside]]
    return cells[sizes[cells] > 0]


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Vectors null, zero or holding null or non-finite components take no part, nor do rows without an id."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int):
    """The k best of the rows that ``rough`` leaves finite, by exact products summed in one order, ties to smaller ids."""
    at = np.flatnonzero(np.isfinite(rough))
    if len(at) > k:
        edge = np.partition(rough[at], len(at) - k)[len(at) - k]
        at = at[rough[at] >= edge - 1e-9 * max(1.0, abs(edge))]
    score = (x[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


FOUND = "query_id long, vec_id long, score double"


def _found(made: list) -> pa.RecordBatch:
    """A batch of ``FOUND`` columns from (query id, ids, scores)."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array([q for q, _, _ in made], np.int64), [len(i) for _, i, _ in made])),
            pa.array(np.concatenate([np.empty(0, np.int64), *[i for _, i, _ in made]])),
            pa.array(np.concatenate([np.empty(0), *[s for _, _, s in made]])),
        ],
        names=["query_id", "vec_id", "score"],
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Centroids of both halves and, once all rows are filed, the rows of each cell."""

    def __init__(self, fit: np.ndarray, rows: int):
        self.dim, self.h, self.rows = fit.shape[1], fit.shape[1] // 2, rows
        k = centroids_for(rows)
        self.c1, self.c2 = kmeans(fit[:, : self.h], k), kmeans(fit[:, self.h :], k)
        self.sizes = np.zeros(len(self.c1) * len(self.c2), np.int64)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest_centroid(x[:, : self.h], self.c1) * len(self.c2) + nearest_centroid(x[:, self.h :], self.c2)

    def walk(self, q: np.ndarray, enough: int) -> np.ndarray:
        return traverse(self.c1 @ q[: self.h], self.c2 @ q[self.h :], self.sizes, enough, RUN)

    def reach(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many rows a walk has visited when it has each of ``cells``."""
        order = self.walk(q, self.rows)
        upto = np.zeros(len(self.sizes), np.int64)
        upto[order] = np.cumsum(self.sizes[order])
        return upto[cells]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells packed into groups of about ``GROUP_ROWS`` rows: each cell's first group, and how many a larger cell is dealt over."""
        first, parts, fill, group = np.zeros(len(self.sizes), np.int32), np.maximum(1, -(-self.sizes // GROUP_ROWS)).astype(np.int32), 0, 0
        for c in np.flatnonzero(self.sizes).tolist():
            if fill and fill + self.sizes[c] > GROUP_ROWS:
                group, fill = group + 1, 0
            first[c] = group
            fill += self.sizes[c]
            if parts[c] > 1:
                group, fill = group + int(parts[c]), 0
        return first, parts


def measured_walk(index: Index, filed: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """Rows that a walk has to visit for ``recall``: up to ``MEASURED`` queries are searched exactly over all of
    ``filed(vec_id, v, cell)``, in one pass, and the walk is as long as that share of their nearest needs."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).collect()
    if not asked:
        return index.rows
    qids, qs = np.array([r.vec_id for r in asked]), np.array([r.v for r in asked])
    dim = index.dim

    def exact(batches):
        for b in batches:
            ids, x, cell = b.column(0).to_numpy(), _matrix(b.column(1), dim), b.column(2).to_numpy()
            made = []
            for s in range(0, len(ids), GROUP_ROWS):
                rough = qs @ x[s : s + GROUP_ROWS].T
                rough[qids[:, None] == ids[None, s : s + GROUP_ROWS]] = -np.inf
                for r, qid in enumerate(qids):
                    at = np.flatnonzero(np.isfinite(rough[r]))
                    if len(at) > k:
                        at = at[np.argpartition(-rough[r][at], k - 1)[:k]]
                    made.append((qid, cell[s + at].astype(np.int64), rough[r][at]))
            yield _found(made)

    near = _top(filed.mapInArrow(exact, FOUND), k).collect()  # the second column holds cells here
    by: dict[int, list[int]] = {}
    for r in near:
        by.setdefault(r.query_id, []).append(r.vec_id)
    need = np.concatenate([index.reach(q, np.array(by[i])) for i, q in zip(qids.tolist(), qs, strict=True) if i in by] or [np.array([index.rows])])
    return int(np.quantile(need, recall, method="higher"))


def search(df: DataFrame, k: int = 20, query_mod: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The ``k`` rows of largest inner product found for every row whose id is divisible by ``query_mod``.

    Centroids are fitted on at most ``FIT_ROWS`` vectors and every vector is filed. The
    walk's length is measured (``measured_walk``) for ``recall``; what it visits is
    scored exactly, in double precision. Cell sizes (at most ``MOST_CENTROIDS`` squared),
    centroids and the measured queries are all that reaches the driver. Cells are packed
    into groups of about ``GROUP_ROWS`` vectors, a larger cell is dealt over several,
    and every row of the index goes to its group once. Queries are sent to the groups
    that hold their cells and stream past the group, in batches, so that a task holds
    one group whatever the number of queries; only a group that more than
    ``GROUP_QUERIES`` queries visit is copied, once for each so many.

    Vectors null, zero or holding null or non-finite components take no part, nor do
    those whose length differs from the most common one; repeated ids count as
    candidates each, and as one query (the smallest vector); rows with a query's own
    id are no candidates for it. A query with ``k`` candidates or fewer gets all.
    Other columns are ignored; an empty table gives no rows.

    Returns ``query_id, rank, vec_id, score``.
    """
    spark = df.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = _usable(df, id_col, vec_col)
    wide = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")).orderBy(F.desc("n"), "d").first()
    if wide is None:
        return spark.createDataFrame([], out)
    dim, total = wide["d"], wide["n"]
    rows = rows.where(F.size("v") == dim)
    fit = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(FIT_ROWS).collect()])
    index = Index(fit, total)

    def file(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index.cell(_matrix(b.column(1), dim)).astype(np.int32))], names=["vec_id", "v", "cell"])

    filed = staged(rows.mapInArrow(file, "vec_id long, v array<double>, cell int"), "filed")
    for r in filed.groupBy("cell").count().collect():
        index.sizes[r["cell"]] = r["count"]
    queries = filed.where(F.pmod("vec_id", F.lit(query_mod)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    # Rows with a query's own id are visited but are no candidates, so repeats lengthen the walk.
    enough = min(total, max(measured_walk(index, filed, queries, k, recall), k + 1 + total - wide["ids"]))
    first, parts = index.groups()

    def walk(batches):
        for b in batches:
            made: dict[str, list] = {"g": [], "id": [], "v": [], "cells": []}
            for qid, q in zip(b.column(0).to_pylist(), _matrix(b.column(1), dim), strict=True):
                cells = index.walk(q, enough)
                n = parts[cells]
                g = np.repeat(first[cells], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = np.repeat(cells, n)
                order = np.argsort(g, kind="stable")
                cuts = np.flatnonzero(np.diff(g[order], prepend=-1))
                for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(g)], strict=True):
                    made["g"].append(int(g[order[s]]))
                    made["id"].append(qid)
                    made["v"].append(q)
                    made["cells"].append(np.unique(own[order[s:e]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(made["g"], pa.int32()), pa.array(made["id"], pa.int64()), pa.array(made["v"], pa.list_(pa.float64())), pa.array(made["cells"], pa.list_(pa.int32()))], names=list(made))

    def deal(batches):
        for b in batches:
            cell, ids = b.column(2).to_numpy(), b.column(0).to_numpy()
            g = first[cell] + (ids * 2654435761 >> 16) % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), *b.columns], names=["g", "id", "v", "cell"])

    # Walking takes time and not room: small blocks of queries, dealt over the cores.
    dealt_queries = queries.repartition(max(8, ceil(total / query_mod / 256)), "vec_id")
    probes = staged(dealt_queries.mapInArrow(walk, "g int, id long, v array<double>, cells array<int>"), "probes")
    copies = probes.groupBy("g").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("copies")).where("copies > 1").collect()
    many = {r.g: r.copies for r in copies}
    n_copies = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("g")), F.lit(1)) if many else F.lit(1)
    left = filed.mapInArrow(deal, "g int, id long, v array<double>, cell int").select("g", F.explode(F.sequence(F.lit(0), n_copies - 1)).alias("copy"), F.lit(False).alias("asks"), "id", "v", F.array("cell").alias("cells"))
    right = probes.select("g", F.pmod(F.hash("id"), n_copies).alias("copy"), F.lit(True).alias("asks"), "id", "v", "cells")
    met = left.unionByName(right).repartition("g", "copy").sortWithinPartitions("g", "copy", "asks", "id")

    def meet(batches):
        """Rows come by group, its vectors first; queries stream past them."""
        group, held, x, ids, cells, own = None, [], None, None, None, None
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for s, e in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                part, asks = b.slice(s, e - s), keys[s][2]
                if keys[s][:2] != group:
                    group, held, x = keys[s][:2], [], None
                if not asks:
                    held.append(part)
                    continue
                if not held:
                    continue
                if x is None:
                    x = np.vstack([_matrix(p.column(4), dim) for p in held])
                    ids = np.concatenate([p.column(3).to_numpy() for p in held])
                    cells, own = np.unique(np.concatenate([p.column(5).flatten().to_numpy() for p in held]), return_inverse=True)
                for at in range(0, part.num_rows, BATCH):
                    some = part.slice(at, BATCH)
                    q, qids = _matrix(some.column(4), dim), some.column(3).to_numpy()
                    visited = np.zeros((len(qids), len(cells)), bool)
                    lists = some.column(5)
                    asked_by, asked = np.repeat(np.arange(len(qids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
                    place = np.minimum(np.searchsorted(cells, asked), len(cells) - 1)
                    here = cells[place] == asked  # a cell dealt over groups may have no row in this one
                    visited[asked_by[here], place[here]] = True
                    rough = np.where(visited[:, own] & (qids[:, None] != ids[None, :]), q @ x.T, -np.inf)
                    yield _found([(qid, *_best(q[r], x, ids, rough[r], k)) for r, qid in enumerate(qids)])

    return _top(met.mapInArrow(meet, FOUND), k).select("query_id", "rank", "vec_id", "score")
