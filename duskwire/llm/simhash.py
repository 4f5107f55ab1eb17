"""Near-duplicate documents by 64-bit SimHash fingerprints.

Candidate search is a byte-position inverted index with count filtering. Two
fingerprints that differ in at most three bits differ in at most three of their
eight bytes, so they share at least five positional bytes. A posting list is kept
per *four* positional bytes. The fourteen position sets ``{a, b, c, d}`` with
``a ^ b ^ c ^ d == 0`` (the planes of the three-dimensional space over GF(2)) are
such that every five positions hold one of the sets entirely, so a pair sharing
five bytes meets in some list, and 32-bit keys keep chance meetings rare however
many documents there are. Within a list the remaining four positions are indexed once
more: a run of fingerprints with one of those bytes in common adds one to the tally of
each of its pairs, and a pair of no run has the four bytes of the list alone and goes
unseen. The pairs that reach five are verified by their differing bits. Long lists and
short ones go the same way.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwire.llm.common import broadcast_if_small, connected_components, staged

SEED = 42
#: Position sets of the index.
KEYS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
MIN_SHARED = 5
#: Positions that each set leaves free.
FREE = np.array([[p for p in range(8) if p not in c] for c in KEYS])
#: Pairs of a run that are tallied and verified at once.
BLOCK_PAIRS = 2_000_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of one text as an unsigned integer; a null or blank text gives zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(width, len(words))
    n = len(words) - k + 1
    starts = (ends - sizes)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    return _majority(h)


_LANES = np.uint64(0x0101010101010101)


def _majority(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of ``h``. Eight bits are counted at once, in the byte lanes of a word."""
    n, out = len(h), 0
    cuts = np.arange(0, n, 255)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, cuts)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp, copy``: the fingerprint of every row's whole text, as a signed long, and a hash of the text.

    Rows are kept one for one, repeated ids and null ids included. A null text
    counts as empty; a text without words has fingerprint zero.
    """

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], names=["doc_id", "fp", "copy"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("copy"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long, copy long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each xor are zero: the tally of shared positional bytes."""
    x = x | (x >> np.uint64(4))
    x = x | (x >> np.uint64(2))
    x = x | (x >> np.uint64(1))
    return 8 - _popcount(x & _LANES)


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = _root(parent, i), _root(parent, j)
        if i != j:
            parent[max(i, j)] = min(i, j)


def _byte(f: np.ndarray, position) -> np.ndarray:
    return (f >> (np.uint64(8) * (np.uint64(7) - np.asarray(position, np.uint64)))) & np.uint64(255)


def _near(x: np.ndarray, bits: int) -> np.ndarray:
    """Of xors: whether the tally reaches the minimum, and the differing bits verify it."""
    return (_shared_bytes(x) >= MIN_SHARED) & (_popcount(x) <= bits)


def _run_links(run: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one run of distinct, ascending fingerprints.

    Joining each fingerprint to the smallest of its tree keeps every connection of the
    run with fewer rows than it has fingerprints, so a run of n near copies gives under
    n links and not n squared. Pairs are tallied in blocks of bounded size.
    """
    n = len(run)
    parent = np.arange(n)
    step = max(1, BLOCK_PAIRS // n)
    for s in range(0, n, step):
        i, j = np.nonzero(_near(run[s : s + step, None] ^ run[None, :], bits))
        up = (i + s) < j
        _union(parent, i[up] + s, j[up])
    roots = np.array([_root(parent, i) for i in range(n)])
    child = np.flatnonzero(roots != np.arange(n))
    return run[child], run[roots[child]]


def list_links(keys: np.ndarray, fps: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links inside posting lists: ``keys`` ascending, ``fps`` distinct within a key.

    For each of the four positions that a list's set leaves free, its fingerprints are
    sorted by that byte into runs, and only pairs of a run are looked at.
    """
    out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    several = np.repeat(np.diff(np.append(start, len(keys))) > 1, np.diff(np.append(start, len(keys))))
    keys, fps = keys[several], fps[several]
    if not len(keys):
        return out_a[0], out_b[0]
    nth = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    free = FREE[(keys.view(np.int64) >> 32)]
    for position in range(4):
        byte = _byte(fps, free[:, position])
        order = np.lexsort((fps, byte, nth))
        run = (nth[order] << 8) | byte[order].astype(np.int64)
        f = fps[order]
        cut = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.append(cut, len(run)))
        two = cut[size == 2]
        two = two[_near(f[two] ^ f[two + 1], bits)]
        out_a.append(f[two + 1])
        out_b.append(f[two])
        for s, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            a, b = _run_links(f[s : s + n], bits)
            out_a.append(a)
            out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def _posting_rows(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        byte = [(fp >> np.uint64(8 * (7 - p))) & np.uint64(255) for p in range(8)]
        keys = []
        for k, (p, q, r, s) in enumerate(KEYS):
            keys.append(np.uint64(k) << np.uint64(32) | byte[p] << np.uint64(24) | byte[q] << np.uint64(16) | byte[r] << np.uint64(8) | byte[s])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, len(KEYS)).view(np.int64))], names=["key", "fp"])


def _scan_postings(bits: int):
    def run(batches):
        """Rows come sorted by key; a list that goes on in the next batch is carried over."""
        keep_k, keep_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def close(k, f):
            a, b = list_links(k, f, bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            k = np.concatenate([keep_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([keep_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            keep_k, keep_f = k[cut:], f[cut:]
            if cut:
                yield close(k[:cut], f[:cut])
        yield close(keep_k, keep_f)

    return run


def fingerprint_links(distinct_fp: DataFrame, bits: int = 3) -> DataFrame:
    """``a, b``: links that join the same fingerprints as all pairs at ``bits`` or fewer differing bits do.

    ``distinct_fp`` has one long column of distinct fingerprints. A posting list is
    worked on as it streams by in key order; its length is that of the *distinct*
    fingerprints sharing four bytes, never of the documents.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees up to three differing bits")
    rows = distinct_fp.mapInArrow(_posting_rows, "key long, fp long")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_scan_postings(bits), "a long, b long")


def _rooted(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and ``fp, first_id, root`` of the distinct ones."""
    fps = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = connected_components(fingerprint_links(groups.select("fp"), bits))
    members = groups.join(comp, groups.fp == comp.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    # Written down, so that joins on ``fp`` deal rows out for themselves and may split a fingerprint that many share.
    return fps, staged(members, "members")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``bits`` bits;
    ``component_id`` is the smallest ``doc_id`` reachable, itself included. Copies
    share a fingerprint, are collapsed to it before the search, and are never
    paired. Null texts count as empty, and texts without words (fingerprint zero)
    link like any other; rows with a null id take the component of their
    fingerprint's smallest id, null if it has none; repeated rows come back
    repeated; an empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    fps, members = _rooted(docs, id_col, text_col, width, bits)
    # Written down, so that neither join below is dealt by an aggregate, whose partitions can't be split.
    best = staged(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "best")
    named = members.join(broadcast_if_small(best), "root").select("fp", "component_id")
    return fps.join(broadcast_if_small(staged(named, "named")), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last, then of the smallest text hash.

    Exact repeats of that row go too. All columns stay as they are.
    """
    fps, members = _rooted(docs, id_col, text_col, width, bits)
    return keep_first(docs, fps, members, id_col, text_col)


def keep_first(docs: DataFrame, fps: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of each root that ``deduplicate`` keeps, by ``doc_id, fp, copy`` of all rows and ``fp, root``."""
    rows = fps.join(broadcast_if_small(members.select("fp", "root")), "fp").select("root", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "copy").alias("key"))
    counted = staged(rows.groupBy("root", "key").agg(F.count("*").alias("n")), "keys")
    # Written down, so that the join below deals its sides out for itself and may split a root that many rows share.
    first = staged(counted.groupBy("root").agg(F.min("key").alias("first")), "firsts")
    both = staged(counted.join(broadcast_if_small(first), "root"), "both")
    gone = both.where(F.col("key") != F.col("first")).select("key.doc_id", "key.copy")
    again = both.where((F.col("key") == F.col("first")) & (F.col("n") > 1)).select("key.doc_id", "key.copy")

    def same(rows, d):
        return rows[id_col].eqNullSafe(d._id) & F.xxhash64(rows[text_col]).eqNullSafe(d._copy)

    gone, again = (d.toDF("_id", "_copy") for d in (gone, again))
    left = docs.join(broadcast_if_small(gone), same(docs, gone), "left_anti")
    if again.limit(1).count():
        again = staged(again, "repeats")
        rows = docs.join(broadcast_if_small(again), same(docs, again), "left_semi")
        once = rows.groupBy(id_col, F.xxhash64(text_col).alias("_copy")).agg(*[F.first(c).alias(c) for c in docs.columns if c != id_col])
        left = left.join(broadcast_if_small(again), same(left, again), "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
    return left.select(*docs.columns)
