"""Near copies by SimHash and the Jaccard similarity of five-word shingles, for the pipeline.

SimHash proposes, the shingles decide. At the similarity asked for, 64 bits are too few: two
texts differ in ten of them, and no index on bytes reaches that. So a fingerprint has many
words, and posting lists are kept per *two* of its positional bytes, ``LISTS`` disjoint pairs.
Two texts with an angle of t between their sets share a bit with probability p = 1 - t / pi,
so they meet in some list with probability 1 - (1 - p**16)**LISTS: at a similarity of 0.8
p is 0.85, and 7e-5 of such pairs meet in none. Whoever meets in a list is verified by the
differing bits of the ``CHECKS`` words that no list is of: ``NEAR_BITS`` of 128 are more than
four standard deviations from a near pair's 19 and from the 64 of texts that have nothing in
common. Sets of a few shingles can be as similar at p = 13/16 (four and five shingles): those
up to ``SMALL`` have more lists among themselves, ``SMALL_LISTS`` in all, in which more bits
may differ. What a list so links is a *bucket*.

A near copy meets its like in many lists, each time in a somewhat different bucket, and
shingles are forty times the size of a bucket's row. So no shingles are moved for a bucket.
The buckets' documents are first compared by their *wide* fingerprints, all the words that
any two have in common: of 2176 bits a pair at 0.8 differs in 330, or 410 in sets of four
and five shingles, with a deviation of 18, and ``WIDE_BITS`` and ``SMALL_WIDE_BITS`` are
five deviations beyond that. What they link, directly or through others, is a *cluster*: a document is in
one cluster only, and all near copies that share a bucket are in the same one. Only the
documents of clusters have their shingles made once more, and compared.

The comparisons are dealt out so that no group of documents meets in one task. First each
document is compared with one other, its lead; where many share a lead, it is copied to
several tasks. That settles most buckets, and of the clusters those whose documents are near
copies of each other. In the others, the documents outside the largest group so far are
compared with that group and with each other, in tiles of two bounded chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwire.llm.common import broadcast_if_small, connected_components, staged
from duskwire.llm.simhash import _LANES, _popcount, keep_first

SEED, WIDTH = 42, 5
#: Least similarity of near copies, as a fraction.
NUM, DEN = 4, 5
#: Posting lists of a set of shingles, the words of its fingerprint that no list is of, its first, and how many bits of those may differ.
LISTS, CHECKS, NEAR_BITS = 128, 2, 38
#: The same for sets of few shingles: up to how many, their lists in all, and the bits in the lists that only they have.
SMALL, SMALL_LISTS, SMALL_BITS = 7, 448, 48
#: Words of the wide fingerprints, and how many bits of them may differ; the latter if a set of the pair has few shingles.
WIDE, WIDE_BITS, SMALL_WIDE_BITS = CHECKS + LISTS // 4, 440, 500
#: Shingles that are mixed at once, rows in a batch that goes back, and fingerprints of a list that are compared shift by shift.
CHUNK, BATCH, SHORT = 4080, 500, 256
#: Sets that are compared with one copy of a lead, and sets and shingles of a chunk.
FAN, TILE_SETS, TILE_SHINGLES = 1024, 256, 1 << 18
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 2**64, (CHECKS + SMALL_LISTS // 4, 1), np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, (CHECKS + SMALL_LISTS // 4, 1), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct hashes of the runs of five words; of a shorter text, of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(WIDTH, len(words))
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[a:b], SEED) for a, b in zip((ends - sizes)[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles in many words, each by hashes mixed anew: a bit is 1 if set in over half of them."""
    words = CHECKS + (LISTS if len(h) > SMALL else SMALL_LISTS) // 4
    votes = np.zeros((8, words, 8), np.int64)
    for at in range(0, len(h), CHUNK):
        x = _mix(h[at : at + CHUNK] * _MUL[:words] + _ADD[:words])
        cuts = np.arange(0, x.shape[1], 255)
        for bit in range(8):
            lanes = np.add.reduceat((x >> np.uint64(bit)) & _LANES, cuts, axis=1)
            votes[bit] += np.ascontiguousarray(lanes.astype("<u8")).view(np.uint8).reshape(words, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * votes > len(h), axis=0, bitorder="little").reshape(words, 8).view("<u8").reshape(words)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets of shingles have a similarity of at least ``NUM / DEN``."""
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _fp(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rid, doc_id, copy, fp, simhash, size`` of every row; ``fp`` is a hash of the set of shingles, ``rid`` tells rows apart."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                b = batch.slice(at, BATCH)
                sets = [shingles(t) for t in b.column(2).to_pylist()]
                fp = np.fromiter(map(_fp, sets), np.uint64, len(sets))
                words = pa.array([fingerprint(h).tobytes() for h in sets], pa.binary())
                size = np.fromiter(map(len, sets), np.int32, len(sets))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(fp.view(np.int64)), words, pa.array(size)], names=["rid", "doc_id", "copy", "fp", "simhash", "size"])

    narrow = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("copy"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"rid long, doc_id {kind}, copy long, fp long, simhash binary, size int")


def shingle_sets(docs: DataFrame, some: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``fp, shingles`` of the rows of ``docs`` that ``some(doc_id, copy)`` names; one row of each ``fp``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                b = batch.slice(at, BATCH)
                sets = [shingles(t) for t in b.column(1).to_pylist()]
                fp = np.fromiter(map(_fp, sets), np.uint64, len(sets))
                flat = pa.array(np.concatenate(sets).view(np.int64)) if sets else pa.array([], pa.int64())
                held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), held], names=["rid", "fp", "shingles"])

    named = some.toDF("_id", "_copy")
    rows = docs.join(broadcast_if_small(named), docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_copy")), "left_semi")
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    made = staged(rows.mapInArrow(run, "rid long, fp long, shingles array<long>"), "chosen_sets")
    # Rows that are repeated, id and text, come back as often.
    once = staged(made.groupBy("fp").agg(F.min("rid").alias("rid")), "once")
    return made.join(broadcast_if_small(once.select("rid")), "rid", "left_semi").select("fp", "shingles")


def _postings(batches):
    """A row of ``key, fp, x, y`` for each list of ``fp, simhash``; a key is a pair of positions with its two bytes, ``x, y`` are the check words."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            b = batch.slice(at, BATCH)
            raw, fp = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False)
            for size in set(map(len, raw)):
                own = [k for k, r in enumerate(raw) if len(r) == size]
                wide = np.frombuffer(b"".join(raw[k] for k in own), "<u8").reshape(len(own), -1)
                pairs = np.ascontiguousarray(wide[:, CHECKS:]).view("<u2").astype(np.int32)
                n = pairs.shape[1]
                keys = pairs | (np.arange(n, dtype=np.int32) << np.int32(16))
                x, y = (np.repeat(wide[:, k].view(np.int64), n) for k in range(CHECKS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp[own], n)), pa.array(x), pa.array(y)], names=["key", "fp", "x", "y"])


def _near(x: np.ndarray, y: np.ndarray, bits: np.ndarray, i, j) -> np.ndarray:
    return _popcount(x[i] ^ x[j]) + _popcount(y[i] ^ y[j]) <= bits[i]


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that the links ``i, j`` reach from each."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def list_buckets(keys: np.ndarray, fps: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """``key, fp, lead, n`` of the buckets of some posting lists: ``keys`` ascending, ``fps`` distinct within a key.

    A bucket is what differing bits link within a list, two documents or more. Its
    key is a hash of its documents, so that equal buckets of several lists are one.
    All pairs of a list are looked at, save those of a long one that are linked already.
    """
    at, bits = np.arange(len(keys)), np.where(keys >> 16 < LISTS, NEAR_BITS, SMALL_BITS)
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else at
    size = np.diff(np.append(cut, len(keys)))
    end, label = np.repeat(cut + size, size), at.copy()
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rows, shift = at[np.repeat(size <= SHORT, size)], 1
    while len(rows := rows[rows + shift < end[rows]]):
        hit = rows[_near(x, y, bits, rows, rows + shift)]
        left.append(hit)
        right.append(hit + shift)
        shift += 1
    label = _settle(label, np.concatenate(left), np.concatenate(right))
    for s, n in zip(cut[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        others = np.arange(s, s + n)
        while len(others):
            first, others = others[0], others[1:]
            front = [first]
            while front and len(others):
                hit = _near(x, y, bits, front.pop(), others)
                label[others[hit]] = first
                front.extend(others[hit].tolist())
                others = others[~hit]
    order = np.lexsort((fps, label))
    label, fps = label[order], fps[order]
    cut = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(label) else order
    n = np.diff(np.append(cut, len(label)))
    key = np.add.reduceat(_mix(_mix(fps.view(np.uint64) * _MUL[0] + _ADD[0])), cut).view(np.int64) if len(cut) else fps
    several = np.repeat(n > 1, n)
    return np.repeat(key, n)[several], fps[several], np.repeat(fps[cut], n)[several], np.repeat(n, n)[several]


def _buckets(batches):
    """Rows come sorted by key; a list that goes on in the next batch is carried over."""
    kept = [np.empty(0, np.int32), *[np.empty(0, np.int64)] * 3]

    def close(columns):
        k, fp, x, y = columns
        made = list_buckets(k, fp, x.view(np.uint64), y.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=["key", "fp", "lead", "n"])

    for batch in batches:
        now = [np.concatenate([a, batch.column(c).to_numpy(zero_copy_only=False)]) for c, a in enumerate(kept)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        kept = [a[cut:] for a in now]
        if cut:
            yield close([a[:cut] for a in now])
    yield close(kept)


def buckets(sets: DataFrame) -> DataFrame:
    """``key, fp, lead, n``: the documents of each bucket of distinct ``sets(fp, simhash)``, its least ``fp`` and how many they are."""
    rows = sets.select("fp", "simhash").mapInArrow(_postings, "key int, fp long, x long, y long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets, "key long, fp long, lead long, n long").distinct()


def wide_sets(sets: DataFrame) -> DataFrame:
    """``fp, size, wide``: the words of ``sets(fp, size, simhash)`` that fingerprints of all sizes have."""

    def run(batches):
        for b in batches:
            words = np.frombuffer(b"".join(r[: 8 * WIDE] for r in b.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * WIDE), pa.array(words))], names=["fp", "size", "wide"])

    return sets.select("fp", "size", "simhash").mapInArrow(run, "fp long, size int, wide array<long>")


def _with_leads(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``fp, lead, x, y``: ``pairs(fp, lead)`` with the structs ``of`` of ``sets(fp, of)``; a lead of many pairs is copied, once for each ``FAN`` of them."""
    fans = staged(pairs.groupBy("lead").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans")), "fans")
    few = broadcast_if_small(fans)
    own = pairs.join(few, "lead").select("fp", "lead", F.pmod(F.hash("fp"), F.col("fans")).alias("fan")).join(sets.select("fp", F.col("of").alias("x")), "fp")
    other = sets.join(few, sets.fp == few.lead).select("lead", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.col("of").alias("y"))
    return own.join(other, ["lead", "fan"])


def near_leads(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """``a, b``: those of ``pairs(fp, lead)`` whose wide fingerprints are near."""
    bits = F.aggregate(F.zip_with("x.wide", "y.wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    most = F.when(F.least("x.size", "y.size") <= SMALL, SMALL_WIDE_BITS).otherwise(WIDE_BITS)
    return _with_leads(pairs, wide.select("fp", F.struct("size", "wide").alias("of"))).where(bits <= most).select(F.col("fp").alias("a"), F.col("lead").alias("b"))


def lead_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: those of ``pairs(fp, lead)`` that are alike."""
    n, m, both = F.size("x.shingles"), F.size("y.shingles"), F.size(F.array_intersect("x.shingles", "y.shingles"))
    sized = _with_leads(pairs, sets.select("fp", F.struct("shingles").alias("of"))).where((DEN * n >= NUM * m) & (DEN * m >= NUM * n))
    return sized.where((DEN + NUM) * both >= NUM * (n + m)).select(F.col("fp").alias("a"), F.col("lead").alias("b"))


def _lists(column: pa.ChunkedArray) -> tuple[list, list, np.ndarray]:
    """Where each row's list starts and ends, and the values of all, without a copy."""
    flat = column.combine_chunks()
    cuts = flat.offsets.to_numpy()
    return cuts[:-1].tolist(), cuts[1:].tolist(), flat.values.to_numpy().view(np.uint64)


def _tiled(rows: pa.Table) -> pa.Table:
    """``a, b``, components that a pair of one tile links: by wide fingerprints and, where the rows have them, by shingles.

    A tile's rows are ``left`` or ``right`` of it, or both."""
    comps, left = (rows.column(c).to_pylist() for c in ("comp", "left"))
    right, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("right", "size"))
    starts, ends, words = _lists(rows.column("wide"))
    wide, few = words[starts[0] : ends[-1]].reshape(-1, WIDE), size <= SMALL
    sets = [np.sort(v[s:e]) for starts, ends, v in [_lists(rows.column("shingles"))] for s, e in zip(starts, ends, strict=True)] if "shingles" in rows.column_names else None
    parent = {c: c for c in comps}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found = []
    for i in (i for i, at in enumerate(left) if at):
        near = np.bitwise_count(wide[i] ^ wide).sum(axis=1) <= np.where(few | few[i], SMALL_WIDE_BITS, WIDE_BITS)
        for j in np.flatnonzero(near & right).tolist():
            a, b = root(comps[i]), root(comps[j])
            if a != b and (sets is None or alike(sets[i], sets[j])):
                parent[max(a, b)] = min(a, b)
                found.append((comps[i], comps[j]))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _deal(rows: DataFrame) -> DataFrame:
    """``key, kind, i, j, left, right, comp, fp``: tiles of ``rows(key, fp, comp, inside, crowds, rests, among)``.

    Those ``inside`` a key's crowd are cut into ``crowds`` chunks, the others into
    ``rests``. Every chunk of the others meets every chunk of the crowd, which may be
    empty, and where ``among`` is true every chunk of the others.
    """
    inside = F.col("inside")
    chunk = F.pmod(F.hash("fp"), F.when(inside, F.col("crowds")).otherwise(F.col("rests")))
    upto = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - 1))
    tile = lambda kind, i, j, left, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    yes, no = F.lit(True), F.lit(False)
    of_crowd = F.transform(upto("rests"), lambda j: tile(0, F.col("chunk"), j, yes, no))
    with_crowd = F.transform(upto("crowds"), lambda i: tile(0, i, F.col("chunk"), no, yes))
    with_rest = F.transform(upto("rests"), lambda k: tile(1, F.least("chunk", k), F.greatest("chunk", k), F.col("chunk") <= k, F.col("chunk") >= k))
    of_rest = F.concat(F.slice(with_crowd, 1, F.col("crowds")), F.slice(with_rest, 1, F.when(F.col("among"), F.col("rests")).otherwise(0)))
    dealt = rows.withColumn("chunk", chunk).withColumn("tile", F.explode(F.when(inside, of_crowd).otherwise(of_rest)))
    return dealt.select("key", "tile.kind", "tile.i", "tile.j", "tile.left", "tile.right", "comp", "fp")


def _tile_links(dealt: DataFrame, *sets: DataFrame) -> DataFrame:
    for each in sets:
        dealt = dealt.join(each, "fp")
    return dealt.groupBy("key", "kind", "i", "j").applyInArrow(_tiled, "a long, b long")


def _chunks(n, shingles=None):
    return F.greatest(F.lit(1), F.ceil(n / TILE_SETS), *([] if shingles is None else [F.ceil(shingles / TILE_SHINGLES)])).cast("int")


def tile_links(members: DataFrame, wide: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links between components of ``members(key, fp, size, comp)`` that have the same key.

    A key's *crowd* is the component with most of its members, the others are its
    *rest*. Both are cut into chunks of some ``TILE_SETS`` sets and ``TILE_SHINGLES``
    shingles, and no two chunks of the crowd meet.
    """
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    crowd = F.max(F.struct("n", "comp", "w")).alias("crowd")
    keys = counts.groupBy("key").agg(crowd, F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    n, w = F.col("n") - F.col("crowd.n"), F.col("w") - F.col("crowd.w")
    keys = staged(keys.select("key", F.col("crowd.comp").alias("top"), _chunks(F.col("crowd.n"), F.col("crowd.w")).alias("crowds"), _chunks(n, w).alias("rests")), "open_keys")
    rows = members.join(broadcast_if_small(keys), "key").withColumn("inside", F.col("comp") == F.col("top")).withColumn("among", F.lit(True))
    return _tile_links(_deal(rows), wide, sets)


def near_links(labels: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b`` twice: what near wide fingerprints link of the labels of ``labels(fp, label, n, fan, keys)`` that share a bucket.

    A bucket's *top* is the largest label in it. The other labels' documents are compared
    with all those of the top, once for all the buckets that they share; and
    with each other, bucket by bucket. ``n`` is a label's number of documents, ``fan`` one of its parts.
    """
    gathered = labels.groupBy("label", "n", "fan").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    places = staged(gathered.select("label", "n", "fan", F.explode("keys").alias("key")), "places")
    tops = places.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    tops = staged(tops.where("lo <> hi").select("key", F.col("top.label").alias("top")), "tops")
    rest = staged(places.join(broadcast_if_small(tops), "key").where("label <> top").select("key", "label", "fan", "top"), "rest")

    met = broadcast_if_small(staged(rest.select("label", "top").distinct(), "met"))
    own = labels.select("fp", "label", "n")
    outside = staged(own.join(met, "label").select(F.col("top").alias("key"), "fp", F.col("label").alias("comp"), F.lit(False).alias("inside")), "outside")
    rests = staged(outside.groupBy("key").agg(_chunks(F.count("*")).alias("rests")), "rests")
    inside = own.join(broadcast_if_small(rests), own.label == rests.key, "left_semi").select(F.col("label").alias("key"), "fp", F.col("label").alias("comp"), F.lit(True).alias("inside"))
    crowds = own.select(F.col("label").alias("key"), _chunks(F.col("n")).alias("crowds")).distinct()
    known = staged(rests.join(broadcast_if_small(crowds), "key").withColumn("among", F.lit(False)), "known")
    by_top = _tile_links(_deal(outside.unionByName(inside).join(broadcast_if_small(known), "key")), wide)

    several = staged(rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "several")
    wanted = staged(rest.join(broadcast_if_small(several), "key", "left_semi").groupBy("label", "fan").agg(F.collect_list("key").alias("wanted")), "wanted")
    listed = labels.join(broadcast_if_small(wanted), ["label", "fan"]).select("fp", F.col("label").alias("comp"), F.explode(F.array_intersect("keys", "wanted")).alias("key"))
    listed = staged(listed, "listed")
    counts = staged(listed.groupBy("key").agg(_chunks(F.count("*")).alias("rests")), "counts")
    rows = listed.join(broadcast_if_small(counts), "key").select("*", F.lit(False).alias("inside"), F.lit(0).alias("crowds"), F.lit(True).alias("among"))
    return by_top, _tile_links(_deal(rows), wide)


def clusters(own: DataFrame, wide: DataFrame) -> DataFrame:
    """``fp, cluster``: what near wide fingerprints link, in the buckets ``own(fp, lead, keys)``, for the documents of clusters of two or more."""
    pairs = own.where("lead is not null").select("fp", "lead")
    first = staged(connected_components(near_leads(pairs, wide)), "led")
    named = staged(own.join(broadcast_if_small(first), own.fp == first.node, "left").select("fp", F.coalesce("component", "fp").alias("label"), "keys"), "named")
    counts = staged(named.groupBy("label").agg(F.count("*").alias("n")), "label_counts")
    fan = F.pmod(F.hash("fp"), F.ceil(F.col("n") / FAN).cast("int"))
    labels = staged(named.join(broadcast_if_small(counts), "label").select("fp", "label", "n", fan.alias("fan"), "keys"), "labels")
    by_top, listed = near_links(labels, wide)
    links = staged(by_top, "top_links").union(staged(listed, "listed_links"))
    then = staged(connected_components(links).toDF("label", "cluster"), "label_components")
    all_ = staged(labels.select("fp", "label").join(broadcast_if_small(then), "label", "left").select("fp", F.coalesce("cluster", "label").alias("cluster")), "in_clusters")
    several = staged(all_.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster"), "cluster_counts")
    return all_.join(broadcast_if_small(several), "cluster", "left_semi").select("fp", "cluster")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, as ``simhash.keep_first`` picks it.

    Texts link at a similarity of 0.8 or more; groups are what is reachable. Equal sets, those of
    blank texts too, are collapsed before the search, and every pair that shares a bucket is compared
    or already joined by others. All columns stay; an empty table gives no rows.
    """
    rows = staged(sketches(docs, id_col, text_col), "sketches")
    groups = staged(rows.groupBy("fp").agg(F.min("rid").alias("rid")), "sets")
    apart = rows.where("size > 0").join(broadcast_if_small(groups.select("rid")), "rid", "left_semi")
    members = staged(buckets(apart), "members")
    # The lead that a document meets most often.
    lead = F.mode(F.when(F.col("fp") != F.col("lead"), F.col("lead"))).alias("lead")
    own = staged(members.groupBy("fp").agg(lead, F.collect_list("key").alias("keys")), "own")
    wide = staged(wide_sets(apart.join(broadcast_if_small(own.select("fp")), "fp", "left_semi")), "wide")
    near = staged(clusters(own, wide), "clusters")
    some = broadcast_if_small(staged(groups.join(broadcast_if_small(near.select("fp")), "fp", "left_semi").select("rid"), "chosen"))
    sets = shingle_sets(docs, staged(rows.join(some, "rid", "left_semi").select("doc_id", "copy"), "chosen_rows"), id_col, text_col)
    leads = broadcast_if_small(staged(near.groupBy("cluster").agg(F.min("fp").alias("lead")), "leads"))
    pairs = staged(near.join(leads, "cluster").where("fp <> lead").select("fp", "lead"), "pairs")
    first = staged(connected_components(lead_links(pairs, sets)), "first_components")
    of = broadcast_if_small(first)
    comp = F.coalesce("component", "fp")
    sized = near.join(broadcast_if_small(wide.select("fp", "size")), "fp")
    open_ = staged(sized.join(of, sized.fp == of.node, "left").select(F.col("cluster").alias("key"), "fp", "size", comp.alias("comp")), "open_members")
    then = staged(connected_components(tile_links(open_, wide, sets)).toDF("comp", "root"), "components")
    named = groups.join(of, groups.fp == of.node, "left").select("fp", comp.alias("comp"))
    roots = named.join(broadcast_if_small(then), "comp", "left").select("fp", F.coalesce("root", "comp").alias("root"))
    return keep_first(docs, rows.select("doc_id", "fp", "copy"), staged(roots, "roots"), id_col, text_col)
