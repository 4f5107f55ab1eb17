from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from duskwire.llm import similar


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """The least id of each group, by comparing all pairs that share a shingle."""
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {()}:
            at[x].append(i)
    for i, j in {p for v in at.values() for p in combinations(v, 2)}:
        if root(i) != root(j) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append((d is None, d or 0))
    return sorted(min(g) for g in groups.values())


def planted():
    """Texts of 40 to 400 words and copies with one to eight words changed."""
    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for _ in range(150):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(40, 400)))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(2):
            other = list(words)
            for at in rng.choice(len(words), int(rng.integers(1, 9)), replace=False):
                other[at] = f"x{rng.integers(0, 10**6)}"
            pairs.append((rows[-1], (len(rows), " ".join(other))))
            rows.append(pairs[-1][1])
    return rows, pairs


def test_the_stage_drops_planted_near_copies(spark):
    rows, pairs = planted()
    near = sum(0.8 <= jaccard(plain_shingles(a), plain_shingles(b)) < 0.95 for (_, a), (_, b) in pairs)
    assert near > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((False, r.doc_id) for r in corpus_pipeline.keep_one(spark, docs, "").collect()) == expected(rows)


def test_on_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted((False, r.doc_id) for r in similar.deduplicate(documents).collect()) == expected(rows)


def test_odd_tables(clashing, empty):
    rows = [tuple(r) for r in clashing.select("doc_id", "text").collect()]
    kept = similar.deduplicate(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == expected(rows)
    assert similar.deduplicate(empty).collect() == []


def test_tiles_and_fans_lose_no_link(spark, monkeypatch):
    """Near copies, and texts that share keys without being near copies, under chunks of three sets and leads of two pairs."""
    monkeypatch.setattr(similar, "TILE_SETS", 3)
    monkeypatch.setattr(similar, "FAN", 2)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        for share in (0.02, 0.02, 0.02, 0.05, 0.05, 0.08, 0.08, 0.1):
            other = list(words)
            at = int(rng.integers(0, 150))
            for k in range(int(share * 150)):
                other[(at + k) % 150] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((False, r.doc_id) for r in similar.deduplicate(docs).collect()) == expected(rows)


def test_a_hub_is_dealt_over_tasks(spark):
    """Many copies with one change each: the lead they share is copied, and no tile holds more than its chunks."""
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*words[: k % 200], f"x{k}", *words[k % 200 + 1 :]])) for k in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in similar.deduplicate(docs).collect()] == [0]


def plain_simhash(h):
    """Bit by bit, with Python's integers."""
    out = []
    for mul, add in zip(similar._MUL[:, 0].tolist(), similar._ADD[:, 0].tolist(), strict=True):
        mixed = []
        for v in h.tolist():
            v = (v * mul + add) % 2**64
            v = (v ^ (v >> 32)) * 0xD6E8FEB86659FD93 % 2**64
            mixed.append(v ^ (v >> 32))
        out.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in mixed) > len(mixed)))
    return out


@pytest.mark.parametrize("n", [1, 4, 7, 8, 255, 256, 5000])
def test_fingerprints_bit_by_bit(n):
    h = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
    have = similar.fingerprint(h).tolist()
    assert len(have) == similar.CHECKS + (112 if n <= 7 else 32) and have == plain_simhash(h)[: len(have)]


def plain_buckets(rows):
    """Sets of what the check words link within a list, by all pairs."""
    at, out = defaultdict(list), set()
    for fp, wide in rows:
        raw = wide[similar.CHECKS :].tobytes()
        for k in range(0, len(raw), 2):
            at[k, raw[k : k + 2]].append((fp, wide[: similar.CHECKS].tolist()))
    for (k, _), docs in at.items():
        bits = similar.NEAR_BITS if k < 2 * similar.LISTS else similar.SMALL_BITS
        label = list(range(len(docs)))
        for i, j in combinations(range(len(docs)), 2):
            if sum((a ^ b).bit_count() for a, b in zip(docs[i][1], docs[j][1], strict=True)) <= bits:
                label = [label[i] if x == label[j] else x for x in label]
        out |= {s for s in (frozenset(d[0] for d, x in zip(docs, label, strict=True) if x == one) for one in label) if len(s) > 1}
    return out


@pytest.mark.parametrize("short", [2, 256])
def test_the_stage_searches_by_simhash(spark, monkeypatch, short):
    """The buckets that the pipeline compares are those of the fingerprints' byte lists, in long lists and short ones."""
    seen = []
    whole = similar.buckets
    monkeypatch.setattr(similar, "buckets", lambda sets: seen.append(sets) or whole(sets))
    rows, _ = planted()
    docs = spark.createDataFrame([*rows, (900, None), (901, "few words"), (902, "few  words"), (903, "a b c d e f g h"), (904, "a b c d e f g h i")], "doc_id long, text string")
    assert len(corpus_pipeline.keep_one(spark, docs, "").collect()) < len(rows)
    sets = [(r.fp, np.frombuffer(r.simhash, np.uint64)) for r in seen[0].collect()]
    assert len(sets) == len({fp for fp, _ in sets}) == len({frozenset(plain_shingles(t)) for _, t in rows}) + 3
    want = plain_buckets(sets)
    assert len(want) > 100
    columns = zip(*sorted((r.key, r.fp, r.x, r.y) for r in pa.Table.from_batches(similar._postings([pa.RecordBatch.from_pylist([{"fp": fp, "simhash": w.tobytes()} for fp, w in sets])])).to_pandas().itertuples()), strict=True)
    keys, fps, x, y = (np.array(c, np.int64) for c in columns)
    monkeypatch.setattr(similar, "SHORT", short)
    for made in (zip(*similar.list_buckets(keys, fps, x.view(np.uint64), y.view(np.uint64)), strict=True), map(tuple, whole(seen[0]).collect())):
        have = defaultdict(set)
        for key, fp, lead, n in made:
            have[key, lead, n].add(fp)
        assert all(min(s) == lead and len(s) == n for (_, lead, n), s in have.items())
        assert {frozenset(s) for s in have.values()} == want and len(have) == len(want)


@pytest.mark.parametrize(("a", "b", "both"), [(4, 5, 4), (5, 6, 5), (6, 7, 6), (7, 8, 7), (8, 10, 8), (9, 9, 8), (80, 100, 80), (90, 90, 80)])
def test_lists_reach_the_similarity(a, b, both):
    """Pairs just similar enough: nearly all meet in a list and pass the check."""
    rng = np.random.default_rng(a)
    lost = 0
    for _ in range(1000):
        h = rng.integers(0, 2**64, a + b - both, np.uint64)
        sets = [(k, similar.fingerprint(np.sort(x))) for k, x in enumerate((h[:a], h[a - both :]))]
        lost += not plain_buckets(sets)
    assert lost <= 1


def varied(rng, share, n, length=200):
    """``n`` copies of one text, in each of which ``share`` of the words, dealt at random, are others."""
    words = [f"w{x}" for x in rng.integers(0, 3000, length)]
    out = []
    for _ in range(n):
        other = list(words)
        for at in rng.choice(length, int(share * length), replace=False):
            other[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(other))
    return out


def test_rows_and_shingles_follow_the_documents(spark, monkeypatch):
    """A group's documents are in very many buckets; rows past the buckets, and shingles, are not made for each."""
    rng = np.random.default_rng(3)
    texts = [*varied(rng, 0.01, 250), *varied(rng, 0.05, 100), *(t for _ in range(200) for t in varied(rng, 0, 1))]
    rows, seen, whole = list(enumerate(texts)), {}, similar.staged

    def staged(df, name):
        made = whole(df, name)
        seen[f"{len(seen)} {name}"] = (made.count(), made.columns)
        return made

    monkeypatch.setattr(similar, "staged", staged)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((False, r.doc_id) for r in similar.deduplicate(docs).collect()) == expected(rows)
    members = next(n for name, (n, _) in seen.items() if name.endswith(" members"))
    past = list(seen.values())[[name.endswith(" members") for name in seen].index(True) + 1 :]
    assert members > 10 * len(rows) and max(n for n, _ in past) < members / 4
    # The texts that have nothing in common with others have no shingles written down.
    assert 250 <= sum(n for n, columns in seen.values() if "shingles" in columns) <= 350


def test_repeated_rows_and_large_labels(spark, monkeypatch):
    """Rows repeated with id and text, null ids among them, and groups in several parts, chunks and copies of a lead."""
    monkeypatch.setattr(similar, "TILE_SETS", 3)
    monkeypatch.setattr(similar, "FAN", 4)
    rng = np.random.default_rng(4)
    rows = list(enumerate(t for share in (0.01, 0.02, 0.03, 0.05) for t in varied(rng, share, 30, 100)))
    rows += [*rows[::3], *((None, t) for _, t in rows[::20]), *((None, t) for _, t in rows[::20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in similar.deduplicate(docs).collect()) == expected(rows)


@pytest.mark.parametrize(("a", "b", "both"), [(4, 5, 4), (5, 6, 5), (6, 7, 6), (7, 8, 7), (8, 10, 8), (9, 9, 8), (12, 15, 12), (13, 14, 12), (80, 100, 80), (90, 90, 80)])
def test_wide_fingerprints_reach_the_similarity(a, b, both):
    """Pairs just similar enough are near, pairs that share half are not, save of sets of few shingles."""
    rng = np.random.default_rng(a)
    most = similar.SMALL_WIDE_BITS if a <= similar.SMALL else similar.WIDE_BITS

    def differ(both):
        h = rng.integers(0, 2**64, a + b - both, np.uint64)
        x, y = (similar.fingerprint(np.sort(s))[: similar.WIDE] for s in (h[:a], h[a - both :]))
        return int(np.bitwise_count(x ^ y).sum())

    assert max(differ(both) for _ in range(400)) <= most
    assert a < 20 or min(differ((a + b) // 3) for _ in range(100)) > most
