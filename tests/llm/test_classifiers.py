from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwire.llm import linear, quality, toxicity


@pytest.fixture(scope="module")
def halves(spark):
    """Documents, the labels to learn from, and those held out: others than those on which the vocabulary's size was chosen (remainder 0)."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 3
    return spark.read.parquet(f"{d}/documents.parquet"), labels.where(~aside), labels.where(aside)


def test_quality_on_held_out_labels(halves):
    docs, known, aside = halves
    rows = quality.classify(docs, known).join(aside.select("doc_id", "quality"), "doc_id").select("quality", "quality_score", "keep").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98
    assert np.mean(bad) <= 0.35
    pos, neg = (np.array([r.quality_score for r in rows if r.quality == k]) for k in (1, 0))
    assert (pos[:, None] > neg[None, :]).mean() >= 0.85


def test_toxicity_on_held_out_labels(halves):
    docs, known, aside = halves
    rows = toxicity.classify(docs, known).join(aside.select(F.col("doc_id"), F.col("toxic").alias("truth")), "doc_id").collect()
    assert np.mean([r.is_toxic for r in rows if r.truth == 1]) >= 0.9
    assert np.mean([r.is_toxic for r in rows if r.truth == 0]) <= 0.01


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 1), (3, 0, 0), (7, 1, 0), (8, 0, 0), (None, 1, 1), (9, None, None), (1, 1, 1), (999, 0, 1)]])
def test_odd_rows(spark, clashing, empty, labels):
    table = spark.createDataFrame(labels, LABELS).withColumn("label", F.lit(7)).withColumn("text", F.lit("clash"))
    scored = quality.classify(clashing, table)
    assert [c for c in scored.columns if c not in ("text_score", "meta_score", "quality_score", "keep")] == [c for c in clashing.columns if c != "keep"]
    assert scored.count() == clashing.count() and scored.where("keep is null or quality_score is null or isnan(quality_score)").count() == 0
    toxic = toxicity.classify(clashing, table)
    assert toxic.count() == clashing.count() and toxic.where("is_toxic is null or isnan(toxic)").count() == 0
    assert quality.classify(empty, table).collect() == [] and toxicity.classify(empty, table).collect() == []


def test_without_labels_of_both_classes_all_are_kept(spark, messy):
    table = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert quality.classify(messy, table).where("not keep").count() == 0


def test_scores_do_not_depend_on_partitions(halves):
    docs, known, _ = halves
    some = docs.limit(500)
    a = {r.doc_id: r.quality_score for r in quality.classify(some, known).collect()}
    b = {r.doc_id: r.quality_score for r in quality.classify(some.repartition(5), known).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def two_views(n, seed):
    """Two views, each enough alone: noisy numbers, and slots that lean to a class."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    xt = (y[:, None] * 2 - 1) + rng.normal(size=(n, 4)) * 1.2
    right = rng.random((n, 3)) < 0.85
    slots = np.where(right, y[:, None], 1 - y[:, None]) * 5 + rng.integers(0, 5, (n, 3))
    return y, xt, slots


def test_pseudo_labels_help_a_view():
    (y, a, b), (_, ua, ub), (ty, ta, tb) = two_views(40, 0), two_views(3000, 1), two_views(4000, 2)
    alone = quality.co_train(a, b, y, quality.Rows(ua[:0], ub[:0]))
    both = quality.co_train(a, b, y, quality.Rows(ua, ub))
    right = lambda m: ((m(ta, tb)[2] >= 0.5) == ty).mean()
    assert right(both) >= right(alone) - 0.005 and right(both) > 0.9


def plain_fit(x, y, weight, l2=1.0):
    """Logistic regression by plain gradient descent with momentum, to the optimum."""
    xs = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.full(x.shape[1], l2), 1e-6)
    w, v = np.zeros(xs.shape[1]), np.zeros(xs.shape[1])
    rate = 1 / (0.25 * np.linalg.norm((xs * weight[:, None]).T @ xs, 2) + l2)
    for _ in range(200_000):
        g = xs.T @ (weight * (1 / (1 + np.exp(-xs @ w)) - y)) + ridge * w
        if np.abs(g).max() < 1e-8:
            break
        v = 0.95 * v - rate * g
        w = w + v
    return w


def plain_cotraining(xt, slots, y, ut, us, rounds=quality.ROUNDS, confident=quality.CONFIDENT):
    """Co-training by the book, row by row: each view's rows given to the other, both fitted anew each round."""
    def hot(s):
        return np.array([[float(k == r[0]) for k in range(48)] + [float(k == r[1]) for k in range(16)] + [float(k == r[2]) for k in range(12)] for r in s]).reshape(-1, 76)

    own = np.arange(len(y)) % 4 != 3
    mean, dev = xt[own].mean(0), np.maximum(xt[own].std(0), 1e-6)
    scaled = lambda x: np.clip((x - mean) / dev, -6, 6)
    of = lambda w, x: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    t, m, target = scaled(xt[own]), hot(slots[own]), y[own].astype(float)
    wt, wm = plain_fit(t, target, np.ones(len(target))), plain_fit(m, target, np.ones(len(target)))

    def more(x, ux, p):
        sure = (p >= confident) | (p <= 1 - confident)
        weight = np.concatenate([np.ones(len(target)), np.full(sure.sum(), min(1, len(target) / max(1, sure.sum())))])
        return plain_fit(np.vstack([x, ux[sure]]), np.concatenate([target, p[sure] >= 0.5]), weight)

    for _ in range(rounds):
        pt, pm = of(wt, scaled(ut)), of(wm, hot(us))
        wt, wm = more(t, scaled(ut), pm), more(m, hot(us), pt)
    return lambda x, s: (of(wt, scaled(x)), of(wm, hot(s)))


def test_cotraining_against_brute_force():
    (y, a, b), (_, ua, ub), (_, ta, tb) = two_views(60, 3), two_views(500, 4), two_views(200, 5)
    have = quality.co_train(a, b, y, quality.Rows(ua, ub))
    want = plain_cotraining(a, b, y, ua, ub)(ta, tb)
    assert have.text.raw(ta) == pytest.approx(want[0], abs=1e-4) and have.meta.raw(tb) == pytest.approx(want[1], abs=1e-4)


def test_sums_over_a_table_are_those_of_its_rows(spark, documents):
    """Counts and Newton sums over the partitions of a table, against all rows in one array."""
    rows = quality._features(documents, ["doc_id"])
    held = rows.collect()
    here = quality.Rows(np.array([r.xt for r in held]), np.array([r.slots for r in held]))
    rng = np.random.default_rng(6)
    text = quality.View(rng.normal(size=quality.N_TEXT + 1), linear.Scaler(here.xt))
    meta = quality.View(rng.normal(size=quality.N_META + 1) * 3)
    there = quality.Table(rows.repartition(5))
    for x, z in zip(here.cells(text, 0.9), there.cells(text, 0.9), strict=True):
        assert (x == z).all()
    want = here.sums(meta, text, 0.9)
    assert want[-1] > 0 and there.sums(meta, text, 0.9) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_logistic_regression_finds_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < linear.sigmoid(x @ np.array([1.0, -2.0, 0.0]) + 0.5)).astype(float)
    w = linear.fit_logistic(x, y, l2=0.5)
    p = linear.predict(w, x)
    assert np.abs(x.T @ (p - y) + 0.5 * w[:-1]).max() < 1e-3 and abs((p - y).sum()) < 1e-2


def test_the_chain_feeds_earlier_probabilities_forward():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (600, 2)).astype(float)
    first = x[:, 0]
    second = np.maximum(first, x[:, 1])
    chain = toxicity.fit_chain(["a", "b"], x, [first, second], np.arange(600) % 5)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert ((chain(x) >= 0.5) == np.column_stack([first, second])).all()


def plain_chain(texts, labels, held):
    """The toxicity chain by the book, from counts and plain gradient descent."""
    import re
    import zlib as z
    from collections import Counter

    def words(t):
        found = set(re.findall(r"[^\W\d_]+", t.lower()))
        return found | {w[:k] + "*" for k in (4, 5, 6) for w in found if len(w) > k}

    bags = [words(t) for t in texts]
    n1, n0 = sum(labels), len(labels) - sum(labels)
    a, n = Counter(), Counter()
    for bag, y in zip(bags, labels, strict=True):
        n.update(bag)
        if y:
            a.update(bag)
    z_of = lambda w: abs(a[w] / n1 - (n[w] - a[w]) / n0) / np.sqrt((n[w] + 1) / (n1 + n0 + 2) * (1 - (n[w] + 1) / (n1 + n0 + 2)) * (1 / n1 + 1 / n0))
    vocabulary = sorted(sorted((w for w in n if n[w] >= 3), key=lambda w: (-z_of(w), w))[: toxicity.VOCABULARY])
    x, q = (np.array([[float(w in b) for w in vocabulary] for b in rows]) for rows in (bags, [words(t) for t in held]))
    fold = np.array([z.crc32(str(i).encode()) % toxicity.FOLDS for i in range(len(texts))])
    out, seen_x, seen_q = [], x, q
    of = lambda w, r: 1 / (1 + np.exp(-(r @ w[:-1] + w[-1])))
    for seeds in [*toxicity.CATEGORIES.values(), None]:
        y = np.array([float(t and (seeds is None or bool(set(seeds) & b))) for t, b in zip(labels, bags, strict=True)])
        fit = lambda r, t: plain_fit(r, t, np.ones(len(t)), 0.02) if t.min() != t.max() else np.append(np.zeros(r.shape[1]), np.log((t.sum() + 0.5) / (len(t) - t.sum() + 0.5)))
        p = np.zeros(len(y))
        for f in set(fold.tolist()):
            p[fold == f] = of(fit(seen_x[fold != f], y[fold != f]), seen_x[fold == f])
        now = of(fit(seen_x, y), seen_q)
        out.append(now)
        join = lambda r, v: np.column_stack([r, np.log(np.clip(v, 1e-6, 1 - 1e-6) / (1 - np.clip(v, 1e-6, 1 - 1e-6))) / 4])
        seen_x, seen_q = join(seen_x, p), join(seen_q, now)
    return np.column_stack(out)


def test_the_chain_against_brute_force(spark):
    rng = np.random.default_rng(8)
    nice, bad = "tree river house walk cloud bread".split(), ["idiot", "pathetic", "scum", "moron"]
    make = lambda k: " ".join([*rng.choice(nice, 4), *(rng.choice(bad, 2) if k % 3 == 0 else [])])
    texts = [make(k) for k in range(60)]
    labels = [int(k % 3 == 0) if k % 10 else int(k % 3 != 0) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    have = {r.doc_id: [r[c] for c in toxicity.NAMES] for r in toxicity.classify(docs, table).collect()}
    want = plain_chain(texts, labels, texts)
    for k in range(60):
        assert have[k] == pytest.approx(want[k].tolist(), abs=2e-3)
