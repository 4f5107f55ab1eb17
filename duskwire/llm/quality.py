"""Quality classifier by co-training on two views of a document.

One linear classifier sees the text's content only, the other the metadata of its page
only. Over some rounds each labels the unlabelled documents it is confident about and
hands them to the other as training rows. Both are then calibrated on labelled rows
that neither was trained on, and a logistic combination of the two calibrated views,
fitted on the same rows, scores every document.

The labelled rows come to the driver, up to a bound. The unlabelled ones don't: all of
them take part, and what comes of them are sums of fixed size. The metadata view has a
few thousand possible cells, so its training rows are a count for each; the text view is
fitted by Newton steps, of which each needs one gradient and one matrix, added up over
all partitions.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwire.llm.common import broadcast_if_small, staged
from duskwire.llm.linear import Scaler, fit_logistic, labelled_sample, logit, predict, sigmoid

#: Labelled rows that the classifiers are fitted on, at most.
LABELLED_ROWS = 6_000
ROUNDS, CONFIDENT = 3, 0.97
#: Newton steps of a round, at most, and the gradient at which they end, of a row on average.
STEPS, SETTLED = 12, 1e-7
#: A document is rejected when its probability of being good is under this: clear junk only.
KEEP_FROM = 0.35
SOURCE_SLOTS, LANG_SLOTS, LENGTH_SLOTS = 48, 16, 12


def text_features(text: str | None) -> list[float]:
    """Content statistics of a whole text; all zero for one without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * N_TEXT
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    digit, wide = int(hist[48:58].sum()), int(hist[128:].sum())
    space = int(hist[9:14].sum() + hist[32])
    marks = size - upper - lower - digit - wide - space
    plain = int(hist[44] + hist[46] + hist[59] + hist[58] + hist[39] + hist[34] + hist[45] + hist[63] + hist[40] + hist[41])
    lengths = np.fromiter(map(len, words), np.int64, n)
    uniq = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bits = hist[hist > 0] / size
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), upper / size, lower / size, digit / size, wide / size, space / size, marks / size,
        (marks - plain) / size, plain / size, int(hist[33]) / n, int(hist[46]) / n, int(hist[44]) / n, int(hist[124]) / n, (lengths > 12).mean(), (lengths < 4).mean(), (lengths == 1).mean(),
        uniq / n, uniq / np.sqrt(n), same / n, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), n / max(1, len(lines)) / 100, float(-(bits * np.log2(bits)).sum()),
    ]


N_TEXT = 26
N_META = SOURCE_SLOTS + LANG_SLOTS + LENGTH_SLOTS


_OFFSETS = np.array([0, SOURCE_SLOTS, SOURCE_SLOTS + LANG_SLOTS])


def meta_slots(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """Slots of the page's source, language and length; a null has a slot of its own."""
    slot = lambda v, n: 0 if v is None else 1 + zlib.crc32(str(v).encode()) % (n - 1)
    length = 0 if n_chars is None or n_chars < 0 else min(LENGTH_SLOTS - 1, 1 + int(np.log2(n_chars + 1) / 2))
    return slot(source, SOURCE_SLOTS), slot(lang, LANG_SLOTS), length


def one_hot(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), N_META))
    np.put_along_axis(out, slots + _OFFSETS, 1.0, axis=1)
    return out


@dataclass
class View:
    """A linear model of features (text) or slots (metadata), and its calibration."""

    w: np.ndarray
    scale: Scaler | None = None
    cal: np.ndarray = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.scale is None:
            return sigmoid(self.w[:-1][x + _OFFSETS].sum(axis=1) + self.w[-1])
        return predict(self.w, self.scale(x))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        return self.raw(x) if self.cal is None else predict(self.cal, logit(self.raw(x))[:, None])


@dataclass
class CoTrained:
    text: View
    meta: View
    mix: np.ndarray

    def __call__(self, xt: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text(xt), self.meta(slots)
        return a, b, predict(self.mix, np.column_stack([logit(a), logit(b)]))


def newton_sums(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient, matrix and number of rows of a logistic loss, in one flat array; sums of these over parts are those of the whole."""
    xs = np.hstack([x, np.ones((len(x), 1))])
    p = sigmoid(xs @ w)
    return np.concatenate([xs.T @ (p - y), ((xs * (p * (1 - p))[:, None]).T @ xs).ravel(), [len(x)]])


def _sure(p: np.ndarray, confident: float) -> np.ndarray:
    return (p >= confident) | (p <= 1 - confident)


@dataclass
class Rows:
    """Unlabelled rows at hand: what a pool gives, from arrays."""

    xt: np.ndarray
    slots: np.ndarray

    def cells(self, text: View, confident: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, labels and counts of the rows that the text view is sure of."""
        p = text.raw(self.xt)
        sure = _sure(p, confident)
        keys, n = np.unique(np.column_stack([self.slots[sure], p[sure] >= 0.5]).astype(np.int64).reshape(-1, 4), axis=0, return_counts=True)
        return keys[:, :3], keys[:, 3], n

    def sums(self, meta: View, text: View, confident: float) -> np.ndarray:
        """``newton_sums`` of the text view over the rows that the metadata view is sure of."""
        p = meta.raw(self.slots)
        sure = _sure(p, confident)
        return newton_sums(text.w, text.scale(self.xt[sure]), (p[sure] >= 0.5).astype(float))


@dataclass
class Table:
    """The same from a table ``xt, slots``: counted and summed where the rows are."""

    df: DataFrame

    def _each(self, make, schema: str) -> DataFrame:
        def run(batches):
            for b in batches:
                rows = Rows(_flat(b.column(0), N_TEXT), _flat(b.column(1), 3).astype(np.int64))
                if b.num_rows:
                    yield make(rows)

        return self.df.select("xt", "slots").mapInArrow(run, schema)

    def cells(self, text: View, confident: float):
        def make(rows):
            slots, label, n = rows.cells(text, confident)
            return pa.RecordBatch.from_arrays([*(pa.array(slots[:, k].astype(np.int32)) for k in range(3)), pa.array(label.astype(np.int32)), pa.array(n.astype(np.int64))], names=["a", "b", "c", "label", "n"])

        found = self._each(make, "a int, b int, c int, label int, n long").groupBy("a", "b", "c", "label").agg(F.sum("n").alias("n")).collect()
        found.sort()
        rows = np.array([tuple(r) for r in found], np.int64).reshape(-1, 5)
        return rows[:, :3], rows[:, 3], rows[:, 4]

    def sums(self, meta: View, text: View, confident: float) -> np.ndarray:
        def make(rows):
            v = rows.sums(meta, text, confident)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["i", "v"])

        found = self._each(make, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        d = len(text.w)
        out = np.zeros(d + d * d + 1)
        for r in found:
            out[r.i] = r.v
        return out


def _flat(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def co_train(xt: np.ndarray, slots: np.ndarray, y: np.ndarray, pool, rounds: int = ROUNDS, confident: float = CONFIDENT, l2: float = 1.0) -> CoTrained:
    """Fit on labelled rows (two views and ``y``) and a pool of unlabelled ones (``Rows`` or ``Table``).

    Every fourth labelled row is kept for calibration. However many rows a view hands
    over, together they weigh no more than the labelled ones.
    """
    aside = np.arange(len(y)) % 4 == 3
    own = ~aside if aside.any() else np.ones(len(y), bool)
    scale, target = Scaler(xt[own]), y[own].astype(float)
    x, hot = scale(xt[own]), one_hot(slots[own])
    text, meta = View(fit_logistic(x, target, l2), scale), View(fit_logistic(hot, target, l2))
    for _ in range(rounds if len(target) and target.min() != target.max() else 0):
        where, label, n = pool.cells(text, confident)
        weight = np.concatenate([np.ones(len(target)), n * min(1.0, len(target) / max(1, n.sum()))])
        given = View(fit_logistic(np.vstack([hot, one_hot(where)]), np.concatenate([target, label.astype(float)]), l2, weight))
        text = _newton(x, target, text, pool, meta, confident, l2)
        meta = given
    for view, rows in ((text, xt), (meta, slots)):
        if aside.any() and y[aside].min() != y[aside].max():
            view.cal = fit_logistic(logit(view.raw(rows[aside]))[:, None], y[aside].astype(float), l2=1e-3)
    mix = np.array([1.0, 0.0, 0.0])
    if aside.any() and y[aside].min() != y[aside].max():
        mix = fit_logistic(np.column_stack([logit(text(xt[aside])), logit(meta(slots[aside]))]), y[aside].astype(float), l2=1.0)
    return CoTrained(text, meta, mix)


def _newton(x: np.ndarray, y: np.ndarray, start: View, pool, meta: View, confident: float, l2: float) -> View:
    """The text view that fits labelled rows and those that ``meta`` is sure of."""
    d = len(start.w)
    ridge = np.append(np.full(d - 1, l2), 1e-6)
    view, step, last = View(start.w.copy(), start.scale), np.zeros(d), np.inf
    for _ in range(STEPS):
        given = pool.sums(meta, view, confident)
        share = min(1.0, len(y) / max(1.0, given[-1]))
        total = newton_sums(view.w, x, y) + share * given
        g = total[:d] + ridge * view.w
        size = np.abs(g).max()
        if size < SETTLED * len(y):
            break
        if size > 2 * last:  # too far: half the way back
            step = step / 2
            view.w = view.w + step
            continue
        h = total[d : d + d * d].reshape(d, d) + np.diag(ridge + 1e-9)
        step, last = np.linalg.solve(h, g), size
        view.w = view.w - step
    return view


def _features(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the two views of every row."""
    at = len(keep)

    def run(batches):
        for b in batches:
            t, m = _views([b.column(at + k) for k in range(4)])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(list(t), pa.list_(pa.float64())), pa.array(list(m), pa.list_(pa.int32()))], names=[*b.schema.names[:at], "xt", "slots"])

    rows = df.select(*keep, "text", "lang", "source", F.col("n_chars").cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:at]) + ", xt array<double>, slots array<int>"
    return rows.mapInArrow(run, schema)


def _views(columns) -> tuple[np.ndarray, np.ndarray]:
    """Text features and metadata slots from columns text, lang, source, n_chars."""
    text, *meta = columns
    t = np.array([text_features(x.as_py()) for x in text], np.float64).reshape(-1, N_TEXT)
    return t, np.array([meta_slots(*v) for v in zip(*(c.to_pylist() for c in meta), strict=True)], np.int32).reshape(-1, 3)


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Co-train on at most ``LABELLED_ROWS`` labelled rows of ``docs``, chosen by hash of id, and on all unlabelled ones, null ids included."""
    known = _features(labelled_sample(docs, labels, "quality", LABELLED_ROWS), ["doc_id", "label"]).collect()
    known.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.xt))
    y = np.array([r.label for r in known], np.int64)
    pool: Rows | Table = Rows(np.zeros((0, N_TEXT)), np.zeros((0, 3), np.int64))
    if len(set(y.tolist())) > 1:
        ids = labels.where("doc_id is not null").select("doc_id").distinct()
        every = staged(_features(docs, ["doc_id"]), "features")
        pool = Table(staged(every.join(broadcast_if_small(ids), "doc_id", "left_anti").select("xt", "slots"), "unlabelled"))
    stack = lambda c, n, kind: np.array([r[c] for r in known], kind).reshape(-1, n)
    return co_train(stack("xt", N_TEXT, np.float64), stack("slots", 3, np.int64), y, pool)


def score(docs: DataFrame, model: CoTrained, keep_from: float = KEEP_FROM) -> DataFrame:
    """All columns of ``docs`` and ``text_score, meta_score, quality_score, keep``.

    Every whole text is scored, in one map over the rows. Null and empty texts, and
    nulls in any metadata column, are values like others; repeated rows score alike;
    columns of the four names are replaced, other columns pass through.
    """
    made = ["text_score", "meta_score", "quality_score", "keep"]
    kept = docs.drop(*made)
    names = kept.columns
    at = [names.index(c) for c in ("text", "lang", "source", "n_chars")]

    def run(batches):
        for b in batches:
            a, c, p = model(*_views([b.column(k) for k in at]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a), pa.array(c), pa.array(p), pa.array(p >= keep_from)], names=[*b.schema.names, *made])

    schema = kept.select("*", *[F.lit(0.0).alias(c) for c in made[:3]], F.lit(True).alias("keep")).schema
    for f in schema.fields:
        f.nullable = True
    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Fit on the labelled documents and score all; without labels of both classes every document is kept."""
    return score(docs, fit(docs, labels), keep_from)
