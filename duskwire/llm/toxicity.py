"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each category's model sees the words
of a text and the probabilities that the earlier models gave, so a later category can
lean on an earlier one. For training, those earlier probabilities are out of fold: a
row's are given by models that were fitted without it, so that later models learn from
inputs as uncertain as they will meet.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwire.llm.linear import fit_logistic, labelled_sample, logit, predict

#: Labelled rows that the chain is fitted on, at most, words that it looks at, and folds.
FIT_ROWS, VOCABULARY, FOLDS = 8_000, 512, 5
#: Weak labels of the categories: a document labelled toxic that has a word of the category.
#: The last category is the label itself.
CATEGORIES = {
    "insult": ["idiot", "moron", "stupid", "loser", "clown", "fool", "dumb", "imbecile"],
    "contempt": ["pathetic", "worthless", "disgusting", "useless", "ridiculous", "vile"],
    "dehumanising": ["scum", "trash", "vermin", "garbage", "filth", "parasite"],
}
NAMES = [*CATEGORIES, "toxic"]
TOXIC_FROM = 0.5
#: Lengths of the prefixes that stand for inflected and compounded words.
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a whole text, and the stems of longer ones: prefixes, marked by a star."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:k] + "*" for k in STEMS for w in words if len(w) > k}


@dataclass
class Chain:
    vocabulary: list[str]
    weights: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a column for each of ``NAMES``."""
        out: list[np.ndarray] = []
        for w in self.weights:
            out.append(predict(w, _with(x, out)))
        return np.column_stack(out)

    def features(self, texts) -> np.ndarray:
        index = {w: i for i, w in enumerate(self.vocabulary)}
        x = np.zeros((len(texts), len(index)))
        for r, t in enumerate(texts):
            for w in words_of(t) & index.keys():
                x[r, index[w]] = 1
        return x


def _with(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([x, *[logit(p) / 4 for p in earlier]]) if earlier else x


def fit_chain(vocabulary: list[str], x: np.ndarray, ys: list[np.ndarray], fold: np.ndarray, l2: float = 0.02) -> Chain:
    """``ys``: 0/1 per category, in chain order; ``fold``: each row's fold."""
    weights, out_of_fold = [], []
    for y in ys:
        own = _with(x, out_of_fold)
        weights.append(fit_logistic(own, y, l2))
        p = np.zeros(len(y))
        for f in np.unique(fold):
            test = fold == f
            p[test] = predict(fit_logistic(own[~test], y[~test], l2) if (~test).any() else weights[-1], own[test])
        out_of_fold.append(p)
    return Chain(vocabulary, weights)


def _distinct_words(rows: DataFrame) -> DataFrame:
    """``doc_id, label, words``: the distinct words of each row's whole text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(words_of(t.as_py())) for t in b.column(2)], pa.list_(pa.string()))], names=["doc_id", "label", "words"])

    return rows.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(run, "doc_id long, label int, words array<string>")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Chain:
    """Fit on up to ``fit_rows`` labelled documents, chosen by hash of id.

    The vocabulary is the ``VOCABULARY`` words whose document rates differ most
    between toxic and other rows, in standard errors; only those rows' places in it
    come to the driver.
    """
    rows = _distinct_words(labelled_sample(docs, labels, "toxic", fit_rows)).cache()
    n1, n0 = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    if not n1 or not n0:
        rows.unpersist()
        d = [fit_logistic(np.zeros((1, 0)), np.array([1.0 if n1 else 0.0])) for _ in NAMES]
        return Chain([], [np.append(np.zeros(k), w[-1]) for k, w in enumerate(d)])
    rate = lambda c, n: F.col(c) / n
    df = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("n")).withColumn("b", F.col("n") - F.col("a"))
    p = (F.col("n") + 1) / (n1 + n0 + 2)
    z = F.abs(rate("a", n1) - rate("b", n0)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    best = df.where("n >= 3").withColumn("z", z).orderBy(F.desc("z"), "word").limit(VOCABULARY)
    vocabulary = sorted(r.word for r in best.collect())
    asked = sorted({w for s in CATEGORIES.values() for w in s} | set(vocabulary))
    found = rows.select("doc_id", "label", F.array_intersect("words", F.array(*map(F.lit, asked))).alias("words")).collect()
    rows.unpersist()
    found.sort(key=lambda r: (r.doc_id, sorted(r.words)))
    index = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(found), len(index)))
    for r, row in enumerate(found):
        for w in row.words:
            if w in index:
                x[r, index[w]] = 1
    toxic = np.array([r.label for r in found], float)
    ys = [np.array([float(r.label and bool(set(seeds) & set(r.words))) for r in found]) for seeds in CATEGORIES.values()]
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % FOLDS for r in found])
    return fit_chain(vocabulary, x, [*ys, toxic], fold)


def score(docs: DataFrame, chain: Chain, toxic_from: float = TOXIC_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the probability of each category and ``is_toxic``, for every row, on its whole text.

    A null text counts as empty; null ids and repeated rows come back as they are;
    other columns are ignored.
    """

    def run(batches):
        for b in batches:
            p = chain(chain.features([t.as_py() for t in b.column(1)]))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, k]) for k in range(len(NAMES))], pa.array(p[:, -1] >= toxic_from)], names=["doc_id", *NAMES, "is_toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in NAMES) + ", is_toxic boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents and score all; without labels of both classes the rate of the one there is is all that is known."""
    return score(docs, fit(docs, labels))
