from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from math import log10
from types import SimpleNamespace

import pyarrow as pa
import pytest

from duskwire.llm import lm

END = "\x00end"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Automaton:
    """States are tuples of words with arcs and one failure arc; a text is read word by word."""

    def __init__(self, texts, order=lm.ORDER, mu=lm.MU, least=lm.STATE_COUNT):
        self.mu, self.c = mu, Counter()
        for t in texts:
            self.c.update((w,) for w in t)
            self.c.update(zip([END, *t], t, strict=False))
            for k in range(3, order + 1):
                run = [END, *t]
                self.c.update(tuple(run[i : i + k]) for i in range(len(run) - k + 1))
        self.order = order
        self.one = Counter({k[0]: n for k, n in self.c.items() if len(k) == 1})
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.states = {()} | {k for k, n in self.c.items() if len(k) < order and n >= (least if len(k) > 1 else 1)} | {(END,)}

    def p(self, h, w):
        """Probability of a word after a history whose shorter ones are states."""
        if not h:
            return (self.one[w] + 1) / (self.n + self.v + 1)
        return (self.c[(*h, w)] + self.mu * self.p(h[1:], w)) / (self.c[h] + self.mu)

    def score(self, t):
        total, state = 0.0, (END,) if self.order > 1 else ()
        for w in t:
            h = state
            while h and not self.c[(*h, w)]:  # no arc: the failure arc
                total += log10(self.mu / (self.c[h] + self.mu))
                h = h[1:]
            total += log10(self.p(h, w))
            state = (*h, w)
            while state not in self.states:
                state = state[1:]
        return total


def check(docs, order):
    rows = [(r.doc_id, tokens(r.text)) for r in docs.select("doc_id", "text").collect()]
    model = Automaton([t for i, t in rows if not held(i)], order)
    want = sorted(
        ((i, held(i), len(t), sum(model.one[w] > 0 for w in t), model.n, sum(log10((model.one[w] + 1) / (model.n + model.v + 1)) for w in t), model.score(t)) for i, t in rows), key=lambda r: (str(r[0]), r[2], r[5])
    )
    have = sorted(map(tuple, lm.score_texts(docs, order=order).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [r[:5] for r in have] == [r[:5] for r in want]
    for h, w in zip(have, want, strict=True):
        assert h[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize(("table", "order"), [("documents", 3), ("clashing", 3), ("clashing", 1), ("clashing", 2), ("clashing", 4)])
def test_against_an_automaton_of_dictionaries(request, table, order):
    check(request.getfixturevalue(table), order)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_short_pieces(spark, monkeypatch, order):
    """A few words in every order, so that long histories recur; pieces of some words."""
    monkeypatch.setattr(lm.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rng = random.Random(order)
    rows = [(k, " ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    text = [tokens(t) for i, t in rows if not held(i)]
    model = Automaton(text, order)
    block = lm.Block(next(lm._make_blocks([small_batch(rows)])).to_pylist()[0])
    counts = [block.counts(0).astype("uint64")]
    for k in range(1, order):
        block.extend(None if k == 1 else counts[-1] >= lm.STATE_COUNT)
        counts.append(block.counts(k).astype("uint64"))
    for piece in (1, 3, 1000):
        monkeypatch.setattr(lm, "PIECE_TOKENS", piece)
        have = lm.Automaton(block, counts, model.n, model.v).read(block)
        assert have == pytest.approx([model.score(tokens(t)) for _, t in rows], rel=1e-9)
    check(docs, order)


def small_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])


def test_blocks_do_not_change_scores(documents):
    a = {r.doc_id: r.score for r in lm.score_texts(documents).collect()}
    b = {r.doc_id: r.score for r in lm.score_texts(documents.repartition(7)).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)


def test_probabilities_sum_to_one():
    model = Automaton([tokens("a b a c"), tokens("b a a b a c")])
    for state in model.states:
        if state and state[-1] == END and len(state) > 1:
            continue
        assert sum(model.p(state, w) for w in model.one) + model.p(state, "unknown") == pytest.approx(1)


def test_it_beats_the_base_on_held_out_texts(documents):
    r = lm.score_texts(documents).where("held_out").selectExpr("sum(score) a", "sum(base_score) b").first()
    assert r.a > r.b


def test_no_documents(empty):
    assert lm.score_texts(empty).collect() == []
