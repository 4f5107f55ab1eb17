"""Language-model scoring by a weighted backoff automaton.

The model is an n-gram model with hierarchical Dirichlet smoothing:

    P(w | h) = (c(hw) + mu * P(w | h')) / (c(h) + mu),    P(w) = (c(w) + 1) / (N + V + 1)

where h' is h without its first word. As an automaton, the empty history, every word and
every longer history seen ``STATE_COUNT`` times or more in training is a state; the arc
for a word that was seen after h weighs log10 P(w | h), and the failure arc from h to h'
weighs log10 mu / (c(h) + mu). A text is read once from left to right: at each word the
carried state's arc is taken, or failure arcs are followed, their weights added, until a
state has one.

The automaton of a large corpus fits in no task, so the corpus is cut into blocks of
some million tokens, and each block gets exactly the slice of the automaton that its
own texts can visit. Blocks send their distinct n-grams, with how often each occurs
in their training texts, to reducers that own a range of n-gram hashes; those add up
the counts and answer every block in the order of its question. Words and pairs are
asked for first, longer n-grams level by level, and only those whose history is a state.
Nothing but the two totals N and V is ever in one place.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwire.llm.common import staged

#: Words in an n-gram, the strength of the shorter history, and tokens in a block and in a reducer's range.
ORDER, MU = 3, 40.0
BLOCK_TOKENS, RANGE_TOKENS = 1 << 20, 3_000_000
#: Training occurrences from which a history of two words or more is a state.
STATE_COUNT = 2
#: Tokens of a piece of a text; pieces are read in step with each other.
PIECE_TOKENS = 512
#: The end of a text, which is also what its first word follows. No word is empty.
END = xxhash.xxh64_intdigest(b"")

_CODEC = pa.Codec("zstd", 1)
BLOCKS = "block long, doc_id array<long>, held array<boolean>, n_tokens array<int>, words binary, tokens binary"
ASKED = "part int, block long, len int, n int, keys binary, counts binary"
TOLD = "part int, block long, len int, n int, counts binary, states binary, total long, distinct long"


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of an unsigned array, plane by plane, so that small numbers take little room."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return _CODEC.compress(planes, asbytes=True)


def unpack(raw: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(raw, n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(raw, n, np.uint64), dtype=np.uint64)


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _tokens(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    out = np.fromiter(map(digest, words), np.uint64, len(words))
    return np.append(out, np.uint64(END))


def _make_blocks(batches):
    part = TaskContext.get().partitionId() << 32
    ids, texts, held = [], [], 0

    def close(nth):
        flat = np.concatenate(texts)
        words, tokens = np.unique(flat, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part + nth], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[held_out(i) for i in ids]], pa.list_(pa.bool_())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                pa.array([pack_sorted(words)], pa.binary()),
                pa.array([pack(tokens.astype(np.uint32))], pa.binary()),
            ],
            names=["block", "doc_id", "held", "n_tokens", "words", "tokens"],
        )

    nth = 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = _tokens(text.as_py())
            if texts and held + len(t) > BLOCK_TOKENS:
                yield close(nth)
                ids, texts, held, nth = [], [], 0, nth + 1
            ids.append(doc_id)
            texts.append(t)
            held += len(t)
    if texts:
        yield close(nth)


class Block:
    """The texts of one block, as n-gram ids at every position, level by level.

    ``keys[k]`` are the ascending hashes of the block's distinct (k+1)-grams, ``at[k]``
    says which of them ends at a position (-1: none), ``first[k]`` where each ends first.
    A text follows an end: its first word makes a pair with it, and no longer n-gram."""

    def __init__(self, row):
        self.ids = row["doc_id"]
        self.held = np.array([bool(x) for x in row["held"]])
        self.n_tokens = np.asarray(row["n_tokens"], np.int64)
        self.ends = np.cumsum(self.n_tokens)
        self.starts = self.ends - self.n_tokens
        total = int(self.ends[-1])
        tokens = unpack(row["tokens"], total, np.uint32).astype(np.int32)
        words = unpack_sorted(row["words"], int(tokens.max()) + 1)
        self.nth = np.arange(total) - np.repeat(self.starts, self.n_tokens)
        self.train = np.repeat(~self.held, self.n_tokens)
        self.end = int(np.searchsorted(words, np.uint64(END)))
        first = np.zeros(len(words), np.int64)
        first[tokens[::-1]] = np.arange(total)[::-1]
        self.keys, self.at, self.first = [words], [tokens], [first]
        self.flat = self.grams = words[tokens]

    def extend(self, states: np.ndarray | None = None) -> None:
        """One level more: of the n-grams whose history ``states`` marks among ``keys[-1]``."""
        k = len(self.keys)
        history = np.concatenate([[self.end if k == 1 else -1], self.at[-1][:-1]])
        if k == 1:
            history[self.nth == 0] = self.end
        fine = (history >= 0) & (self.nth >= k - 1)
        if states is not None:
            fine[fine] = states[history[fine]]
        before = np.concatenate([[np.uint64(END)], self.grams[:-1]])
        before[self.nth == 0] = np.uint64(END)
        with np.errstate(over="ignore"):
            self.grams = _mix(before * np.uint64(0x9E3779B97F4A7C15) + self.flat + np.uint64(k))
        place = np.flatnonzero(fine)
        keys, first, own = np.unique(self.grams[place], return_index=True, return_inverse=True)
        at = np.full(len(self.flat), -1, np.int32)
        at[place] = own
        self.keys.append(keys)
        self.at.append(at)
        self.first.append(place[first])

    def history(self, k: int) -> np.ndarray:
        """For each (k+1)-gram, the k-gram before its last word."""
        p = self.first[k]
        own = self.at[k - 1][np.maximum(p - 1, 0)]
        return np.where(self.nth[p] == 0, self.end, own) if k == 1 else own

    def counts(self, k: int) -> np.ndarray:
        return np.bincount(self.at[k][self.train & (self.at[k] >= 0)], minlength=len(self.keys[k])).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bounds(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)


def _questions(block: Block, block_id: int, k: int, bounds: np.ndarray) -> list[tuple]:
    """Rows of ``ASKED`` about the (k+1)-grams of a block, one for each range of hashes."""
    keys, counts = block.keys[k], block.counts(k)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    return [(p, block_id, k, e - s, pack_sorted(keys[s:e]), pack(counts[s:e])) for p, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if e > s]


def _ask(order: int, parts: int):
    bounds = _bounds(parts)
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                for k in range(min(order, 2)):
                    if k:
                        block.extend()
                    made = _questions(block, row["block"], k, bounds)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)], names=["part", "block", "len", "n", "keys", "counts"])

    return run


def _joined(told: pd.DataFrame, k: int) -> pd.DataFrame:
    return told[told["len"] == k].sort_values("part")


def _states(told: pd.DataFrame, k: int) -> np.ndarray:
    """Which of a block's (k+1)-grams are states."""
    own = _joined(told, k)
    return np.concatenate([np.empty(0, bool), *[np.unpackbits(np.frombuffer(r, np.uint8), count=n).astype(bool) for r, n in zip(own["states"], own["n"], strict=True)]])


def _ask_more(level: int, parts: int):
    bounds = _bounds(parts)

    def run(blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = blocks.iloc[0]
        block = Block(row)
        for k in range(1, level + 1):
            block.extend(None if k == 1 else _states(told, k - 1))
        return pd.DataFrame(_questions(block, row["block"], level, bounds), columns=["part", "block", "len", "n", "keys", "counts"])

    return run


def _tell(asked: pd.DataFrame) -> pd.DataFrame:
    """Answer the questions of all blocks about one range of hashes."""
    out = []
    for k, rows in asked.groupby("len"):
        keys = np.concatenate([unpack_sorted(r, n) for r, n in zip(rows["keys"], rows["n"], strict=True)])
        counts = np.concatenate([unpack(r, n, np.uint32) for r, n in zip(rows["counts"], rows["n"], strict=True)])
        known, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, counts, len(known)).astype(np.uint64)
        answers = sums[at]
        cuts = np.concatenate([[0], np.cumsum(rows["n"])])
        told = rows[["part", "block", "len", "n"]].copy()
        told["counts"] = [pack(answers[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        told["states"] = [np.packbits(answers[s:e] >= STATE_COUNT).tobytes() if k else b"" for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        told["total"], told["distinct"] = 0, 0
        if k == 0:  # the totals go with one of the rows
            told.iloc[0, told.columns.get_loc("total")] = int(sums.sum())
            told.iloc[0, told.columns.get_loc("distinct")] = int((sums > 0).sum())
        out.append(told)
    return pd.concat(out)


class Automaton:
    """The slice of the backoff automaton that a block's texts visit, as tables.

    State 0 is the empty history; its arcs, one for each word, are ``word_weight`` and
    ``word_to``. Every other arc is a row of ``arc`` (state and word in one number,
    ascending), ``weight`` and ``to``; each of those states has one failure arc, ``fail``
    and ``fail_weight``."""

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int, mu: float = MU):
        order = len(counts)
        base = np.concatenate([[1], 1 + np.cumsum([len(c) for c in counts])])  # the first state of each level
        state_of = [np.where(counts[k] >= (STATE_COUNT if k else 1), base[k] + np.arange(len(counts[k])), 0) for k in range(max(1, order - 1))]
        if order == 1:
            state_of = [np.zeros(len(counts[0]), np.int64)]
        p = (counts[0] + 1.0) / (n + v + 1)
        self.word_weight, self.word_to = np.log10(p), state_of[0]
        self.start = int(base[0]) + block.end if order > 1 else 0
        self.fail = np.zeros(int(base[-1]), np.int64)
        self.fail_weight = np.zeros(int(base[-1]))
        arcs, weights, targets = [], [], []
        shorter = state_of[0]  # for each gram of the level below, the longest state that ends it
        for k in range(1, order):
            history, suffix, word = block.history(k), block.at[k - 1][block.first[k]], block.at[0][block.first[k]]
            total = counts[k - 1].astype(np.float64)
            p = (counts[k] + mu * p[suffix]) / (total[history] + mu)
            ends = shorter[suffix]
            longest = np.where(state_of[k] > 0, state_of[k], ends) if k < order - 1 else ends
            seen = np.flatnonzero(counts[k] > 0)
            arcs.append(((base[k - 1] + history[seen]).astype(np.uint64) << np.uint64(32)) | word[seen].astype(np.uint64))
            weights.append(np.log10(p[seen]))
            targets.append(longest[seen])
            span = slice(int(base[k - 1]), int(base[k]))
            self.fail_weight[span] = np.log10(mu / (total + mu))
            if k >= 2:
                self.fail[span] = below
            below, shorter = ends, longest
        if arcs:
            every = np.concatenate(arcs)
            by = np.argsort(every)
            self.arc, self.weight, self.to = every[by], np.concatenate(weights)[by], np.concatenate(targets)[by]
        else:
            self.arc, self.weight, self.to = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64)
        self.order = order

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word from each of some states: the states that follow, and the weights."""
        to, total, left = np.zeros(len(state), np.int64), np.zeros(len(state)), np.arange(len(state))
        state = state.copy()
        while len(left):
            now, w = state[left], word[left]
            empty = now == 0
            done = left[empty]
            total[done] += self.word_weight[w[empty]]
            to[done] = self.word_to[w[empty]]
            left, now, w = left[~empty], now[~empty], w[~empty]
            if not len(left) or not len(self.arc):
                state[left] = 0
                continue
            key = (now.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[at] == key
            done = left[hit]
            total[done] += self.weight[at[hit]]
            to[done] = self.to[at[hit]]
            left, now = left[~hit], now[~hit]
            total[left] += self.fail_weight[now]
            state[left] = self.fail[now]
        return to, total

    def read(self, block: Block) -> np.ndarray:
        """The log10 probability of each text, read once from left to right.

        A long text is read as pieces, each after the few words before it, which fix the
        state it starts in; all pieces advance together, a word at a time."""
        n_pieces = -(-block.n_tokens // PIECE_TOKENS)
        text = np.repeat(np.arange(len(n_pieces)), n_pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        begin = block.starts[text] + nth * PIECE_TOKENS
        warm = np.minimum(self.order - 1, nth * PIECE_TOKENS)
        upto = np.minimum(begin + PIECE_TOKENS, block.ends[text])
        at, length = begin - warm, upto - begin + warm
        by = np.argsort(-length, kind="stable")
        at, length, warm = at[by], length[by], warm[by]
        # A piece that starts with its text follows an end; the others' first state is forgotten while they warm up.
        state = np.where(at == block.starts[text[by]], self.start, 0)
        total = np.zeros(len(by))
        live = np.searchsorted(-length, -np.arange(length[0]), side="left")
        tokens = block.at[0]
        for t in range(int(length[0])):
            m = live[t]
            state[:m], weight = self.step(state[:m], tokens[at[:m] + t])
            total[:m] += np.where(warm[:m] <= t, weight, 0.0)
        out = np.zeros(len(n_pieces))
        np.add.at(out, text[by], total)
        return out


def _score(order: int, n: int, v: int, mu: float):
    def run(blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block, counts = Block(blocks.iloc[0]), []
        for k in range(order):
            if k:
                block.extend(None if k == 1 else _states(told, k - 1))
            own = _joined(told, k)
            counts.append(np.concatenate([np.empty(0, np.uint64), *[unpack(r, m, np.uint64) for r, m in zip(own["counts"], own["n"], strict=True)]]))
        c1 = counts[0][block.at[0]].astype(np.float64)
        base = np.add.reduceat(np.log10((c1 + 1) / (n + v + 1)), block.starts)
        known = np.add.reduceat((c1 > 0).astype(np.int64), block.starts)
        automaton = Automaton(block, counts, n, v, mu)
        del counts, c1, told
        block.flat = block.grams = None
        score = automaton.read(block)
        ids = pd.array([None if x is None or x != x else int(x) for x in block.ids], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": block.held, "n_tokens": block.n_tokens, "n_known": known, "train_tokens": n, "base_score": base, "score": score})

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: float = MU) -> DataFrame:
    """Score every whole text under a model learnt from the texts whose id is not held out.

    A text's tokens are its words (A-Z lower-cased) and one end. A null text counts
    as empty and is one token long; a null id is a training text; repeated rows count
    and come back once each; other columns are ignored; an empty table gives no rows.
    n-grams are told apart by 64-bit hashes. Words or n-grams that training lacks
    have count zero and cost what the smoothing says.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    if order < 1:
        raise ValueError("order must be positive")
    made = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_make_blocks, BLOCKS)
    blocks = staged(made, "blocks")
    size, n_blocks = blocks.agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)), F.count("*")).first()
    # Tasks grow in number with the corpus: one for a range of hashes, one for a block.
    parts, tasks = max(8, ceil((size or 0) * order / RANGE_TOKENS)), max(8, n_blocks)
    tell = lambda asked, k: staged(asked.repartition(parts, "part").groupBy("part").applyInPandas(_tell, TOLD), f"answers_{k}")
    dealt = lambda df: df.repartition(tasks, "block").groupBy("block")
    told = tell(blocks.mapInArrow(_ask(order, parts), ASKED), 1)
    n, v = told.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    told = told.drop("total", "distinct")
    for k in range(2, order):
        states = told.where("len > 0").select("part", "block", "len", "n", "states")
        asked = dealt(blocks).cogroup(dealt(states)).applyInPandas(_ask_more(k, parts), ASKED)
        told = told.unionByName(tell(asked, k).drop("total", "distinct"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt(blocks).cogroup(dealt(told)).applyInPandas(_score(order, n, v, mu), out)
