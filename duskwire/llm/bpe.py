"""Byte-level BPE encoding and decoding by tree concatenation.

A text is halved until its pieces are short, the pieces are encoded in parallel
threads, and neighbours are joined bottom-up. At a join a window around the cut is
encoded afresh and grows until both of its sides agree exactly with what the halves
hold: a token boundary with the same token on either side of it, some characters
clear of both the cut and the window's end. Two facts make that exact. Where words
begin depends on a few characters only, so clear of the cuts both encodings split
words alike; and within a word a sequence of BPE tokens is the encoding of its
bytes if and only if each adjacent pair is, and across the agreed boundary the pair
is the same one in both.
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of up to so many characters are encoded at once.
LEAF = 32768
#: Tokens of a window on each side at first, and the characters that must lie clear of an agreed boundary.
WINDOW, CLEAR = 32, 8


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class Codec:
    """Encoder and decoder for one ``tokenizers`` JSON file of the byte-level BPE kind.

    The merge loop runs in ``tiktoken``, which agrees with the file's own library
    where merge order and id order coincide; the constructor checks that they do.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not plain byte-level BPE")
        letters = _byte_letters()
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: added tokens with options are not supported")
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.added}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError(f"{path}: merges are not in id order")
        self.core = tiktoken.Encoding("duskwire", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        size = max([*ranks.values(), *self.added.values()]) + 1
        self.pieces = [b""] * size
        for b, i in [*ranks.items(), *((c.encode(), i) for c, i in self.added.items())]:
            self.pieces[i] = b
        self.lengths = np.array([len(b) for b in self.pieces], np.int64)

    def encode(self, text: str, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
        """Token ids of a whole text; strings of added tokens become those tokens."""
        for mark, i in self.added.items():
            if mark in text:
                parts = [self.encode(p, leaf, pool) for p in text.split(mark)]
                out = [parts[0]]
                for p in parts[1:]:
                    out += [np.array([i], np.int32), p]
                return np.concatenate(out)
        return self._plain(text) if len(text) <= leaf else self._tree(text, leaf, pool)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), np.int32)

    def _tree(self, text: str, leaf: int, pool: ThreadPoolExecutor | None) -> np.ndarray:
        parts = [text]
        while max(map(len, parts)) > leaf:
            parts = [h for p in parts for h in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > leaf else (p,))]
        nodes = list((pool.map if pool else map)(lambda p: (p.encode(), self._plain(p)), parts))
        while len(nodes) > 1:
            pairs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
            nodes = list((pool.map if pool else map)(lambda p: self._join(*p) if len(p) == 2 else p[0], pairs))
        return nodes[0][1]

    def _join(self, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        raw, a, b = left[0] + right[0], left[1], right[1]
        cut, w = len(left[0]), WINDOW
        ends_a, ends_b = np.cumsum(self.lengths[a]), cut + np.cumsum(self.lengths[b])
        while True:
            i, j = max(0, len(a) - w), min(len(b), w)
            lo, hi = int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1]) if j else cut
            while lo and raw[lo] & 0xC0 == 0x80:  # a token may end inside a character
                i -= 1
                lo = int(ends_a[i - 1]) if i else 0
            while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                j += 1
                hi = int(ends_b[j - 1])
            fresh = self._plain(raw[lo:hi].decode())
            ends = lo + np.cumsum(self.lengths[fresh])
            x = (0, 0) if i == 0 else self._agree(a, ends_a, fresh, ends, lo + 4 * CLEAR, cut - 4 * CLEAR)
            y = (len(fresh), len(b)) if hi == len(raw) else self._agree(fresh, ends, b, ends_b, cut + 4 * CLEAR, hi - 4 * CLEAR)
            if x and y and x[1] <= y[0]:
                return raw, np.concatenate([a[: x[0]], fresh[x[1] : y[0]], b[y[1] :]])
            w *= 2

    @staticmethod
    def _agree(p, ends_p, q, ends_q, lo: int, hi: int) -> tuple[int, int] | None:
        """Token counts before a boundary in [lo, hi] that both have, with equal tokens on both of its sides."""
        _, at, to = np.intersect1d(ends_p, ends_q, assume_unique=True, return_indices=True)
        ok = (ends_p[at] >= lo) & (ends_p[at] <= hi) & (at + 1 < len(p)) & (to + 1 < len(q))
        at, to = at[ok], to[ok]
        ok = (p[at] == q[to]) & (p[at + 1] == q[to + 1])
        return (int(at[ok][0]) + 1, int(to[ok][0]) + 1) if ok.any() else None

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, as ``decode(ids, skip_special_tokens=False)`` gives it;
        bytes that are not UTF-8 become the replacement character."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _in_parts(batch: pa.RecordBatch, size: int):
    for s in range(0, batch.num_rows, size):
        yield batch.slice(s, size)


def _others(df: DataFrame, *made: str) -> DataFrame:
    return df.drop(*made)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Add ``ids_col`` (array of int): the token ids of every whole text.

    A null text counts as empty and gives an empty array, as an empty text does.
    Rows stay one for one, with every other column as it was; a column that is
    already named ``ids_col`` is replaced. One map over the rows, without a shuffle.
    """
    path = path or default_path()
    kept = _others(df, ids_col)
    at = kept.columns.index(text_col)

    def run(batches):
        c = codec(path)
        with ThreadPoolExecutor(max(1, min(2, os.cpu_count() or 1))) as pool:
            for b in batches:
                for part in _in_parts(b, 512):
                    ids = [c.encode(t or "", leaf, pool) for t in part.column(at).to_pylist()]
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[*part.schema.names, ids_col])

    schema = kept.withColumn(ids_col, F.array().cast("array<int>")).schema
    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``out_col`` (string): the text that each array of ids stands for.

    A null array gives an empty text; an id outside the vocabulary, or a null one,
    raises. Rows stay one for one; a column already named ``out_col`` is replaced.
    """
    path = path or default_path()
    kept = _others(df, out_col)
    at = kept.columns.index(ids_col)

    def run(batches):
        c = codec(path)
        for b in batches:
            for part in _in_parts(b, 512):
                col = part.column(at)
                flat, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                texts = [c.decode(flat[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    schema = kept.withColumn(out_col, F.lit("").cast("string")).schema
    return kept.mapInArrow(run, schema)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and decoding back."""
    both = decode(encode(df.select(id_col, text_col), text_col, "ids", path).drop(text_col), "ids", "decoded", path)
    return both.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
