"""Rows in chunks, in order of a value, and through a cache of bounded size."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(rows: DataFrame, size: int, by: list[str], order: list[str]) -> DataFrame:
    """``chunk`` of each row: runs of ``size`` rows, in ``order`` inside each group of ``by``; one chunk if ``size`` isn't positive."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("chunk", F.floor((nth - 1) / size) if size > 0 else F.lit(0).cast("long"))


def chunks_by(rows: DataFrame, joined: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], by: list[str], order: list[str]) -> DataFrame:
    """``chunk`` of each row: a row goes on in the chunk of the one before it if ``joined(before, now)`` holds.

    ``before`` and ``now`` give a column of either row by name. A null condition starts a chunk.
    """
    over = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.row_number().over(over) == 1, 0).otherwise(F.when(joined(lambda c: F.lag(c).over(over), F.col), 0).otherwise(1))
    return rows.withColumn("_new", new).withColumn("chunk", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_new")


def sorted_by(rows: DataFrame, value: Column, *ties: str, descending: bool = False) -> DataFrame:
    return rows.orderBy(value.desc() if descending else value.asc(), *ties)


class RecentCache:
    """At most ``capacity`` entries; the one not used for longest goes first."""

    def __init__(self, capacity: int):
        self.capacity, self._held = capacity, OrderedDict()

    def __contains__(self, key) -> bool:
        return key in self._held

    def __len__(self) -> int:
        return len(self._held)

    def get(self, key, default=None):
        if key not in self._held:
            return default
        self._held.move_to_end(key)
        return self._held[key]

    def put(self, key, value) -> None:
        self._held[key] = value
        self._held.move_to_end(key)
        if len(self._held) > self.capacity:
            self._held.popitem(last=False)

    def remove(self, key) -> None:
        self._held.pop(key, None)

    def clear(self) -> None:
        self._held.clear()

    def keys(self) -> list:
        return list(self._held)


def cache_hits(accesses: DataFrame, capacity: int) -> DataFrame:
    """``owner, seq, key, hit``: which accesses of each owner a cache of ``capacity`` keys would have served.

    ``accesses`` has ``owner, seq, key``. Each owner's accesses stream past one cache in
    order of ``seq``; a task holds ``capacity`` keys, however many rows an owner has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, cache = object(), RecentCache(capacity)
        for b in batches:
            hits = []
            for who, key in zip(b["owner"], b["key"], strict=True):
                if who != owner:
                    owner, cache = who, RecentCache(capacity)
                hits.append(key in cache)
                cache.put(key, True)
            yield b.assign(hit=hits)

    rows = accesses.select("owner", "seq", "key")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition("owner").sortWithinPartitions("owner", "seq").mapInPandas(run, f"{kinds}, hit boolean")
