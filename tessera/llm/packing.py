"""Filling containers of fixed capacity with items of varying length (problem 9)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .tokens import TOKENIZERS, encode, encoding, rank_file

ASSIGNED = "doc_id long, part int, start_token long, n_tokens long, container_id long"


def harmonic(sizes: list[int], capacity: int, classes: int = 16) -> list[int]:
    """The bin (0, 1, ...) of each item; sizes from 0 to ``capacity``.

    Class j < ``classes`` has the sizes in (capacity/(j+1), capacity/j], and each of its bins takes j of its items
    (the last fewer); the space a bin then has left takes the largest still unplaced items of later classes that fit.
    Sizes of capacity/``classes`` and less are one class, whose bins are filled in the same way. Items of size
    0 are dealt over the bins in turn.
    """
    held: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        held.setdefault(s, []).append(i)
    empty = held.pop(0, [])
    left = sorted(held)  # sizes with unplaced items
    bins = [-1] * len(sizes)
    n = 0

    def take(most: int, b: int) -> int:
        """Place one item of the largest size <= most; its size, or 0."""
        k = bisect_right(left, most)
        if not k:
            return 0
        s = left[k - 1]
        bins[held[s].pop()] = b
        if not held[s]:
            del left[k - 1]
        return s

    while left:
        j = min(capacity // left[-1], classes)
        floor = capacity // (j + 1) if j < classes else 0  # sizes above it are of class j
        room = capacity
        for _ in range(j if j < classes else 1):
            if left and left[-1] > floor and left[-1] <= room:
                room -= take(left[-1], n)
        while room and (s := take(room, n)):
            room -= s
        n += 1
    for k, i in enumerate(empty):
        bins[i] = k % max(1, n)
    return bins


def fill_containers(
    documents: DataFrame,
    capacity: int = 2048,
    name: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    block: int = 50_000,
) -> DataFrame:
    """(doc_id, part, start_token, n_tokens, container_id): every text of ``documents`` in containers of ``capacity``.

    A text's size is its number of tokens. Only a text over the capacity is split, into full containers (each a bin of
    its own) and a rest that is packed as an item; part counts its pieces from 0. Null and empty texts are items of
    size 0, with part 0. Each worker packs blocks of up to ``block`` of its own items by harmonic(), so nothing is
    shuffled, no size or source gathers in one task, and at most one container of a block is left half full by the
    end of its items. Container ids are unique; they follow from the partitions in which the input is read. Every
    input row comes out, repeated rows too.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    ranks = rank_file(documents.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        base = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal base
            open_ = [(i, r[3]) for i, r in enumerate(rows) if r[3] < capacity]
            bins = harmonic([s for _, s in open_], capacity)
            at, used = [0] * len(rows), max(bins, default=-1) + 1
            for (i, _), b in zip(open_, bins):
                at[i] = base + b
            for i, r in enumerate(rows):
                if r[3] == capacity:
                    at[i] = base + used
                    used += 1
            base += used
            cols = [list(c) for c in zip(*rows)]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            out = [pa.array(c, t) for c, t in zip(cols, types)] + [pa.array(at, pa.int64())]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=["doc_id", "part", "start_token", "n_tokens", "container_id"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                n = len(encode(enc, text))
                for part, start in enumerate(range(0, max(n, 1), capacity)):
                    rows.append((doc, part, start, min(capacity, n - start)))
                if len(rows) >= block:
                    yield packed()
        if rows:
            yield packed()

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, ASSIGNED)


def container_fill(assigned: DataFrame, capacity: int = 2048) -> DataFrame:
    """(capacity, containers, items, tokens, fill): how full the containers are over all; fill null without any."""
    bins = assigned.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return bins.agg(
        F.lit(capacity).alias("capacity"),
        F.count("*").alias("containers"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        (F.sum("tokens") / (F.count("*") * capacity)).alias("fill"),
    )
