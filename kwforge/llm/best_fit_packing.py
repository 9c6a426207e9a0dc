"""Operator 4, best-fit packing: local best fit, then a tree of merges over underfull bins.

Every document becomes its ids and one end id. One longer than `capacity` is cut into a first piece, which may be
shorter, and whole pieces of `capacity` ids. Whole pieces are sequences of their own. Each task packs its other pieces
best-fit in decreasing order and emits bins; a bin within `slack` ids of full is done. The others are items of the
next round: rounds read fewer and fewer tasks, about `items_per_task` bins each, until one round no longer saves a
share of `least_gain` of its bins. A bin carries its pieces as packed records of 28 bytes; pieces have an id at least,
so a bin has at most `capacity` of them.

Nulls: a null or empty text is one piece that holds the end id alone. A null id stays null. Repeated rows are
documents of their own. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm.common import cut, drop_cut, table
from kwforge.llm.tokens import encode

PIECE = np.dtype([("doc", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BIN = "fill int, items binary"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit in decreasing order: each item goes to the fullest bin that still has room for it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if some bin has room r
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= size
        if r:
            room[r].append(b)
            open_rooms |= 1 << r
    return bins


def _batch(fills: list[int], items: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fills, pa.int32()), pa.array(items, pa.binary())], names=["fill", "items"])


def _merge(fills: list[int], items: list[bytes], capacity: int) -> pa.RecordBatch:
    sizes = np.array(fills, np.int64)
    made = best_fit(sizes, capacity)
    return _batch([int(sizes[b].sum()) for b in made], [b"".join(items[i] for i in b) for b in made])


def first_bins(df: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenise, cut and pack within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills, items = [], []
        for batch in batches:
            full = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                ends = range(first, len(ids) + 1, capacity)
                out = np.zeros(len(ends), PIECE)
                for k, end in enumerate(ends):
                    start = 0 if k == 0 else end - capacity
                    out[k] = (doc or 0, doc is None, k, start, end - start, zlib.crc32(ids[start:end].tobytes()))
                for p in out:
                    if p["length"] == capacity:
                        full.append(p.tobytes())
                    else:
                        fills.append(int(p["length"]))
                        items.append(p.tobytes())
            if full:
                yield _batch([capacity] * len(full), full)
        if fills:
            yield _merge(fills, items, capacity)

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, BIN)


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, slack: int = 2,
    items_per_task: int = 200_000, least_gain: float = 0.0005, max_rounds: int = 6,
) -> DataFrame:
    """Bins of pieces, one row a sequence: sequence_id, fill, items."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills, items = [], []
        for batch in batches:
            fills += batch.column(0).to_pylist()
            items += batch.column(1).to_pylist()
        if fills:
            yield _merge(fills, items, capacity)

    bins = cut(first_bins(df, id_col, text_col, capacity, end_id), "bins")
    done, was = bins.filter(F.col("fill") >= capacity - slack), bins.filter(F.col("fill") < capacity - slack)
    n, tasks = was.count(), max(1, bins.rdd.getNumPartitions())
    for _ in range(max_rounds):
        if n < 2:
            break
        fewer = max(1, -(-n // items_per_task), tasks // 8)
        # by content and place in the written table: repeated rows make equal bins, which may be a large part of all
        dealt = was.withColumn("at", F.monotonically_increasing_id()).repartition(fewer, F.xxhash64("items", "at")).drop("at")
        merged = cut(dealt.mapInArrow(merge, BIN), "bins")
        done = done.unionByName(merged.filter(F.col("fill") >= capacity - slack))
        was = merged.filter(F.col("fill") < capacity - slack)
        saved = n - merged.count()
        last, tasks = fewer == tasks, fewer
        if (saved < least_gain * n and tasks == max(1, -(-n // items_per_task))) or (last and not saved):
            break
        n = was.count()
    return done.unionByName(was).withColumn("sequence_id", F.monotonically_increasing_id())


def pieces(bins: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a piece with its place in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            got = np.frombuffer(b"".join(blobs), PIECE)
            per = np.array([len(b) // PIECE.itemsize for b in blobs], np.int64)
            length = got["length"].astype(np.int64)
            ends = np.cumsum(length)
            firsts = np.cumsum(per) - per
            base = (ends - length)[firsts] if len(got) else ends
            offset = ends - length - np.repeat(base, per)
            doc = pa.array(got["doc"], mask=got["null"].astype(bool))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(got["piece"]), pa.array(got["start"]), pa.array(length), pa.array(got["crc"].astype(np.int64)), pa.array(np.repeat(np.array(batch.column(0)), per)), pa.array(offset)],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return bins.select("sequence_id", "items").mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(pack(table(spark, sf_dir, "documents")))
