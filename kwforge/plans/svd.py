"""Truncated singular value decomposition of the sparse object-by-keyword matrix, by a randomised range finder.

The matrix X has a row an object and a column a keyword. Power steps with X X^T bring a block of p columns to the leading
singular vectors, until the values that are asked for no longer change; columns are made orthonormal by the Cholesky factor
of their p x p inner products. The most frequent keywords, FREQUENT at most, have nearly all pairs. Their part of the
block is a matrix of bounded size that all tasks get, so an object's row is summed where the object's keywords lie, and a
task hands on one row for each keyword that it met, whatever the number of its pairs. All other keywords are joined by
shuffles, pair by pair. To need few such steps, the block first converges over the frequent keywords alone, which give a
start and no result: the steps that count are over all keywords.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwforge.sources.shared import cut, drop_cut

#: Keywords whose part of a block goes to every task.
FREQUENT = 1 << 17
#: Pairs of a task, which has a row for each of its frequent keywords to hand on.
PAIRS = 1 << 24


def _inner(block: DataFrame, p: int) -> np.ndarray:
    """The p x p inner products of a block's columns."""
    ij = [(i, j) for i in range(p) for j in range(i, p)]
    row = block.agg(*(F.sum(F.get("y", F.lit(i)) * F.get("y", F.lit(j))).alias(f"g{i}_{j}") for i, j in ij)).first()
    g = np.zeros((p, p))
    for i, j in ij:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g


def _times(t: np.ndarray) -> Column:
    """A block's row times a small matrix."""
    return F.array(*(sum((F.get("y", F.lit(i)) * F.lit(float(t[i, j])) for i in range(t.shape[0])), F.lit(0.0)) for j in range(t.shape[1])))


def _orthonormal(g: np.ndarray) -> np.ndarray:
    """What makes columns with these inner products orthonormal."""
    g = g + np.eye(len(g)) * max(g.trace(), 1e-300) * 1e-14  # columns may depend on each other
    return np.linalg.inv(np.linalg.cholesky(g)).T


def _summed(rows: DataFrame, key: str, p: int) -> DataFrame:
    return rows.groupBy(key).agg(F.array(*(F.sum(F.get("y", F.lit(i))) for i in range(p))).alias("y"))


def _frequent(pairs: DataFrame, most: int) -> DataFrame:
    """(kw, id): keywords from a frequency on that `most` at most reach, numbered from 0. Only counts of counts reach the driver."""
    counts = cut(pairs.groupBy("kw").agg(F.count("*").alias("n")), "counts")
    least, taken = None, 0
    for n, words in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        taken += words
        if taken > most:
            break
        least = n
    chosen = counts.filter(F.col("n") >= F.lit(least)).select("kw", (F.row_number().over(Window.orderBy("kw")) - 1).alias("id"))
    chosen = cut(chosen, "frequent")
    drop_cut(counts)
    return chosen


def _rows(objects: DataFrame, z: np.ndarray, t: np.ndarray, keep: bool) -> DataFrame:
    """(obj_id, id, y): with keep the objects' rows of X times a block, and by id what a task's objects add to X^T times these
    rows (an id a frequent keyword) and to their inner products (the ids after).

    objects: obj_id, ids (of frequent keywords), r (null, or the sum of the block's rows of its other keywords, before t).
    """
    told = objects.sparkSession.sparkContext.broadcast(np.ascontiguousarray(z.T))
    width, p = z.shape

    def batch_of(ids, at, y: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, p), pa.int32()), pa.array(y.ravel()))
        return pa.RecordBatch.from_arrays([ids, at, lists], names=["obj_id", "id", "y"])

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, back, kind = told.value, np.zeros((p, width + p)), None
        for batch in batches:
            ids, r, kind = batch.column("ids"), batch.column("r"), batch.column("obj_id").type
            n, met = len(ids), ids.flatten().to_numpy()
            of = np.repeat(np.arange(n), ids.value_lengths().to_numpy())
            y = np.stack([np.bincount(of, z[j][met], n) for j in range(p)], 1).astype(float)  # counts of nothing are integers
            has = r.is_valid().to_numpy(zero_copy_only=False)
            if has.any():
                y[has] += r.flatten().to_numpy().reshape(-1, p) @ t
            for j in range(p):
                back[j, :width] += np.bincount(met, y[of, j], width)[:width]
            back[:, width:] += y.T @ y
            if keep:
                yield batch_of(batch.column("obj_id"), pa.nulls(n, pa.int32()), y)
        if kind is not None:
            met = np.flatnonzero(back.any(0)).astype(np.int32)
            for i in range(0, len(met), 1 << 13):
                some = met[i : i + (1 << 13)]
                yield batch_of(pa.nulls(len(some), kind), pa.array(some), np.ascontiguousarray(back[:, some].T))

    return objects.mapInArrow(through, f"obj_id {objects.schema['obj_id'].dataType.simpleString()}, id int, y array<double>")


def _back(rows: DataFrame, width: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(X^T times the rows, over frequent keywords; inner products of the rows)."""
    got = _summed(rows.filter("id IS NOT NULL"), "id", p).toArrow()
    out = np.zeros((width + p, p))
    out[got["id"].to_numpy()] = got["y"].combine_chunks().flatten().to_numpy().reshape(-1, p)
    return out[:width], out[width:]


def _top(values: np.ndarray, was: np.ndarray | None, k: int, tolerance: float) -> tuple[np.ndarray, bool]:
    """(the k largest of ascending values, whether they are what they were)."""
    top = values[::-1][:k]
    return top, was is not None and bool((np.abs(top - was) <= tolerance * max(top[0], 1e-300)).all())


def truncated_svd(pairs: DataFrame, k: int = 2, extra: int = 10, most: int = 40, tolerance: float = 1e-10, frequent: int = FREQUENT) -> tuple[list[float], DataFrame, DataFrame]:
    """(k singular values, (obj_id, x) objects on the k axes, (kw, v) the axes) of distinct (obj_id, kw).

    Stops when a step changes no squared value by more than `tolerance` of the largest, after `most` steps at the latest.
    There are fewer values where the matrix has a lower rank. Objects are the rows of U S, axes those of V; signs are free.
    """
    p, spark = k + extra, pairs.sparkSession
    pairs = cut(pairs.select("obj_id", "kw"), "matrix")
    words = _frequent(pairs, frequent)
    width = words.count()
    told = pairs.join(F.broadcast(words), "kw", "left")
    objects = cut(told.groupBy("obj_id").agg(F.collect_list("id").alias("ids"), F.count("*").alias("n")), "objects")
    parts = max(spark.sparkContext.defaultParallelism, -(-(objects.agg(F.sum("n")).first()[0] or 0) // PAIRS))
    rare = cut(told.filter("id IS NULL").select("obj_id", "kw"), "rare")
    some_rare = rare.limit(1).count() > 0
    alone = objects.select("obj_id", "ids", F.lit(None).cast("array<double>").alias("r")).coalesce(parts)

    z, was = np.random.default_rng(1).choice([-1.0, 1.0], (width, p)), None
    for _ in range(most if width else 0):
        z, g = _back(_rows(alone, z, np.eye(p), keep=False), width, p)
        z = z @ _orthonormal(g)
        values, turn = np.linalg.eigh(z.T @ z)
        z = z @ turn[:, ::-1]  # the leading columns first
        was, same = _top(values, was, k, tolerance)
        if same:
            break

    t, told_rare = np.eye(p), None
    if some_rare:
        # of the columns that go on, the last have a start of their own among the other keywords
        p, own = k + extra // 2, extra // 4
        t, z = np.eye(p), z[:, :p]
        z[:, p - own :] = 0.0
        sign = lambda j: F.when(F.xxhash64("kw", F.lit(j)).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
        told_rare = rare.select("kw").distinct().select("kw", F.array(*(sign(j) if j >= p - own else F.lit(0.0) for j in range(p))).alias("y"))

    def product(z: np.ndarray, t: np.ndarray, others: DataFrame | None) -> DataFrame:
        """Written rows of X times the block that is z for frequent keywords and others times t for all else."""
        if others is None:
            return cut(_rows(alone, z, t, keep=True), "rows")
        r = _summed(rare.join(others, "kw"), "obj_id", p).withColumnRenamed("y", "r")
        return cut(_rows(objects.select("obj_id", "ids").join(r.hint("merge"), "obj_id", "left").coalesce(parts), z, t, keep=True), "rows")

    was = None
    for _ in range(most if some_rare else 0):
        rows = product(z, t, told_rare)
        z, g = _back(rows, width, p)
        new = cut(_summed(rare.join(rows.filter("id IS NULL").select("obj_id", "y").hint("merge"), "obj_id"), "kw", p), "block")
        t = _orthonormal(g)
        z, told_rare = z @ t, new
        drop_cut(rows)
        values = np.linalg.eigvalsh(z.T @ z + t.T @ _inner(told_rare, p) @ t)
        was, same = _top(values, was, k, tolerance)
        if same:
            break

    s = _orthonormal(z.T @ z + (t.T @ _inner(told_rare, p) @ t if some_rare else 0.0))
    z, t = z @ s, t @ s
    rows = product(z, t, told_rare)
    values, axes = np.linalg.eigh(_back(rows, width, p)[1])
    order = [i for i in np.argsort(values)[::-1][:k] if values[i] > 1e-9 * max(values.max(), 1e-300)]
    axes = axes[:, order]
    v = words.join(spark.createDataFrame(pa.table({"id": pa.array(np.arange(width), pa.int32()), "v": pa.array((z @ axes).tolist(), pa.list_(pa.float64()))})), "id").select("kw", "v")
    if some_rare:
        v = v.unionByName(told_rare.select("kw", _times(t @ axes).alias("v")))
    return [float(np.sqrt(values[i])) for i in order], rows.filter("id IS NULL").select("obj_id", _times(axes).alias("x")), v
