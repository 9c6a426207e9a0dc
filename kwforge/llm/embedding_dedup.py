"""Operator 6, embedding near-duplicates by a pivot-permutation index.

A vector is described by its `near` closest pivots, in order, among `pivots` reference vectors, which are a bounded
sample drawn by hash and thinned until no two are near each other. An inverted list holds, for each label and pivot, the vectors that have it among their closest.
Two vectors of a label that share at least `shared` pivots are candidates, and a candidate is a link if its cosine, in
double precision, reaches the threshold.

Equal vectors of a label are one entry with a count. A list is dealt into blocks of about `block` entries, and each
pair of blocks is one group: it multiplies the two blocks, masks the pairs by their shared-pivot count, and counts a
pair only in the first list that both are in, so no pair is counted twice. A group returns one row for each entry with
links: how many it has found there and one link of a spanning forest; pairs never leave a group. The entries of a list
meet its length, and the rows of an entry its outcome, dealt into parts, as either may be a third of all rows.

Nulls: a null label, a null, empty or zero vector, or one with a null or non-finite component links with nothing. Vectors
of different lengths never link. Repeated rows (the same id) count as vectors of their own in n_links and share one
outcome. A row with a null id links with nothing: no links, a null component, kept. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm.common import components, cut, drop_cut, each_salt, salt, salts_met, table

#: Vector lengths that get pivots of their own; vectors of any other length are compared in one list.
LENGTHS = 32
#: Rows of one id that are made in one go.
RUN = 1 << 16


def unit_vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows that hold a usable vector, their unit vectors in double precision)."""
    at, out = [], []
    for i, x in enumerate(batch.column(2)):
        if not x.is_valid or not batch.column(1)[i].is_valid or not batch.column(0)[i].is_valid:
            continue
        v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
        if len(v) and np.isfinite(v).all():
            top = np.abs(v).max()
            if top > 0:
                v = v / top
                at.append(i)
                out.append(v / np.sqrt((v * v).sum()))
    return np.array(at, np.int64), out


def spread(units: np.ndarray, most: int, apart: float) -> np.ndarray:
    """At most `most` rows, each in turn with a cosine under `apart` to all taken before; the first is always taken."""
    out = np.empty((min(most, len(units)), units.shape[1]))
    n = 0
    for v in units:
        if n == most:
            break
        if not n or (out[:n] @ v).max() < apart:
            out[n] = v
            n += 1
    return out[:n]


def choose_pivots(vectors: DataFrame, pivots: int, near: int, apart: float, drawn_for: int = 4) -> dict[int, np.ndarray]:
    """By vector length: unit pivots that are spread out, at most `pivots` of a length, from a sample drawn by hash of the id.

    The sample holds `drawn_for` vectors for each pivot, and every one of the `LENGTHS` most frequent lengths has its
    share of it, `near` vectors at least. A group of near copies gives few pivots, however large it is, so its members are
    described by the same pivots outside it. Where fewer than `near` are found, random directions fill up: then all
    vectors of the length share all pivots and are compared with each other.
    """
    sized = vectors.select("id", "label", "vector", F.size("vector").alias("size")).filter("size > 0")
    sizes = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(LENGTHS).collect()}
    total = sum(sizes.values())
    out = {}
    for size, n in sizes.items():
        share = max(near, drawn_for * pivots * n // total)
        drawn = sized.filter(F.col("size") == size).select("id", "label", "vector").orderBy(F.xxhash64("id"), "id").limit(share).toArrow().combine_chunks().to_batches()
        units = [v for batch in drawn for v in unit_vectors(batch)[1]]
        if units:
            found = spread(np.array(units), max(near, pivots * n // total), apart)
            more = np.random.default_rng(size).normal(size=(max(0, near - len(found)), size))
            out[size] = np.vstack([found, more / np.linalg.norm(more, axis=1, keepdims=True)])
    return out


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray], near: int) -> DataFrame:
    """(id, label, unit, key, nearest) for every usable vector; nearest holds pivot numbers, closest first. A length without pivots has the same numbers for all."""
    label = vectors.schema["label"].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, units = unit_vectors(batch)
            nearest = []
            for v in units:
                p = sent.value.get(len(v))
                nearest.append(list(range(near)) if p is None else np.argsort(-(p @ v), kind="stable")[:near].tolist())
            blobs = [v.tobytes() for v in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(blobs, pa.binary()), pa.array(nearest, pa.list_(pa.int32()))],
                names=["id", "label", "unit", "nearest"],
            )

    return vectors.mapInArrow(run, f"id long, label {label}, unit binary, nearest array<int>").withColumn("key", F.sha2("unit", 256))


def _group(pdf: pd.DataFrame, threshold: float, shared: int, block: int) -> pd.DataFrame:
    """Links between blocks i and j of one inverted list."""
    i, j, pivot = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), int(pdf["pivot"].iloc[0])
    pdf = pdf.sort_values("rep")
    sides = [pdf[pdf["mine"] == k].reset_index(drop=True) for k in (i, j)]
    found: dict[int, list[int]] = {}

    def put(rep: int, n: int, other: int) -> None:
        x = found.setdefault(rep, [0, other])
        x[0] += n

    def side(s: pd.DataFrame):
        sizes = s["unit"].map(len).to_numpy()
        top = int(max((max(x) for x in s["nearest"]), default=0)) + 1
        m = np.zeros((len(s), top), np.float32)
        for k, x in enumerate(s["nearest"]):
            m[k, x] = 1
        return sizes, m

    for a0 in range(0, len(sides[0]), block):
        a = sides[0].iloc[a0 : a0 + block]
        for b0 in range(a0 if i == j else 0, len(sides[1]), block):
            b = sides[1].iloc[b0 : b0 + block]
            (sa, ma), (sb, mb) = side(a), side(b)
            w = min(ma.shape[1], mb.shape[1])
            ma, mb = ma[:, :w], mb[:, :w]
            mask = (ma @ mb.T >= shared) & (ma[:, :pivot] @ mb[:, :pivot].T == 0) & (sa[:, None] == sb[None, :])
            if i == j and a0 == b0:
                mask = np.triu(mask, 1)
            for size in np.unique(sa):
                ka, kb = np.flatnonzero(sa == size), np.flatnonzero(sb == size)
                if not len(kb) or not mask[np.ix_(ka, kb)].any():
                    continue
                va = np.frombuffer(b"".join(a["unit"].iloc[ka]), np.float64).reshape(len(ka), -1)
                vb = np.frombuffer(b"".join(b["unit"].iloc[kb]), np.float64).reshape(len(kb), -1)
                good = mask[np.ix_(ka, kb)] & (va @ vb.T >= threshold)
                ra, rb = a["rep"].to_numpy()[ka], b["rep"].to_numpy()[kb]
                ca, cb = a["copies"].to_numpy()[ka], b["copies"].to_numpy()[kb]
                n_a, n_b = good @ cb, ca @ good
                for k in np.flatnonzero(n_a):
                    put(int(ra[k]), int(n_a[k]), int(rb[good[k].argmax()]))
                for k in np.flatnonzero(n_b):
                    put(int(rb[k]), int(n_b[k]), int(ra[good[:, k].argmax()]))
                # one link an entry may leave parts of this block apart: add links that join them
                _join(good, ra, rb, found)
    rows = [(r, n, o) for r, (n, *others) in found.items() for n, o in [(n, others[0]), *((0, x) for x in others[1:])]]
    return pd.DataFrame(rows, columns=["rep", "n", "other"]).astype("int64")


def _join(good: np.ndarray, ra: np.ndarray, rb: np.ndarray, found: dict[int, list[int]]) -> None:
    """Add the links that a spanning forest of this block needs beyond one link an entry."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k in np.flatnonzero(good.any(1)):
        a = root(int(ra[k]))
        first = True
        for m in np.flatnonzero(good[k]):
            b = root(int(rb[m]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                a = min(a, b)
                if not first:
                    found[int(ra[k])].append(int(rb[m]))
            first = False


def link(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    pivots: int | None = None, near: int = 8, shared: int = 2, block: int = 512, apart: float = 0.8,
) -> DataFrame:
    """id, n_links, component_id, kept for every vector.

    pivots (default: one for 64 vectors, 64 at least and 2,048 at most) bounds the sample that the index is fitted on; no two
    pivots have a cosine of `apart` or more.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = vectors.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.col("label").isNotNull())
    if pivots is None:
        pivots = max(64, min(2048, usable.count() // 64))
    described = cut(describe(usable, choose_pivots(usable, pivots, near, apart), near), "described")
    described_parts = described.select("id", "label", "key", salt("id").alias("part"))
    entries = described.withColumn("part", salt("id")).groupBy("label", "key").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("unit").alias("unit"), F.any_value("nearest").alias("nearest"), salts_met("part").alias("mask")
    )
    entries = cut(entries, "entries")
    listed = entries.select("label", "rep", "copies", "unit", "nearest", salt("rep").alias("part"), F.explode("nearest").alias("pivot"))
    lengths = entries.select("label", salt("rep").alias("part"), F.explode("nearest").alias("pivot")).groupBy("label", "pivot").agg(F.count("*").alias("n"), salts_met("part").alias("mask")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    lengths = lengths.select("label", "pivot", parts.alias("parts"), each_salt().alias("part"))
    dealt = listed.join(lengths, ["label", "pivot", "part"]).withColumn("mine", mine).withColumn("pair", F.explode(pairs))
    dealt = dealt.select("label", "pivot", "rep", "copies", "unit", "nearest", "mine", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
    found = cut(dealt.groupBy("label", "pivot", "i", "j").applyInPandas(lambda pdf: _group(pdf, threshold, shared, block), "rep long, n long, other long"), "found")
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts_of = components(found, "rep", "other").select(F.col("id").alias("rep"), "component")
    # the least id of a component is the least rep, as a rep is the least id of its entry
    result = entries.select("label", "key", "rep", "copies", "mask").join(linked, "rep", "left").join(parts_of, "rep", "left")
    result = result.select("label", "key", each_salt().alias("part"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    by_id = described_parts.join(result, ["label", "key", "part"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    # all rows of an id come out alike, so they are counted and repeated instead of joined; rows without an id need neither
    counted = vectors.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).join(by_id, "id", "left")
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RUN))))
    each = runs.withColumn("row", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + (RUN - 1), F.col("n") - 1))))
    component = F.coalesce("component_id", "id")
    out = each.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    alone = vectors.filter("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(alone).withColumnRenamed("id", id_col)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
