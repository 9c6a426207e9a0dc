"""Operator 11, embedding whitening from an exact scatter matrix, kept in residues.

Entries c become whole numbers x = floor(64 c) + 1000000. The fit list holds each distinct x-vector once.

1. The distinct vectors are written; each task sums them (in two halves of 26 bits, so no sum overflows), which gives n, S
   and the largest |n x - S|.
2. Residue-number scatter: a task centres its vectors, y = n x - S, takes them modulo several primes below 2^20, and
   multiplies blocks of residues by themselves as doubles: a block is so short that every sum is below 2^53 and thus exact.
   The residues of the d (d + 1) / 2 entries are added over tasks by Spark. There are as many primes as the bound of the
   true entries asks for, n max|y|^2 on either side of zero.
3. The driver puts the sums together by Chinese remaindering into whole numbers without any rounding, divides by n^3 and
   decomposes the covariance in double precision. It holds d^2 numbers a prime, whatever the number of rows.
4. Each row is projected; the covariance of the whitened fit list is measured over that list in one more pass.

Vectors of different lengths are whitened apart, each length with its own fit list. Components whose eigenvalue is not above
the rounding of the largest one (all rows alike, a constant dimension, fewer rows than dimensions) have no whitened value
and are left out; the others keep their numbers, which are the first ones.

Cases: rows whose vector is null, or has a null or non-finite entry, or one of 2^46 and above, for which 64 c + 1000000 has no
exact double, are dropped; a vector without entries has no components. Repeated rows are projected each. A deviation
beyond a long is null. An empty table, or one without a usable row, gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm.common import cut, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries from here on have no exact x.
LARGEST = float(1 << 46)
#: Primes are below 2^20, so residues around zero are below 2^19, and so many rows of their products stay below 2^53.
PRIME_BITS, BLOCK = 20, 1 << 14
_HALF = 26
#: Names that users' columns can't have taken: the table is cut down to id and vector first.
_ID, _X = "id", "x"


class Fit(NamedTuple):
    """What a length's rows are projected with."""

    n: int
    sums: list[int]
    axes: np.ndarray  # d x k, unit columns
    values: np.ndarray  # k eigenvalues, falling
    explained: np.ndarray
    largest: int  # of |n x - S|


def whole_numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vector is usable."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(LARGEST)))  # false for NaN, which is above all
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))
    return df.filter(usable).select(F.col(id_col).alias(_ID), x.alias(_X)).filter(F.size(_X) > 0)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of x) for each length of vectors in a batch."""
    lists = batch.column(_X)
    sizes = np.asarray(lists.value_lengths(), np.int64)
    flat, ends = np.asarray(lists.flatten(), np.int64), np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _blocks(m: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, len(m), BLOCK):
        yield m[k : k + BLOCK]


def column_sums(distinct: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """{length: (n, S, largest |n x - S|)} of the fit list: two numbers a dimension from each task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, m in _by_length(batch):
                d = m.shape[1]
                got = found.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64), m.min(0), m.max(0)])
                got[0] += len(m)
                got[1] += (m >> _HALF).sum(0)
                got[2] += (m & ((1 << _HALF) - 1)).sum(0)
                got[3], got[4] = np.minimum(got[3], m.min(0)), np.maximum(got[4], m.max(0))
        rows = [(d, i, n, int(h), int(l), int(a), int(b)) for d, (n, hi, lo, least, most) in found.items() for i, (h, l, a, b) in enumerate(zip(hi, lo, least, most, strict=True))]
        yield pa.RecordBatch.from_pydict({k: pa.array([r[j] for r in rows], pa.int64()) for j, k in enumerate(("d", "i", "n", "hi", "lo", "least", "most"))})

    sums = distinct.mapInArrow(run, "d long, i long, n long, hi long, lo long, least long, most long")
    sums = sums.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.min("least").alias("least"), F.max("most").alias("most"))
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in sums.orderBy("d", "i").collect():  # one row a dimension
        n, s, largest = out.get(r.d, (r.n, [], 0))
        total = (r.hi << _HALF) + r.lo
        out[r.d] = n, [*s, total], max(largest, abs(n * r.least - total), abs(n * r.most - total))
    return out


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^20, as many as whole numbers of up to `bound` on either side of zero ask for."""
    found, product, p = [], 1, 1 << PRIME_BITS
    while product <= 2 * bound:
        p -= 1
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def _centred(m: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n x - S modulo p, around zero, as doubles."""
    y = ((m % p) * (n % p) - np.array([s % p for s in sums], np.int64)) % p
    return np.where(y > p // 2, y - p, y).astype(np.float64)


def scatter(distinct: DataFrame, sums: dict[int, tuple[int, list[int], int]]) -> dict[int, list[list[int]]]:
    """{length: exact sum of y y^T over the fit list}, y = n x - S, by residues and Chinese remaindering."""
    primes = {d: primes_for(n * largest * largest) for d, (n, _, largest) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, m in _by_length(batch):
                d = m.shape[1]
                n, s, _ = sums[d]
                for b in _blocks(m):
                    for p in primes[d]:
                        y = _centred(b, n, s, p)
                        product = (y.T @ y).astype(np.int64)
                        found[d, p] = (found.get((d, p), 0) + product) % p
        for (d, p), z in found.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"d": np.full(len(i), d), "p": np.full(len(i), p), "i": i, "j": j, "z": z[i, j]})

    parts = distinct.mapInArrow(run, "d long, p long, i long, j long, z long").groupBy("d", "p", "i", "j").agg(F.pmod(F.sum("z"), F.col("p")).alias("z"))
    residues: dict[tuple[int, int, int], dict[int, int]] = {}
    for r in parts.toLocalIterator():
        residues.setdefault((r.d, r.i, r.j), {})[r.p] = r.z
    out = {}
    for d, ps in primes.items():
        whole = 1
        for p in ps:
            whole *= p
        weights = {p: whole // p * pow(whole // p, -1, p) for p in ps}
        out[d] = [[0] * d for _ in range(d)]
        for i in range(d):
            for j in range(i, d):
                v = sum(weights[p] * z for p, z in residues.get((d, i, j), {}).items()) % whole
                out[d][i][j] = out[d][j][i] = v - whole if 2 * v > whole else v
    return out


def decompose(n: int, sums: list[int], largest: int, scattered: list[list[int]], components: int) -> Fit:
    """Eigenvectors of the covariance, scattered / n^3, each entry rounded once."""
    v = np.array([[_ratio(x, n**3) for x in row] for row in scattered])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    trace = _ratio(sum(scattered[i][i] for i in range(len(sums))), n**3)
    k = min(components, int((values > len(sums) * np.finfo(float).eps * max(values[0], 0.0)).sum()))
    return Fit(n, sums, axes[:, :k].copy(), values[:k].copy(), values[:k] / trace if trace else values[:k], largest)


def _ratio(a: int, b: int) -> float:
    return a / b  # whole numbers of any size divide with one rounding


def _project(m: np.ndarray, f: Fit) -> np.ndarray:
    """Whitened values of rows of x: n x - S is exact where it fits in a long, as the offset of x is gone then."""
    if f.largest < 1 << 62:
        y = (m * f.n - np.array(f.sums, np.int64)).astype(np.float64) / f.n
    else:
        y = np.array([[_ratio(int(x) * f.n - s, f.n) for x, s in zip(row, f.sums, strict=True)] for row in m])
    return y @ (f.axes / np.sqrt(f.values))


def _deviations(m: np.ndarray, f: Fit) -> list[int | None]:
    """Exact sums of (n x - S)^2; null beyond a long."""
    d = m.shape[1]
    if d * f.largest * f.largest < 1 << 63:
        y = m * f.n - np.array(f.sums, np.int64)
        return (y * y).sum(1).tolist()
    exact = [sum((int(x) * f.n - s) ** 2 for x, s in zip(row, f.sums, strict=True)) for row in m]
    return [e if e < 1 << 63 else None for e in exact]


def identity_errors(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """{length: largest absolute entry of the whitened fit list's covariance minus the identity}, from one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, m in _by_length(batch):
                f = fits[m.shape[1]]
                for b in _blocks(m):
                    w = _project(b, f)  # centred: x - S / n
                    found[m.shape[1]] = found.get(m.shape[1], 0.0) + w.T @ w
        rows = [(d, i, j, float(z[i, j])) for d, z in found.items() for i in range(len(z)) for j in range(len(z))]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["d", "i", "j", "z"])

    sums = distinct.mapInArrow(run, "d long, i long, j long, z double").groupBy("d", "i", "j").agg(F.sum("z").alias("z"))
    out = dict.fromkeys(fits, 0.0)
    for r in sums.collect():  # components squared
        out[r.d] = max(out[r.d], abs(r.z / fits[r.d].n - (1.0 if r.i == r.j else 0.0)))
    return out


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    spark = df.sparkSession
    rows = whole_numbers(df, id_col, vector_col)
    distinct = cut(rows.select(_X).distinct(), "fit-list")
    sums = column_sums(distinct)
    scattered = scatter(distinct, sums)
    fits = {d: decompose(n, s, largest, scattered[d], components) for d, (n, s, largest) in sums.items()}
    errors = identity_errors(distinct, fits)
    sent = spark.sparkContext.broadcast((fits, errors))  # a few vectors a length
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, errors = sent.value
        for batch in batches:
            for at, m in _by_length(batch):
                f = fits[m.shape[1]]
                k = len(f.values)
                for start in range(0, len(m), BLOCK):
                    part, ids = m[start : start + BLOCK], batch.column(_ID).take(pa.array(at[start : start + BLOCK]))
                    each = np.repeat(np.arange(len(part)), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(each), f.n)),
                            pa.array(_deviations(part, f), pa.int64()).take(pa.array(each)), pa.array(_project(part, f).ravel()), pa.array(np.tile(f.explained, len(part))), pa.array(np.full(len(each), errors[m.shape[1]])),
                        ],
                        [_ID, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return rows.mapInArrow(run, f"{_ID} {kind.simpleString()}, {OUT}").withColumnRenamed(_ID, id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
