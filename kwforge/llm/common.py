"""Helpers that the operators share: tables, the shared folder, written tables, components, word hashing."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.sources.shared import cut, drop_cut, shared_dir

__all__ = ["SALTS", "WORD", "components", "cut", "drop_cut", "each_salt", "mix", "salt", "salts_met", "shared_dir", "shingle_hashes", "table", "word_hashes"]

#: A word: a run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts that the rows of one key are dealt into where they meet the one row that the key has on the other side.
SALTS = 16


def salt(c: str | Column) -> Column:
    """The part of a row, by hash of a column that tells the rows of one key apart."""
    return F.pmod(F.xxhash64(c, F.lit(3)), F.lit(SALTS)).cast("int")


def salts_met(part: str | Column) -> Column:
    """An aggregate: which parts a key has rows in, as a set of bits."""
    return F.bit_or(F.expr(f"shiftleft(1, {part})") if isinstance(part, str) else F.shiftleft(F.lit(1), part))


def each_salt(mask: str = "mask") -> Column:
    """One row for each part in a set of bits. The copies of a key's row are no more than the rows that they meet."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col(mask), i) == 1))


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links: (id, component), component = the smallest id reachable.

    Minimum labels spread along links and along the labels themselves, so rounds grow with the logarithm of the
    diameter for the star-like links that the operators emit. Labels live in written tables; the driver sees one
    count a round. The links of a hub and the ids of a component meet its label dealt into parts, as either may be a
    large part of all. Ids without a link are absent from the result. Null ends are dropped; self links are allowed.
    """
    e = links.select(F.col(a).alias("s"), F.col(b).alias("d")).dropna()
    e = cut(e.union(e.select(F.col("d"), F.col("s"))).distinct().withColumn("salt", salt("d")), "links")
    labels = cut(e.groupBy(F.col("s").alias("id")).agg(F.least(F.col("id"), F.min("d")).alias("component"), salts_met("salt").alias("mask")), "labels")
    for _ in range(max_rounds):
        told = labels.select(F.col("id").alias("s"), "component", each_salt().alias("salt"))
        near = e.join(told, ["s", "salt"]).groupBy(F.col("d").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "mask", F.least("component", "near").alias("component"), F.col("component").alias("was"), salt("id").alias("salt"))
        up = step.groupBy("component").agg(salts_met("salt").alias("met")).join(labels.select(F.col("id").alias("component"), F.col("component").alias("up")), "component")
        up = up.select("component", "up", each_salt("met").alias("salt"))
        new = cut(step.join(up, ["component", "salt"]).select("id", "mask", F.least("component", "up").alias("component"), "was"), "labels")
        changed = new.filter(F.col("component") != F.col("was")).limit(1).count()
        old, labels = labels, new.select("id", "component", "mask")
        drop_cut(old)
        if not changed:
            drop_cut(e)
            return labels.drop("mask")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased (ASCII) words of a whole text, in order; long texts go block by block."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= _BLOCK:
        return _hashed(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _BLOCK)
        if end < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            while not len(gaps) and end < len(raw):
                end = min(len(raw), end + _BLOCK)
                gaps = np.flatnonzero(_SPACE[raw[at:end]])
            if len(gaps) and end < len(raw):
                end = at + int(gaps[-1]) + 1
        out.append(_hashed(raw[at:end]))
        at = end
    return np.concatenate(out)


def _hashed(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    if len(_POWERS[0]) < n + 1:
        size = max(1 << 14, 2 * n)
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of runs of `size` words; a shorter text that has words is one shingle of all of them."""
    if not len(words):
        return words
    k = min(size, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x100000001B3) + words[i : len(words) - k + 1 + i] + np.uint64(i + 1))
    return h
