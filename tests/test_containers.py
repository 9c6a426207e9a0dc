"""Compressed bitmaps of every kind against sets."""

import random

import pytest
from pyspark.sql import functions as F

from kwforge.operators import bitmaps, containers


@pytest.fixture(scope="module")
def sets():
    g = random.Random(8)
    size = 3 * containers.CHUNK
    out = {
        "few": set(g.sample(range(size), 300)), "one": {40_000}, "run": set(range(100, 60_000)), "runs": {x for a in range(0, size, 5000) for x in range(a, a + 900)},
        "dense": {x for x in range(size) if g.random() < 0.4}, "denser": {x for x in range(size) if g.random() < 0.7}, "edges": {0, 31, 32, 32_767, 32_768, 65_535, 98_303}, "all": set(range(size)),
    }
    return out | {"cut": out["few"] | set(range(50_000, 50_400))}


@pytest.fixture(scope="module")
def held(spark, sets):
    import pandas as pd

    rows = pd.DataFrame([(k, x) for k, s in sets.items() for x in s] + [("few", next(iter(sets["few"])))], columns=["kw", "position"])
    pairs = spark.createDataFrame(rows).repartition(4)
    return pairs, containers.encode(pairs, ["kw"], "position").persist()


def test_kinds_and_round_trip(held, sets):
    pairs, c = held
    kinds = {}
    for r in c.select("kw", "chunk", "kind", "n").collect():
        mine = sorted(x % containers.CHUNK for x in sets[r.kw] if x // containers.CHUNK == r.chunk)
        runs = sum(1 for i, x in enumerate(mine) if i == 0 or mine[i - 1] != x - 1)
        want = "array" if 2 * len(mine) <= min(4 * runs, 4096) else "runs" if 4 * runs <= 4096 else "bitmap"
        assert (r.kind, r.n) == (want, len(mine))
        kinds[r.kind] = kinds.get(r.kind, 0) + 1
    assert set(kinds) == {"array", "runs", "bitmap"}
    back = containers.decode(c, ["kw"])
    assert back.exceptAll(pairs.distinct()).count() == 0 and back.count() == sum(map(len, sets.values()))


def test_intersections(spark, held, sets):
    """Every pair of kinds, three at once, one alone, and a key that there is not."""
    names = list(sets)
    asked = [[a, b] for i, a in enumerate(names) for b in names[i + 1 :]] + [["dense", "denser", "runs"], ["dense", "denser"], ["run", "all", "cut"], ["one"], ["few", "none"], ["edges", "all", "run"]]
    q = spark.createDataFrame([(i, k) for i, ks in enumerate(asked) for k in ks], "query_id long, kw string")
    got = {}
    for r in containers.intersect(held[1], q).toPandas().itertuples():
        got.setdefault(r.query_id, []).append(r.position)
    for i, ks in enumerate(asked):
        want = set.intersection(*(sets.get(k, set()) for k in ks))
        assert len(got.get(i, [])) == len(want) and set(got.get(i, [])) == want


def test_smaller_than_words(held):
    pairs, c = held
    words = bitmaps.encode(pairs, ["kw"], "position").count()
    s = {r.kind: r for r in containers.sizes(c).collect()}
    assert c.count() < words / 100 and sum(r.bytes for r in s.values()) < 4 * words
    assert containers.encode(pairs.limit(0), ["kw"], "position").count() == 0


def test_words_are_filled_in_one_pass(spark, held):
    """The 1,024 words of a bitmap come from one pass over those that are set, not from a map built anew for each."""
    assert "map_from_entries" not in containers.encode(held[0], ["kw"], "position")._jdf.queryExecution().toString()
    words = [(0, -1), (3, 5), (1022, 7)]
    df = spark.createDataFrame([(words,), ([],)], "w array<struct<word int, bits int>>")
    got = [r.x for r in df.select(containers._dense(F.col("w")).alias("x")).collect()]
    assert got == [[dict(words).get(i, 0) for i in range(1024)], [0] * 1024]
