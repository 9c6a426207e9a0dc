"""Sides that change from batch to batch: against a loop in Python, as a stream, and when batches run again."""

import random

import pytest

from kwforge.functions.cost import CostModel
from kwforge.streaming.assign import Assignment


@pytest.fixture(scope="module")
def data():
    g = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    objects = {i: sorted(set(g.choices(words[:20] if i % 2 else words[10:], k=6))) for i in range(60)}
    seeds = {i: (objects[i], 1 + i % 2) for i in range(6)}
    batches = [list(range(6, 20)), list(range(20, 45)), list(range(45, 60))]
    return objects, seeds, batches


def by_hand(objects, seeds, batches):
    """Storage costs, one batch after the other."""
    have = {s: {k for ks, t in seeds.values() if t == s for k in ks} for s in (1, 2)}
    n = {s: sum(t == s for _, t in seeds.values()) for s in (1, 2)}
    out = {}
    for b, ids in enumerate(batches):
        cost = lambda i, s: len(have[s]) + len(set(objects[i]) - have[s]) * (n[s] + 33) + 32  # noqa: B023, E731
        chosen = {i: 1 if cost(i, 1) <= cost(i, 2) else 2 for i in ids}
        for i, s in chosen.items():
            have[s] |= set(objects[i])
            n[s] += 1
            out[i] = (s, b)
    return out


def started(spark, path, seeds):
    a = Assignment(spark, path, spark.createDataFrame([(1, "w1")], "query_id long, kw string"), CostModel())
    a.seed(spark.createDataFrame([(i, k, s) for i, (ks, s) in seeds.items() for k in ks], "obj_id long, kw string, side int"))
    return a


def rows(a):
    return {r.obj_id: (r.side, r.batch) for r in a.placed().collect()}


def test_batches_and_replay(spark, tmp_path, data):
    objects, seeds, batches = data
    a = started(spark, str(tmp_path / "a"), seeds)
    frames = [spark.createDataFrame([(i, k) for i in ids for k in objects[i]] + [(None, "lost")], "obj_id long, kw string") for ids in batches]
    for n, df in enumerate(frames):
        a.place(df, n)
    want = by_hand(objects, seeds, batches)
    assert rows(a) == want
    a.place(frames[1], 1)  # an old batch again, with later ones there: nothing moves
    assert rows(a) == want
    a.place(frames[0], 3)  # objects that are placed already stay
    assert rows(a) == want
    a.place(frames[0].limit(0), 4)
    assert rows(a) == want
    assert want != by_hand(objects, seeds, [sum(batches, [])]) or len({s for s, _ in want.values()}) == 2


def test_stream(spark, tmp_path, data):
    """One file a micro-batch; a stream that starts again from nothing repeats its batches and changes nothing."""
    objects, seeds, batches = data
    for n, ids in enumerate(batches):
        spark.createDataFrame([(i, " ".join(objects[i])) for i in ids], "obj_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("obj_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    a = started(spark, str(tmp_path / "a"), seeds)
    a.follow(read(), str(tmp_path / "c1")).awaitTermination()
    got = rows(a)
    order = [sorted(i for i, (_, b) in got.items() if b == n) for n in range(3)]
    assert sorted(order) == batches and got == by_hand(objects, seeds, order)
    a.follow(read(), str(tmp_path / "c2")).awaitTermination()
    assert rows(a) == got
