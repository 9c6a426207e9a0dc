"""The conversation trie against brute force, on the given table and on awkward ones."""

import hashlib
import random
import zlib

import duckdb
import pytest

from kwforge.llm import prefix_trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows, order):
    """{path: row} over all rebuilt conversations; order sorts the rows of a conversation."""
    turns = {}
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=order):
        turns.setdefault(c, []).append((r or "", x or ""))
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids.get(p, []))
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
BY_TURN = lambda x: (x[0], x[1] is not None, x[1] or 0)


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = prefix_trie.op13_prefix_trie(spark, SF)
    assert got(df) == brute_force(rows, BY_TURN)
    assert dict(df.dtypes) == {n: "string" if n == "ends_sha256" else "bigint" for n in NAMES}


def test_op13_sql():
    """The SQL that the query is held against, itself held against brute force."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({prefix_trie.SQL})").fetchall(), key=str) == brute_force(rows, BY_TURN)


@pytest.mark.parametrize("seed", [1, 2])
def test_op13_random(spark, seed):
    """Shared beginnings, nulls, short bases, absent bases, conversations without turns, negative ids, null ids."""
    g = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(150, 190), *g.sample(range(300, 900), 40), -150, -200, -101]:
        for t in range(g.randint(1, 9)):
            rows.append((c, t or None, g.choice(["user", None, ""]), g.choice(["a", "bé🙂", "", None])))
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    g.shuffle(rows)
    df = spark.createDataFrame([(*r, 7, "clash", 1.5) for r in rows], SCHEMA + ", depth int, node string, x double").repartition(5)
    assert got(prefix_trie.prefix_trie(df, 7)) == brute_force(rows, BY_TURN)


def test_op13_hot(spark):
    """A third of all rows in one conversation, a third repeating one row, and a third in copies of one conversation."""
    long = [(7, t, "user", f"t{t % 3}") for t in range(3000)]
    copies = [(1000 + c, t, "user", f"same{t}") for c in range(700) for t in range(4)]
    again = [(2100, 1, "user", "again")] * 3000
    rows = long + copies + again
    df = spark.createDataFrame(rows, SCHEMA)
    turns = prefix_trie.slices(df, 8)
    sizes = [r["count"] for r in turns.groupBy("part").count().collect()]
    assert max(sizes) < len(rows) / 4 and turns.filter("conv_id = 7").select("part").distinct().count() > 1 and turns.filter("conv_id = 2100").select("part").distinct().count() > 1
    assert got(prefix_trie.prefix_trie(df, 8)) == brute_force(rows, BY_TURN)


def test_op13_ties_and_none(spark):
    """Rows of one turn number in any order give one result; no rows, no nodes."""
    rows = [(c, t // 3, "user", f"x{t}") for c in (1, 2, 3) for t in range(7)] + [(1, 0, "user", "x0")]
    a, b = (got(prefix_trie.prefix_trie(spark.createDataFrame(x, SCHEMA))) for x in (rows, rows[::-1]))
    assert a == b and sum(r[3] for r in a if r[1] == 0) == 3
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_op13_one_exchange_a_family(spark):
    """Families are combined in the partitioning of their cogroup; only the merge by node shuffles again."""
    turns = prefix_trie.slices(spark.read.parquet(f"{SF}/conversations.parquet"))
    plan = prefix_trie.family_nodes(turns, prefix_trie._contexts(turns))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Exchange hashpartitioning(part")[0]
    assert "Window" in above and "Aggregate" in above and "Exchange" not in above
