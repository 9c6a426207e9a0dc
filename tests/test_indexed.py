"""CSV files and keyword lines as indexes."""

import csv

import pytest

from kwforge.operators import containers
from kwforge.sources import indexed


def written(path, rows, **options):
    with open(path, "w", newline="", encoding=options.pop("encoding", "utf-8")) as f:
        csv.writer(f, **options).writerows(rows)
    return str(path)


def sets(ix):
    return [set(r.kws) for r in ix.rows.orderBy("row").collect()]


def check(ix, want):
    """Rows, dense ids in keyword order, and postings that agree with each other."""
    assert sets(ix) == want
    ids = {r.kw: r.kw_id for r in ix.vocabulary.collect()}
    assert ids == {k: i for i, k in enumerate(sorted(set().union(*want)))}
    assert {r.kw_id: r.ids for r in ix.postings.collect()} == {i: [n for n, s in enumerate(want) if k in s] for k, i in ids.items()}


def test_csv(spark, tmp_path):
    named = written(tmp_path / "a.csv", [["id", " Title ", "x"], ["1", "a b;a", "q"], ["2", 'say "c, d"|e', ""], [], ["3", "", "z"], ["4", "two\nlines", ""]])
    check(indexed.index_csv(spark, named), [{"a", "b"}, {"say", '"c', 'd"', "e"}, {"3", "z"}, {"two", "lines"}])
    check(indexed.index_csv(spark, named, column="none"), [{"1", "a", "b", "q"}, {"2", "say", '"c', 'd"', "e"}, {"3", "z"}, {"4", "two", "lines"}])
    alone = written(tmp_path / "b.csv", [["Title"], ["a b"], ["0", "c d"], ["e"]])
    check(indexed.index_csv(spark, alone), [{"a", "b"}, {"c", "d"}, {"e"}])
    bare = written(tmp_path / "c.csv", [["1", "a é", "x"], ["only"], ["2", "b", "y"]], delimiter=";", encoding="latin-1")
    check(indexed.index_csv(spark, bare, header=False, delimiter=";", encoding="ISO-8859-1"), [{"a", "é"}, {"only"}, {"b"}])
    assert indexed.index_csv(spark, written(tmp_path / "d.csv", [["Title"]])).rows.count() == 0


def test_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Title\na,b a\n\nzz\nb;zz|a\n  \nb\n")
    vocab = spark.createDataFrame([("a", 4), ("b", 9)], "kw string, kw_id long")
    c, n = indexed.index_lines(spark, str(tmp_path / "l.txt"), vocab)
    assert tuple(n.first()) == (4, 5)
    assert {tuple(r) for r in containers.decode(c, ["kw_id"]).collect()} == {(4, 0), (9, 0), (9, 2), (4, 2), (9, 3)}
    with pytest.raises(Exception, match="unknown keyword: zz"):
        indexed.index_lines(spark, str(tmp_path / "l.txt"), vocab, unknown="fail")
    known = spark.createDataFrame([("a", 0), ("b", 1), ("zz", 2)], "kw string, kw_id long")
    assert indexed.index_lines(spark, str(tmp_path / "l.txt"), known, unknown="fail")[1].first()["pairs"] == 7
    with pytest.raises(ValueError, match="drop or fail"):
        indexed.index_lines(spark, "", vocab, unknown="other")
