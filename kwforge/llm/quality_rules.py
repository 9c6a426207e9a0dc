"""Operator 9, quality rules: a short-circuit cascade ordered by rejection per cost.

`text_counts` takes the counts that every document gets. `order_rules` runs each rule over a bounded sample, measures
its cost and its share of rejections, and sorts the rules by rejection per cost; `judge` then runs the ordered rules
over every row, each row only until its first rejection. A document is kept if no rule rejects it, so the order changes
the cost and the reported first rejection, never the verdict.

Nulls: a null text is an empty one (all counts 0); a null id stays null. Repeated rows are judged row by row. Extra
columns are not read. An empty table gives an empty result. Texts are always taken whole.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm.common import WORD, table

SYMBOLS = "#*$%&|<>"
_UPPER = re.compile(r"[A-Z]{2,}")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text:
    """One text with its word list and counts, each taken once however many rules read it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = WORD.findall(self.text)

    @cached_property
    def symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))


def n_symbols(t: Text) -> int:
    return t.symbols


def n_dup_lines(t: Text) -> int:
    """Lines with a word that equal an earlier line."""
    return t.dup_lines


def n_repeat_words(t: Text, window: int = 3) -> int:
    """Words inside any window of `window` words that the text has twice or more, the first one included."""
    n = len(t.words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in t.words), np.int64, n)
    key = ids[: n - window + 1]
    for i in range(1, window):  # ranks stay below n, so the products never overflow
        key = np.unique(key * len(seen) + ids[i : n - window + 1 + i], return_inverse=True)[1]
    at = np.flatnonzero(np.bincount(key)[key] > 1)
    hit = np.zeros(n + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + window, -1)
    return int((np.cumsum(hit)[:n] > 0).sum())


def text_counts(t: Text) -> tuple[int, int, int, int, int]:
    return len(t.words), sum(map(len, t.words)), n_symbols(t), n_dup_lines(t), n_repeat_words(t)


def rejects_symbols(t: Text) -> bool:
    """More than one symbol to ten words."""
    return 10 * n_symbols(t) > len(t.words)


def rejects_word_length(t: Text) -> bool:
    """A mean word length outside 2 to 12 characters."""
    chars = sum(map(len, t.words))
    return chars < 2 * len(t.words) or chars > 12 * len(t.words)


def rejects_dup_lines(t: Text) -> bool:
    """More than three in ten of the lines with words repeat an earlier one."""
    return 10 * n_dup_lines(t) > 3 * len(t.lines)


def rejects_few_distinct(t: Text) -> bool:
    """Distinct words are under a tenth of the words."""
    return 10 * len(set(t.words)) < len(t.words)


def rejects_shouting(t: Text) -> bool:
    """Most words hold two capital ASCII letters in a row."""
    return 2 * sum(1 for w in t.words if _UPPER.search(w)) > len(t.words)


RULES: tuple[tuple[str, Callable[[Text], bool]], ...] = (
    ("symbols", rejects_symbols),
    ("word_length", rejects_word_length),
    ("dup_lines", rejects_dup_lines),
    ("few_distinct", rejects_few_distinct),
    ("shouting", rejects_shouting),
)


def order_rules(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: Sequence = RULES, sample_rows: int = 1000, seed: int = 7
) -> list[tuple[str, Callable[[Text], bool]]]:
    """Rules in descending order of rejections per second, as measured on a sample.

    sample_rows bounds the sample: rows are drawn evenly by hash of the id at a rate that gives about that many. Each
    task returns one row a rule (nanoseconds, rejections), so the driver gets a table bounded by rules times tasks.
    """
    n = df.count()
    share = max(1, n // max(1, sample_rows))
    names, tests = [r[0] for r in rules], [r[1] for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ns, hits = [0] * len(tests), [0] * len(tests)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                t = Text(x)
                for i, test in enumerate(tests):
                    began = time.perf_counter_ns()
                    hits[i] += bool(test(t))
                    ns[i] += time.perf_counter_ns() - began
        yield pa.RecordBatch.from_pydict({"rule": names, "ns": ns, "hits": hits})

    sample = df.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(share)) == 0).select(F.col(text_col).alias("text"))
    got = sample.mapInArrow(measure, "rule string, ns long, hits long").groupBy("rule").agg(F.sum("ns").alias("ns"), F.sum("hits").alias("hits"))
    rate = {r["rule"]: (r["hits"] + 0.5) / max(1, r["ns"]) for r in got.collect()}
    return sorted(rules, key=lambda r: -rate.get(r[0], 0.0))


def first_rejection(t: Text, rules: Sequence) -> str | None:
    """Name of the first rule that rejects; later rules don't run."""
    return next((name for name, test in rules if test(t)), None)


def judge(df: DataFrame, rules: Sequence, id_col: str = "doc_id", text_col: str = "text", base: Callable[[tuple], bool] | None = None) -> DataFrame:
    """Counts and verdict of every row: id, the five counts, base_failed, kept, rejected_by.

    base(counts) true means rejected before any rule runs.
    """
    rules = list(rules)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                t = Text(x)
                counts = text_counts(t)
                failed = bool(base and base(counts))
                by = "base" if failed else first_rejection(t, rules)
                rows.append((*counts, failed, by is None, by))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, *COUNTS, "base_failed", "kept", "rejected_by"])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, rejected_by string"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def base_rule(counts: tuple) -> bool:
    """Under 50 words, or more than half of the words repeat in windows of three."""
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def keep(text: Column, rules: Sequence) -> Column:
    """A column that is true where neither the base rule nor any rule rejects the text."""
    rules = list(rules)

    @F.pandas_udf("boolean")
    def kept(s):
        import pandas as pd

        def good(x):
            t = Text(x)
            n = len(t.words)
            return n >= 50 and first_rejection(t, rules) is None and 100 * n_repeat_words(t) <= 50 * n

        return pd.Series([good(x) for x in s], dtype=bool)

    return kept(text)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, order_rules(docs), base=base_rule).drop("rejected_by")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS c FROM g WHERE w2 IS NOT NULL),
h AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) AS t(k) WHERE c > 1),
n AS (SELECT doc_id, count(*) AS n_repeat_words FROM h GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_distinct(ws)) AS n_distinct,
             len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z][A-Z]'))) AS n_upper
      FROM w LEFT JOIN n ON n.doc_id = w.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 12 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_distinct < n_words OR 2 * n_upper > n_words) AS kept
FROM s
"""
