"""Operator 2, quality classifier: weak labels, expectation-maximisation, and a hashed linear scorer.

Overlapping heuristic labellers vote on every document: good, bad, or no vote. One aggregation over all documents
counts the vote patterns, of which there are at most 3 to the power of the labellers; expectation-maximisation over
that bounded table estimates the class share and each labeller's accuracy, with no gold label. The posterior of a
document's pattern is its label. A logistic scorer over hashed text features is fitted to posteriors of a bounded
sample (`train_rows`, drawn evenly by hash of the text over all documents, each text once, so that copies can't
swell it) and then scores every document; the verdict is the scorer's.

Nulls: a null text is an empty one. An empty text gets a score like any other. Null ids stay null, repeated rows are
scored row by row, extra columns are not read, and an empty table gives an empty result (no model is fitted).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm.common import table, word_hashes
from kwforge.llm.quality_rules import Text, n_dup_lines, n_repeat_words, n_symbols

DIM = 2048
#: Classes weigh alike in the fit although bad texts are few, so the line lies below one half.
THRESHOLD = 0.25
GOOD, BAD, NONE = 1, 0, -1
_CAPS = re.compile(r"\b[A-Z]{2,}\b")


def by_symbols(t: Text) -> int:
    return BAD if 10 * n_symbols(t) > len(t.words) else NONE


def by_repeats(t: Text) -> int:
    return BAD if 10 * n_repeat_words(t) > 4 * len(t.words) else NONE


def by_lines(t: Text) -> int:
    return BAD if 10 * n_dup_lines(t) > 3 * len(t.lines) else NONE


def by_distinct(t: Text) -> int:
    n = len(t.words)
    return BAD if n >= 30 and 5 * len(set(t.words)) < n else NONE


def by_word_length(t: Text) -> int:
    n = len(t.words)
    if n < 5:
        return NONE
    mean = sum(map(len, t.words)) / n
    return GOOD if 3.8 <= mean <= 6.6 else BAD if mean > 7 or mean < 3.5 else NONE


def by_prose(t: Text) -> int:
    """Marks that stand alone or hang on words other than stops, and shouting, are no prose; sentences are."""
    n = len(t.words)
    if not n:
        return BAD
    odd = sum(1 for w in t.words if not (w[-1].isalnum() or w[-1] in ".,;:?)\"'"))
    if 5 * odd > n or 2 * len(_CAPS.findall(t.text)) > n:
        return BAD
    return GOOD if 20 * odd < n and t.text.count(".") * 60 > n else NONE


LABELLERS = (by_symbols, by_repeats, by_lines, by_distinct, by_word_length, by_prose)


def votes(text: Column, labellers=LABELLERS) -> Column:
    """A string of one character a labeller: g, b or - (no vote)."""
    marks = {GOOD: "g", BAD: "b", NONE: "-"}

    @F.pandas_udf("string")
    def vote(s):
        import pandas as pd

        return pd.Series(["".join(marks[f(t)] for f in labellers) for t in map(Text, s)], dtype=object)

    return vote(text)


def fit_accuracies(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern, each labeller's table P(vote | class), and the share of good.

    The first posteriors are the vote majorities, which also fixes which class is good. Counts get one pseudo-vote.
    """
    if not patterns:
        return {}, np.zeros((0, 2, 3)), 0.5
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["bg-".index(c) for c in k] for k in keys])
    post = np.array([(k.count("g") + 0.5) / (k.count("g") + k.count("b") + 1) for k in keys])
    for _ in range(rounds):
        share = float(np.clip((n * post).sum() / n.sum(), 1e-3, 1 - 1e-3))
        p = np.ones((v.shape[1], 2, 3))
        for j in range(v.shape[1]):
            for c, w in ((0, 1 - post), (1, post)):
                p[j, c] += np.bincount(v[:, j], n * w, 3)
        p /= p.sum(2, keepdims=True)
        logs = np.stack([np.log(p[np.arange(v.shape[1]), c, v]).sum(1) for c in (0, 1)])
        odds = logs[1] - logs[0] + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return dict(zip(keys, post.tolist(), strict=True)), p, share


def features(text: str | None, dim: int = DIM) -> np.ndarray:
    """Hashed features of a whole text, of length one: byte pairs, immediate repeats, and share of distinct words."""
    out = np.zeros(dim, np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) > 1:
        pair = (raw[:-1] * np.uint32(256) + raw[1:]) * np.uint32(2654435761)
        out += np.bincount(pair >> np.uint32(32 - dim.bit_length() + 1), minlength=dim)[:dim]
        out = np.sqrt(out / (len(raw) - 1))
    words = word_hashes(text)
    n = len(words)
    if n:
        tell = {f"distinct={len(np.unique(words)) * 10 // n}": 0.5}
        if n > 1:
            tell[f"again={int((words[1:] == words[:-1]).mean() * 10)}"] = 0.5
            pairs = words[:-1] * np.uint64(31) + words[1:]
            tell[f"pairs={len(np.unique(pairs)) * 10 // (n - 1)}"] = 0.5
        for k, x in tell.items():
            out[zlib.crc32(k.encode()) % dim] += x
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 3.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last is the bias) for soft labels, by gradient steps with momentum; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    good = max(y.sum(), 1e-9)
    bad = max((1 - y).sum(), 1e-9)
    weight = y * (0.5 / good) + (1 - y) * (0.5 / bad)
    w, step = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = 0.9 * step - rate * (x.T @ (weight * (p - y)) + decay * w)
        w = w + step
    return w


def train(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", train_rows: int = 4000, labellers=LABELLERS, dim: int = DIM, seed: int = 11) -> np.ndarray | None:
    """Weights of the scorer, or None for an empty table.

    Votes are counted over all rows. The fit reads about train_rows rows, in one task, whose size they bound.
    """
    counted = df.select(votes(F.col(text_col), labellers).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    patterns = {r["v"]: r["n"] for r in counted.collect()}
    post, _, _ = fit_accuracies(patterns)
    total = sum(patterns.values())
    if not total:
        return None
    share = max(1, round(total / train_rows))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {GOOD: "g", BAD: "b", NONE: "-"}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            y = [post.get("".join(marks[f(t)] for f in labellers), 0.5) for t in map(Text, texts)]
            x = [features(s, dim).tobytes() for s in texts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.float64())], names=["x", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:
            x += [np.frombuffer(b, np.float32) for b in batch.column(0).to_pylist()]
            y += batch.column(1).to_pylist()
        if x:
            order = sorted(range(len(x)), key=lambda i: (y[i], x[i].tobytes()))
            w = fit_scorer(np.array([x[i] for i in order]), np.array([y[i] for i in order]))
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float64).tobytes()], pa.binary())], names=["w"])

    text = F.col(text_col)
    drawn = F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(share)) == 0
    sample = df.filter(drawn).select(text.alias("text")).distinct()
    fitted = sample.mapInArrow(labelled, "x binary, y double").repartition(1).mapInArrow(fit, "w binary").collect()
    return np.frombuffer(fitted[0]["w"], np.float64) if fitted else np.zeros(dim + 1)


def score(text: Column, weights: np.ndarray, dim: int = DIM) -> Column:
    """Probability that a document is good."""
    w, bias = weights[:-1].astype(np.float32), float(weights[-1])

    @F.pandas_udf("double")
    def scored(s):
        import pandas as pd

        z = np.array([float(features(x, dim) @ w) + bias for x in s], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    return scored(text)


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """id, probability, kept for every row."""
    weights = train(df, text_col, id_col, **options)
    if weights is None:
        return df.select(F.col(id_col)).withColumns({"probability": F.lit(None).cast("double"), "kept": F.lit(None).cast("boolean")})
    scored = df.select(F.col(id_col), F.round(score(F.col(text_col), weights), 6).alias("probability"))
    return scored.withColumn("kept", F.col("probability") >= threshold)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
