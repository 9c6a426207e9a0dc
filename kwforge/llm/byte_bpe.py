"""Operator 10, byte-level BPE: encoding and decoding by Spark's higher-order functions.

The rank file becomes a literal rank map inside the plan: a flat array of longs in which the pair of tokens (left,
right) has one of two slots, and a slot holds the rank of the two tokens' joined bytes and the pair. A second array
holds the pairs of single bytes. A word starts as the array of its bytes' pairs; `aggregate` folds one merge after
another, always the leftmost pair of the least rank, until no pair has a rank. Decoding looks ids up in a literal array
of pieces and concatenates the bytes. The maps are scalar subqueries over local rows, which Spark turns into literals
in its compact array format: a task reads them as a few blocks of bytes, not as a million objects.

Words repeat, so the words that are frequent in a bounded sample of texts (`memo_rows` texts, `memo_words` words) are
folded once, as distinct words, and kept as a second literal. The memo changes the cost alone: a word outside it is
folded in place, so every text is encoded whole and alike at every size. Nothing is shuffled but the sample's counts.

Very long words: a word of more than `LONG` bytes is first cut where two bytes meet that no token of the vocabulary
holds side by side, as nothing is ever merged there; that is linear in its length. A part that is still long is folded
in rounds over a string of one character a token, each of which merges all places of the least pair at once, so runs and
periods take few rounds.

Nulls: a null text is an empty one: no ids, and the hashes of nothing. Repeated rows are encoded row by row. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm.common import table
from kwforge.llm.tokens import RANK_FILE, read_ranks, vocabulary_path

#: White space as Unicode defines it; Java's own class is the ASCII one.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A packed pair: rank, left token, right token, in 17 bits each below the rank.
_BITS = 17
_LOW, _PAIR = (1 << _BITS) - 1, (1 << 2 * _BITS) - 1
NO_RANK = 1 << (3 * _BITS)
#: The code of a word's edge, one above the bytes; as a character it parts the segments of a long word.
EDGE = 256
#: Bytes of a word beyond which it is cut into segments first.
LONG = 256
#: In the string of a long segment, token t is the character CHARS + t.
CHARS = 0x10000
#: Bounds of the memo: texts of the sample, and distinct words kept from it.
MEMO_ROWS, MEMO_WORDS = 64_000, 1 << 19


def java_pattern(pattern: str) -> str:
    """The public split pattern with its white-space classes written out for Java."""
    return pattern.replace(r"\p{L}+", r"\p{L}++").replace(r"\p{N}+", r"\p{N}++").replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of every pair of tokens whose joined bytes are a token."""
    return {
        (ranks[t[:i]], ranks[t[i:]]): r
        for t, r in ranks.items()
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    }


def _primes(least: int, n: int) -> list[int]:
    out, x = [], least | 1
    while len(out) < n:
        if all(x % p for p in range(3, int(x**0.5) + 1, 2)):
            out.append(x)
        x += 2
    return out


def two_slot_table(pairs: dict[tuple[int, int], int]) -> tuple[list[int], int, int]:
    """(slots, p, q): a pair's key is left * 2**17 + right; the packed pair lies in slot key mod p or p + key mod q.

    The first table is sparse: most pairs without a rank meet an empty slot there, which ends the search.
    """
    p, q = _primes(4 * len(pairs), 1)[0], _primes(len(pairs) // 2, 1)[0]
    while True:
        slots = [-1] * (p + q)
        for (left, right), rank in pairs.items():
            item = (((rank << _BITS) | left) << _BITS) | right
            at = (item & _PAIR) % p
            for _ in range(500):
                item, slots[at] = slots[at], item
                if item < 0:
                    break
                at = p + (item & _PAIR) % q if at < p else (item & _PAIR) % p
            else:
                break
        else:
            return slots, p, q
        p, q = _primes(int(p * 1.2), 1)[0], _primes(int(q * 1.2), 1)[0]


def _xxhash64(s: str) -> int:
    """Spark's xxhash64 of a string (seed 42)."""
    import xxhash

    v = xxhash.xxh64_intdigest(s.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def let(value: Column, f) -> Column:
    """Bind a value to a name inside an expression: the end of a fold over no element, which copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, f)


def constant(values: list | np.ndarray, element: pa.DataType) -> Column:
    """An array as a literal of the plan. Name it in a projection: lambdas may not hold a subquery themselves."""
    spark = SparkSession.active()
    return spark.createDataFrame(pa.table({"v": pa.array([values], pa.list_(element))})).scalar()


class Memo(NamedTuple):
    """Words and their ids, in `size` slots (a power of two)."""

    words: Column
    ids: Column
    size: int


class Vocabulary:
    """A rank file as literals. Columns that read them are built by functions of the bound literals."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        ranks = read_ranks(path or vocabulary_path(RANK_FILE))
        self.pattern = java_pattern(pattern)
        pairs = pair_ranks(ranks)
        slots, self.p, self.q = two_slot_table(pairs)
        self.end = max(ranks.values()) + 1  # no token: no pair with it has a rank
        self.slots = constant(slots, pa.int64())
        byte = [*(ranks[bytes([b])] for b in range(256)), self.end]
        self.first = constant([(pairs.get((a, b), NO_RANK >> 2 * _BITS) << 2 * _BITS) | (a << _BITS) | b for a in byte for b in byte], pa.int64())
        near = {t[i : i + 2] for t in ranks for i in range(len(t) - 1)}
        self.apart = constant([bytes([a, b]) not in near for a in range(256) for b in range(256)], pa.bool_())
        self.chars = constant([chr(CHARS + t) for t in range(self.end)], pa.string())
        pieces = [b""] * self.end
        for t, r in ranks.items():
            pieces[r] = t
        self.pieces = constant([t.hex() for t in pieces], pa.string())

    def maps(self) -> dict[str, Column]:
        """The literals that a fold reads, to be bound by name."""
        return {"slots": self.slots, "first": self.first, "apart": self.apart, "chars": self.chars}

    def packed(self, slots: Column, pair: Column) -> Column:
        """The packed pair of a key, with NO_RANK if it has no rank."""

        def search(k):
            none = k + F.lit(NO_RANK)
            mine = lambda s: s.bitwiseAND(F.lit(_PAIR)) == k
            second = F.get(slots, (F.pmod(k, F.lit(self.q)) + F.lit(self.p)).cast("int"))
            last = lambda s: F.when(mine(s), s).otherwise(none)
            return let(F.get(slots, F.pmod(k, F.lit(self.p)).cast("int")), lambda s: F.when(s < F.lit(0), none).when(mine(s), s).otherwise(let(second, last)))

        return let(pair, search)

    def fold(self, maps: Column, word: Column) -> Column:
        """Ids of one word as a string of decimal numbers; maps binds what `maps` names."""
        parts = lambda d: F.transform(self.segments(maps, d), lambda s: F.when(F.length(s) <= F.lit(LONG), self.fold_short(maps, s)).otherwise(self.fold_long(maps, s)))
        latin = F.decode(word.cast("binary"), "ISO-8859-1")
        return let(latin, lambda d: F.when(F.length(d) <= F.lit(LONG), self.fold_short(maps, d)).otherwise(F.array_join(parts(d), " ")))

    def fold_short(self, maps: Column, latin: Column) -> Column:
        """Ids of a word that is given as one character a byte.

        The state is the array of adjacent packed pairs, from (end, first token) to (last token, end). A merge takes the
        leftmost least pair out and renames the joined token in the pairs on its sides.
        """
        codes = F.transform(F.split(F.concat(F.lit(chr(EDGE)), latin, F.lit(chr(EDGE))), ""), F.ascii)
        begin = lambda c: F.transform(F.slice(c, F.lit(2), F.size(c) - F.lit(1)), lambda x, i: F.get(maps["first"], F.get(c, i) * F.lit(EDGE + 1) + x))
        left = lambda x: F.shiftright(x, _BITS).bitwiseAND(F.lit(_LOW))

        def merge(pairs, _):
            def at(x, rank):
                sides = F.array(
                    self.packed(maps["slots"], F.shiftleft(left(F.get(pairs, x - F.lit(2))), _BITS) + rank),
                    self.packed(maps["slots"], F.shiftleft(rank, _BITS) + F.get(pairs, x).bitwiseAND(F.lit(_LOW))),
                )
                return F.flatten(F.array(F.slice(pairs, F.lit(1), x - F.lit(2)), sides, F.slice(pairs, x + F.lit(2), F.size(pairs))))

            found = lambda m: let(F.array_position(pairs, m).cast("int"), lambda x: let(F.shiftright(m, 2 * _BITS), lambda rank: at(x, rank)))
            return let(F.array_min(pairs), lambda m: F.when(m >= F.lit(NO_RANK), pairs).otherwise(found(m)))

        done = lambda pairs: F.array_join(F.transform(F.slice(pairs, F.lit(2), F.size(pairs) - F.lit(1)), lambda x: left(x).cast("string")), " ")
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(latin))), let(codes, begin), merge, done)

    def segments(self, maps: Column, latin: Column) -> Column:
        """A long word cut between the bytes that no token holds side by side."""
        code = lambda cs, i: F.ascii(F.get(cs, i))
        mark = lambda cs: F.transform(cs, lambda c, i: F.when(F.get(maps["apart"], code(cs, i - F.lit(1)) * F.lit(256) + F.ascii(c)), F.concat(F.lit(chr(EDGE)), c)).otherwise(c))
        return F.split(F.array_join(let(F.split(latin, ""), mark), ""), chr(EDGE))

    def fold_long(self, maps: Column, latin: Column) -> Column:
        """Ids of a long segment: a round merges all places of the least pair. A leading space says that no pair is left."""
        byte = lambda c: F.get(maps["first"], F.lit(EDGE * (EDGE + 1)) + F.ascii(c)).bitwiseAND(F.lit(_LOW)).cast("int")
        start = F.array_join(F.transform(F.split(latin, ""), lambda c: F.get(maps["chars"], byte(c))), "")
        token = lambda c: (F.ascii(c) - F.lit(CHARS)).cast("long")
        char = lambda t: F.get(maps["chars"], t.bitwiseAND(F.lit(_LOW)).cast("int"))

        def least(cs):
            next_ = lambda i: F.coalesce(token(F.get(cs, i + F.lit(1))), F.lit(self.end))
            return F.array_min(F.transform(cs, lambda c, i: self.packed(maps["slots"], F.shiftleft(token(c), _BITS) + next_(i))))

        def merge(state, _):
            pair = lambda m: F.concat(char(F.shiftright(m, _BITS)), char(m))
            put = lambda m: F.when(m >= F.lit(NO_RANK), F.concat(F.lit(" "), state)).otherwise(F.replace(state, pair(m), char(F.shiftright(m, 2 * _BITS))))
            return F.when(F.startswith(state, F.lit(" ")), state).otherwise(let(let(F.split(state, ""), least), put))

        done = lambda s: F.array_join(F.transform(F.split(F.ltrim(s), ""), lambda c: token(c).cast("string")), " ")
        return F.aggregate(F.sequence(F.lit(1), F.length(latin)), start, merge, done)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def memo(self, df: DataFrame, text_col: str, id_col: str, memo_rows: int, memo_words: int) -> Memo:
        """Frequent words of about memo_rows texts, memo_words at most, in one of two slots each.

        A word that finds both its slots taken by more frequent ones is left out.
        """
        n = df.count()
        share = max(1, n // max(1, memo_rows))
        sample = df.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(share)) == 0)
        counted = sample.select(F.explode(self.words(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter("n > 1")
        top = counted.orderBy(F.desc("n"), "w").limit(memo_words)
        parts = 4 * df.sparkSession.sparkContext.defaultParallelism
        maps = self.maps()
        named = top.repartition(parts, F.xxhash64("w")).select("w", "n", *(c.alias(name) for name, c in maps.items()))
        folded = named.select("w", "n", let(F.struct(*maps), lambda m: self.fold(m, F.col("w"))).alias("ids")).toArrow()
        size = 1 << max(1, (folded.num_rows * 3 // 2).bit_length())
        words, ids = [None] * size, [None] * size
        for i in folded.to_pandas(self_destruct=True).sort_values(["n", "w"], ascending=[False, True]).itertuples():
            h = _xxhash64(i.w)
            at = h & (size - 1) if words[h & (size - 1)] is None else (h >> 20) & (size - 1)
            if words[at] is None:
                words[at], ids[at] = i.w, i.ids
        return Memo(constant(words, pa.string()), constant(ids, pa.string()), size)

    def encode(self, df: DataFrame, memo: Memo) -> DataFrame:
        """(id, ids) of (id, text): ids of a whole text as decimal numbers joined by one space; empty for an empty text."""
        maps = self.maps() | {"words": memo.words, "ids": memo.ids}
        named = df.select("id", "text", *(c.alias(name) for name, c in maps.items()))
        slot = lambda h: h.bitwiseAND(F.lit(memo.size - 1)).cast("int")

        def one(m, w, h):
            first, second = slot(h), slot(F.shiftright(h, 20))
            return F.when(F.get(m["words"], first) == w, F.get(m["ids"], first)).when(F.get(m["words"], second) == w, F.get(m["ids"], second)).otherwise(self.fold(m, w))

        hashed = lambda m: let(self.words(F.col("text")), lambda ws: F.array_join(F.zip_with(ws, F.transform(ws, lambda w: F.xxhash64(w)), lambda w, h: one(m, w, h)), " "))
        return named.select("id", let(F.struct(*maps), hashed).alias("ids"))

    def decode(self, df: DataFrame) -> DataFrame:
        """(id, ids, bytes) of (id, ids), ids being decimal numbers joined by one space."""
        named = df.select("id", "ids", self.pieces.alias("pieces"))
        joined = let(F.col("pieces"), lambda p: F.array_join(F.transform(F.split("ids", " "), lambda i: F.get(p, i.cast("int"))), ""))
        return named.select("id", "ids", F.unhex(F.when(F.col("ids") == "", F.lit("")).otherwise(joined)).alias("bytes"))


def encode_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, memo_rows: int = MEMO_ROWS, memo_words: int = MEMO_WORDS) -> DataFrame:
    """id and ids (decimal numbers joined by one space) for every row."""
    v = Vocabulary(path)
    memo = v.memo(df, text_col, id_col, memo_rows, memo_words)
    return v.encode(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), memo).select(F.col("id").alias(id_col), "ids")


def decode_rows(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and bytes for every row of ids; ids may also be an array of numbers."""
    ids = F.col(ids_col)
    if df.schema[ids_col].dataType.typeName() == "array":
        ids = F.array_join(ids.cast("array<string>"), " ")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(ids, F.lit("")).alias("ids"))
    return Vocabulary(path).decode(rows).select(F.col("id").alias(id_col), "bytes")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Vocabulary()
    docs = table(spark, sf_dir, "documents")
    memo = v.memo(docs, "text", "doc_id", MEMO_ROWS, MEMO_WORDS)
    r = v.decode(v.encode(docs.select(F.col("doc_id").alias("id"), "text"), memo))
    return r.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("ids") == "", F.lit(0)).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
