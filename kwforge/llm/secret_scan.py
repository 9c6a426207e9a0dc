"""Operator 7, secret scans: candidates by pattern, false positives removed by a random forest.

Everything runs in the JVM: patterns find candidates, SQL expressions take the features (length, character transitions,
dictionary coverage, path, neighbouring words), and Spark ML's forest judges them. The dictionary is the lower-case words
of a public vocabulary file (`language`, a parameter): coverage is the share of a value that lies in runs of letters
that are such words, and the transitions of letters are scored by the pairs that those words are made of. The forest is
trained from labelled findings (`labelled_findings`, generated here from a seed: secrets in the forms they take, and the
look-alikes that scanners stumble over); any other table of the same columns and a label can be given instead.

Texts without a candidate leave after one pattern match. Offsets come from the pieces between candidates, so one text
with many candidates costs one pass. No candidate has an upper length.

Nulls: a null text has no finding. Findings of a null id carry a null id; a redacted row takes those of its own text
alone. Repeated rows repeat their findings. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import collections
import functools
import math
import re

import xxhash
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm.byte_bpe import let
from kwforge.llm.common import table
from kwforge.llm.tokens import RANK_FILE, read_ranks, vocabulary_path

_KEYWORD = r"(?:[Pp]ass(?:word|wd)?|PASS(?:WORD|WD)?|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey|ACCESS[_-]?KEY)"
#: A name may go on after its keyword: API_KEY_PROD, token2.
_REST = r"(?:[_-][A-Za-z0-9_-]*+|[0-9]++)?+"
#: A name is looked into once, from its start, and only if it is assigned to; so names of any length cost one pass.
_NAME = "[A-Za-z0-9_-]"
_ASSIGN = f"(?<!{_NAME})(?={_NAME}*+[\"']?\\s*+[:=]){_NAME}*?" + _KEYWORD + _REST + r"[\"']?\s*+[:=]\s*+[\"']?"
#: What stands before a value and is no part of it: a telling name, an authorisation header, the user of a connection string.
_BEFORE = f"(?:{_ASSIGN}|[Bb]earer\\s++|://[^\\s/:@\"']++:)"
_KNOWN = (
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}|-----BEGIN [A-Z ]*?PRIVATE KEY-----(?:[A-Za-z0-9+/=\s\\:,]*+-----END [A-Z ]*?PRIVATE KEY-----)?+"
)
_RUN = "[A-Za-z0-9+/_-]"
_OPAQUE = f"(?<!{_RUN})(?=[A-Za-z+/_-]*+[0-9])(?={_RUN}{{16}})(?!{_RUN}*?{_ASSIGN}){_RUN}{{16,}}+(?:={{1,2}}(?![A-Za-z0-9]))?"
#: The password of a connection string, a value under a telling name or in a header, a known form, or a long run with a digit.
CANDIDATE = f"://[^\\s/:@\"']++:[^\\s/@\"']{{6,}}(?=@)|(?:{_ASSIGN}|[Bb]earer\\s++)[^\\s\"']{{8,}}|{_KNOWN}|{_OPAQUE}"
_CONTEXT = 40
_NEAR_KEY = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)" + _REST + r"[\"']?\s*+[:=]?\s*+[\"']?$|bearer\s++$"
_NEAR_BENIGN = r"(?i)(commit|checksum|sha-?\d*|md5|digest|hash|uuid|guid|revision|etag|build|version|example|sample|dummy|placeholder|phone|card|order|invoice|ticket|isbn)\W{0,3}$"
#: Values that stand for a secret that is elsewhere, or for none.
_STAND_IN = r"(?i)example|sample|dummy|placeholder|change.?me|your|^\$|[<{\[(]|\benv\b|environ|getenv|x{4,}|\*{3,}|0{8,}|1234567"

FEATURES = (
    "f_length", "f_digits", "f_upper", "f_lower", "f_transitions", "f_distinct", "f_hex", "f_words", "f_separators",
    "f_path", "f_known", "f_near_key", "f_near_benign", "f_run", "f_pairs", "f_stand_in", "f_user",
)
#: Buckets that the words of the dictionary are dealt into.
BUCKETS = 1 << 12


#: Parts that rows of one id and text are dealt into when they meet their findings.
SALTS = 8


def text_key(text: Column) -> Column:
    """A text's 256-bit hash, which tells the findings of rows with the same id apart."""
    return F.sha2(text, 256)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates: id, start (characters before the value), value, before, after, text_key."""
    text = F.col("text")
    hit = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.rlike(text, F.lit(CANDIDATE)))
    cut_up = hit.select("id", text_key(text).alias("text_key"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("between"))
    sizes = F.zip_with(F.slice(F.col("between"), F.lit(1), F.size("found")), F.col("found"), lambda b, c: F.struct(F.length(b).alias("b"), F.length(c).alias("c")))
    starts = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, x: F.struct((s["at"] + x["b"] + x["c"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["b"])).alias("out")), lambda s: s["out"],
    )
    each = cut_up.select("id", "text_key", "found", "between", starts.alias("starts")).select("id", "text_key", "between", F.posexplode(F.arrays_zip("found", "starts")).alias("i", "x"))
    found, prefix = F.col("x.found"), F.regexp_extract(F.col("x.found"), f"^{_BEFORE}", 0)
    value = F.substring(found, F.length(prefix) + F.lit(1), F.length(found))
    return each.select(
        "id",
        "text_key",
        (F.col("x.starts") + F.length(prefix)).cast("long").alias("start"),
        value.alias("value"),
        F.right(F.concat(F.get("between", F.col("i")), prefix), F.greatest(F.lit(_CONTEXT), F.length(prefix))).alias("before"),
        F.left(F.get("between", F.col("i") + 1), F.lit(_CONTEXT)).alias("after"),
    )


@functools.lru_cache(maxsize=4)
def language(path: str | None = None, least: int = 4) -> tuple[str, str]:
    """(dictionary, pairs) of the lower-case words of `least` letters or more that a rank file holds as whole tokens.

    The dictionary is one line a bucket, its words between spaces; pairs are the natural logarithms of the shares of the
    26 * 26 pairs of letters in these words, in alphabetical order. Both are of a size that the file sets.
    """
    words = [t[1:].decode() for t in read_ranks(path or vocabulary_path(RANK_FILE)) if re.fullmatch(rb" [a-z]{%d,}" % least, t)]
    lines: list[list[str]] = [[] for _ in range(BUCKETS)]
    for w in words:
        lines[xxhash.xxh64_intdigest(w.encode(), 42) % BUCKETS].append(w)
    seen = collections.Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    letters = "abcdefghijklmnopqrstuvwxyz"
    total = sum(seen.values()) + len(letters) ** 2
    pairs = (math.log((seen[a + b] + 1) / total) for a in letters for b in letters)
    return "\n".join(f" {' '.join(x)} " for x in lines), " ".join(f"{x:.3f}" for x in pairs)


def with_features(found: DataFrame, path: str | None = None) -> DataFrame:
    """The forest's features of each candidate, as doubles."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001-\u0003]+", "\u0004")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    words, pairs = language(path)
    lines, logs = F.split(F.lit(words), "\n"), F.split(F.lit(pairs), " ").cast("array<double>")  # folded into literals
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]{4,}"), F.lit(0))
    # a bucket is pmod of the unsigned hash; BUCKETS is a power of two, so the low bits are enough
    line = lambda r: F.get(lines, F.xxhash64(r).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    known = F.aggregate(runs, F.lit(0), lambda a, r: a + F.when(F.contains(line(r), F.concat(F.lit(" "), r, F.lit(" "))), F.length(r)).otherwise(0))
    codes = F.transform(F.split(F.regexp_replace(F.lower(v), "[^a-z]", ""), ""), lambda c: F.ascii(c) - F.lit(ord("a")))
    scores = lambda c: F.transform(F.slice(c, F.lit(2), F.size(c)), lambda x, i: F.get(logs, F.get(c, i) * F.lit(26) + x))
    mean = lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))
    return found.withColumns({
        "f_length": F.least(n, F.lit(200.0)),
        "f_digits": count("[0-9]") / n,
        "f_upper": count("[A-Z]") / n,
        "f_lower": count("[a-z]") / n,
        "f_transitions": F.length(kinds).cast("double") / n,
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double") / F.least(n, F.lit(32.0)),
        "f_hex": flag(F.rlike(v, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))),
        "f_words": known.cast("double") / n,
        "f_separators": count("[-_/.=+]") / n,
        "f_path": flag(F.rlike(F.col("before"), F.lit(r"[/\\.]$")) | F.rlike(v, F.lit(r"^/|/.*/"))),
        "f_known": flag(F.rlike(v, F.lit(f"^(?:{_KNOWN})"))),
        "f_near_key": flag(F.rlike(F.col("before"), F.lit(_NEAR_KEY))),
        "f_near_benign": flag(F.rlike(F.col("before"), F.lit(_NEAR_BENIGN))),
        "f_run": F.coalesce(F.length(F.regexp_extract(v, r"(.)\1{3,}", 0)).cast("double") / n, F.lit(0.0)),
        "f_pairs": F.coalesce(mean(let(codes, scores)), F.lit(-6.5)),
        "f_stand_in": flag(F.rlike(v, F.lit(_STAND_IN))),
        "f_user": flag(F.rlike(F.col("before"), F.lit(r"://[^\s/:@]+:$"))),
    })


def labelled_findings(spark: SparkSession, n: int = 9000, seed: int = 3) -> DataFrame:
    """n labelled findings: value, before, after, label (1 a secret). Secrets and look-alikes take turns."""
    h = F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string")), 512)
    base = spark.range(n).select("id", h.alias("h"), F.base64(F.unhex(h)).alias("b"))
    pick = lambda salt, items: F.get(F.array(*map(F.lit, items)), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(items))).cast("int"))
    alnum = F.regexp_replace("b", "[^A-Za-z0-9]", "")
    name = pick(1, ["password", "passwd", "secret", "token", "api_key", "apiKey", "API_KEY", "TOKEN", "access_key", "Token", "SECRET"])
    assign = F.concat(pick(2, ["the ", "set ", "", "\n", "on. "]), name, pick(3, [' = "', "=", ": ", ' : "', "='", "= "]))
    plain = pick(4, ["see ", "and the ", "\n", "with ", "( "])
    benign = F.concat(pick(5, ["", "the ", "at "]), pick(6, ["commit ", "checksum: ", "sha1 ", "sha256:", "md5 ", "uuid ", "digest ", "build ", "version ", "revision ", "etag: ", "order ", "card "]))
    sub = lambda c, k: F.substring(c, 1, k)
    length = F.lit(20) + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(40)).cast("int")
    uuid = F.concat_ws("-", sub("h", 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12))
    filler = pick(7, ["your-api-key-here-1", "changeme123456789", "xxxxxxxxxxxxxxxxxxx0", "example_token_value_1", "placeholder-secret-01", "0000000000000000", "1234567890abcdef123", "test_user_password_1", "sample_key_value_2024", "aaaaaaaaaaaaaaaaaaaa1", "<your_token_here_1>"])
    snake = F.concat_ws("_", pick(10, ["get", "set", "report", "model"]), pick(11, ["user", "page", "image", "table"]), pick(12, ["index", "config", "version", "data"]), sub("h", 2), pick(13, ["final", "draft", "v2", "2024"]))
    name_like = F.replace(snake, F.lit("_"), pick(8, ["_", "-"]))
    path = F.concat(pick(14, ["usr/lib/", "home/site/", "img/2024/"]), pick(15, ["python3/packages/", "data/images/", "build/report/"]), sub("h", 6))
    digits = F.rpad(F.regexp_replace("h", "[^0-9]", ""), 16, "4071")
    word = lambda salt: pick(salt, ["winter", "monkey", "silver", "garden", "tiger", "coffee", "orange", "river", "falcon", "magic", "horse", "battery", "purple", "dragon"])
    secret_name = pick(17, ["password", "passwd", "Password", "PASSWORD", "pwd", "db_password", "DB_PASSWD", "pass"])
    told = F.concat(pick(2, ["the ", "set ", "", "\n", "on. "]), secret_name, pick(3, [' = "', "=", ": ", ' : "', "='", "= "]))
    user = F.concat(pick(18, ["postgres", "mysql", "https", "redis", "amqp", "mongodb+srv"]), F.lit("://"), pick(19, ["admin", "root", "app", "svc-web", "u1"]), F.lit(":"))
    end = F.concat(pick(20, ["", "_", "-", "2024", "99", "7"]), pick(21, ["!", "1", "#", "", "$4", "x"]))
    phrase = F.concat(word(22), word(23), word(24))
    mixed = F.concat(F.initcap(word(25)), F.substring(digits, F.lit(1), F.lit(4)), end)
    prose = pick(26, ["required", "authentication", "something", "management", "information", "available", "unlimited.", "generated", "protected", "forgotten,", "characters", "optional;"])
    source = pick(27, ["${DB_PASSWORD}", "process.env.API_TOKEN", "os.environ[", "getenv(TOKEN)", "{{secret_value}}", "<password-goes-here>", "config.get(", "********", "xxxxxxxxxx", "self.token_value", "request.headers[", "settings.SECRET_KEY"])
    slug = F.concat_ws("-", word(28), F.lit("and"), word(29), pick(30, ["guide", "review", "recipe", "history"]), pick(31, ["2024", "2", "part-1", "10"]))
    shapes = [
        (1, assign, sub("h", 40)), (1, assign, F.upper(sub("h", 40))), (1, assign, F.substring(alnum, F.lit(1), length)), (1, assign, sub("h", 32)),
        (1, assign, F.concat(sub(alnum, 10), pick(16, ["!", "#7", "$x", "@9"]), F.substring(alnum, 20, 4))),
        (1, plain, F.concat(F.lit("AKIA"), F.upper(sub(F.regexp_replace("b", "[^A-Z0-9a-z]", "7"), 16)))),
        (1, plain, F.concat(F.lit("ghp_"), F.rpad(sub(alnum, 36), 36, "a7"))), (1, assign, F.concat(F.lit("sk_live_"), sub(alnum, 24))),
        (1, user, F.concat(sub(alnum, 12), end)), (1, user, mixed), (1, told, phrase), (1, told, mixed), (1, F.lit("Authorization: Bearer "), F.concat(F.lit("ya29."), F.substring(alnum, F.lit(1), length))),
        (1, F.lit("authorization: bearer "), F.substring(alnum, F.lit(1), length)), (1, assign, F.concat(sub("b", 40), F.lit("=="))),
        (0, benign, sub("h", 40)), (0, benign, sub("h", 32)), (0, benign, sub("h", 64)), (0, benign, uuid), (0, plain, uuid),
        (0, assign, filler), (0, plain, name_like), (0, F.concat(plain, F.lit("/")), path), (0, plain, path), (0, benign, sub(digits, 16)), (0, plain, sub(digits, 16)), (0, F.concat(benign, F.lit("#")), sub(digits, 18)),
        (0, assign, source), (0, told, source), (0, told, prose), (0, assign, prose), (0, plain, slug), (0, F.concat(plain, F.lit("?id=")), sub(digits, 16)), (0, user, source), (0, told, filler),
    ]
    kind = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(77)), F.lit(len(shapes))).cast("int")
    rows = F.array(*(F.struct(F.lit(y).alias("label"), b.alias("before"), v.alias("value")) for y, b, v in shapes))
    return base.select(F.get(rows, kind).alias("r")).select("r.value", F.right("r.before", F.lit(_CONTEXT)).alias("before"), F.lit(' "\n').alias("after"), F.col("r.label").cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 17) -> PipelineModel:
    """Fit the forest to labelled findings."""
    ready = with_features(findings).repartition(2, "value").select(*FEATURES, "label")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(ready)


def scan(df: DataFrame, model: PipelineModel | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every candidate with its verdict: id, start, length, value, probability, is_secret, text_key."""
    model = model or train(labelled_findings(df.sparkSession))
    judged = model.transform(with_features(find(df, id_col, text_col)))
    p = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return judged.select(F.col("id").alias(id_col), "start", F.length("value").cast("long").alias("length"), "value", p.alias("probability"), (p >= threshold).alias("is_secret"), "text_key")


def redact(df: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The table with every found secret replaced by a mark; its columns and rows stay as they are.

    findings are those of `scan`: a row takes only the findings of its own id and text, so rows that
    share an id, or have none, don't change each other. Equal rows share their findings, whatever their number; rows
    meet them salted, as one id and text may be very frequent.
    """
    spans = findings.filter("is_secret").select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"), F.struct("start", "length").alias("__s"))
    spans = spans.groupBy("__id", "__key").agg(F.array_sort(F.collect_set("__s")).alias("__spans"))
    spans = spans.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    text = F.col(text_col)
    new = F.aggregate(
        "__spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark)).alias("out"), (x["start"] + x["length"]).alias("at")),
        lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    keyed = df.withColumns({"__text": text_key(text), "__part": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    same = keyed[id_col].eqNullSafe(spans["__id"]) & (keyed["__text"] == spans["__key"]) & (keyed["__part"] == spans["__salt"])
    joined = keyed.join(spans.hint("merge"), same, "left")
    return joined.select(*(F.when(F.col("__spans").isNull(), text).otherwise(new).alias(c) if c == text_col else keyed[c] for c in df.columns))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("text_key")
