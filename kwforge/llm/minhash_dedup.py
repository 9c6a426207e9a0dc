"""Operator 5, near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts collapse to one representative, the smallest id (one shuffle of hashes, not texts).
2. Word frequencies: every task counts the representatives that hold a word, by word hash in `IDF_BUCKETS` buckets;
   the bucketed counts are summed by block. The table has a fixed size, so its broadcast is bounded.
3. A text is a weighted set of five-word shingles. The weight is tf * idf: tf is 1 + ln(count); idf is
   1 + half the mean over the five words of ln((1 + n) / (1 + df)) / ln(1 + n). idf is taken from words, not from
   whole shingles, because a large group of copies would raise the frequency of its own shingles and so push its
   members apart. A shingle that occurs c times enters as c features of fixed weight that add up to tf * idf, which
   makes the weighted Jaccard similarity the weight of shared features over the weight of all.
4. Improved consistent weighted sampling draws SAMPLES samples a text, banded BANDS times ROWS.
5. Pairs that share a band are verified by exact weighted Jaccard similarity, but only as far as the classes need it:
   a pair whose ends are linked already, over whatever path, changes no class. First each text is verified against one
   hub, the least id it shares a band with; a hub's texts are dealt into groups of `block`, so a group of near copies
   costs work linear in its size, however large it is. A band is mixed if its texts are of two classes or more; texts
   of mixed bands meet other hubs in further rounds while that settles at least half of them. What is left is verified
   exhaustively, in pairs of blocks of `block` texts, without the pairs inside a cluster's largest class. Groups emit
   stars or spanning forests of the verified links, never all pairs.
6. Components of the verified links are the classes.

Nulls: a null or wordless text has no shingle and links with nothing but equal texts (null with null is no link: each
null text is a class of its own). A text under five words is one shingle. A null id is kept as a class of its own.
Repeated rows give repeated result rows. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwforge.llm.common import SALTS, components, cut, drop_cut, each_salt, mix, salt, salts_met, shingle_hashes, table, word_hashes

BANDS, ROWS = 24, 6
SAMPLES = BANDS * ROWS
IDF_BUCKETS = 1 << 20
IDF_BLOCK = 1 << 14
#: Rows of random numbers that features share by hash: two features of one row draw alike, one pair in 65,536.
PARAMS = 1 << 16
#: Features that two blocks are compared by at once: a dense matrix of these by 512 texts, 8 MB, for either block.
FEATURES = 1 << 12


def word_frequencies(texts: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """(documents by word bucket, number of texts); a table of IDF_BUCKETS counts whatever the corpus is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(IDF_BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[np.unique(word_hashes(text) % np.uint64(IDF_BUCKETS)).astype(np.int64)] += 1
                n += 1
        blocks = df.reshape(-1, IDF_BLOCK)
        used = np.flatnonzero(blocks.any(1)).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used], pa.int32()), pa.array([np.int64(n).tobytes(), *(blocks[i].astype("<u4").tobytes() if blocks[i].max() < 1 << 32 else blocks[i].tobytes() for i in used)], pa.binary())],
            names=["block", "counts"],
        )

    def as_counts(b: bytes) -> np.ndarray:
        return np.frombuffer(b, "<u4" if len(b) == 4 * IDF_BLOCK else "<i8").astype(np.int64)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(as_counts(b) for b in pdf["counts"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [np.asarray(total).astype("<i8").tobytes()]})

    parts = texts.select(column).mapInArrow(count, "block int, counts binary")
    summed = parts.groupBy("block").applyInPandas(add, "block int, counts binary")
    df, n = np.zeros(IDF_BUCKETS, np.int64), 0
    for r in summed.toLocalIterator():  # IDF_BUCKETS counts at most
        if r["block"] < 0:
            n = int(np.frombuffer(r["counts"], "<i8")[0])
        else:
            df[r["block"] * IDF_BLOCK : (r["block"] + 1) * IDF_BLOCK] = np.frombuffer(r["counts"], "<i8")
    return df, n


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """Damped inverse frequency by word bucket: from 1 (in every text) to 1.5 (in none)."""
    return (1 + 0.5 * np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(2 + n)).astype(np.float32)


def weighted_shingles(text: str | None, idf: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features and their weights; the j-th occurrence of a shingle adds ln(j / (j - 1)) of its idf, the first 1."""
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    k = min(size, len(words))
    w = idf[(words % np.uint64(len(idf))).astype(np.int64)].astype(np.float64)
    total = np.concatenate(([0.0], np.cumsum(w)))
    mean = (total[k:] - total[:-k]) / k
    h = shingle_hashes(words, size)
    order = np.argsort(h, kind="stable")
    h, mean = h[order], mean[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    starts = np.flatnonzero(first)
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h)))) + 1
    base = mean[np.repeat(starts, np.diff(np.append(starts, len(h))))]
    with np.errstate(divide="ignore"):
        part = np.where(nth == 1, 1.0, np.log(nth / np.maximum(nth - 1, 1)))
    feature = np.where(nth == 1, h, mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    weight = np.round(base * part, 5).astype(np.float32)
    order = np.argsort(feature, kind="stable")
    return feature[order], weight[order]


_PARAMS: dict[int, tuple] = {}


def _sampling_params(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, beta and ln c for PARAMS rows of features and every sample: r and c are Gamma(2, 1), beta is uniform."""
    if seed not in _PARAMS:
        g = np.random.default_rng(seed)
        shape = (PARAMS, SAMPLES)
        r = g.standard_gamma(2.0, shape, dtype=np.float32)
        np.maximum(r, np.float32(1e-3), out=r)
        c = g.standard_gamma(2.0, shape, dtype=np.float32)
        np.log(c, out=c)
        beta = g.random(shape, dtype=np.float32)
        _PARAMS[seed] = r, beta, c
    return _PARAMS[seed]


def forget_sampling() -> None:
    """Free the random numbers of this process, 113 MB: Spark uses its workers again for tasks that draw no samples."""
    _PARAMS.clear()


def samples(feature: np.ndarray, weight: np.ndarray, seed: int = 1) -> np.ndarray:
    """One draw a sample: a 64-bit key of (feature, t), by the least ln a = ln c - r (t - beta) - r."""
    r_all, beta_all, c_all = _sampling_params(seed)
    best = np.full(SAMPLES, np.inf, np.float32)
    key = np.zeros(SAMPLES, np.uint64)
    cols = np.arange(SAMPLES)
    for at in range(0, len(feature), 2048):
        f, lw = feature[at : at + 2048], np.log(weight[at : at + 2048]).astype(np.float32)[:, None]
        rows = (f >> np.uint64(48)).astype(np.int64) % PARAMS
        r, beta = r_all[rows], beta_all[rows]
        t = lw / r
        t += beta
        np.floor(t, out=t)
        a = t - beta
        a += np.float32(1)
        a *= r
        np.subtract(c_all[rows], a, out=a)
        i = a.argmin(0)
        low = a[i, cols]
        better = low < best
        best = np.where(better, low, best)
        key = np.where(better, mix(f[i] ^ (t[i, cols].astype(np.int64).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))), key)
    return key


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for col in sample.reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0x100000001B3) ^ col)
    return out.view(np.int64)


def representatives(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rep, text_key) for every row with an id and a text: the smallest id with an equal text, by its 256-bit hash, and 64 bits of that."""
    hashed = df.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(F.col(text_col), 256).alias("h"), salt(id_col).alias("salt"))
    least = hashed.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"), salts_met("salt").alias("mask")).filter("n > 1")
    salted = least.select("h", "rep", each_salt().alias("salt"))
    return hashed.join(salted, ["h", "salt"], "left").select("id", F.coalesce("rep", "id").alias("rep"), F.xxhash64("h").alias("text_key"))


def _links(shared_blocks: list[tuple], threshold: float, other: list[tuple] | None) -> list[tuple[int, int]]:
    """Verified pairs of a block with itself, or of two blocks, as a spanning forest.

    A row is (id, features, weights, bands). Pairs that share no band are not links.
    """
    left, right = shared_blocks, shared_blocks if other is None else other
    lb, rb = np.array([x[3] for x in left]), np.array([x[3] for x in right])
    pairs = np.zeros((len(left), len(right)), bool)
    for b in range(BANDS):
        pairs |= lb[:, b][:, None] == rb[:, b][None, :]
    if other is None:
        pairs = np.triu(pairs, 1)
    if not pairs.any():
        return []
    used_l, used_r = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
    total = lambda rows: np.array([float(x[2].astype(np.float64).sum()) for x in rows])
    tl, tr = total(left), total(right)
    both = np.zeros(pairs.shape)
    names = np.unique(np.concatenate([left[i][1] for i in used_l]))
    names = names[np.isin(names, np.concatenate([right[j][1] for j in used_r]))]
    for at in range(0, len(names), FEATURES):
        part = names[at : at + FEATURES]

        def dense(rows, used, part=part, weigh=False):
            m = np.zeros((len(used), len(part)), np.float32)
            for k, i in enumerate(used):
                f, w = rows[i][1], rows[i][2]
                lo, hi = np.searchsorted(f, part[0]), np.searchsorted(f, part[-1], "right")
                f, w = f[lo:hi], w[lo:hi]
                pos = np.searchsorted(part, f)
                ok = part[np.minimum(pos, len(part) - 1)] == f
                m[k, pos[ok]] = w[ok] if weigh else 1
            return m

        both[np.ix_(used_l, used_r)] += dense(left, used_l, weigh=True) @ dense(right, used_r).T
    good = pairs & (both >= threshold * (tl[:, None] + tr[None, :] - both) * (1 - 1e-6))
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(good), strict=True):
        a, b = left[i][0], right[j][0]
        ra, rb_ = root(a), root(b)
        if ra != rb_:
            parent[max(ra, rb_)] = min(ra, rb_)
            out.append((min(a, b), max(a, b)))
    return out


def near_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, block: int = 256, star_rounds: int = 4, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(reps, links): reps (id, rep, text_key) of equal texts; links (a, b), a spanning forest of the verified near-duplicates."""
    spark = df.sparkSession
    reps = cut(representatives(df, id_col, text_col), "reps")
    own = reps.filter("id = rep").select("id").distinct()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts are always dealt by id: what is broadcast in a small run would be shuffled in a large one
    once = texts.join(own.hint("merge"), "id", "left_semi")
    counts, n = word_frequencies(texts, "text")
    idf = spark.sparkContext.broadcast(idf_table(counts, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bands = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, w = weighted_shingles(text, idf.value)
                if len(f):
                    ids.append(i)
                    bands.append(band_keys(samples(f, w, seed)))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)], names=["id", "bands"])

    signed = cut(once.mapInArrow(sign, "id long, bands array<long>"), "bands")
    # a band that very many texts share is one key: its texts meet its hub dealt into parts
    flat = signed.select("id", F.explode("bands").alias("band"), salt("id").alias("salt"))
    hubs = flat.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n"), salts_met("salt").alias("mask")).filter("n > 1")
    met = cut(flat.join(hubs.select("band", "hub", each_salt().alias("salt")), ["band", "salt"]).select("id", "band", "salt", "hub"), "met")
    texted = cut(texts.join(met.select("id").distinct().hint("merge"), "id"), "met-texts")

    # rounds of stars: each text meets one hub, first the least of its bands, later one of another class in a mixed band
    stars = _star_links(texted, met.groupBy("id").agg(F.min("hub").alias("hub")).filter("id <> hub"), idf, threshold, block)
    links = cut(stars, "near")
    before = None
    for turn in range(max(1, star_rounds)):
        classes = components(links)
        mixed = cut(_mixed_bands(met, classes), "mixed")
        drop_cut(classes)
        left = mixed.select("id").distinct().count()
        if not left or turn >= star_rounds - 1 or (before is not None and 2 * left > before):
            break
        before = left
        order = F.xxhash64("id", F.lit(turn))
        first = F.when(F.col("class") == F.col("least"), F.struct(order.alias("o"), F.col("id").alias("hub")))
        hubs = mixed.groupBy("band").agg(F.min(first)["hub"].alias("hub"), F.bit_or(F.expr("if(class <> least, shiftleft(1, salt), 0)")).alias("mask"))
        one = F.min(F.struct(F.xxhash64("hub", F.lit(turn)).alias("o"), F.col("hub")))["hub"].alias("hub")
        others = mixed.filter("class <> least").select("id", "band", "salt").join(hubs.select("band", "hub", each_salt().alias("salt")), ["band", "salt"]).groupBy("id").agg(one)
        links = links.union(cut(_star_links(texted, others, idf, threshold, block), "near"))
        drop_cut(mixed)
    if left:
        links = links.union(cut(_block_links(texted, signed, mixed, idf, threshold, block), "near"))
    for done in (mixed, met, texted, signed):
        drop_cut(done)
    return reps, links


def _mixed_bands(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, band, salt, class, least) of the bands whose texts are of two classes or more; least is the band's least class."""
    classed = met.join(classes.withColumnRenamed("component", "class"), "id", "left").select("id", "band", "salt", F.coalesce("class", "id").alias("class"))
    mixed = classed.groupBy("band").agg(F.min("class").alias("least"), F.max("class").alias("most"), salts_met("salt").alias("mask")).filter("least <> most")
    return classed.join(mixed.select("band", "least", each_salt().alias("salt")), ["band", "salt"]).select("id", "band", "salt", "class", "least")


def _star_links(texted: DataFrame, pairs: DataFrame, idf, threshold: float, block: int) -> DataFrame:
    """Verified links (a, b) among pairs (id, hub). A hub's texts are dealt into groups of about `block`, its own text goes to each."""
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    pairs = cut(pairs, "pairs")
    pairs = pairs.withColumn("salt", salt("id"))
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("n"), salts_met("salt").alias("mask")).select("hub", "mask", parts.alias("parts"))
    rays = pairs.join(sizes.select("hub", "parts", each_salt().alias("salt")), ["hub", "salt"]).select("id", "hub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    centres = sizes.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = texted.join(rays.union(centres).hint("merge"), "id")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        forget_sampling()
        hub = int(pdf["hub"].iloc[0])
        at_hub = pdf["id"] == hub
        hf, hw = weighted_shingles(pdf["text"][at_hub].iloc[0] if at_hub.any() else None, idf.value)
        total, found = float(hw.astype(np.float64).sum()), []
        for i, text in zip(pdf["id"][~at_hub], pdf["text"][~at_hub], strict=True):
            f, w = weighted_shingles(text, idf.value)
            if len(hf) and len(f):
                shared = hf[np.minimum(np.searchsorted(hf, f), len(hf) - 1)] == f
                both, own = float(w[shared].astype(np.float64).sum()), float(w.astype(np.float64).sum())
                if both >= threshold * (total + own - both) * (1 - 1e-6):
                    found.append((min(int(i), hub), max(int(i), hub)))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("hub", "part").applyInPandas(verify, "a long, b long")


def _block_links(texted: DataFrame, signed: DataFrame, mixed: DataFrame, idf, threshold: float, block: int) -> DataFrame:
    """Verified links (a, b) among the texts of mixed bands, whose pairs of two classes the stars have not settled.

    The texts that mixed bands connect are a cluster. A small cluster is one group. In a larger one the texts of its
    largest class are dealt into blocks that meet the blocks of all other texts, but not each other.
    """
    hubs = mixed.groupBy("band").agg(F.min("id").alias("hub"), salts_met("salt").alias("mask")).select("band", "hub", each_salt().alias("salt"))
    clusters = components(mixed.join(hubs, ["band", "salt"]).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    member = clusters.join(mixed.select("id", "class", "salt").distinct(), "id")
    main = member.groupBy("component", "class").agg(F.count("*").alias("n"), salts_met("salt").alias("mask")).groupBy("component").agg(
        F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("n"), F.bit_or("mask").alias("mask")
    )
    small = F.col("n") <= block
    main_parts = F.when(small, 0).otherwise(F.ceil(F.col("main.n") / F.lit(block))).cast("int")
    rest_parts = F.when(small, 1).otherwise(F.ceil((F.col("n") - F.col("main.n")) / F.lit(block))).cast("int")
    sized = main.select("component", F.col("main.class").alias("main"), small.alias("small"), main_parts.alias("p"), rest_parts.alias("q"), each_salt().alias("salt"))
    of_main = ~F.col("small") & (F.col("class") == F.col("main"))
    place = F.xxhash64("id")
    mine = F.when(of_main, F.pmod(place, F.greatest("p", F.lit(1)))).otherwise(F.col("p") + F.pmod(place, F.col("q"))).cast("int")
    first = F.when(of_main, F.col("p")).otherwise(F.lit(0))
    pairs = F.transform(F.sequence(first, F.col("p") + F.col("q") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    member = member.join(sized, ["component", "salt"]).withColumn("mine", mine).select("id", "component", "mine", pairs.alias("pairs"))
    ready = texted.join(member.hint("merge"), "id").join(signed.hint("merge"), "id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [weighted_shingles(t, idf.value) for t in batch.column("text").to_pylist()]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array([f.tobytes() for f, _ in got], pa.binary()), pa.array([w.tobytes() for _, w in got], pa.binary())],
                names=[*(batch.schema.names[i] for i in kept), "f", "w"],
            )

    vectored = ready.select("id", "component", "mine", "pairs", "bands", "text").mapInArrow(vectors, "id long, component long, mine int, pairs array<struct<i int, j int>>, bands array<long>, f binary, w binary")
    dealt = vectored.withColumn("pair", F.explode("pairs")).select("id", "component", "mine", "bands", "f", "w", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        forget_sampling()
        rows = [(int(r.id), np.frombuffer(r.f, np.uint64), np.frombuffer(r.w, np.float32), np.asarray(r.bands)) for r in pdf.itertuples()]
        i, j, mine_ = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), pdf["mine"].to_numpy()
        out = []
        left = [x for x, m in zip(rows, mine_, strict=True) if m == i]
        right = [x for x, m in zip(rows, mine_, strict=True) if m == j]
        step = 2 * block  # hashing deals blocks unevenly; a block stays under its bound here
        for p in range(0, len(left), step):
            for q in range(p if i == j else 0, len(right), step):
                same = i == j and p == q
                out += _links(left[p : p + step], threshold, None if same else right[q : q + step])
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("component", "i", "j").applyInPandas(verify, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, class_id (the smallest id of its class), kept (id = class_id) for every row."""
    reps, links = near_links(df, id_col, text_col, **options)
    classes = components(links)
    reps = reps.withColumn("salt", salt("id"))
    met = reps.groupBy("rep").agg(salts_met("salt").alias("mask")).join(classes.select(F.col("id").alias("rep"), "component"), "rep")
    rep_class = reps.join(met.select("rep", "component", each_salt().alias("salt")), ["rep", "salt"], "left")
    by_id = rep_class.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
    out = df.select(F.col(id_col).alias("id")).join(by_id, "id", "left")
    cls = F.coalesce(F.col("class_id"), F.col("id"))
    return out.select(F.col("id").alias(id_col), cls.alias("class_id"), F.coalesce(cls == F.col("id"), F.lit(True)).alias("kept"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
