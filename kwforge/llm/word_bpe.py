"""Operator 12, BPE with word ends: encoding by a tokenization automaton that is compiled from the merges.

The automaton reads tokens. It starts as one state with a loop on every base symbol, and one gadget for each merge (u, v)
-> t, in their order, turns it into the automaton of the texts as they are tokenized after that merge:

* t leads where v led;
* u now leads to a copy of its state in which v is not accepted any more, nor any token that grew from v after this merge;
* t is accepted wherever u is. If v is not accepted behind u to begin with, t can't arise, and is accepted nowhere.

The accepted strings are in the end the tokenizations that the merges give, one for every word. All arcs of a token lead to
one state, so the automaton is a table of target states (`target`) and, for each state, what it does not accept. Tokens
are numbered so that a token and what grew from it later are one range; what a state does not accept is then a few ranges,
found by one binary search (`lo`, `hi`).

A word is encoded by table look-ups from left to right: from each place whose state is known, the tokens that start there
are read off a trie, and each one that the state accepts leads to the place behind it. Every place is reached by one token,
as every beginning of a word has one tokenization; the tokens are read back from the end. Distinct words of a batch go
through the tables side by side, in numpy. Decoding emits the labels of the arcs, joined as the library joins them.

Words: text is cut at the special tokens' strings, which are ids of their own as in the library. What lies between is
brought into NFC, lower-cased and split by the file's pattern. Text of ordinary Latin characters, for which NFC changes
nothing and Unicode versions agree, is split here; any other text by the library's own normalizer and pattern.

The automaton is compiled on the driver and broadcast: its size follows from the vocabulary file (a few megabytes), not
from the data. Words that a process has encoded are remembered, MEMO_WORDS at most; this changes the cost alone.

Cases: a null text is an empty one, without ids, and decodes to the empty text. Texts are encoded whole, very long ones
block by block, cut at white space; a word of more than LONG symbols goes through the same tables alone. Repeated rows are
encoded row by row. Ids beyond the vocabulary decode to nothing, as in the library. Extra columns are kept by `encode`; its
own two columns take the place of columns of the same names. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from kwforge.llm.common import table
from kwforge.llm.tokens import vocabulary_path

FILE = "word_bpe_49k.json"
#: Symbols: the 256 bytes, and the 256 bytes that end a word.
SYMBOLS, ENDED = 512, 256
#: Bits below a state's number in the keys of what it does not accept.
_BITS = 17
#: Words of more symbols go alone; words remembered by a process; characters of text that are split at once; words of
#: texts whose new ones are encoded together.
LONG, MEMO_WORDS, BLOCK, TOGETHER = 64, 1 << 19, 1 << 20, 1 << 18
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ]*")
_GAP = re.compile(r"\s")


def _byte_names() -> list[str]:
    """The characters that stand for bytes in the file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, fresh = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(fresh)
            fresh += 1
    return [names[b] for b in range(256)]


def _pattern() -> re.Pattern:
    """The file's split pattern over lower-cased ordinary Latin text, its classes written out."""
    kind = {k: "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kind['L']}]+|[{kind['N']}]|[^\s{kind['L']}{kind['N']}]+")


_WORDS = _pattern()


class Automaton:
    """The compiled merges: arrays only, so that it can be sent and shared."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int], end: str = "</w>"):
        n = max([*vocabulary.values(), *specials.values()], default=-1) + 1
        self.labels = [""] * n
        for t, i in {**vocabulary, **specials}.items():
            self.labels[i] = t
        self.specials = dict(specials)
        byte_of = {c: b for b, c in enumerate(_byte_names())}
        spell = lambda t: [byte_of[c] for c in t.removesuffix(end)]
        self.symbols = {}
        for t, i in vocabulary.items():
            s = spell(t)
            if t.endswith(end):
                s[-1] += ENDED
            self.symbols[i] = s
        ids = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in merges]
        self._compile(ids, n)
        self._trie(n)
        del self.symbols

    def _compile(self, merges: list[tuple[int, int, int]], n: int) -> None:
        """Apply the merge gadgets one by one. State r + 1 is the copy that merge r makes; its parent is what it copies."""
        target, parent = [0] * n, [-1]
        grown: list[list[int]] = [[] for _ in range(n)]  # merges by which a token grew at its right side
        for r, (u, v, t) in enumerate(merges):
            target[t] = target[v]
            grown[u].append(r)
            parent.append(target[u])
            target[u] = r + 1
        # numbers: whatever grew from a token lies before it, earlier growth first
        born = {t for _, _, t in merges}
        place, begin, at = [0] * n, [0] * n, 0
        for root in (i for i in sorted(self.symbols) if i not in born):
            stack = [(root, 0)]
            while stack:
                t, k = stack.pop()
                if k == 0:
                    begin[t] = at
                if k < len(grown[t]):
                    stack += [(t, k + 1), (merges[grown[t][k]][2], 0)]
                else:
                    place[t] = at
                    at += 1
        # what merge r forbids: v, and the tokens that grew from v from r on
        ranges = [(-1, -1)]
        for r, (_, v, _) in enumerate(merges):
            later = bisect.bisect_left(grown[v], r)
            ranges.append((begin[merges[grown[v][later]][2]] if later < len(grown[v]) else place[v], place[v]))
        never = set()
        for r, (u, v, t) in enumerate(merges):
            s, at = parent[r + 1], place[v]
            while s > 0 and not ranges[s][0] <= at <= ranges[s][1]:
                s = parent[s]
            if s > 0 or u in never or v in never:
                never.add(t)
        for t in never:
            del self.symbols[t]
        number = {s: i for i, s in enumerate(sorted({0, *(target[i] for i in self.symbols)}))}
        lo, hi = [], []
        for s, i in number.items():
            mine = []
            while s > 0:
                mine.append(ranges[s])
                s = parent[s]
            end = -1
            for a, b in sorted(mine, key=lambda x: (x[0], -x[1])):  # ranges nest or lie apart
                if b > end:
                    lo.append((i << _BITS) | a)
                    hi.append((i << _BITS) | b)
                    end = b
        self.lo, self.hi = np.array(lo, np.int64), np.array(hi, np.int64)
        self.target = np.array([number[target[i]] if i in self.symbols else 0 for i in range(n)], np.int32)
        self.place = np.array(place, np.int32)
        self.start, self.states = number[0], len(number)

    def _trie(self, n: int) -> None:
        """Arcs of the trie of all tokens: sorted keys node * SYMBOLS + symbol, the node that each leads to, and nodes' tokens."""
        arcs: dict[int, int] = {}
        token = [-1]
        for i, s in self.symbols.items():
            at = 0
            for x in s:
                at = arcs.setdefault(at * SYMBOLS + x, len(token))
                if at == len(token):
                    token.append(-1)
            token[at] = i
        self.keys = np.array(sorted(arcs), np.int64)
        self.nodes = np.array([arcs[k] for k in self.keys.tolist()], np.int32)
        self.token = np.array(token, np.int32)
        self.size = np.zeros(n, np.int32)
        for i, s in self.symbols.items():
            self.size[i] = len(s)
        self.longest = int(self.size.max(initial=0))


@functools.lru_cache(4)
def compile_file(path: str | None = None) -> Automaton:
    """The automaton of a vocabulary file of the tokenizers library (BPE over bytes, with word ends)."""
    with open(path or vocabulary_path(FILE), encoding="utf-8") as f:
        d = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
    specials = {t["content"]: t["id"] for t in d["added_tokens"]}
    vocabulary = {t: i for t, i in d["model"]["vocab"].items() if t not in specials}
    return Automaton(vocabulary, merges, specials, d["model"]["end_of_word_suffix"])


class Labels:
    """Decoding: the labels of the automaton's arcs."""

    def __init__(self, labels: list[str]):
        self.n = len(labels)
        self.spoken = pa.array([x + " " for x in labels] + labels + [""], pa.large_string())  # a label before others, and one at the end

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts: the labels of each row's ids, joined by one space; ids without a label are passed over."""
        n = self.n
        known = (ids >= 0) & (ids < n)
        if not known.all():
            row = np.repeat(np.arange(len(counts)), counts)[known]
            ids, counts = ids[known], np.bincount(row, minlength=len(counts))
        ends = np.cumsum(counts)
        pick = ids.astype(np.int64)
        pick[ends[counts > 0] - 1] += n  # the last label of a text has no space behind it
        spoken = pc.take(self.spoken, pa.array(pick))
        at = np.frombuffer(spoken.buffers()[1], np.int64, len(pick) + 1) if len(pick) else np.zeros(1, np.int64)
        data = spoken.buffers()[2] if len(pick) else pa.py_buffer(b"")
        offsets = at[np.concatenate(([0], ends))]
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(np.ascontiguousarray(offsets)), data)


class Encoder:
    """Table-driven encoding with a compiled automaton; one a process."""

    def __init__(self, automaton: Automaton, path: str | None = None):
        self.a, self.path = automaton, path
        self.cut = re.compile("|".join(map(re.escape, sorted(automaton.specials, key=len, reverse=True))) or r"(?!)")
        self.full = None
        self.arcs = None
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 12, np.int32), 0
        self.first, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        for s, i in self.a.specials.items():
            self._remember([s], np.array([i], np.int32), np.array([1], np.int32))

    def _remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Ids of new words, one word's after the other."""
        k, n = len(self.code), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while k + n > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[k : k + n] = self.used + np.cumsum(counts) - counts
        self.count[k : k + n] = counts
        self.used += len(ids)
        self.code.update(zip(words, range(k, k + n), strict=True))

    # --- words of a text

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a whole text in order, block by block; a special token's string is a word of its own."""
        at = 0
        for m in self.cut.finditer(text):
            yield from self._split(text[at : m.start()])
            yield [m.group()]
            at = m.end()
        yield from self._split(text[at:] if at else text)

    def _split(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            if end < len(text):  # no word holds white space
                gap = _GAP.search(text, end)
                end = gap.start() if gap else len(text)
            block = text[at:end]
            at = end
            yield _WORDS.findall(block.lower()) if _PLAIN.fullmatch(block) else self._library_words(block)

    def _library_words(self, text: str) -> list[str]:
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path or vocabulary_path(FILE))
            self.byte = {c: b for b, c in enumerate(_byte_names())}
        found = self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(text))
        return [bytes([self.byte[c] for c in w]).decode() for w, _ in found]

    # --- the automaton

    def learn(self, words: list[str]) -> None:
        """Encode distinct new words and remember them."""
        raw = [w.encode() for w in words]
        short = sorted((i for i in range(len(raw)) if len(raw[i]) <= LONG), key=lambda i: len(raw[i]))
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            self._remember([words[i] for i in part], *self._side_by_side([raw[i] for i in part]))
        for i in range(len(raw)):
            if len(raw[i]) > LONG:
                ids = self._alone(raw[i])
                self._remember([words[i]], ids, np.array([len(ids)], np.int32))

    def _accepts(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        a = self.a
        key = (states.astype(np.int64) << _BITS) | a.place[tokens]
        j = np.searchsorted(a.hi, key)
        inside = j < len(a.hi)
        inside[inside] = a.lo[j[inside]] <= key[inside]
        return ~inside

    def _side_by_side(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words of similar length."""
        a = self.a
        size = np.array([len(w) for w in raw])
        wide = int(size.max(initial=0))
        spelled = np.zeros((len(raw), wide), np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        spelled[np.arange(wide) < size[:, None]] = flat
        spelled[np.arange(len(raw)), size - 1] += ENDED
        state = np.full((len(raw), wide + 1), -1, np.int32)
        arrived = np.full((len(raw), wide + 1), -1, np.int32)
        state[:, 0] = a.start
        for i in range(wide):
            row = np.flatnonzero(size > i)
            node = np.zeros(len(row), np.int64)
            for j in range(i, min(wide, i + a.longest)):
                key = node * SYMBOLS + spelled[row, j]
                at = np.minimum(np.searchsorted(a.keys, key), len(a.keys) - 1)
                there = a.keys[at] == key
                row, node = row[there], a.nodes[at[there]].astype(np.int64)
                if not len(row):
                    break
                t = a.token[node]
                real = t >= 0
                r, t = row[real], t[real]
                ok = self._accepts(state[r, i], t)
                r, t = r[ok], t[ok]
                state[r, j + 1], arrived[r, j + 1] = a.target[t], t
                more = size[row] > j + 1
                row, node = row[more], node[more]
        back, left, row = np.full((len(raw), wide), -1, np.int32), size.copy(), np.arange(len(raw))
        steps = 0
        while len(row):
            steps += 1
            t = arrived[row, left[row]]
            back[row, wide - steps] = t
            left[row] -= a.size[t]
            row = row[left[row] > 0]
        return back[back >= 0], (back >= 0).sum(1).astype(np.int32)

    def _alone(self, raw: bytes) -> np.ndarray:
        """Ids of one long word by the same tables, one look-up after the other."""
        a = self.a
        if self.arcs is None:
            self.arcs = dict(zip(a.keys.tolist(), a.nodes.tolist(), strict=True))
            self.tables = a.lo.tolist(), a.hi.tolist(), a.place.tolist(), a.token.tolist(), a.target.tolist()
        lo, hi, place, token, target = self.tables
        n = len(raw)
        state, arrived = [-1] * (n + 1), np.zeros(n + 1, np.int32)
        state[0] = a.start
        for i in range(n):
            node, base = 0, state[i] << _BITS
            for j in range(i, min(n, i + a.longest)):
                node = self.arcs.get(node * SYMBOLS + raw[j] + (ENDED if j == n - 1 else 0), -1)
                if node < 0:
                    break
                t = token[node]
                if t >= 0 and state[j + 1] < 0:
                    key = base | place[t]
                    k = bisect.bisect_left(hi, key)
                    if k == len(hi) or lo[k] > key:
                        state[j + 1], arrived[j + 1] = target[t], t
        out, at = [], n
        while at > 0:
            out.append(arrived[at])
            at -= int(a.size[arrived[at]])
        return np.array(out[::-1], np.int32)

    # --- batches

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); new words of about TOGETHER words of texts are encoded side by side."""
        ids, counts, held, n = [], np.zeros(len(texts), np.int64), [], 0
        for k, text in enumerate(texts):
            for words in self.words(text or ""):
                held.append((k, words))
                n += len(words)
                if n >= TOGETHER:
                    self._encode_words(held, ids, counts)
                    held, n = [], 0
        self._encode_words(held, ids, counts)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    def _encode_words(self, held: list[tuple[int, list[str]]], ids: list[np.ndarray], counts: np.ndarray) -> None:
        if not held:
            return
        all_ = [w for _, words in held for w in words]
        new = [w for w in dict.fromkeys(all_) if w not in self.code]
        if len(self.code) + len(new) > MEMO_WORDS:
            self.forget()
            new = [w for w in dict.fromkeys(all_) if w not in self.code]
        if new:
            self.learn(new)
        codes = np.fromiter(map(self.code.__getitem__, all_), np.int64, len(all_))
        n = self.count[codes]
        ids.append(self.flat[np.repeat(self.first[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        ends = np.concatenate(([0], np.cumsum([len(words) for _, words in held])))
        np.add.at(counts, [k for k, _ in held], np.diff(np.concatenate(([0], np.cumsum(n)))[ends]))


_LOADED: dict[tuple[str, type], Encoder | Labels] = {}


def _loaded(kind: type, key: str, sent, *more):
    """This process's encoder or labels; the broadcast is read once a process."""
    if (key, kind) not in _LOADED:
        _LOADED[key, kind] = kind(sent.value, *more)
    return _LOADED[key, kind]


def _parts(batch: pa.RecordBatch, column: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold about `limit` bytes or elements in one column, a row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.list_value_length(column), 0), np.int64)
    run = np.cumsum(sizes) // limit
    starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df without its text, and `out`: the ids of the whole text as array<int>."""
    spark = df.sparkSession
    sent, key = spark.sparkContext.broadcast(compile_file(path)), f"{spark.sparkContext.applicationId}:{path}"
    rest = [f for f in df.schema.fields if f.name not in (text_col, out)]
    schema = StructType([*rest, StructField(out, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _loaded(Encoder, key, sent, path)
        for batch in batches:
            for part in _parts(batch, batch.column(text_col), 4 << 20):
                ids, counts = e.encode(part.column(text_col).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), lists], [*(f.name for f in rest), out])

    return df.select(*(f.name for f in rest), text_col).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """df with `out`: the decoded text of an array of ids (null: the empty text)."""
    spark = df.sparkSession
    sent, key = spark.sparkContext.broadcast(compile_file(path).labels), f"{spark.sparkContext.applicationId}:{path}"
    rest = [f for f in df.schema.fields if f.name != out]
    schema = StructType([*rest]).add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _loaded(Labels, key, sent)
        for batch in batches:
            for part in _parts(batch, batch.column(ids_col), 1 << 20):
                lists = part.column(ids_col)
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                ids = np.asarray(pc.fill_null(lists.flatten(), -1), np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, e.decode(ids, counts).cast(pa.string())], [*part.schema.names, out])

    return df.select(*(f.name for f in rest)).mapInArrow(run, schema)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode(ids).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
