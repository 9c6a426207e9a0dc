"""BPE with word ends against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from kwforge.llm import word_bpe
from kwforge.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def automaton():
    return word_bpe.compile_file()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(word_bpe.FILE))


@pytest.fixture()
def encoder(automaton):
    return word_bpe.Encoder(automaton)


def awkward():
    g = random.Random(3)
    texts = ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaa", "don't we'll I'VE 'sabc ''s", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ ΟΔΟΣ İstanbul ŉ ǅ", "é Å Å ẛ̣", "日本語 한국어 각 🙂👩‍👩‍👧", "1234 ½²³ ٣٤", "a b\u0085c d​e\u001cf\u0000g", "ª º ß ÿ Ÿ", "the" * 300, "1" * 100, "!" * 150, "ab" * 5000, "z" * 70]
    texts += ["".join(g.choice("abcdefghinorst") for _ in range(g.randint(1, 90))) for _ in range(600)]
    texts += ["".join(g.choice("aé🙂 '1.s\n日") for _ in range(g.randint(1, 60))) for _ in range(400)]
    texts += [g.choice("athein") * g.randint(1, 80) for _ in range(100)]
    return texts


def test_op12_encode(encoder, library):
    texts = awkward()
    ids, counts = encoder.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(counts)
    got = [ids[b - n : b].tolist() for b, n in zip(ends, counts)]
    assert got == want
    assert word_bpe.Labels(encoder.a.labels).decode(ids, counts).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]
    assert encoder.encode([None, "", None])[1].tolist() == [0, 0, 0]


def test_op12_alone_and_side_by_side(encoder):
    """Long words by the same tables, one after the other, come out as side by side; so do blocks of a long text and a full memory."""
    g = random.Random(4)
    raw = ["".join(g.choice("etaoin'é") for _ in range(g.randint(1, 60))).encode() for _ in range(300)]
    ids, counts = encoder._side_by_side(raw)
    assert ids.tolist() == [i for w in raw for i in encoder._alone(w).tolist()] and counts.sum() == len(ids)
    text = " ".join(f"word{i % 700} don't" for i in range(3000))
    once = encoder.encode([text])[0].tolist()
    small = word_bpe.Encoder(encoder.a)
    old = word_bpe.BLOCK, word_bpe.MEMO_WORDS, word_bpe.TOGETHER
    try:
        word_bpe.BLOCK, word_bpe.MEMO_WORDS, word_bpe.TOGETHER = 50, 60, 20
        assert small.encode([text])[0].tolist() == once and len(small.code) <= 60 + 2
    finally:
        word_bpe.BLOCK, word_bpe.MEMO_WORDS, word_bpe.TOGETHER = old


def test_op12_gadgets():
    """Small merge lists against merging by hand, over all words of six symbols."""
    import itertools

    for merges in ([("a", "a"), ("aa", "a</w>")], [("a", "b"), ("b", "a"), ("ab", "ab"), ("b", "a</w>"), ("ba", "ba</w>")], [("a", "a"), ("aa", "aa"), ("b", "aa"), ("a", "b</w>"), ("aa", "ab</w>")]):
        vocab = {}
        for c in [*(x for x in word_bpe._byte_names()), *(x + "</w>" for x in word_bpe._byte_names()), *(u + v for u, v in merges)]:
            vocab.setdefault(c, len(vocab))
        e = word_bpe.Encoder(word_bpe.Automaton(vocab, merges, {}))
        for n in range(1, 7):
            for w in itertools.product("ab", repeat=n):
                parts = [*w[:-1], w[-1] + "</w>"]
                for u, v in merges:
                    i = 0
                    while i + 1 < len(parts):
                        if parts[i] == u and parts[i + 1] == v:
                            parts[i : i + 2] = [u + v]
                        i += 1
                word = "".join(w).encode()
                assert [e.a.labels[i] for i in e._side_by_side([word])[0]] == parts == [e.a.labels[i] for i in e._alone(word)]


def test_op12_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in word_bpe.op12_word_bpe(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want = len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_op12_frames(spark, library):
    """Nulls, repeated rows, clashing columns, ids that no token has, no rows."""
    rows = [(1, None, "own", 5), (2, "", None, 6), (2, "two words", "x", 7), (2, "two words", "x", 7), (None, "é🙂<|endoftext|>", "y", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, size int")
    out = word_bpe.encode(df)
    assert out.columns == ["doc_id", "size", "ids"]
    got = sorted(((r.size, r.ids) for r in out.collect()))
    assert got == sorted((s, library.encode(t or "", add_special_tokens=False).ids) for _, t, _, s in rows)
    back = word_bpe.decode(out)
    assert sorted((r.size, r.text) for r in back.collect()) == sorted((s, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for _, t, _, s in rows)
    odd = spark.createDataFrame([(1, [0, 60000, -1, 49407, None]), (2, [70000]), (3, None)], "id long, ids array<int>")
    assert {r.id: r.text for r in word_bpe.decode(odd).collect()} == {1: "! <|endoftext|>", 2: "", 3: ""}
    assert word_bpe.decode(word_bpe.encode(df.limit(0))).count() == 0
