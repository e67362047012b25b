"""Merge replay against two independent encoders."""

import base64
import os
import random

import numpy as np
import pytest

from tidemark.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.default_path()), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    from public_tokenizers import PATTERN, path

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lists(texts):
    ids, counts = bpe.encode(bpe.vocabulary(bpe.default_path()), texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_random_texts(reference):
    rng = random.Random(1)
    letters = "'stre vmld \n\t a1é,.-'  Z9你\x1c\x85ᅵ🎉　 ²ǅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    assert _lists(texts) == [reference.encode_ordinary(t) for t in texts]


def test_runs_contractions_and_ends(reference):
    texts = ["", "a", " ", "  ", "a ", "a  b", "\n'", "'s", "x's", "x''s", " 's", "'ll've", "'l", "'rest", "we'", "'", "don't", "\n\n x", "a" * 5000, " " * 3000, "'" * 501, "ab" * 4000, "<|endoftext|>", ""]
    assert _lists(texts) == [reference.encode_ordinary(t) for t in texts]


def test_a_hash_collision_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "_mix", lambda: np.ones(0x110000, np.uint64))
    texts = ["abc abd bca", "cab dab"]
    assert _lists(texts) == [reference.encode_ordinary(t) for t in texts]


def test_one_word_longer_than_a_block_of_words(reference, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    texts = ["one two three four", "x" * 2000, "", "five six"]
    assert _lists(texts) == [reference.encode_ordinary(t) for t in texts]


def test_rows(spark, reference):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(bpe.default_path())
    other.encode_special_tokens = True
    texts = {1: None, 2: "", 3: " hello  world\r\n", 4: "é" * 300, 5: "<|endoftext|> same", 6: "<|endoftext|> same"}
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, key string, ids int")
    got = {r.doc_id: r.ids for r in bpe.token_ids(df, block=5).collect()}
    assert got == {k: reference.encode_ordinary(t or "") for k, t in texts.items()}
    assert got == {k: other.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "text", ["doc_id", "key"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.token_ids(df.limit(0)).count() == 0


def test_every_merge_is_applied_once_in_rank_order():
    rng = random.Random(3)
    vocab = bpe.vocabulary(bpe.default_path())
    words = sorted({"".join(rng.choice("the ing er on re at es") for _ in range(rng.randint(1, 12))) for _ in range(3000)} | {"aaaaa", " the", "internationalization"})
    applied = []
    ids, sizes = bpe.word_ids(vocab, words, applied)
    assert applied == sorted(set(applied))
    rows = [[int(vocab.byte_ids[b]) for b in w.encode()] for w in words]
    order = np.argsort(vocab.ranks)
    for rank in applied:  # the same, merge by merge over all words
        pair = int(vocab.pairs[order[rank]])
        for row in rows:
            i = 0
            while i + 1 < len(row):
                if row[i] << 32 | row[i + 1] == pair:
                    row[i : i + 2] = [int(vocab.made[rank])]
                i += 1
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == rows


def test_numbers_are_packed_and_unpacked():
    codes = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 5])
    data, sizes = bpe.packed(codes)
    back, last = bpe.unpacked(data)
    assert back.tolist() == codes.tolist() and np.diff(np.append(-1, last)).tolist() == sizes.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 1]
    assert len(bpe.unpacked(bpe.packed(codes[:0])[0])[0]) == 0


@pytest.mark.parametrize(("words", "symbols", "piece"), [(1_000_000, 8_000_000, 4_000_000), (40, 1, 300), (1, 1, 1)])
def test_blocks_and_chunks_change_nothing(spark, reference, monkeypatch, words, symbols, piece):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", words)
    monkeypatch.setattr(bpe, "SYMBOLS", symbols)
    rng = random.Random(5)
    texts = [None if rng.random() < 0.1 else " ".join(rng.choice(["the", "quick", "Straße", "你好", "a" * 50, "\n\n", "it's", "x1"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += ["word " * 9000, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.token_ids(df, block=piece).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "text", ["doc_id"], block=piece).collect()} == {k: len(v) for k, v in got.items()}


def test_repeated_rows_and_null_keys(spark, reference):
    rows = [(None, "same text"), (None, "same text"), (1, "same text"), (1, None)]
    got = [(r.doc_id, r.ids) for r in bpe.token_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(k, reference.encode_ordinary(t or "")) for k, t in rows], key=str)


def test_query_over_all_documents(spark, reference):
    from tidemark.llm import queries
    from tidemark.sources.tables import table

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    want = {r.doc_id: reference.encode_ordinary(r.text or "") for r in table(spark, folder, "documents", "doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in queries.p7_ids(spark, folder).collect()} == want


def test_ids_put_together_again(spark):
    texts = ["", " hello  world\r\n", "é你🎉" * 50, "<|endoftext|>", "\x00\x1c ᅵ", "x" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in bpe.texts_of(bpe.token_ids(df)).collect()}
    assert got == {**dict(enumerate(texts)), 99: ""}
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.text for r in bpe.texts_of(none).collect()} == {""} and bpe.texts_of(none.limit(0)).count() == 0
