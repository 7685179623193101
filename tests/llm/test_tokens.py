"""Packing, byte-level BPE and the token store against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspan.llm import byte_bpe, packing, token_store
from docspan.llm.tokens import ByteTokens, WordTokens, byte_level_json, read_ranks

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sdmtlvreaZΣσéßİ  ́ͅ\x1c\x85.,!1²🙂"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def word():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    return WordTokens(open(WORDS, encoding="utf-8").read()), lambda t: plain.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ByteTokens(byte_level_json(read_ranks(RANKS), public_tokenizers.PATTERN)), encoding.encode_ordinary


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_remembered_pieces_give_the_ids_of_the_whole_text(word, byte, text):
    for tokens, whole in (word, byte):
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == whole(text)


def test_ids_stay_the_same_after_forgetting(word, monkeypatch):
    monkeypatch.setattr("docspan.llm.tokens.REMEMBERED_BYTES", 500)
    for text in ("one two three four five", "six seven eight", "one nine ten two", "a " * 50 + "b"):
        assert np.frombuffer(word[0].ids(text), "<u4").tolist() == word[1](text)


def test_the_library_holds_few_results_at_a_time(word):
    calls = []

    class Counted:
        def __init__(self, whole):
            self.whole = whole

        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return self.whole.encode_batch_fast(texts, **how)

    tokens = WordTokens(open(WORDS, encoding="utf-8").read())
    tokens.tokenizer = Counted(tokens.tokenizer)
    text = " ".join(f"w{k}" + "|" * (k % 9 == 0) for k in range(20_000))
    assert np.frombuffer(tokens.ids(text), "<u4").tolist() == word[1](text)
    assert 0 < max(calls) <= 64


def test_a_worker_that_remembers_little_packs_the_same(odd_docs):
    def rows(**how):
        return sorted(repr((r.doc_id, r.start, r.length, r.doc_tokens, r.ids)) for r in packing.pack(odd_docs, WORDS, **how).collect())

    assert rows(remembered=300, slice_bytes=50) == rows()


def test_packing_covers_every_id_once(odd_docs, no_docs, word):
    rows = packing.pack(odd_docs, WORDS).collect()
    per_text = {}
    for i, text in {(r.doc_id, r.text) for r in odd_docs.collect()}:
        per_text.setdefault(i, word[1](text or "") + [1])
    pieces = {}
    for r in rows:
        assert r.length in {1 << k for k in range(12)} and r.offset == 0 and r.bucket == r.length.bit_length() - 1
        assert r.ids == per_text[r.doc_id][r.start:r.start + r.length] and r.doc_tokens == len(per_text[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, spans in pieces.items():
        copies = 2 if i == 7 else 1  # one row is repeated
        assert sum(n for _, n in spans) == copies * len(per_text[i])
        assert sorted(n for _, n in spans) == sorted(packing.piece_lengths(len(per_text[i])) * copies)
    assert packing.pack(no_docs, WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_docs, WORDS, longest=1000)


@given(st.integers(0, 100_000))
def test_piece_lengths(n):
    parts = packing.piece_lengths(n)
    assert sum(parts) == n and parts == sorted(parts, reverse=True)
    small = [p for p in parts if p < packing.LONGEST]
    assert len(small) == len(set(small))


def test_bytes_round_trip_with_offsets(odd_docs, no_docs, byte):
    encoded = byte_bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    for r in encoded.filter("doc_id < 50 OR doc_id > 52 OR doc_id IS NULL").collect():
        text = texts[r.doc_id]
        assert r.ids == byte[1](text)
        if r.ids:
            assert r.char_start[0] == 0 and r.char_end[-1] == len(text)
            assert all(a < b for a, b in zip(r.char_start, r.char_end))
            assert all(n in (e, e - 1) for e, n in zip(r.char_end, r.char_start[1:]))  # one may be shared when it is split
    for r in byte_bpe.decode(encoded, RANKS).collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]
    assert byte_bpe.decode(byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_split_characters_wait_for_their_last_byte(byte):
    table = [t for t, _ in sorted(read_ranks(RANKS).items(), key=lambda x: x[1])]
    text = "a🙂漢é"
    parts = byte_bpe.token_texts(byte[1](text), table)
    assert "".join(parts) == text and "" in parts
    assert byte_bpe.token_texts([], table) == []


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=3000), st.data())
@settings(max_examples=60, deadline=None)
def test_codes_are_directly_addressable(ids, data):
    codes = token_store.Codes(token_store.encode_codes(np.asarray(ids, dtype=np.uint32)))
    assert len(codes) == len(ids) and codes.read(0, len(ids)).tolist() == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert codes.read(a, b).tolist() == ids[a:b]
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        assert codes[i] == ids[i]


def test_token_files(spark, odd_docs, no_docs, word, tmp_path):
    token_store.write_tokens(odd_docs, WORDS, f"{tmp_path}/t", segment_ids=1000)
    rows = token_store.read_tokens(spark, f"{tmp_path}/t").collect()
    docs = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd_docs.collect()))
    at, want = 0, []
    for has, i, _, text in docs:
        ids = word[1](text) + [2]
        want.append((i if has else None, at, len(ids), ids))
        at += len(ids)
    key = lambda x: x[1]
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids) for r in rows), key=key) == want
    files = spark.read.parquet(f"{tmp_path}/t")
    assert token_store.token_at(files, 51, 5000) == word[1]("lorem ipsum dolor " * 40_000)[5000]
    assert token_store.token_at(files, 6, 99) is None and token_store.token_at(files, 999, 0) is None
    token_store.write_tokens(no_docs, WORDS, f"{tmp_path}/none")
    assert token_store.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_registered_token_queries(spark, sf_dir, word, byte):
    from docspan.llm import queries

    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, sf_dir).collect()}
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    for r in queries.op1_packing(spark, sf_dir).collect():
        assert crc((word[1](texts[r.doc_id]) + [1])[r.start:r.start + r.length]) == r.ids_crc32
    for r in queries.op2_byte_bpe(spark, sf_dir).collect():
        ids = byte[1](texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    at, got = 0, {r.doc_id: r for r in queries.op4_token_store(spark, sf_dir).collect()}
    for i in sorted(texts):
        ids = word[1](texts[i]) + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
