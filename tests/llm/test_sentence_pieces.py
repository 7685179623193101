"""SentencePiece encoding, offsets and decoding against the library."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docspan.llm import queries, sentence_pieces
from docspan.llm.sentence_pieces import CharacterMap, Pieces, Rules, wire_fields

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SAMPLES = " \n\tab▁é🙂漢.<0xA>​　　ﬁＡｶﾞ①㍿Ạ̊\x00\x1f"
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(SAMPLES), st.characters(exclude_categories=["Cs"])), max_size=50)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(open(MODEL, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_ids_spans_and_text(pieces, library, text):
    ((ids, starts, ends),) = pieces.encoded([text])
    want = library.encode(text, return_type="proto").pieces
    assert ids.tolist() == [p.id for p in want] == library.encode(text)
    assert (starts.tolist(), ends.tolist()) == ([p.begin for p in want], [p.end for p in want])
    assert pieces.decoded([ids.tolist()]) == [library.decode(library.encode(text))]


def rules_of(name, **options):
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=name, **options)
    spec = {}
    for field, value in wire_fields(normaliser.serialized_model_proto()):
        if field == 3:
            spec.update(wire_fields(value))
    return normaliser, Rules(CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))


RULES = [rules_of(name, escape_whitespaces=bool(k & 1), remove_extra_whitespaces=bool(k & 2), add_dummy_prefix=bool(k & 4))
         for name in ("nfkc", "nmt_nfkc", "nmt_nfkc_cf", "identity") for k in range(8)]


@settings(max_examples=150, deadline=None)
@given(text=TEXTS)
def test_longest_prefixes_of_compiled_maps(text):
    """The maps that come with the library: normalised text and the source of each of its characters."""
    for normaliser, rules in RULES:
        want, offsets = normaliser.normalize(text, with_offsets=True)
        normal, source = rules.normalised(text.encode())
        assert normal.decode() == want
        ends = [0]
        for c in want:
            ends.append(ends[-1] + len(c.encode()))
        assert [len(text.encode()[:source[k]].decode(errors="replace")) for k in ends] == offsets


def test_bytes_that_are_no_character():
    _, rules = rules_of("nfkc")
    normal, _ = rules.normalised(b"a\xffb\xe2\x96")
    assert normal.decode().endswith("a�b��")


def test_encode_and_decode(odd_docs, no_docs, library):
    rows = sentence_pieces.encode(odd_docs, MODEL).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id])
        raw = texts[r.doc_id].encode()
        # no byte is lost and none is in two spans: this model's map drops nothing
        assert b"".join(raw[a:b] for a, b in zip(r.byte_start, r.byte_end)) == raw
    back = sentence_pieces.decode(sentence_pieces.encode(odd_docs, MODEL), MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), library.decode(r.ids) if r.ids else "") for r in rows)
    assert sentence_pieces.encode(no_docs, MODEL).count() == 0 and sentence_pieces.round_trip(no_docs, MODEL).count() == 0


def test_decoding_of_any_ids(spark, library):
    ids = [[], None, [0], [1, 2], [200, 131], [35, 5000], [29871, 29871], [3 + 0xE2, 3 + 0x96]]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in sentence_pieces.decode(frame, MODEL).collect()}
    assert got == {k: library.decode(x) if x else "" for k, x in enumerate(ids)}


def test_registered_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, sf_dir).collect()}
    rows = queries.op11_sentence_pieces(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest()
