"""The transducer against the library whose ids it gives, and its UTF-8 machine against the standard library's."""

import codecs
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumigrid.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(PATH, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aehinrstAE'sé 1<|\n\t ", max_size=80))
def test_any_text(library, encoder, text):
    assert encoder(text) == library.encode_ordinary(text)


def test_long_pieces_and_a_small_table(library):
    draw = random.Random(2)
    small = byte_bpe.Transducer(byte_bpe.load_ranks(PATH), moves=40)
    for text in ["a" * 3000, "0" * 777, " " * 500, "".join(draw.choices("ab", k=2000)), "".join(draw.choices("0123456789", k=1500)), "-=" * 600, "ÃÂ" * 300]:
        assert small.encode(text.encode()) == [i for i in library.encode_ordinary(text)]
        assert len(small.moves) <= 40 + byte_bpe.WAIT + 1
    assert small.longest < 400  # ids are certain a bounded number of bytes after their end


def test_every_token_and_parts(library, encoder):
    """Tokens joined by twos, fed byte by byte."""
    ranks = list(byte_bpe.load_ranks(PATH))
    draw = random.Random(3)
    machine = encoder.transducer
    for _ in range(3000):
        piece = draw.choice(ranks) + draw.choice(ranks) + draw.choice(ranks)[:3]
        want = library._encode_single_piece(piece)
        assert machine.encode(piece) == want
        if piece not in machine.ranks:
            assert [i for b in piece for i in machine.feed(bytes([b]))] + machine.close() == want


def test_other_ranks():
    """A made-up vocabulary with tokens that merging alone does not give."""
    draw = random.Random(4)
    for _ in range(30):
        words = {bytes(draw.choices(b"abc", k=draw.randint(2, 5))) for _ in range(12)}
        ranks = {bytes([b]): b for b in range(256)} | {w: 256 + k for k, w in enumerate(draw.sample(sorted(words), len(words)))}
        other = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        machine = byte_bpe.Transducer(ranks)
        for _ in range(60):
            piece = bytes(draw.choices(b"abc", k=draw.randint(1, 14)))
            assert machine.encode(piece) == other._encode_single_piece(piece)
    with pytest.raises(ValueError):
        byte_bpe.Transducer({b"a": 0})


@settings(max_examples=500, deadline=None)
@given(st.lists(st.binary(max_size=6) | st.text(max_size=3).map(str.encode) | st.sampled_from([b"\xed\xa0", b"\xf0\x80", b"\xf4\x90", b"\xe2\x82"]), max_size=8))
def test_utf8(parts):
    machine, other = byte_bpe.Utf8(), codecs.getincrementaldecoder("utf-8")("replace")
    got, want = "".join(map(machine.feed, parts)) + machine.close(), "".join(map(other.decode, parts)) + other.decode(b"", True)
    assert got == want


def test_documents(spark, library):
    """Null, empty and long texts, repeated rows, clashing names, no rows."""
    texts = [None, "", "hello world", "é日本😀 ́", "a\n\n  b\t'll", "<|endoftext|>", "word " * 30000, "hello world"]
    docs = spark.createDataFrame([(k // 2, t, [1], "x") for k, t in enumerate(texts)], SCHEMA + ", IDS array<int>, decoded string").repartition(3)
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted(back.columns) == ["decoded", "doc_id", "ids", "text"]
    for r in back.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    assert back.count() == len(texts)
    assert byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [31373, None, -1, 99999999]), (4, [188])], "doc_id long, ids array<int>")
    token = {rank: t for t, rank in byte_bpe.load_ranks(PATH).items()}
    got = dict(byte_bpe.decode(rows, PATH).select("doc_id", "decoded").collect())
    assert got == {1: "", 2: "", 3: token[31373].decode() + "�" * 3, 4: token[188].decode("utf-8", "replace")}


def test_query(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want
