import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from chronoplane.llm import bpe, packing, token_count

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def awkward():
    rnd = random.Random(1)
    letters = "aàb cdé'sZ019  \n\t\x1c\x85\xa0　!?#-—€漢字🙂the​᠎<|endoftext|>"
    out = ["", " ", "a" * 3000, "ab" * 1500, "!" * 2000, " " * 2000, "<|endoftext|>", "x<|endoftext|> y\n\n  z ", "it's 'tis we'll"]
    out += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    out += ["".join(chr(rnd.randrange(0x250)) for _ in range(3000)), "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))]
    return out


@pytest.fixture(scope="module")
def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_tree_encoder_equals_library(tiktoken_encoding):
    encoder, texts = bpe.encoder(RANKS, P.PATTERN), awkward()
    for text, packed in zip(texts, encoder.encode_many(texts), strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == tiktoken_encoding.encode_ordinary(text)
        assert encoder.decode(ids, fan=3) == text.encode()


def test_join_is_associative_and_shape_free(tiktoken_encoding):
    encoder, rnd = bpe.encoder(RANKS, P.PATTERN), random.Random(3)
    for _ in range(300):
        word = "".join(rnd.choice("thereoning") for _ in range(rnd.randrange(3, 40))).encode()
        i, j = sorted(rnd.sample(range(1, len(word)), 2))
        a, b, c = (encoder.tree(x) for x in (word[:i], word[i:j], word[j:]))
        assert encoder.join(encoder.join(a, b), c) == encoder.join(a, encoder.join(b, c)) == encoder.merge(word)


def test_array_merger_equals_library(library):
    merger, texts = token_count.merger(JSON, P.PATTERN), awkward()
    for text, packed in zip(texts, merger.encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded(library):
    merger = token_count.ArrayMerger(JSON, P.PATTERN, limit=50)
    for text in ("one two three " * 5, "other words come here", "alpha beta gamma delta " * 9):
        assert np.frombuffer(merger.encode_many([text])[0], "<u4").tolist() == library.encode(text).ids
    assert len(merger.memo) < 100


DOCS = [(1, "plain words", "x", 5), (2, None, None, 6), (3, "", "y", 7), (4, "café <|endoftext|> z" * 400, None, 8), (4, "café <|endoftext|> z" * 400, None, 8)]
DOC_SCHEMA = "doc_id long, text string, n_tokens string, length long"


def test_round_trip_query(spark, tiktoken_encoding):
    rows = bpe.round_trip_digests(spark.createDataFrame(DOCS, DOC_SCHEMA), RANKS, P.PATTERN).collect()
    assert len(rows) == len(DOCS)
    text_of = {d[0]: d[1] or "" for d in DOCS}
    for r in rows:
        ids = tiktoken_encoding.encode_ordinary(text_of[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest()


def test_encode_and_decode_tables(spark):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    encoded = bpe.encode_documents(docs, RANKS, P.PATTERN)
    decoded = {r.id: bytes(r.decoded).decode() for r in bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()}
    assert decoded == {d[0]: d[1] or "" for d in DOCS}


def test_count_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(d[0] - 100, d[1]) for d in DOCS], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = token_count.count_tokens(docs, JSON, P.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert bpe.round_trip_digests(empty, RANKS, P.PATTERN).count() == 0
    assert token_count.count_tokens(empty, JSON, P.PATTERN).count() == 0
    assert packing.pack_documents(empty, JSON, P.PATTERN).count() == 0


def test_best_fit_is_valid_and_tight():
    rnd = np.random.default_rng(0)
    lengths = rnd.integers(1, 101, 3000)
    bin_of, offset, fills = packing.best_fit(lengths, 100)
    assert fills.max() <= 100 and len(fills) <= 1.03 * lengths.sum() / 100
    for b in range(len(fills)):
        at = np.flatnonzero(bin_of == b)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.cumsum(np.r_[0, lengths[at][:-1]])).all()


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


@pytest.mark.parametrize("window,group", [(200_000, 400_000), (20, 30)])
def test_packing_query(spark, sf, library, window, group):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-2, None), (-3, "")], "doc_id long, text string"))
    docs = docs.repartition(4, "doc_id")
    rows = packing.pack_documents(docs, JSON, P.PATTERN, window=window, group=group).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * total / 2048 + 2
