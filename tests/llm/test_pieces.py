"""Sentence-piece BPE against the library that the model file is made for."""

import hashlib
import random

import numpy as np
import pytest

from passforge.llm import piecebpe, queries
from llm_docs import awkward, empty, frame

PATH = piecebpe.model_path()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(codec, texts):
    return [np.frombuffer(i, "<i4").tolist() for i in codec.encode_batch(texts)]


def odd_texts(rng, n):
    signs = "abcthein   XYZ'sΣσİİé́̀ \t\n\x1c\x85\xa0 　日本語中国😀1٣½!?#<|>\x00‍한글ᄒ▁▁"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_codec_equals_library(library):
    rng = random.Random(1)
    texts = odd_texts(rng, 3000)
    texts += ["".join(rng.choice("theandingtionourste ") for _ in range(rng.randint(0, 200))) for _ in range(1000)]
    texts += ["<s>a</s>", "<unk> x <0x41>", " " * 1000, "x" * 3000, "", " ", "  a", "▁", "ab" * 2000, "\n" * 500, " \n " * 300]
    codec = piecebpe.PieceCodec(open(PATH, "rb").read())
    for text, mine, want in zip(texts, ids_of(codec, texts), library.encode(texts), strict=True):
        assert mine == want, text[:60]
        assert codec.decode(mine) == library.decode(want)
    assert ids_of(codec, texts[::-1]) == library.encode(texts)[::-1]  # from the memory


def test_batch_equals_one_by_one(library):
    texts = odd_texts(random.Random(5), 300)
    codec = piecebpe.codec_for(PATH)
    together = ids_of(codec, texts)
    codec.forget()
    for text, want in zip(texts, together, strict=True):
        assert ids_of(codec, [text]) == [want]
        codec.forget()


def test_decode_of_any_ids(library):
    rng = random.Random(2)
    codec = piecebpe.codec_for(PATH)
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def plain_merging(codec, symbols):
    """One pair at a time: least rank, leftmost."""
    symbols = list(symbols)
    while len(symbols) > 1:
        rank, new = codec._rank(np.array(symbols[:-1]), np.array(symbols[1:]))
        i = int(np.argmin(rank))
        if rank[i] == piecebpe.NONE:
            break
        symbols[i:i + 2] = [int(new[i])]
    return symbols


def test_rounds_equal_plain_merging():
    rng = random.Random(3)
    codec = piecebpe.codec_for(PATH)
    words = ["".join(rng.choice("▁▁theandio") for _ in range(rng.randint(1, 90))) for _ in range(120)]
    symbols = [codec.char[[ord(c) for c in w]] for w in words]
    owner = np.repeat(np.arange(len(words)), list(map(len, words)))
    part, merged = codec.merge_rounds(np.concatenate(symbols), owner)
    for k, s in enumerate(symbols):
        assert merged[part == k].tolist() == plain_merging(codec, s.tolist())


def test_long_texts_without_blanks(library):
    rng = random.Random(4)
    codec = piecebpe.codec_for(PATH)
    for signs in (" ", "x", "abcdefghij", "theandingtionourste", "日本語中国人の一"):
        text = "".join(rng.choice(signs) for _ in range(100_000))
        assert ids_of(codec, [text]) == [library.encode(text)]


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(piecebpe, "MEMO_BYTES", 20_000)
    rng = random.Random(6)
    codec = piecebpe.PieceCodec(open(PATH, "rb").read())
    for _ in range(30):
        texts = ["".join(rng.choice("abcde fg") for _ in range(200)) for _ in range(5)]
        assert ids_of(codec, texts) == library.encode(texts)
        assert len(codec.memo) + len(codec.older) < 1000
    codec.forget()
    assert not codec.memo and not codec.older


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piecebpe.PieceCodec(b"")


def test_encode_decode_rows(spark, library):
    rows = piecebpe.encode_decode(frame(spark)).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        want = library.encode(r.text or "")
        assert r.token_ids == want and r.n_tokens == len(want) and r.decoded == library.decode(want)
    clash = frame(spark).withColumnRenamed("size", "n_tokens")
    assert piecebpe.encode_decode(clash).columns.count("n_tokens") == 1
    assert piecebpe.encode_decode(empty(spark)).count() == 0


def test_query_digests(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.queries()["op12_pieces"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
