"""BPE against the library that the vocabulary file is made for."""

import random

import pytest

from passforge.llm import bpe
from llm_docs import awkward, empty, frame

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_codec_equals_library(library):
    rng = random.Random(1)
    signs = "abcXYZ'sΣσİİé́̀ \t\n\x1c\x85\xa0 　日本😀1٣½!?#<|>\x00‍한글ᄒ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|startoftext|>", "x<|ENDOFTEXT|>", "I'm we'll 's", "a" * 30000, "!?" * 5000, "ΑΣ ΑΣ.", ""]
    codec = bpe.codec_for(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(text)
        assert bpe.ids_array(ids) == want.ids, text[:60]
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def brute_merge(ids, ranks, made):
    ids = list(ids)
    while True:
        best = min(((ranks.get(a << 32 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))),
                   default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return ids
        ids[best[1]:best[1] + 2] = [made[best[0]]]


def test_segment_tree_equals_plain_merging():
    rng = random.Random(2)
    codec = bpe.codec_for(PATH)
    for _ in range(300):
        raw = bytes(rng.choice(b"theandingtionou") for _ in range(rng.randint(1, 40)))
        start = [codec.inner[b] for b in raw[:-1]] + [codec.last[raw[-1]]]
        assert codec.merge_bytes(raw) == brute_merge(start, codec.ranks, codec.made)


def test_long_run_without_blanks_is_fast():
    import time

    t = time.time()
    codec = bpe.Codec(__import__("json").load(open(PATH, encoding="utf-8")))
    rng = random.Random(3)
    codec.encode("".join(rng.choice("abcdefghij") for _ in range(200_000)))
    assert time.time() - t < 30


def test_encode_decode_rows(spark, library):
    rows = bpe.encode_decode(frame(spark)).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert bpe.ids_array(r.token_ids) == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    clash = frame(spark).withColumnRenamed("size", "n_tokens")
    assert bpe.encode_decode(clash).columns.count("n_tokens") == 1
    assert bpe.encode_decode(empty(spark)).count() == 0
