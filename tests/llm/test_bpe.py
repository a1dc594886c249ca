"""BPE by forced boundaries against the tokenizers library, on hostile strings."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "B", "re", "s", "t", "é", "ß", "日", "本", "1", "٣", "½", ".", "!!", "<|endoftext|>", "<|endof", "‍", "\U0001f600", "ʼ", "’s", "\x00", "́", "_"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, encoding="utf-8").read())


def held_to_library(codec, texts):
    theirs = Tokenizer.from_file(PATH)
    ids, counts = codec.encode_many(texts)
    ends = np.append(0, np.cumsum(counts))
    for k, (text, back) in enumerate(zip(texts, codec.decode_many(ids, counts))):
        want = theirs.encode(text or "", add_special_tokens=False).ids
        assert ids[ends[k] : ends[k + 1]].tolist() == want, text
        assert back == theirs.decode(want, skip_special_tokens=False)


def test_hostile_strings(codec):
    rng = random.Random(3)
    held_to_library(codec, ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(20000)] + [None, ""])


def test_long_fragments_and_chunks(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "CELLS", 128)
    rng = random.Random(4)
    held_to_library(codec, ["".join(rng.choices("aeinrst", k=n)) for n in (1, 63, 64, 65, 200, 3000)] + ["日本" * 300, None, "", "x", "<|endoftext|>" * 30])


def test_forced_boundaries_cut_and_keep_the_ids(codec, monkeypatch):
    """With the table off, fragments are fewer and the ids the same: forced cuts are certain ones."""
    texts = ["zß日 xq7#Zz " * 20, "日本語テキスト混在 text", "naïve façade"]
    joined = "".join(texts)
    first = np.append(0, np.cumsum([len(t) for t in texts]))[:-1]
    with_table, ids = len(codec.cuts(joined, first, [])[1]), codec.encode_many(texts)[0]
    monkeypatch.setattr(codec, "forced", np.zeros(1 << 16, bool))
    assert len(codec.cuts(joined, first, [])[1]) < with_table
    assert codec.encode_many(texts)[0].tolist() == ids.tolist()


def test_equal_hashes_do_not_mix_fragments(codec, monkeypatch):
    monkeypatch.setattr(bpe, "word_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    held_to_library(codec, ["one two three four one two", "five"])


def test_decode_any_ids(codec):
    theirs = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(6))]
        assert codec.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    assert codec.decode([-1, 99999999, codec.encode("x")[0]]) == "x"


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a b", "y"), (2, "a b", "z")], "doc_id long, text string, tokens string")
    out = bpe.bpe_round_trip(df, PATH, out="both")
    assert out.columns == ["doc_id", "text", "tokens", "both"]
    assert [(r["doc_id"], r["tokens"], r["both"]["decoded"]) for r in out.orderBy("doc_id", "tokens").collect()] == [(1, "x", ""), (2, "y", "a b"), (2, "z", "a b")]
    ids = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 64])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.bpe_decode(ids, PATH).orderBy("doc_id").collect()] == ["", "", "aa"]
    assert bpe.bpe_encode(df.where(F.lit(False)), PATH).count() == 0
