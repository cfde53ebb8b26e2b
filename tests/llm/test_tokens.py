import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from civicframe.llm import byte_bpe as B
from civicframe.llm import repair_ids as R

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(1)
    texts = [
        "", "a" * 501, "ab" * 300, "abc" * 200 + "aab" * 101, " \n\n  x  \t y z 's 'll don't", "\x1c\x1d a\x1fb", "日本語テキスト " * 20, "🙂🙂é́", "   ",
        "\n", "a\n ", "a\n", "a ", " a", "x \n y", "x　 y", "x 　y", "<|endoftext|>x", "ΣΑΣ ΟΔΟΣ x",
    ]
    texts += ["".join(rng.choice("aab") for _ in range(3000)), "".join(rng.choice("abcde ") for _ in range(3000))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 600), rng.randrange(0x3000, 0x9000)])) for _ in range(300)) for _ in range(20)]
    return texts + ["".join(rng.choice(" \n\ta'sx1 .") for _ in range(60)) for _ in range(200)]


def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("one_by_one", [False, True])
def test_ids_are_those_of_the_library(one_by_one):
    m, enc, texts = B.merger(RANKS, P.PATTERN), plain(), odd_texts()
    for group in [[t] for t in texts] if one_by_one else [texts]:
        ids, counts = m.encode(pa.array(group, pa.string()))
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [enc.encode_ordinary(t) for t in group]
        assert m.decode(ids, counts) == [t.encode() for t in group]


def test_words_longer_than_the_rounds_and_decoding_in_blocks(monkeypatch):
    monkeypatch.setattr(B, "ROUNDS", 2)
    monkeypatch.setattr(B, "DECODE_IDS", 7)
    m, enc = B.Merger(B.read_ranks(RANKS), P.PATTERN), plain()
    text = "antidisestablishmentarianism" * 40 + " the internationalisation"
    ids, counts = m.encode(pa.array([text, "x"]))
    assert ids[: counts[0]].tolist() == enc.encode_ordinary(text)
    assert m.decode(ids, counts) == [text.encode(), b"x"]


def test_bpe_documents(spark):
    enc, long = plain(), "some long text " * 20_000
    rows = [(1, "Hello world", "c"), (1, "Hello world", "c"), (None, None, "x"), (2, "", "y"), (3, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(B.encode(docs, RANKS, P.PATTERN).collect(), key=str)
    assert len(got) == 5
    for r in got:
        text = {1: "Hello world", 3: long}.get(r["doc_id"], "")
        ids = enc.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_equal"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert B.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_encoder_is_the_library():
    t, e, texts = Tokenizer.from_file(WORDS), R.Encoder(WORDS), odd_texts()
    texts += ["a.b,c!d?e", "it's,that's.'s x'y!z'", "…,a…b", "É,é!x", "a1.b2", "###a$$$ b&&&c", "don't!!'t", "x''y,'re"]
    for group in ([x for x in texts if "<|" not in x], texts):
        ids, counts = e.encode(pa.array(group))
        ends = np.cumsum(counts)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == [t.encode(x, add_special_tokens=False).ids for x in group]


@pytest.mark.parametrize("ids", [
    [], [5], [7] * 5000, [1, 2] * 3000, [3, 3, 3, 4] * 900, "random", "words",
])
def test_grammar_round_trip_and_random_access(ids):
    rng = np.random.default_rng(4)
    if ids == "random":
        ids = rng.integers(0, 49408, 20_000)
    elif ids == "words":
        ids = np.concatenate([rng.integers(0, 300, 6)[rng.integers(0, 6, 3)] for _ in range(8000)])
    ids = np.array(ids, np.uint32)
    shard = R.Shard(R.pack(["a"], np.array([len(ids)]), ids, 49408))
    assert (shard.ids() == ids).all()
    assert (shard.lengths == [len(R.expand(np.array([49408 + i], np.uint32), shard.rules, 49408)) for i in range(len(shard.rules))]).all()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 2, 2).tolist())
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_broken_shards_are_refused():
    raw = R.pack([1], np.array([3]), np.array([1, 2, 3], np.uint32), 10)
    for bad in (b"NOPE" + raw[4:], raw + b"x"):
        with pytest.raises(ValueError):
            R.Shard(bad)


def test_shards_of_documents(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD_TOKENS", 500)
    rng = random.Random(9)
    texts = {i: " ".join(rng.choice(["one", "Two", "three,", "été"]) for _ in range(rng.randrange(60))) for i in range(200)}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(None, "null id", ""), (500, None, ""), (501, "", ""), (502, "long words " * 5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = sorted(R.apply(docs, WORDS, with_ids=True).collect(), key=lambda r: r["start"])
    t, at = Tokenizer.from_file(WORDS), 0
    assert [r["doc_id"] for r in got] == [None, *sorted(texts), 500, 501, 502]
    for r, text in zip(got, ["null id", *(texts[i] for i in sorted(texts)), "", "", "long words " * 5000]):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert R.apply(docs.limit(0), WORDS).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r["start"] for r in R.apply(twice, WORDS).collect()) == [0, 2, 4]
