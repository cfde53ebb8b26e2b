import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from civicframe.llm import ef_trie_lm as T
from civicframe.llm.common import crc_remainder, hash_words


@pytest.mark.parametrize("kind", ["empty", "one", "same", "dense", "sparse", "wide"])
def test_sequences_give_every_value_back(kind):
    rng = np.random.default_rng(1)
    values = {
        "empty": np.zeros(0, np.uint64), "one": np.array([2**63 + 5], np.uint64), "same": np.full(700, 9, np.uint64),
        "dense": np.sort(rng.integers(0, 900, 3000)).astype(np.uint64), "sparse": np.sort(rng.integers(0, 2**62, 3000)).astype(np.uint64),
        "wide": np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64)),
    }[kind]
    ef = T.EliasFano(T.EliasFano.pack(values))
    assert (ef.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), np.array([0], np.uint64)])
    got = ef.find_anywhere(asked) if kind not in ("same", "dense") else ef.find(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(values)))
    held = set(values.tolist())
    assert [(g >= 0) for g in got] == [x in held for x in asked.tolist()]
    assert all(values[g] == x for g, x in zip(got, asked) if g >= 0)


def test_trie_from_a_memory_map(tmp_path):
    rng = random.Random(2)
    rows = Counter((rng.randrange(1, 40) << 30, rng.randrange(500)) for _ in range(3000))
    words = Counter(w for w, _ in rows.elements())
    pairs = np.array([(*k, v) for k, v in rows.items()], np.uint64)
    raw = T.Trie.pack(np.array([*words], np.uint64), np.array([*words.values()]), pairs[:, 0], pairs[:, 1], pairs[:, 2].astype(int))
    (tmp_path / "trie").write_bytes(raw)
    trie = T.Trie.open(str(tmp_path / "trie"))
    asked = np.array([*words, 7], np.uint64)
    counts, logs = trie.word(asked)
    assert counts.tolist() == [*words.values(), 0] and np.allclose(10 ** logs[:-1], counts[:-1] + 1, rtol=0.02)
    for w in words:
        children = np.arange(500, dtype=np.uint64)
        code = trie.pair(np.array([w], np.uint64), np.array([500]), children)
        want = [rows.get((w, c), 0) for c in range(500)]
        got = np.append(0.0, 10 ** T._book(trie.pair_top))[code]
        assert np.allclose(got, want, rtol=0.02)
    assert not trie.pair(np.array([7], np.uint64), np.array([3]), np.arange(3, dtype=np.uint64)).any()
    with pytest.raises(ValueError):
        T.Trie(b"x" * 100)


def test_word_hashes_tell_words_apart():
    words = [f"w{i}" for i in range(50_000)] + ["", "a", "aa", "é", "\x00", "\x00\x00"]
    assert len(set(hash_words(pa.array([w.encode() for w in words])).tolist())) == len(words)


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), "</s>"]


def slow_scores(rows, taught):
    """Plain counts and the model with exact probabilities."""
    words, pairs, starts = Counter(), Counter(), 0
    for (_, text), use in zip(rows, taught):
        if use:
            t = tokens_of(text)
            words.update(t)
            pairs.update(zip(["<s>", *t], t))
            starts += 1
    n, v = sum(words.values()), len(words)
    out = []
    for _, text in rows:
        t = tokens_of(text)
        prior = lambda w: (words[w] + 1) / (n + v + 1)
        full = sum(math.log10((pairs[a, b] + T.MU * prior(b)) / ((starts if a == "<s>" else words[a]) + T.MU)) for a, b in zip(["<s>", *t], t))
        out.append((len(t), sum(words[w] > 0 for w in t), n, sum(math.log10(prior(w)) for w in t), full))
    return out


def made(seed, n=150):
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "Mo", "ri", "te") for b in ("la", "no", "pé", "")]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ",", str(rng.randrange(30))]) for _ in range(rng.randrange(80)))) for i in range(n)]
    return [*rows, (None, "null id"), (5000, None), (5001, ""), (5002, "long text " * 20_000), (3, rows[3][1])]


@pytest.mark.parametrize("small", [False, True])
def test_documents_match_plain_counts(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(T, "CHUNK_BYTES", 900)
        monkeypatch.setattr(T, "SHARD_TOKENS", 9_000)
    rows = made(4)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string").repartition(4)
    got = T.apply(docs).collect()
    want = slow_scores(rows, [crc_remainder(i, 7) != 2 for i, _ in rows])
    key = lambda r: (str(r[0]), r[1])
    assert len(got) == len(rows)
    for r, ((i, _), w) in zip(sorted(((r["doc_id"], r["n_tokens"], r) for r in got), key=key), sorted(zip(rows, want), key=lambda x: (str(x[0][0]), x[1][0]))):
        r = r[2]
        assert r["held_out"] == (crc_remainder(i, 7) == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(w[4], rel=5e-3, abs=0.05 + 1e-4 * w[0])
    assert T.apply(docs.limit(0)).count() == 0


def test_model_is_kept_and_used_on_other_documents(spark, tmp_path):
    rows, other = made(6, 60), [(1, "kala Mo kala"), (2, "never seen"), (3, None)]
    folder = str(tmp_path / "model")
    T.train(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    got = {r["doc_id"]: r for r in T.score(spark.createDataFrame(other, "doc_id long, text string"), folder).collect()}
    want = slow_scores([*rows, *other], [True] * len(rows) + [False] * 3)[-3:]
    for (i, _), w in zip(other, want):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == w[:3]
        assert got[i]["score"] == pytest.approx(w[4], rel=5e-3, abs=0.05)


def test_probabilities_add_up():
    rows = made(8, 40)
    words, pairs = Counter(), Counter()
    for _, text in rows:
        t = tokens_of(text)
        words.update(t)
        pairs.update(zip(["<s>", *t], t))
    n, v = sum(words.values()), len(words)
    for context in [*words][:20]:
        if context == "</s>":
            continue
        total = sum((pairs[context, w] + T.MU * (words[w] + 1) / (n + v + 1)) / (words[context] + T.MU) for w in words)
        unknown = T.MU / (n + v + 1) / (words[context] + T.MU)
        assert total + unknown == pytest.approx(1)


def test_chunks_travel_in_short_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "PIECE_BYTES", 500)
    docs = spark.createDataFrame(made(9), "doc_id long, text string").repartition(3)
    T._write_chunks(docs, "doc_id", "text", str(tmp_path / "chunks"), True)
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    pieces = T._pieces(chunks).collect()
    assert max(len(p["data"]) for p in pieces) <= 500 and len(pieces) > 100
    for row in chunks.collect():
        whole = T._whole([p["data"] for p in sorted(pieces, key=lambda p: p["part"]) if p["chunk"] == row["chunk"]])
        want = T._chunk(row.asDict())
        assert all((getattr(whole, k) == getattr(want, k)).all() for k in ("vocabulary", "tokens", "counts", "train", "pairs", "pair_counts"))
    key = lambda r: (str(r["doc_id"]), r["n_tokens"])
    cut = sorted(T.apply(docs).collect(), key=key)
    monkeypatch.setattr(T, "PIECE_BYTES", 1 << 30)
    assert cut == sorted(T.apply(docs).collect(), key=key)


def test_a_hot_word_gets_more_shards_as_the_model_grows():
    chunk = T.Chunk.of(pa.array([" ".join(f"the w{i}" for i in range(6000))]), np.ones(1, bool))
    chunk.count()
    hot = np.bincount(chunk.first).argmax()
    followers = chunk.first == hot
    assert followers.sum() >= 6000
    for n, most in ((8, 0.5), (1024, 0.1), (8192, 0.025)):
        assert np.bincount(chunk.shards(n)[1][followers], minlength=n).max() <= most * followers.sum()


def test_short_questions_are_looked_up_together():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ka", "mo", "ri", "te", "no"]) + str(rng.randrange(40)) for _ in range(30)) for _ in range(400)]
    questions = []
    for text in [*texts, ""]:
        chunk = T.Chunk.of(pa.array([text]), np.ones(1, bool))
        chunk.count()
        questions += [q for _, q in chunk.questions(1)]

    class Counting(T.Trie):
        calls = 0

        def pair(self, *asked):
            self.calls += 1
            return super().pair(*asked)

    trie = Counting(T.build(questions))
    together = T.answers(trie, questions)
    assert trie.calls <= 2
    assert together == [T.answers(trie, [q])[0] for q in questions]
    assert T.answers(trie, []) == []


def test_words_are_cut_from_a_little_text_at_a_time():
    texts = pa.array(["lorem ipsum dolor sit amet " * 2000] * 150)
    tracemalloc.start()
    try:
        chunk = T.Chunk.of(texts, np.ones(150, bool))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert chunk.counts.tolist() == [10_001] * 150 and len(chunk.vocabulary) == 6
    assert peak < 14 * 150 * 27 * 2000


@pytest.mark.parametrize("sizes", [[], [5], [5] * 30, [0] * 25, [30, 1, 30, 2, 2]])
def test_batches_are_dealt_into_chunks(sizes):
    texts = [str(i % 10) * n for i, n in enumerate(sizes)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[a : a + 4], pa.string()), "id": pa.array(range(a, min(a + 4, len(texts))), pa.int64())}) for a in range(0, len(texts), 4)]
    out = [b.to_pydict() for b in T._filled(iter(batches), 20, 10)]
    assert [t for b in out for t in b["text"]] == texts and [i for b in out for i in b["id"]] == [*range(len(texts))]
    assert all(0 < len(b["text"]) <= 10 and (len(b["text"]) == 1 or sum(map(len, b["text"])) <= 20) for b in out)
    assert all(len(a["text"]) == 10 or sum(map(len, a["text"])) + len(b["text"][0]) > 20 for a, b in zip(out, out[1:]))
