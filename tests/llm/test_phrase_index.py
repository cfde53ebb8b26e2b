"""Phrases against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from civicframe.llm import phrase_index as P
from civicframe.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)) if w]


def slow(rows, least=30, longest=4, top=2000):
    """Rows of (lang, text): the result by counting every run of words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {g: c for g, c in f.items() if len(g[1]) > 1 and c >= least}
    inside = set()
    for (lang, words), c in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                if 100 * c >= 80 * f[part]:
                    inside.add(part)
    out = []
    for lang in n:
        kept = []
        for (at, words), a in found.items():
            if at == lang and (at, words) not in inside:
                cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                kept.append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
        kept.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(kept[:top])]
    return sorted(out)


def test_words_and_breaks():
    texts = ["The Cat, sat\ton a  mat.", "", "É É;x", " a", "b\x0bc\x1cd\x00", "..."]
    words, first = P.words_and_breaks(pa.array(texts))
    want = [(w, i == 0) for t in texts for p in pieces(t) for i, w in enumerate(p)]
    assert [(w.decode(), bool(b)) for w, b in zip(words.to_pylist(), first)] == want


def test_index_counts_every_phrase():
    rng = random.Random(6)
    text = np.array([rng.choice([0, 1, 1, 2, 3, 4]) for _ in range(700)], np.int32)
    whole = [0, *text.tolist()]
    index = P.PhraseIndex(text, 4)
    words = np.arange(1, index.symbols)
    at, size = index.begin[words], np.diff(index.begin)[words]
    grams = [(int(w),) for w in words]
    for k in range(1, 4):
        place, p, q, count = index.longer(at, size, k)
        found = {grams[i] + grams[j][-1:]: int(c) for i, j, c in zip(p, q, count)}
        assert all(grams[i][1:] == grams[j][:-1] for i, j in zip(p, q))
        want = Counter(g for g in zip(*(whole[i:] for i in range(k + 1))) if 0 not in g)
        assert found == dict(want)
        grams = [grams[i] + grams[j][-1:] for i, j in zip(p, q)]
        starts = [tuple(index.text[x : x + k + 1]) for x in index.order[place]]
        assert [tuple(map(int, g)) for g in starts] == grams
        at, size = place, count


def test_collocations_match_plain_counts(spark):
    docs = table(spark, FOLDER, "documents")
    want = slow([(r["lang"], r["text"]) for r in docs.collect()], least=5, top=300)
    got = P.collocations(docs.repartition(6), least=5, top=300).collect()
    assert sorted(map(tuple, got)) == want and len({r[0] for r in want}) == 4


def test_small_shards_and_ties(spark, monkeypatch):
    rng = random.Random(9)
    words = ["a", "B", "b", "É", "cc", "d-d", "e"]
    rows = [(rng.choice(["en", None, "und", "x"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(80)))) for _ in range(120)]
    rows += [("en", "one two three four five " * 40), ("en", None), (None, ""), ("x", " .,; "), *[("en", "hot phrase here")] * 60]
    docs = spark.createDataFrame([(l, t, "own") for l, t in rows], "lang string, text string, name string")
    for least in (2, 30):
        got = P.collocations(docs.repartition(9), least=least).collect()
        assert sorted(map(tuple, got)) == slow(rows, least=least)
    assert P.collocations(docs.limit(0)).count() == 0
    assert P.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


def test_shards_of_bounded_size(monkeypatch):
    monkeypatch.setattr(P, "SHARD_BYTES", 300)
    texts = [("en" if i % 3 else "fr", f"word{i % 7} word{i % 5}. other {i}") for i in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array([l for l, _ in texts[i : i + 9]]), pa.array([t for _, t in texts[i : i + 9]])], ["lang", "text"]) for i in range(0, 200, 9)]
    made = [row for b in P._shards(iter(batches)) for row in b.to_pylist()]
    assert len(made) > 10 and sum(r["n"] for r in made) == 4 * 200
    total = Counter()
    for r in made:
        total.update({(r["lang"], w): c for w, c in zip(r["words"], r["counts"])})
    want = Counter((l, w) for l, t in texts for p in pieces(t) for w in p)
    assert total == want
