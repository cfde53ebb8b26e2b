import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash

from civicframe.llm import simhash_gray as S


def slow_fingerprint(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(codes):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in itertools.combinations(sorted(set(codes)), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {c: find(c) for c in codes}


def test_fingerprints_match_a_plain_count():
    rng = random.Random(3)
    texts = ["", " \n", "one", "Two WORDS", "a\x1cb c", "É é Ü ü ß"]
    texts += [" ".join(rng.choice(["The", "cat", "É", "x1", "mat."]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    got = S.fingerprints(pa.array(texts))
    assert [int(x) for x in got] == [slow_fingerprint(t) for t in texts]


def near_codes(rng, n):
    codes = set()
    while len(codes) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            codes.add(base)
            for _ in range(rng.randrange(4)):
                base ^= 1 << rng.randrange(64)
    return np.array(sorted(codes), np.uint64)


def test_index_finds_every_near_pair_of_a_group():
    rng = random.Random(5)
    codes = near_codes(rng, 400)
    groups = np.array([rng.randrange(3) for _ in codes])
    index = S.GrayIndex(groups, codes)
    got = {(int(x), int(y)) for a, b in index.links(2) for x, y in zip(a, b)}
    want = {
        (i, j) for i, j in itertools.combinations(range(len(codes)), 2)
        if index.groups[i] == index.groups[j] and (int(index.codes[i]) ^ int(index.codes[j])).bit_count() <= 2
    }
    assert got == want


def test_masks_cover_every_pair_within_the_distance():
    masks = S._masks()
    assert len(masks) == 15 and min(m.bit_count() for m in masks) >= 42
    for a, b in itertools.combinations(range(64), 2):
        assert any(m >> a & 1 == 0 and m >> b & 1 == 0 for m in masks)


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    codes = near_codes(rng, 300)
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in S.components(S.near_links(frame)).collect()}
    want = slow_components([int(c) for c in codes])
    groups = lambda m: sorted(sorted(c for c in want if m.get(c, c) == r) for r in set(m.get(c, c) for c in want))
    assert groups(roots) == groups(want)


def test_documents(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(5, "Same text here now", "a"), (3, "same TEXT here now", "b"), (9, None, "c"), (8, " ", "d"), (None, "", "e"), (1, long, "f"), (5, "Same text here now", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.apply(docs).collect()), key=str)
    same, big = f"{slow_fingerprint('same text here now'):016x}", f"{slow_fingerprint(long):016x}"
    want = [(1, big, 1), (3, same, 3), (5, same, 3), (5, same, 3), (8, "0" * 16, 8), (9, "0" * 16, 8), (None, "0" * 16, 8)]
    assert got == sorted(want, key=str)
    assert S.apply(docs.limit(0)).count() == 0


def test_keep_matches_brute_force_over_bits(spark):
    rng = random.Random(11)
    texts = ["", " ", "one two", "One TWO", "one two three four five", "one two three four six"]
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 12, 40, 200, 600]))]
        for _ in range(rng.randrange(1, 8)):
            texts.append(" ".join(words))
            words = [*words]
            for _ in range(rng.choice([0, 1, 1, len(words) // 40])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    codes = [slow_fingerprint(t) for t in texts]
    root = slow_components(codes)
    first = {r: min(i for i, c in enumerate(codes) if root[c] == r) for r in set(root.values())}
    assert len(set(codes)) > len(first)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.keep(docs.repartition(5)).collect()) == sorted(first.values())


def test_keep_leaves_the_columns_of_its_input(spark):
    rows = [(1, "a b c", 5, 6, "x"), (2, "A b c", 7, 8, "y"), (2**53 + 1, "other words", None, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row long, mark long, MARK_ string")
    assert sorted(map(tuple, S.keep(docs).collect())) == [rows[0], rows[2]]
    assert S.keep(docs.limit(0)).schema == docs.schema
