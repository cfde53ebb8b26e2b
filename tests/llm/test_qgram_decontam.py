import random

import pytest

from civicframe.llm import qgram_decontam as G

LETTERS = "abcdefghij klmno pqrst uvwxyz "


def slow_distance(item, text):
    """Fewest edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def random_text(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n)).strip() or "x"


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(LETTERS)
        elif kind == 1:
            out.insert(at, rng.choice(LETTERS))
        else:
            del out[at]
    return "".join(out)


def test_all_passages_within_the_budget_are_found():
    rng = random.Random(1)
    items = [G.normal(random_text(rng, n)).strip() for n in (81, 120, 200, 394, 30, 14, 5)]
    texts = []
    for _ in range(60):
        k = rng.randrange(len(items))
        texts.append(random_text(rng, rng.randrange(400)) + edited(rng, items[k], rng.randrange(G.budget(len(items[k])) + 3)) + random_text(rng, rng.randrange(400)))
    passages = G.Passages(list(range(len(items))), items)
    got = {(d, i): e for d, i, _, _, e in passages.find(texts)}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            e = slow_distance(item, G.normal(t))
            if e <= G.budget(len(item)):
                want[d, i] = e
    assert got == want and len(want) > 20


def test_places_are_those_of_the_text():
    rng = random.Random(2)
    item = random_text(rng, 150)
    text = "Some İstanbul words.\n" + item.upper().replace(" ", "\n", 2) + " end"
    (_, _, begin, end, edits), = G.Passages([0], [G.normal(item).strip()]).find([text])
    assert edits == 0 and text[begin:end] == item.upper().replace(" ", "\n", 2)


def test_align_counts_edits():
    rng = random.Random(3)
    item = random_text(rng, 100)
    for n in range(6):
        text = "prefix " * 3 + edited(rng, item, n) + " suffix" * 3
        got = G.align(item, text, 0, 40, 6)
        assert got[0] == slow_distance(item, text) and slow_distance(item, text[got[1] : got[2]]) == got[0]
    assert G.align(item, "nothing like it " * 10, 0, 40, 6) is None


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK_CHARS", block)
    rng = random.Random(4)
    a, b = random_text(rng, 90), random_text(rng, 130)
    long = random_text(rng, 100_000) + b
    rows = [(1, "x " + a.upper() + " y", "c"), (1, "x " + a.upper() + " y", "c"), (2, random_text(rng, 500), ""), (None, a, ""), (4, None, ""), (5, "", ""), (6, long, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, a, 1), (11, b, 1), (11, b, 1), (12, None, 1), (13, "  ", 1), (None, "q" * 40, 1)], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in G.apply(docs, bench).collect()), key=str)
    assert got == sorted([(1, 10, 0), (1, 10, 0), (None, 10, 0), (6, 11, 0), (6, 11, 0)], key=str)
    assert sorted(r["doc_id"] for r in G.keep(docs, bench).collect()) == [2, 4, 5]
    assert G.apply(docs.limit(0), bench).count() == 0 and G.apply(docs, bench.limit(0)).count() == 0
    assert G.keep(docs, bench.limit(0)).count() == 7 and G.keep(docs, bench).columns == docs.columns
