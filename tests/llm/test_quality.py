import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from civicframe.llm import common
from civicframe.llm import ftrl_quality as Q
from civicframe.llm import line_crf as L
from civicframe.llm.common import crc_remainder


def slow_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hit = set()
    for i in range(len(words) - 2):
        if any(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2) if j != i):
            hit |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_base_counts_match_a_plain_count():
    rng = random.Random(2)
    texts = ["", " \n\n", "a\x1cb \x0b c", "x\nx\nx y\n\n \n ", "é# é# é# é#"]
    texts += ["".join(rng.choice(["a ", "b ", "é ", "#", "\n", "a\tb "]) for _ in range(rng.randrange(150))) for _ in range(200)]
    for t in texts:
        assert L.judge(t, L.KEEP_ALL)[:6] == slow_base(t)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(30):
        field = L.LineField(tuple(rng.normal(size=len(L.FEATURES))), tuple(rng.normal(size=2)), tuple(map(tuple, rng.normal(size=(2, 2)))))
        x = rng.normal(size=(6, len(L.FEATURES)))
        emit = x @ np.array(field.weights)

        def value(path):
            return field.start[path[0]] + sum(e for e, y in zip(emit, path) if y) + sum(field.change[a][b] for a, b in zip(path, path[1:]))

        assert value(field.decode(x)) == pytest.approx(max(map(value, product((0, 1), repeat=6))))
    assert L.KEEP_ALL.decode(np.zeros((4, len(L.FEATURES)))) == [1, 1, 1, 1]
    assert L.KEEP_ALL.decode(np.zeros((0, len(L.FEATURES)))) == []


def test_field_gradient_matches_differences():
    rng = np.random.default_rng(4)
    lengths, y = [5, 3, 3, 1], np.array([1, 0, 1, 0])
    x = np.zeros((5, 4, len(L.FEATURES)), np.float32)
    for i, n in enumerate(lengths):
        x[:n, i] = rng.normal(size=(n, len(L.FEATURES)))
    active = [sum(n > t for n in lengths) for t in range(5)]
    theta = rng.normal(size=len(L.FEATURES) + 6) * 0.3

    def likelihood(theta):
        w, start, change = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        total = 0.0
        for i, n in enumerate(lengths):
            emit = x[:n, i] @ w
            score = lambda p: start[p[0]] + sum(e for e, k in zip(emit, p) if k) + sum(change[a, b] for a, b in zip(p, p[1:]))
            scores = [score(p) for p in product((0, 1), repeat=n)]
            total += score([y[i]] * n) - np.log(np.sum(np.exp(scores)))
        return total

    got = L._gradient(theta, x, y, active)
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-4
        assert got[k] == pytest.approx((likelihood(theta + step) - likelihood(theta - step)) / 2e-4, abs=2e-3)


def made(n, seed):
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "mo", "ri", "te", "su", "na") for b in ("la", "no", "pe", "du", "shi", "", "ren", "tolu")]
    texts, labels = [], []
    for _ in range(n):
        good = rng.random() < 0.7
        mark = rng.choice(["###", " |", "!!"])
        line = lambda: " ".join(w if good else (w.upper() if mark == "!!" else w) + mark for w in (rng.choice(words) for _ in range(rng.randrange(5, 20)))) + "."
        texts.append("\n".join(line() for _ in range(rng.randrange(8, 15))))
        labels.append(int(good))
    return texts, labels


def frames(spark, n=300):
    texts, labels = made(n, 5)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, ""), (0, texts[0], "clash"), (9_000, "", ""), (9_001, "word " * 200_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    return docs, spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)] + [(None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int"), labels


def test_quality_rules_on_documents(spark):
    docs, labels, truth = frames(spark)
    field = L.fit(docs, labels)
    got = L.apply(docs, field).collect()
    assert len(got) == docs.count()
    judged = {r["doc_id"]: r for r in got}
    right = [judged[i]["kept"] == bool(y) for i, y in enumerate(truth) if not judged[i]["base_failed"]]
    assert np.mean(right) > 0.97
    assert not judged[9_000]["kept"] and judged[9_001]["n_repeat_words"] == 200_000
    kept = L.keep(docs, field)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert L.apply(docs.limit(0), field).count() == 0
    assert L.fit(docs, labels.limit(0)) == L.KEEP_ALL


def test_classifier_on_documents(spark):
    docs, labels, truth = frames(spark)
    model = Q.fit(docs, labels)
    got = Q.apply(docs, model).collect()
    assert len(got) == docs.count()
    scored = {r["doc_id"]: r for r in got}
    held = [(scored[i]["predicted"] == y) for i, y in enumerate(truth) if crc_remainder(i, 3) == 1]
    assert np.mean(held) > 0.97
    assert all(r["held_out"] == (crc_remainder(i, 3) == 1) for i, r in scored.items())
    assert Q.keep(docs, model).count() == sum(r["predicted"] for r in got)
    assert Q.apply(docs.limit(0), model).count() == 0
    assert {r["score"] for r in Q.apply(docs, Q.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels, _ = frames(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert (Q.fit(docs, labels).weights == Q.fit(docs, flipped).weights).all()
    assert L.fit(docs, labels) == L.fit(docs, flipped)


def test_ftrl_matches_a_plain_loop():
    rng = random.Random(6)
    rows = [(np.array(sorted(rng.sample(range(50), 5))), np.array([rng.random() for _ in range(5)]), rng.randrange(2)) for _ in range(60)]
    rate, l1, l2 = 0.5, 1e-3, 1e-2
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((1 + n[i] ** 0.5) / rate + l2)
    for _ in range(4):
        for slots, values, y in rows:
            items = [*zip(slots.tolist(), values), (-1, 1.0)]
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in items)))
            for i, v in items:
                g, w = (p - y) * v, weight(i)
                z[i] = z.get(i, 0) + g - ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / rate * w
                n[i] = n.get(i, 0) + g * g
    model = Q.train(rows)
    assert all(model.weights[i] == pytest.approx(weight(i), abs=1e-6) for i in range(50))
    assert model.bias == pytest.approx(weight(-1), abs=1e-9)


def test_score_is_a_sparse_dot_product():
    rng = np.random.default_rng(8)
    model = Q.Model(rng.normal(size=1 << Q.BITS).astype(np.float32), 0.3)
    texts = ["", "one", "a b a b a b", "É É x!! y###"]
    want = []
    for t in texts:
        _, slot, counts = Q.features(pa.array([t]))
        want.append(1 / (1 + np.exp(-(0.3 + Q.SCALE * model.weights[slot].sum(dtype=float) / max(1, counts[0])))))
    assert np.allclose(model.score(pa.array(texts)), want)


def test_sample_takes_one_row_of_an_id_and_bounded_bytes(spark):
    rows = [(7, f"text {i}") for i in range(50)] + [(i, "x" * 100) for i in range(3, 40)] + [(40, "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 41)], "doc_id long, quality int")
    taught = {i for i in range(3, 41) if common.crc_remainder(i, 3) != 1}
    got = common.labelled_sample(docs.repartition(4), labels, "quality", 1000).collect()
    assert 7 in taught and sorted(r["__id"] for r in got) == sorted(taught)
    few = common.labelled_sample(docs, labels, "quality", 1000, most_bytes=1000).collect()
    assert 5 < len(few) < len(taught) and sum(len(r["text"]) for r in few) <= 1000 and all(len(r["text"]) <= 100 for r in few)
    assert common.labelled_sample(docs, labels, "quality", 5).count() == 5
