import random

import numpy as np
import pyarrow as pa
import pytest

from civicframe.llm import gru_toxicity as G


def made(n, seed):
    """Toxic texts hold a bad word somewhere, or two words that begin with a bad stem."""
    rng = random.Random(seed)
    plain = [a + b for a in ("ka", "mo", "ri", "te", "su") for b in ("la", "no", "pe", "du", "shi", "")]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(1, 300))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Idiot!!", "scum,", "zorgla" + rng.choice(plain)]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels, np.float32)


def test_gradient_matches_differences(monkeypatch):
    monkeypatch.setattr(G, "WINDOW", 6)
    rng = np.random.default_rng(1)
    batch = G.Batch.of(pa.array(["the cat sat on a mat you idiot", "a b c", "", "dog the the cat ### mat"]))
    net = G.Network(np.sort(np.unique(batch.hashes[batch.hashes != 0]))[:5], rng)
    first, length, _ = batch.windows()
    label = (np.arange(len(first)) % 2).astype(np.float32)
    net.p = {k: v.astype(np.float64) + (rng.standard_normal(v.shape) * 0.3 if k != "char" else 0) for k, v in net.p.items()}

    def loss():
        gates = net.gates(net.inputs(net.numbers(batch.hashes), batch.grams))
        z = net.forward(gates, *batch.matrix(first, length)).astype(np.float64)
        return np.mean(np.log1p(np.exp(z)) - label * z)

    for name, grad in net.gradient(batch, first, length, label).items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        kept, losses = net.p[name][at], []
        for step in (1e-2, -1e-2):
            net.p[name][at] = kept + step
            losses.append(loss())
        net.p[name][at] = kept
        assert grad[at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=2e-2, abs=1e-4)


def test_windows_cover_every_word():
    batch = G.Batch.of(pa.array(["", "x", " ".join(["w"] * 64), " ".join(["w"] * 65), " ".join(["w"] * 1000)]))
    first, length, doc = batch.windows()
    at = np.cumsum(batch.counts) - batch.counts
    for d, n in enumerate(batch.counts):
        seen = set()
        for f, k in zip(first[doc == d], length[doc == d]):
            seen |= set(range(f - at[d], f - at[d] + k))
        assert seen == set(range(n))
    assert (doc == 0).sum() == 1 and (doc == 3).sum() == 2


@pytest.fixture(scope="module")
def net():
    texts, labels = made(900, 1)
    return G.train(pa.array(texts), labels)


def test_held_out_accuracy(net):
    texts, labels = made(400, 2)
    predicted = net.score(pa.array(texts)) >= 0.5
    assert (predicted == labels).mean() > 0.95


def test_score_depends_on_the_whole_text_and_not_on_its_batch(net):
    long = " ".join(["kala"] * 20_000)
    alone = [net.score(pa.array([t]))[0] for t in (long, long + " idiot", "", "###")]
    assert alone[1] > 0.5 > alone[0] and alone[2] < 0.5
    assert np.allclose(net.score(pa.array([long, long + " idiot", "", "###"])), alone, atol=1e-4)


def test_documents_and_training_rows(spark):
    texts, labels = made(300, 3)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, "x"), (0, texts[0], "clash"), (7_000, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    frame = spark.createDataFrame([(i, int(y), 0) for i, y in enumerate(labels)] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, quality int")
    model = G.fit(docs, frame)
    got = G.apply(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({(r["score"], r["predicted"]) for r in got if r["doc_id"] == 0}) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert G.apply(docs.limit(0), model).count() == 0
    untrained = G.fit(docs, frame.limit(0))
    assert {r["predicted"] for r in G.apply(docs, untrained).collect()} == {0}
