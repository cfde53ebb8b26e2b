"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is read in overlapping windows of words, all of them.  A word enters as two
vectors: one of the word itself (hashed letters, looked up in a vocabulary of the training
sample's frequent words) and the scaled sum of its character n-grams' vectors.  Two gated
recurrent passes read the window in both directions, attention weighs their states, and a
logistic unit scores the pooled state.  A second logistic unit scores a text from its windows:
the two highest, the sum of their probabilities and how many there are.

Training takes a bounded, documented sample of labelled texts.  Labels belong to texts, not
windows: in each round every text is represented by the window that scores highest now,
and a clean text by another window as well.

Everything that depends on a word alone, up to the gates' inputs, is computed once per
distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_text, byte_sizes, freed, id_remainder, labelled_sample, runs, small_batches, split_words, spread

WINDOW, STRIDE = 64, 48
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
#: Bytes of the n-grams, which also hold marks of the word's begin and end, and bits of their slots.
GRAMS, CHAR_BITS = (3, 5, 7), 17
#: Words of the vocabulary stand in so many texts of the sample or more; at most so many, the most frequent.
LEAST_TEXTS, VOCABULARY = 6, 20_000
#: Window scores are kept between this logit and its opposite.
LOWEST = -8.0
#: Bytes of text, windows and distinct words handled at once.
TEXT_BYTES, WINDOWS, WORDS = 4_000_000, 4096, 32_768
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_IS_CORE = np.zeros(256, bool)
_IS_CORE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _core(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of lower-case words (all bytes one after another) and how many each word has."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(words) else np.zeros(0, np.uint8)
    inside = _IS_CORE[raw]
    total = np.append(0, np.cumsum(inside))
    return raw[inside], np.diff(total[ends - ends[0]])


def _segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes; empty runs are 0."""
    out = np.zeros((len(sizes), *values.shape[1:]), values.dtype)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], axis=0)
    return out


def word_inputs(words: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Per word a hash of its letters (0 without any), and for each length of n-gram their slots and how many each word has."""
    core, sizes = _core(words)
    full = sizes > 0
    marked = np.where(full, sizes + 2, 0)
    ends = np.cumsum(marked)
    text = np.full(int(marked.sum()), 1, np.uint64)
    text[(ends - 1)[full]] = 2
    text[np.arange(len(core)) + np.repeat(np.cumsum(2 * full) - 1, sizes)] = core
    place = np.arange(len(core)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _BASE))
        hashes = _segment_sums((core.astype(np.uint64) + np.uint64(1)) * powers[place], sizes) * _MIX
        found = []
        for n in GRAMS:
            many = np.maximum(0, marked - n + 1)
            start = np.repeat(ends - marked - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            code = np.full(len(start), n, np.uint64)
            for k in range(n):
                code = code * _BASE + text[start + k]
            found.append(((code * _MIX >> np.uint64(64 - CHAR_BITS)).astype(np.int32), many))
    return hashes, found


@dataclass
class Batch:
    """Texts as word numbers into the distinct words' inputs."""

    codes: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: pa.StringArray) -> Batch:
        words, counts = split_words(texts, lower=True)
        coded = words.dictionary_encode()
        return cls(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, *word_inputs(coded.dictionary))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and length of every window, and its text; a text without words has one empty window."""
        n = np.maximum(1, -(-(self.counts - WINDOW) // STRIDE) + 1)
        doc = np.repeat(np.arange(len(n)), n)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        first = np.cumsum(self.counts) - self.counts
        return first[doc] + place, np.minimum(WINDOW, self.counts[doc] - place), doc

    def matrix(self, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of windows (windows x words) and which of them are words."""
        steps = np.arange(WINDOW)
        mask = steps < length[:, None]
        at = np.where(mask, first[:, None] + steps, 0)
        return np.where(mask, self.codes[at], 0) if len(self.codes) else np.zeros(at.shape, np.int64), mask


def _scatter(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up at their places."""
    return np.stack([np.bincount(at, rows[:, k], size) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def _scale(grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One over the square root of each word's n-grams."""
    return (1 / np.sqrt(np.maximum(1, sum(many for _, many in grams))))[:, None].astype(np.float32)


class Network:
    """Parameters by name; ``vocabulary`` holds the sorted word hashes, number 0 stands for any other word."""

    def __init__(self, vocabulary: np.ndarray, rng: np.random.Generator):
        self.vocabulary = vocabulary
        wide = WORD_DIM + CHAR_DIM

        def start(*shape, scale=None):
            return (rng.standard_normal(shape) * (scale or (2 / sum(shape)) ** 0.5)).astype(np.float32)

        self.p = {"word": start(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": start(1 << CHAR_BITS, CHAR_DIM, scale=0.1)}
        for way in ("ahead", "back"):
            self.p |= {f"{way}_in": start(wide, 3 * HIDDEN), f"{way}_bias": np.zeros(3 * HIDDEN, np.float32), f"{way}_state": start(HIDDEN, 3 * HIDDEN)}
        self.p |= {
            "attend": start(2 * HIDDEN, ATTENTION), "attend_bias": np.zeros(ATTENTION, np.float32), "attend_to": start(ATTENTION),
            "out": start(2 * HIDDEN), "out_bias": np.zeros(1, np.float32),
        }
        #: The unit over a text's windows; to begin with the highest window decides.
        self.head = np.array([1.0, 0, 0, 0, 0])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers in the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where((self.vocabulary[at] == hashes) & (hashes != 0), at + 1, 0)

    def inputs(self, numbers: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The input vector of each word, from its number in the vocabulary and its n-grams."""
        out = np.empty((len(numbers), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][numbers]
        out[:, WORD_DIM:] = 0
        for slots, many in grams:
            ends = np.append(0, np.cumsum(many))
            for a in range(0, len(numbers), WORDS):
                b = min(a + WORDS, len(numbers))
                out[a:b, WORD_DIM:] += _segment_sums(self.p["char"][slots[ends[a] : ends[b]]], many[a:b])
        out[:, WORD_DIM:] *= _scale(grams)
        return out

    def _pass(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States of one direction (steps x windows x units)."""
        state_weights = self.p[f"{way}_state"]
        n, steps = ids.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if way == "ahead" else range(steps - 1, -1, -1):
            x, u = gates[ids[:, t]], h @ state_weights
            zr = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, new, u[:, 2 * HIDDEN :]))
            h = np.where(mask[:, t, None], new + z * (h - new), h)
            out[t] = h
        return out

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window; ``gates`` are the distinct words' inputs to the gates of both directions."""
        passes = [self._pass(gates[way], ids, mask, way, None if keep is None else keep.setdefault(way, [])) for way in ("ahead", "back")]
        states = np.concatenate(passes, axis=2)
        seen = np.tanh(states @ self.p["attend"] + self.p["attend_bias"])
        weight = np.where(mask.T, np.exp(np.clip(seen @ self.p["attend_to"], -20, 20)), 0)
        total = np.maximum(weight.sum(0), 1e-9)
        weight = weight / total
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"states": states, "seen": seen, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["out_bias"][0]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p[f"{way}_in"] + self.p[f"{way}_bias"] for way in ("ahead", "back")}

    def logits(self, batch: Batch, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        gates = self.gates(self.inputs(self.numbers(batch.hashes), batch.grams)) if len(batch.hashes) else {w: np.zeros((1, 3 * HIDDEN), np.float32) for w in ("ahead", "back")}
        out = np.empty(len(first), np.float32)
        for a in range(0, len(first), WINDOWS):
            some = slice(a, a + WINDOWS)
            out[some] = self.forward(gates, *batch.matrix(first[some], length[some]))
        out[length <= 0] = LOWEST
        return out

    def text_features(self, texts: pa.StringArray) -> np.ndarray:
        """Of each text: its two highest windows, the log sum of its windows' probabilities, the log of their number, and 1."""
        out = np.empty((len(texts), len(self.head)))
        for a, b in runs(byte_sizes(texts).tolist(), TEXT_BYTES):
            batch = Batch.of(texts.slice(a, b - a))
            first, length, doc = batch.windows()
            logits = np.clip(self.logits(batch, first, length), LOWEST, -LOWEST).astype(np.float64)
            order = np.lexsort((-logits, doc))
            head = np.flatnonzero(np.append(True, np.diff(doc) > 0))
            many = np.diff(np.append(head, len(doc)))
            for k in range(2):
                out[a:b, k] = np.where(many > k, logits[order[np.minimum(head + k, len(doc) - 1)]], LOWEST)
            out[a:b, 2] = np.log(np.add.reduceat(1 / (1 + np.exp(-logits)), head) + 0.01)
            out[a:b, 3] = np.log(many)
            out[a:b, 4] = 1
        return out

    def score(self, texts: pa.StringArray) -> np.ndarray:
        """The score of each text, from 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.text_features(texts) @ self.head, -30, 30)))

    def fit_head(self, texts: pa.StringArray, label: np.ndarray, penalty: float = 1e-3) -> None:
        """Logistic regression of texts on their windows, by Newton steps with a small penalty."""
        if not 0 < label.sum() < len(label):
            return
        x, w = self.text_features(texts), self.head.copy()
        ridge, start = np.diag([penalty * len(label)] * 4 + [1e-3]), w.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (label - p) - ridge @ (w - start)
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad) * 0.7
        self.head = w

    def gradient(self, batch: Batch, first: np.ndarray, length: np.ndarray, label: np.ndarray, rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of windows, by back-propagation through time.

        With ``rng``, half of the words enter without their own vector, so that their letters must tell.
        """
        ids, mask = batch.matrix(first, length)
        used, ids = np.unique(ids, return_inverse=True)
        ids = ids.reshape(mask.shape)
        numbers = self.numbers(batch.hashes[used])
        if rng is not None:
            numbers = np.where(rng.random(len(numbers)) < 0.5, numbers, 0)
        grams = []
        for slots, many in batch.grams:
            starts, sizes = (np.cumsum(many) - many)[used], many[used]
            grams.append((slots[spread(starts, sizes)], sizes))
        x = self.inputs(numbers, grams)
        keep: dict = {}
        logit = self.forward(self.gates(x), ids, mask, keep)
        g = {}
        d_logit = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) / len(label)).astype(np.float32)
        g["out"], g["out_bias"] = keep["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, keep["states"])
        d_score = keep["weight"] * (d_weight - (keep["weight"] * d_weight).sum(0))
        d_states = keep["weight"][:, :, None] * d_pooled
        g["attend_to"] = np.einsum("tn,tna->a", d_score, keep["seen"])
        d_seen = d_score[:, :, None] * self.p["attend_to"] * (1 - keep["seen"] ** 2)
        g["attend"], g["attend_bias"] = np.einsum("tnh,tna->ha", keep["states"], d_seen), d_seen.sum((0, 1))
        d_states += d_seen @ self.p["attend"].T
        d_x = np.zeros_like(x)
        for way, part in (("ahead", slice(0, HIDDEN)), ("back", slice(HIDDEN, 2 * HIDDEN))):
            u = self.p[f"{way}_state"]
            d_u, d_h = np.zeros_like(u), np.zeros((len(label), HIDDEN), np.float32)
            d_each = np.empty((WINDOW, len(label), 3 * HIDDEN), np.float32)
            for t, h, z, r, new, un in reversed(keep[way]):
                d_h = d_h + d_states[t, :, part]
                on = mask[:, t, None]
                d_on = np.where(on, d_h, 0)
                d_new = d_on * (1 - z) * (1 - new**2)
                d_z, d_r = d_on * (h - new) * z * (1 - z), d_new * un * r * (1 - r)
                d_rec = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += h.T @ d_rec
                d_each[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_h = np.where(on, d_on * z + d_rec @ u.T, d_h)
            d_gates = _scatter(ids.T.ravel(), d_each.reshape(-1, 3 * HIDDEN), len(x))
            g[f"{way}_state"], g[f"{way}_in"], g[f"{way}_bias"] = d_u, x.T @ d_gates, d_gates.sum(0)
            d_x += d_gates @ self.p[f"{way}_in"].T
        g["word"] = _scatter(numbers, d_x[:, :WORD_DIM], len(self.p["word"]))
        d_char = d_x[:, WORD_DIM:] * _scale(grams)
        rows = np.concatenate([np.repeat(np.arange(len(x)), many) for _, many in grams])
        g["char"] = _scatter(np.concatenate([slots for slots, _ in grams]), d_char[rows], len(self.p["char"]))
        return g


def _unlike(batch: Batch, size: int = 5) -> np.ndarray:
    """The first text of each group of near-copies: texts of which three of four smallest shingle hashes are alike."""
    with np.errstate(over="ignore"):
        h = batch.hashes[batch.codes]
        shingle = np.zeros(len(h), np.uint64)
        for k in range(size if len(h) >= size else 0):
            shingle[: len(h) - size + 1] = shingle[: len(h) - size + 1] * _BASE + h[k : len(h) - size + 1 + k]
        at, seen, out = np.cumsum(batch.counts) - batch.counts, [set() for _ in range(4)], []
        for i, (a, n) in enumerate(zip(at.tolist(), batch.counts.tolist())):
            if n < 2 * size:
                out.append(i)
                continue
            low = [int((shingle[a : a + n - size + 1] * np.uint64(k) * _MIX >> np.uint64(8)).min()) for k in (3, 5, 7, 11)]
            if sum(x in s for x, s in zip(low, seen)) < 3:
                out.append(i)
            for x, s in zip(low, seen):
                s.add(x)
    return np.array(out, np.int64)


def _log_odds(rows: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct (feature, text) rows: the features, how many texts hold each and the log odds of a toxic text that does."""
    names, at = np.unique(rows[:, 0], return_inverse=True)
    toxic = np.bincount(at, label[rows[:, 1].astype(np.int64)], len(names))
    texts = np.bincount(at, minlength=len(names))
    n, ones = len(label), label.sum()
    return names, texts, np.log((toxic + 0.5) / (ones + 1)) - np.log((texts - toxic + 0.5) / (n - ones + 1))


def _odds(batch: Batch, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words frequent enough, sorted, their log odds, and the log odds of every n-gram slot (0 if rare)."""
    doc = np.repeat(np.arange(len(batch.counts)), batch.counts)
    held = np.unique(batch.codes * len(label) + doc)
    word, doc = held // len(label), held % len(label)
    rows = np.unique(np.column_stack([batch.hashes[word], doc.astype(np.uint64)]), axis=0)
    names, texts, odds = _log_odds(rows[rows[:, 0] != 0], label)
    kept = np.flatnonzero(texts >= LEAST_TEXTS)
    kept = np.sort(kept[np.lexsort((names[kept], -texts[kept]))[:VOCABULARY]])
    slot_odds = np.zeros(1 << CHAR_BITS)
    for slots, many in batch.grams:
        starts = np.cumsum(many) - many
        at = slots[spread(starts[word], many[word])]
        pairs = np.unique(at.astype(np.int64) * len(label) + np.repeat(doc, many[word]))
        slot, texts, lift = _log_odds(np.column_stack([pairs // len(label), pairs % len(label)]), label)
        slot_odds[slot[texts >= LEAST_TEXTS]] += lift[texts >= LEAST_TEXTS]
    return names[kept], odds[kept], slot_odds


def train(texts: pa.StringArray, label: np.ndarray, *, rounds: int = 6, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Train on texts with labels 0 and 1; the first dimension of words' and n-grams' vectors starts from their log odds."""
    rng = np.random.default_rng(seed)
    whole = Batch.of(texts)
    some = _unlike(whole)
    texts, label = texts.take(pa.array(some)), label[some].astype(np.float32)
    batch = Batch.of(texts)
    vocabulary, odds, slot_odds = _odds(batch, label)
    net = Network(vocabulary, rng)
    net.p["word"][1:, 0] = np.clip(odds, -4, 6) / 2
    net.p["char"][:, 0] = np.clip(slot_odds, -4, 6) / 4
    if not 0 < label.sum() < len(label):
        net.p["out"][:] = 0
        net.p["out_bias"][:] = 3.0 if len(label) and label.sum() else -3.0
        return net
    first, length, doc = batch.windows()
    head = np.flatnonzero(np.append(True, np.diff(doc) > 0))
    many = np.diff(np.append(head, len(doc)))
    lift = np.append(0.0, odds)[net.numbers(batch.hashes)] + net.inputs(net.numbers(batch.hashes), batch.grams)[:, WORD_DIM]
    ids, mask = batch.matrix(first, length)
    rank = np.where(mask, lift[ids] if len(lift) else 0, -9).max(axis=1)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step = 0
    for turn in range(rounds):
        rank = rank if turn == 0 else net.logits(batch, first, length)
        best = np.array([a + int(np.argmax(rank[a : a + n])) for a, n in zip(head, many)])
        other = (head + rng.integers(0, many))[label == 0]
        pick = np.concatenate([best, other])
        target = np.concatenate([label, np.zeros(len(other), np.float32)])
        order = rng.permutation(len(pick))
        for a in range(0, len(order), 256):
            rows = order[a : a + 256]
            g = net.gradient(batch, first[pick[rows]], length[pick[rows]], target[rows], rng)
            step += 1
            for k, x in net.p.items():
                grad = g[k].astype(np.float32) + decay * x
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                x -= rate * 0.75**turn * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.fit_head(texts, label)
    return net


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = 4000, *, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on at most ``most`` labelled texts of the training rows (see ``labelled_sample``), in order of a hash of the id."""
    sample = labelled_sample(docs, labels, target, most, id_col=id_col, text_col=text_col)
    rows = sample.select(F.xxhash64("__id").alias("key"), "label", "text").toArrow()
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("key", "ascending"), ("text", "ascending")]))
    return train(arrow_text(rows.column("text")), rows.column("label").to_numpy().astype(np.float32))


def apply(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    A null text counts as empty; an empty text is one window without words, which has the lowest logit.  A null id is
    never held out.  Ids may repeat; each row is scored by itself.  Other columns are not read.  An empty table
    gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.score(arrow_text(batch.column("text")))
            columns = [batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).alias("id"), (id_remainder(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
