"""Byte-level BPE: DuckDB recursive queries merge the words of a partition, ordered aggregates decode.

Spark deals out the documents.  In a task, each text is cut by the pattern; a
word not met before becomes token-position rows (word, position, id), one per byte.
A recursive query joins neighbouring rows to the merge table, finds each word's
minimum rank and contracts that pair, leftmost first, until no word holds a pair
that the table knows.  Decoding joins the ids to the vocabulary's bytes and
aggregates them in order of position.

All rows of one round that hold the word's minimum-rank pair are contracted in that
round; in a run such as ``aaaa`` every other one, from the left.  A merge makes a longer
token whose pairs rank after it, so this equals one leftmost contraction at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import arrow_text, byte_sizes, distinct, freed, runs, small_batches, spread

#: Rounds of one recursive query; words that need more go into the next query.
ROUNDS = 24
#: Bytes of words merged by one query, ids decoded by one query, bytes of text handled at once, pieces remembered (twice at most).
MERGE_BYTES, DECODE_IDS, TEXT_BYTES, REMEMBERED = 500_000, 250_000, 4_000_000, 400_000

#: Unicode white space, as the pattern's engine has it (Python's own \s also counts four control characters).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A blank that other white space precedes or follows, other than a line break before a visible character's blank.
_BESIDE = rf" [{_SPACE}]|[{_SPACE}] $"
#: Pieces between which no match of the usual byte-level patterns can reach over.
_PIECES = rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_FIND = re.compile(_PIECES).findall

_MERGE = """
WITH RECURSIVE step(word, pos, id, round, open) AS (
    SELECT word, pos, id, 0, true FROM seed
  UNION ALL (
    WITH pairs AS (
      SELECT word, row_number() OVER w AS pos, id, round,
        CASE WHEN lead(word) OVER w = word THEN id::BIGINT << 32 | lead(id) OVER w END AS pair
      FROM step WHERE open AND round < {rounds} WINDOW w AS (ORDER BY pos)
    ), ranked AS (
      SELECT p.*, m.id AS rank FROM pairs p LEFT JOIN merges m ON m.pair = p.pair
    ), best AS (
      SELECT word, min(rank) AS rank FROM ranked GROUP BY word
    ), hits AS (
      SELECT pos, pos - row_number() OVER (ORDER BY pos) AS run FROM ranked JOIN best USING (word, rank)
    ), chosen AS (
      SELECT pos FROM hits QUALIFY row_number() OVER (PARTITION BY run ORDER BY pos) % 2 = 1
    )
    SELECT r.word, r.pos, CASE WHEN c.pos IS NULL THEN r.id ELSE b.rank END, r.round + 1, b.rank IS NOT NULL
    FROM ranked r JOIN best b ON b.word = r.word
      LEFT JOIN chosen c ON c.pos = r.pos
      ANTI JOIN chosen g ON g.pos + 1 = r.pos
  )
)
SELECT word, id, open FROM step WHERE NOT open OR round = {rounds} ORDER BY word, pos
"""

#: The vocabulary's bytes are held as text of the characters 0 to 255.
_DECODE = "SELECT doc, string_agg(bytes, '' ORDER BY pos) FROM ids JOIN vocabulary USING (id) GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Encode and decode with one vocabulary, in a DuckDB database held in memory by this process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self._ranks, self._pattern = ranks, regex.compile(pattern)
        #: Pieces met lately, and those met before them: what is used again moves up, the rest is forgotten.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        merges = [
            (ranks[t[:i]] << 32 | ranks[t[i:]], rank)
            for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        pair, rank = np.array(merges, np.int64).reshape(-1, 2).T
        self._load("merges", {"pair": pair, "id": rank.astype(np.int32)})
        self._load("vocabulary", {"id": np.array([*ranks.values()], np.int32), "bytes": [t.decode("latin-1") for t in ranks]})

    def _load(self, name: str, columns: dict) -> None:
        rows = pa.table(columns)
        self._db.register("rows", rows)
        self._db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows")
        self._db.unregister("rows")

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has, by recursive queries."""
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        ids = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            self._load("seed", {"word": word, "pos": np.arange(len(word)), "id": ids})
            out = self._db.execute(_MERGE.format(rounds=ROUNDS)).fetchnumpy()
            still = out["open"].astype(bool)
            done.append((out["word"][~still], out["id"][~still]))
            word, ids = out["word"][still], out["id"][still]
        word, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces, each as the bytes of 32-bit integers."""
        parts = [[p] if p[p[:1] == " " :].isalpha() else self._pattern.findall(p) for p in pieces]
        coded = [[w.encode() for w in ws] for ws in parts]
        whole = {w: np.int32(self._ranks[w]).tobytes() for ws in coded for w in ws if w in self._ranks}
        words = [*{w: None for ws in coded for w in ws if w not in whole}]
        for a, b in runs([len(w) for w in words], MERGE_BYTES):
            ids, sizes = self._merge(words[a:b])
            raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            whole |= {w: raw[i:j] for w, i, j in zip(words[a:b], [0, *ends], ends)}
        self._known |= {p: b"".join([whole[w] for w in ws]) for p, ws in zip(pieces, coded)}

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        pieces, counts = _pieces(texts)
        names, codes = distinct(pieces)
        if len(self._known) > REMEMBERED:
            self._older, self._known = self._known, {}
        self._known |= {p: self._older[p] for p in names if p in self._older}
        self._learn([p for p in names if p not in self._known])
        found = [self._known[p] for p in names]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        flat, at = np.frombuffer(b"".join(found), np.int32), np.cumsum(sizes) - sizes
        ids = flat[spread(at[codes], sizes[codes])]
        doc = np.repeat(np.arange(len(texts)), counts)
        return ids, np.bincount(doc, sizes[codes], len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids."""
        doc, parts = np.repeat(np.arange(len(counts)), counts), [[] for _ in counts]
        for a in range(0, len(ids), DECODE_IDS):
            some = slice(a, a + DECODE_IDS)
            self._load("ids", {"doc": doc[some], "pos": np.arange(len(ids[some])), "id": ids[some]})
            for d, text in self._db.execute(_DECODE).fetchall():
                parts[d].append(text.encode("latin-1"))
        return [b"".join(x) for x in parts]


def _pieces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The texts cut where no match of the pattern can reach over, and how many pieces each has.

    A blank before a visible character begins a piece, so a text is cut at its
    blanks; a text where a blank stands beside other white space is cut by ``_PIECES``.
    """
    plain = pc.invert(pc.match_substring_regex(texts, _BESIDE))
    if not pc.all(plain).as_py():
        cut = [t.split(" ") if ok else None for t, ok in zip(texts.to_pylist(), plain.to_pylist())]
        cut = [[x[0], *(" " + y for y in x[1:])] if x else _FIND(t) for x, t in zip(cut, texts.to_pylist())]
        lists = pa.array(cut, pa.list_(pa.string()))
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    first = np.zeros(int(counts.sum()), bool)
    first[np.cumsum(counts) - counts] = True
    return pc.binary_join_element_wise(pc.if_else(pa.array(first), "", " "), lists.flatten(), ""), counts


_MERGERS: dict[tuple[str, str], Merger] = {}


def merger(path: str, pattern: str) -> Merger:
    """This process's merger of a vocabulary file, made once."""
    key = (path, pattern)
    if key not in _MERGERS:
        _MERGERS[key] = Merger(read_ranks(path), pattern)
    return _MERGERS[key]


def _lists(ids: np.ndarray, counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), values)


def encode(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, ``decoded_equal`` and (``with_ids``) ids.

    ``ids`` is an array of ints.  A null text counts as empty; an empty text has no ids.  Ids may repeat
    or be null, each row is handled by itself, and other columns are not read.  An empty table gives an
    empty result.  ``path`` must name the vocabulary file on every machine.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path, pattern)
        for batch in batches:
            texts = arrow_text(batch.column("text"))
            for a, b in runs(byte_sizes(texts).tolist(), TEXT_BYTES):
                part = texts.slice(a, b - a)
                ids, counts = m.encode(part)
                raw = m.decode(ids, counts)
                said = pc.binary_join(_lists(ids, counts, pc.cast(pa.array(ids), pa.string())), ",")
                out = {
                    id_col: batch.column("id").slice(a, b - a), "n_tokens": pa.array(counts),
                    "ids_sha256": [hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in said],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
                    "decoded_equal": [x == t.as_buffer().to_pybytes() for x, t in zip(raw, part)],
                }
                if with_ids:
                    out["ids"] = _lists(ids, counts, pa.array(ids))
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_equal boolean"
    rows = small_batches(docs).selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(freed(digest), schema + (", ids array<int>" if with_ids else ""))
