"""Byte-level BPE through DuckDB recursive queries inside Spark's tasks.

Every task cuts its texts into the pattern's matches and encodes each distinct
match once. A recursive query holds one row per token of each match: a row
joins the one that starts where it ends, the pair joins the merge table, the
leftmost pair of minimum rank is contracted, until no match has a pair left.
Decoding is an ordered aggregation over the token rows. There is no shuffle;
a task keeps a bounded table of matches, so a lost task is simply run again.

Defined results: null texts encode as empty ones (no tokens, digests of the
empty string); texts are encoded whole; repeated rows give repeated results;
an empty table gives an empty table; other columns do not enter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RANKS = "byte_bpe_50k.tiktoken"
CHUNK_CHARS = 2_000_000     # texts of about so many characters are cut together
TABLE_WORDS = 400_000       # a task forgets its matches beyond so many
QUERY_BYTES = 400_000       # bytes of matches in one recursive query
LONG_WORD = 256             # longer matches contract all pairs of the lowest rank at once

# Letters of the Latin blocks, for which the standard library's
# character classes are exact, and Unicode's white space.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PLAIN_TEXT = re.compile(f"[\\x00-\\x7f{_LATIN}]*")
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^{_SPACE}{_LATIN}0-9]+"
                   f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

_ENCODE = """
WITH RECURSIVE s(w, i, pos, tok, nxt) AS (
  SELECT w, 0::INT, pos, tok, pos + 1 FROM init
  UNION ALL
  SELECT s.w, s.i + 1, s.pos, CASE WHEN s.pos = b.at THEN b.merged ELSE s.tok END,
    CASE WHEN s.pos = b.at THEN b.after ELSE s.nxt END
  FROM s JOIN (
    SELECT w, (k >> 31)::INT AS merged, (k & 2147483647)::INT AS at, dead, after FROM (
      SELECT w, min(k) AS k, arg_min(dead, k) AS dead, arg_min(after, k) AS after FROM (
        SELECT a.w, b.pos AS dead, b.nxt AS after, (m.tok::BIGINT << 31) + a.pos AS k
        FROM s a JOIN s b ON b.pos = a.nxt JOIN merges m ON m.pair = a.tok::BIGINT * 65536 + b.tok)
      GROUP BY w)) b ON s.w = b.w
  WHERE s.pos <> b.dead
)
SELECT w, string_agg(tok, ' ' ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS hex
FROM s JOIN vocabulary USING (tok) WHERE (w, i) IN (SELECT w, max(i) FROM s GROUP BY w) GROUP BY w
"""
# Long matches: every pair of the lowest rank at once; of pairs that share a
# token the left one, then every second one. In a vocabulary in which each
# token encodes to itself, this is what one contraction after another gives.
_ENCODE_LONG = """
WITH RECURSIVE s(w, i, pos, tok, nxt) AS (
  SELECT w, 0::INT, pos, tok, pos + 1 FROM init
  UNION ALL (
    WITH pairs AS (
      SELECT a.w, a.pos, b.pos AS dead, b.nxt AS after, m.tok AS merged, min(m.tok) OVER (PARTITION BY a.w) AS low
      FROM s a JOIN s b ON b.pos = a.nxt JOIN merges m ON m.pair = a.tok::BIGINT * 65536 + b.tok),
    best AS (SELECT * EXCLUDE (low), coalesce(lag(dead) OVER (PARTITION BY w ORDER BY pos) = pos, false) AS touches
      FROM pairs WHERE merged = low),
    runs AS (SELECT *, sum((NOT touches)::INT) OVER (PARTITION BY w ORDER BY pos) AS run FROM best),
    picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS n FROM runs) WHERE n % 2 = 1)
    SELECT s.w, s.i + 1, s.pos, coalesce(p.merged, s.tok), coalesce(p.after, s.nxt)
    FROM s JOIN (SELECT DISTINCT w FROM picked) q ON s.w = q.w LEFT JOIN picked p ON p.pos = s.pos
    WHERE s.pos NOT IN (SELECT dead FROM picked)
  )
)
SELECT w, string_agg(tok, ' ' ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS hex
FROM s JOIN vocabulary USING (tok) WHERE (w, i) IN (SELECT w, max(i) FROM s GROUP BY w) GROUP BY w
"""
_DECODE = """
SELECT d, string_agg(hex, '' ORDER BY p) AS hex
FROM (SELECT d, unnest(ids) AS tok, generate_subscripts(ids, 1) AS p FROM given) JOIN vocabulary USING (tok) GROUP BY d
"""


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read by the driver and sent to the tasks (its
    size is that of a vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


class Coder:
    """One task's DuckDB database with vocabulary, merge table and known matches."""

    def __init__(self, ranks: bytes, pattern: str):
        import duckdb
        import regex

        tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        pairs = [(tokens[t[:k]] * 65536 + tokens[t[k:]], r) for t, r in tokens.items()
                 for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens]
        self.bytes = [tokens[bytes([i])] for i in range(256)]
        self.slow = regex.compile(pattern)
        self.known: dict[str, tuple[str, bytes]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self._table("vocabulary", tok=pa.array(list(tokens.values()), pa.int32()),
                    hex=pa.array([t.hex() for t in tokens]))
        self._table("merges", pair=pa.array([p for p, _ in pairs], pa.int64()),
                    tok=pa.array([r for _, r in pairs], pa.int32()))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("_new", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _new")
        self.db.unregister("_new")

    def cut(self, text: str) -> list[str]:
        """The pattern's matches; they cover the text."""
        return (_FAST if _PLAIN_TEXT.fullmatch(text) else self.slow).findall(text)

    def learn(self, words: list[str]) -> None:
        """Encode matches and keep ``ids`` and decoded bytes of each."""
        batch, size = [], 0
        for word in words:
            data = word.encode("utf-8", "replace")
            if len(data) > LONG_WORD:
                self._query(_ENCODE_LONG, [word], [data])
                continue
            batch.append((word, data))
            size += len(data)
            if size >= QUERY_BYTES:
                self._query(_ENCODE, *map(list, zip(*batch)))
                batch, size = [], 0
        if batch:
            self._query(_ENCODE, *map(list, zip(*batch)))

    def _query(self, sql: str, words: list[str], data: list[bytes]) -> None:
        import numpy as np

        sizes = np.array([len(d) for d in data])
        owner = np.repeat(np.arange(len(data)), sizes)
        tok = np.array(self.bytes)[np.frombuffer(b"".join(data), np.uint8)]
        # a gap after each match: its last token has no next row
        pos = np.arange(len(tok)) + owner
        self.db.register("init", pa.table({"w": pa.array(owner, pa.int32()), "pos": pa.array(pos, pa.int32()),
                                           "tok": pa.array(tok, pa.int32())}))
        found = self.db.execute(sql).fetchall()
        self.db.unregister("init")
        for w, ids, hexes in found:
            self.known[words[w]] = ids, bytes.fromhex(hexes)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[str], list[bytes]]]:
        """Per text: its matches' ids and their decoded bytes, in order."""
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > TABLE_WORDS:
            self.known.clear()
        known = self.known
        self.learn(list({w: 0 for c in cuts for w in c if w not in known}))
        for c in cuts:
            pairs = [known[w] for w in c]
            yield [p[0] for p in pairs], [p[1] for p in pairs]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        self.db.register("given", pa.table({"d": pa.array(range(len(ids)), pa.int32()),
                                            "ids": pa.array(ids, pa.list_(pa.int32()))}))
        found = dict(self.db.execute(_DECODE).fetchall())
        self.db.unregister("given")
        return [bytes.fromhex(found.get(i, "")) for i in range(len(ids))]


def _chunks(batches: Iterator[pa.RecordBatch], column: str, weight) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_CHARS; a longer text is a slice of its own."""
    for batch in batches:
        values, start, size = batch.column(column).to_pylist(), 0, 0
        for i, v in enumerate(values):
            if size and size + weight(v) > CHUNK_CHARS:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += weight(v)
        if start < len(values):
            yield batch.slice(start)


def _tokenizer(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    if ranks_path is None or pattern is None:
        import public_tokenizers

        return ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    return ranks_path, pattern


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None,
           pattern: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key, n_tokens, ids, ids_sha256, decoded_sha256`` of every row, and the
    columns named in ``carry`` as they are.

    ``ids`` are the token ids; the digests are of the decimal ids joined by
    one space, and of the bytes that the ids decode to.
    """
    return _run(docs, key, text, ranks_path, pattern, True, carry)


def _run(docs, key, text, ranks_path, pattern, with_ids: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    path, pattern = _tokenizer(ranks_path, pattern)
    shipped = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                       *[F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)])
    kept = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for part in _chunks(batches, "text", lambda t: len(t or "")):
            coder = coder or Coder(shipped.value, pattern)
            n, ids, id_sums, byte_sums = [], [], [], []
            for id_texts, pieces in coder.encode(part.column("text").to_pylist()):
                line = " ".join(id_texts)
                n.append(line.count(" ") + 1 if line else 0)
                id_sums.append(hashlib.sha256(line.encode()).hexdigest())
                byte_sums.append(hashlib.sha256(b"".join(pieces)).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in line.split()])
            columns = {**{c: part.column(c) for c in kept}, "n_tokens": pa.array(n, pa.int64()),
                       "ids_sha256": pa.array(id_sums, pa.string()), "decoded_sha256": pa.array(byte_sums, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    coded = rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
    return coded.withColumnsRenamed({"key": key, **{f"carry{i}": c for i, c in enumerate(carry)}})


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``key, data`` (binary) from arrays of token ids, by ordered aggregation.
    A null array decodes to no bytes."""
    path, pattern = _tokenizer(ranks_path, None)
    shipped = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for part in _chunks(batches, "ids", lambda x: len(x or ())):
            coder = coder or Coder(shipped.value, pattern)
            data = coder.decode([x or [] for x in part.column("ids").to_pylist()])
            yield pa.RecordBatch.from_pydict({"key": part.column("key"), "data": pa.array(data, pa.binary())})

    return rows.mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def encode_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``doc_id, text``."""
    return _run(docs, "doc_id", "text", None, None, False)
