"""Substring dedup by subtrees over words, partitioned by prefix.

A window is ``size`` consecutive words. Its prefix key is the least of the
hashes of its runs of PREFIX words: equal windows have equal keys, and
neighbouring windows mostly share one, so a document is a row of runs of
windows with one key each. (The prefix of every suffix would be a key of its
own, and each suffix would carry its next ``size`` words: fifty times the
text.) Keys that only one document holds are dropped by a count.

Equal runs are one class, known by the digest of its words. Where a class has
several documents, all but the smallest lose the whole run; only the smallest
one's goes on, and only if its key has other classes. So a group of copies or
near copies costs one row per copy and run, and meets others as one. The runs
of a key are a group of suffixes; a task takes whole groups up to a bounded
number of words, and finds the tree nodes of depth ``size`` by prefix doubling:
after it, suffixes under one node bear one number. A node's smallest document
keeps its windows, all other leaves lose theirs. Where a key has too many
classes the prefix grows to the whole window, so that such groups combine
before they meet.

Defined results: null and empty texts have no words; texts are read whole;
documents of equal word sequences count once (the smallest id keeps its
words); equal ids are never smaller than each other, so repeated rows keep
what one of them would; rows with a null id neither lose words nor take them;
an empty table gives an empty table; other columns do not enter.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small, stage
from .wordhash import WordHasher, grams

WINDOW = 50
PREFIX = 8
GROUP_SUFFIXES = 2048   # different runs of windows with one prefix beyond which it is lengthened
SPAN_NUMBERS = 1 << 23  # numbers of the spans that may be broadcast to the texts (64 MB)
TREE_WORDS = 1_000_000  # words of the groups that one tree is built of


def _leftmost_min(g: np.ndarray, width: int) -> np.ndarray:
    """Per start: where the least value of the next ``width`` stands."""
    def both(a, b):
        return np.where(g[b] < g[a], b, a)
    best, span = np.arange(len(g)), 1
    while span * 2 <= width:
        best = both(best[:-span], best[span:])
        span *= 2
    rest = width - span
    return both(best[:len(best) - rest], best[rest:]) if rest else best


def _prefixes(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix hashes of a text, and per window where its key stands."""
    g = grams(h, PREFIX)
    return g, _leftmost_min(g, size - PREFIX + 1)


def _encoded(part: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t else b"" for t in part.column("text").to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _scan(size: int):
    """``id, n, digest, keys``: word count, digest of the words, prefix keys."""
    def run(batches):
        hasher = WordHasher(False)
        for part in _parts(batches):
            n, digests, keys = [], [], []
            texts = _encoded(part)
            for data, (h, _, _) in zip(texts, hasher.many(texts)):
                n.append(len(h))
                digests.append(hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest())
                if len(h) >= size:
                    g, at = _prefixes(h, size)
                    # one for each run of windows that share it
                    keys.append(g[at[np.concatenate(([True], at[1:] != at[:-1]))]].view(np.int64))
                else:
                    keys.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"), "n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()),
                "keys": pa.array(keys, pa.list_(pa.int64()))})
    return run


_RUNS = "key bigint, id bigint, start int, n int, digest binary, words binary"


def _runs(size: int):
    """Runs of windows that share a key which other documents hold too. ``words``
    are those from the first window's start to the last one's end."""
    kinds = {"key": pa.int64(), "id": pa.int64(), "start": pa.int32(), "n": pa.int32(), "digest": pa.binary(),
             "words": pa.binary()}

    def batch_of(out):
        return pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})

    def run(batches):
        hasher = WordHasher(False)
        out = {c: [] for c in kinds}
        for part in _parts(batches, 64):
            texts = _encoded(part)
            for me, live, data, (h, s, e) in zip(part.column("id").to_pylist(), part.column("live").to_pylist(),
                                                 texts, hasher.many(texts)):
                g, at = _prefixes(h, size)
                free = np.isin(g[at], np.array(live, np.int64).view(np.uint64))
                cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (free[1:] != free[:-1]), [True])))
                for x, y in zip(cut[:-1], cut[1:]):
                    if not free[x]:
                        continue
                    words = b" ".join(data[s[x]:e[y + size - 2]].split())
                    out["key"].append(int(g[at[x]].view(np.int64)))
                    out["id"].append(me)
                    out["start"].append(int(x))
                    out["n"].append(int(y - x))
                    out["digest"].append(hashlib.blake2b(words, digest_size=16).digest())
                    out["words"].append(words)
                if len(out["key"]) > 20_000:
                    yield batch_of(out)
                    out = {c: [] for c in out}
        if out["key"]:
            yield batch_of(out)
    return run


def _windows(size: int):
    """Each window of a run by the digest of all its words: ``deep, id, start``."""
    def run(batches):
        for part in _parts(batches):
            deep, ids, starts = [], [], []
            for me, start, n, words in zip(*(part.column(c).to_pylist() for c in ("id", "start", "n", "words"))):
                split = words.split()
                for k in range(n):
                    deep.append(hashlib.blake2b(b" ".join(split[k:k + size]), digest_size=16).digest())
                    ids.append(me)
                    starts.append(start + k)
            yield pa.RecordBatch.from_pydict({"deep": pa.array(deep, pa.binary()), "id": pa.array(ids, pa.int64()),
                                              "start": pa.array(starts, pa.int32())})
    return run


def tree_nodes(words: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node of ``depth`` above each suffix of ``words`` (those
    with at least ``depth`` words to come), by prefix doubling: suffixes with
    the same number share their first ``depth`` words."""
    rank, span = words, 1
    while span < depth:
        step = min(span, depth - span)
        if len(rank) <= step:
            return np.empty(0, np.int64)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        span += step
    return rank


def _trees(size: int):
    """Runs ``id, start, stop`` of words that lie in a window under a node which
    a smaller document shares."""
    def tree(rows):
        numbers: dict[bytes, int] = {}
        texts, lengths = [], []
        for w in rows["words"]:
            split = w.split()
            texts.append(np.fromiter((numbers.setdefault(x, len(numbers) + 1) for x in split), np.int64, len(split)))
            lengths.append(len(split))
        first = np.cumsum([0, *lengths[:-1]])
        node = tree_nodes(np.concatenate(texts), size)
        # leaves: the window starts of each row
        at = np.concatenate([np.arange(f, f + n) for f, n in zip(first, rows["n"])])
        owner = np.repeat(np.arange(len(first)), rows["n"])
        ids = np.array(rows["id"], np.int64)[owner]
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node[at], ids)
        lost = np.flatnonzero(least[node[at]] < ids)
        where = np.array(rows["start"])[owner] + at - first[owner]
        return ids[lost], where[lost]

    def spans(rows):
        ids, starts = tree(rows)
        if not len(ids):
            return None
        o = np.lexsort((starts, ids))
        ids, starts = ids[o], starts[o]
        cut = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + 1))))
        last = np.concatenate((cut[1:], [len(ids)])) - 1
        return pa.RecordBatch.from_pydict({"id": pa.array(ids[cut]), "start": pa.array(starts[cut], pa.int32()),
                                           "stop": pa.array(starts[last] + size, pa.int32())})

    def run(batches):
        rows, words, key = {c: [] for c in ("id", "start", "n", "words")}, 0, None
        for part in _parts(batches):
            columns = part.to_pydict()
            for i, k in enumerate(columns["key"]):
                if k != key and words > TREE_WORDS:
                    found = spans(rows)
                    if found is not None:
                        yield found
                    rows, words = {c: [] for c in rows}, 0
                key = k
                for c in rows:
                    rows[c].append(columns[c][i])
                words += columns["n"][i] + size - 1
        if rows["id"]:
            found = spans(rows)
            if found is not None:
                yield found
    return run


def repeated_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``id, n, whole, spans``: per row, its word count, whether its words are
    those of a smaller document, and the word runs ``start, stop`` that windows
    of smaller documents cover. ``docs``: ``id, text``. Rows with nothing
    repeated have null ``whole`` and ``spans``."""
    known = stage(docs.mapInArrow(_scan(size), "id bigint, n bigint, digest binary, keys array<bigint>"), "scan")
    classes = stage(known.filter(f"n >= {size}").groupBy("digest").agg(F.min("id").alias("first")), "classes")
    copies = (known.select("id", "digest").join(classes, "digest").filter("id > first").select("id").distinct()
              .withColumn("whole", F.lit(True)))
    leaders = classes.select(F.col("first").alias("id")).filter("id IS NOT NULL")
    keyed = known.join(small(leaders), "id", "left_semi").select("id", F.explode("keys").alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("key"),
                   "keys")
    live = stage(keyed.join(shared, "key").groupBy("id").agg(F.collect_set("key").alias("live")), "live")
    n_live = live.agg(F.coalesce(F.sum(F.size("live")), F.lit(0))).first()[0]
    runs = stage(docs.join(small(live, n_live), "id").select("id", "text", "live").mapInArrow(_runs(size), _RUNS)
                 .withColumn("tag", F.monotonically_increasing_id()), "runs")
    groups = stage(runs.groupBy("key", "digest").agg(F.min("id").alias("first"), F.max("id").alias("last")), "groups")
    stop = F.col("start") + F.col("n") + F.lit(size - 1)
    held = (runs.select("key", "digest", "id", "start", "n").join(groups.filter("first < last"), ["key", "digest"])
            .filter("id > first").select("id", "start", stop.alias("stop")))
    # a key of one class has nothing left to compare
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(
        "key", (F.col("m") > GROUP_SUFFIXES).alias("deep"))
    firsts = groups.join(sizes, "key").select("key", "digest", F.col("first").alias("id"), "deep")
    # which rows go on is settled without their words; repeated rows go on once
    tags = stage(runs.select("key", "digest", "id", "start", "tag").join(firsts, ["key", "digest", "id"])
                 .groupBy("key", "digest", "id", "start", "deep").agg(F.min("tag").alias("tag")).select("tag", "deep"), "tags")
    left = runs.join(small(tags), "tag")
    trees = (left.filter("NOT deep").select("key", "id", "start", "n", "words").repartition("key")
             .sortWithinPartitions("key").mapInArrow(_trees(size), "id bigint, start int, stop int"))
    deep = stage(left.filter("deep").select("id", "start", "n", "words").mapInArrow(
        _windows(size), "deep binary, id bigint, start int"), "windows")
    least = (deep.groupBy("deep").agg(F.min("id").alias("least"), F.max("id").alias("most"))
             .filter("least < most").select("deep", "least"))
    lost = deep.join(least, "deep").filter("id > least").select(
        "id", "start", (F.col("start") + size).alias("stop"))
    spans = (trees.unionByName(lost).unionByName(held).groupBy("id")
             .agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    return stage(spans.join(copies, "id", "full"), "repeats")


def _kept(size: int):
    """Digest of what is left of each text."""
    def run(batches):
        for part in _parts(batches):
            n, gone, sums = [], [], []
            for data, whole, spans in zip(_encoded(part), part.column("whole").to_pylist(),
                                          part.column("spans").to_pylist()):
                words = data.split()
                keep = np.ones(len(words), bool)
                for s in spans or ():
                    keep[s["start"]:s["stop"]] = False
                if whole:
                    keep[:] = False
                left = words if keep.all() else [w for w, k in zip(words, keep) if k]
                n.append(len(words))
                gone.append(len(words) - len(left))
                sums.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                "kept_sha256": pa.array(sums, pa.string())})
    return run


def _cut_text():
    def run(batches):
        for part in _parts(batches):
            out = []
            for text, whole, spans in zip(part.column("text").to_pylist(), part.column("whole").to_pylist(),
                                          part.column("spans").to_pylist()):
                if not text or not (whole or spans):
                    out.append(text)
                    continue
                words = text.encode("utf-8", "replace").split()
                keep = np.full(len(words), not whole)
                for s in spans or ():
                    keep[s["start"]:s["stop"]] = False
                out.append(b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "text": pa.array(out, pa.string())})
    return run


def _with_spans(docs: DataFrame, size: int) -> DataFrame:
    found = repeated_spans(docs, size).withColumnRenamed("id", "s_id")
    # a row weighs as many numbers as its spans hold; 8 bytes each, SPAN_NUMBERS in all are broadcast
    weight = found.agg(F.coalesce(F.sum(2 + 2 * F.coalesce(F.size("spans"), F.lit(0))), F.lit(0))).first()[0]
    return docs.join(small(found, weight, SPAN_NUMBERS), docs["id"] == found["s_id"], "left").select("id", "text", "whole", "spans")


def remove_repeats(docs: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` of every row, without repeated words; rows that lose words
    have those left joined by one space."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return (_with_spans(rows, size).mapInArrow(_cut_text(), "id bigint, text string")
            .select(F.col("id").alias(key), F.col("text").alias(text)))


def repeats_digest(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The contract's columns for ``doc_id, text``."""
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    return (_with_spans(rows, size)
            .mapInArrow(_kept(size), "id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
            .withColumnRenamed("id", "doc_id"))
