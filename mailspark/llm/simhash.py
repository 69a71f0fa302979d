"""SimHash fingerprints and near duplicates by covering locality-sensitive hashing.

Each bit position is labelled with a non-zero vector of ``radius + 1`` bits.
For each non-zero vector v there is one table; its mask holds the positions
whose label has an odd product with v. The labels of at most ``radius``
differing positions span less than the whole space, so some v is orthogonal to
all of them: its mask holds none of the positions, and the two fingerprints
agree there. No pair within the radius is missed.

Only distinct fingerprints enter the tables. A bucket is searched in its task:
breadth first, each fingerprint reached is compared with those not reached yet,
so what comes out is a spanning forest and never all pairs. A bucket of more
than BUCKET fingerprints passes through unread and is dealt anew over masks of
its remaining positions, by the same rule; at most 2 ** 16 values fit into such
a bucket, so no task ever holds more.

Defined results: null, empty and blank texts have the fingerprint zero; texts
are read whole; rows with one id stay rows, each with its own fingerprint; a
row with a null id gets the smallest id of its class (null where no other has
one); an empty table gives an empty table; other columns do not enter.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 1 << 16      # fingerprints of one bucket that a task compares
PIECE = 50_000        # shingles whose bits are counted at once
ROWS = 100_000        # rows of sorted buckets that are looked at together


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions``, one per non-zero vector of ``radius + 1`` bits."""
    span = (1 << (radius + 1)) - 1
    labels = [(p, i % span + 1) for i, p in enumerate(positions)]
    return [sum(1 << p for p, label in labels if (label & v).bit_count() % 2) for v in range(1, span + 1)]


def _free(mask: int) -> list[int]:
    return [p for p in range(64) if not mask >> p & 1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A text's fingerprint: the majority of its shingles' hash bits."""
    words = (text or "").encode("utf-8", "replace").lower().split()    # bytes: only A-Z change
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(words) - size + 1]
    ends = ends[size - 1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), PIECE):
        spans = zip(starts[at:at + PIECE].tolist(), ends[at:at + PIECE].tolist())
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fp": pa.array(prints.view(np.int64))})
    return run


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within the radius connect."""
    left, a, b = prints, [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
                left = left[~near]
    none = [np.empty(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


_LINKS = "a bigint, b bigint, pending int"


def _buckets(radius: int, limit: int):
    """Links ``a, b`` from rows ``t, key, fp`` sorted by bucket. Buckets over the
    limit come out as they are: ``pending`` is their table, ``a`` a member."""
    few = 6

    def links(a, b):
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)),
                                           "pending": pa.nulls(len(a), pa.int32())})

    def passed(t, fp):
        return pa.RecordBatch.from_pydict({"a": pa.array(fp.view(np.int64)), "b": pa.nulls(len(fp), pa.int64()),
                                           "pending": pa.array(np.full(len(fp), t, np.int32))})

    def whole(t, fp, starts, ends):
        """Complete buckets."""
        sizes = ends - starts
        size_of = np.repeat(sizes, sizes)
        end_of = np.repeat(ends, sizes)
        at = np.arange(len(size_of)) + starts[0]
        for step in range(1, few):     # small ones: every pair of neighbours, next but one, ...
            i = at[(size_of <= few) & (at + step < end_of)]
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
            if len(i):
                yield links(fp[i], fp[i + step])
        for s, e in zip(starts[sizes > few], ends[sizes > few]):
            if e - s > limit:
                yield passed(t[s], fp[s:e])
                continue
            a, b = _forest(fp[s:e], radius)
            if len(a):
                yield links(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, through = 0, None          # through: a bucket beyond the limit, passed on as it comes

        def parts(last: bool):
            nonlocal held, rows, through
            t, key, fp = (np.concatenate(x) for x in zip(*held))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cut))
            ends = np.concatenate((cut, [len(t)]))
            if through is not None:
                if (t[0], key[0]) == through:
                    yield passed(t[0], fp[:ends[0]])
                    starts, ends = starts[1:], ends[1:]
                if len(starts):
                    through = None
            held, rows = [], 0
            if not last and len(starts):   # the last bucket may go on
                s = starts[-1]
                if len(t) - s > limit:
                    yield passed(t[s], fp[s:])
                    through = (t[s], key[s])
                else:
                    held, rows = [(t[s:], key[s:], fp[s:])], len(t) - s
                starts, ends = starts[:-1], ends[:-1]
            if len(starts):
                yield from whole(t, fp, starts, ends)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("t").to_numpy(), batch.column("key").to_numpy(),
                             batch.column("fp").to_numpy().view(np.uint64)))
                rows += batch.num_rows
            if rows >= ROWS + (len(held[0][0]) if held else 0):
                yield from parts(False)
        if held:
            yield from parts(True)
    return run


def _search(tables: DataFrame, radius: int, limit: int) -> DataFrame:
    return (tables.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
            .mapInArrow(_buckets(radius, limit), _LINKS))


def _refined(radius: int):
    """Rows of a table too large for a task, dealt over masks of its free positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = covering_masks(list(range(64)), radius)
        second = [np.array([m | first_mask for m in covering_masks(_free(first_mask), radius)], np.uint64)
                  for first_mask in first]
        for batch in batches:
            t, fp = batch.column("pending").to_numpy(), batch.column("a").to_numpy().view(np.uint64)
            for one in np.unique(t):
                mine = fp[t == one]
                for u, mask in enumerate(second[one]):
                    yield pa.RecordBatch.from_pydict({
                        "t": pa.array(np.full(len(mine), (one + 1) * len(first) + u, np.int32)),
                        "key": pa.array((mine & mask).view(np.int64)), "fp": pa.array(mine.view(np.int64))})
    return run


def similar_prints(prints: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """Links ``a, b`` between the distinct 64-bit ``fp`` of ``prints``: all pairs
    within ``radius`` bits are connected by them, none lies further apart."""
    masks = covering_masks(list(range(64)), radius)
    tables = prints.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    found = stage(_search(tables.select("t", "key", "fp"), radius, limit), "links")
    links = found.filter("pending IS NULL").select("a", "b")
    pending = found.filter("pending IS NOT NULL").select("a", "pending")
    if pending.isEmpty():
        return links
    again = pending.mapInArrow(_refined(radius), "t int, key bigint, fp bigint")
    return links.unionByName(_search(again, radius, 1 << 32).select("a", "b"))


def print_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """``id, fp, component_id`` for ``id, text``: the fingerprint and the least
    id reachable over fingerprints within ``radius`` bits."""
    prints = stage(docs.mapInArrow(_prints(shingle), "id bigint, fp bigint"), "prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    joined = stage(components(similar_prints(distinct.select("fp"), radius, limit)), "components")
    classes = distinct.join(joined, distinct["fp"] == joined["id"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("class"))
    first = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    of_print = classes.join(first, "class").select("fp", "component_id")
    return prints.join(of_print, "fp").select("id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``doc_id, text``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return simhash_classes(rows).select(F.col("id").alias("doc_id"), print_hex(F.col("fp")).alias("fingerprint"),
                                        "component_id")
