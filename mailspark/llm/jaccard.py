"""N-gram Jaccard join: documents whose sets of word n-grams are alike.

Equal sets become one class first. Any two sets alike enough share SHARED
n-grams among the first few of each (in an order that puts n-grams of very many
documents last), so each such n-gram opens a tile. Pairs that meet in small
tiles only must do so SHARED times; large tiles are cut into bands of size in
which only sets of compatible size meet. Hashed bitmap signatures bound the
overlap of a pair from above (an n-gram whose bit the other lacks is missing
there); what passes is intersected exactly. One star per tile is tried first,
then each member of a tile with the likeliest partner in another component, so
that a large group of near copies is joined by about as many tests as it has
members; afterwards all pairs of different components are tried. No limit
applies to tiles, partners or candidates: large tiles are cut into blocks.

N-grams are compared by 64-bit hashes of their words.

Defined results: null, empty and word-free texts have the empty set and are
their own component; equal texts are one class; repeated rows of one id and
text change nothing (ids should else be unique); an empty table gives an empty
table; other columns do not enter.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small, stage
from .components import components
from .wordhash import WordHasher, grams

COMMON_DOCS = 50        # n-grams of so many documents go last in the order ...
COMMON_LISTED = 200_000  # ... as far as this list reaches; the order alone depends on it
SHARED = 3              # first n-grams that two sets alike have in common at least
SMALL = 16              # members of a small tile
BLOCK = 2048            # rows of a tile compared in one go
STAR = 1000             # members compared with one pivot in one go


def _sets(batch: pa.RecordBatch, n: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row's ``text``."""
    texts = [t.encode("utf-8", "replace") if t else b"" for t in batch.column("text").to_pylist()]
    for h, _, _ in hasher.many(texts):
        yield np.unique(grams(h, n))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def common_grams(docs: DataFrame, n: int) -> np.ndarray:
    """The most frequent n-grams, most frequent last: a bounded list that only
    orders n-grams. A task reports what it sees often; the sums rank it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, hasher = [], 0, WordHasher(True)

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= 4
            return pa.RecordBatch.from_pydict({"g": pa.array(u[keep].view(np.int64)), "c": pa.array(c[keep])})
        for part in _parts(batches):
            for s in _sets(part, n, hasher):
                held.append(s)
                size += len(s)
            if size > 3_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    top = (docs.select("text").mapInArrow(count, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))
           .filter(F.col("c") >= COMMON_DOCS).orderBy(F.col("c").desc(), "g").limit(COMMON_LISTED))
    # a list of bounded length
    return np.array([r.g for r in top.collect()], np.int64).view(np.uint64)[::-1]


def _width(n: np.ndarray | int):
    """Log2 of a signature's bits: at least four times the set's size, by size band."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(int) + 2, 6, 16)


def _bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(1 << int(_width(len(s))), np.uint8)
    bits[(s >> np.uint64(13)).astype(np.int64) & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def summaries(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``id, n, digest, prefix, bitmap`` of every document."""
    common = common_grams(docs, n)
    order = np.argsort(common)
    listed = docs.sparkSession.sparkContext.broadcast((common[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = listed.value
        hasher = WordHasher(True)
        for part in _parts(batches):
            sizes, digests, prefixes, maps = [], [], [], []
            for s in _sets(part, n, hasher):
                need = -(-num * len(s) // den)
                p = len(s) - need + min(SHARED, need)
                if len(known) and p:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    rare = s[~hit]
                    first = rare[:p] if len(rare) >= p else np.concatenate(
                        (rare, s[hit][np.argsort(rank[at[hit]], kind="stable")]))[:p]
                else:
                    first = s[:p]
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefixes.append(first.view(np.int64))
                maps.append(_bitmap(s))
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"), "n": pa.array(sizes, pa.int32()), "digest": pa.array(digests, pa.binary()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())), "bitmap": pa.array(maps, pa.binary())})

    return docs.mapInArrow(run, "id bigint, n int, digest binary, prefix array<bigint>, bitmap binary")


def _compare(num: int, den: int, best: bool):
    """Pairs of a cell whose signatures leave room for the overlap needed; with
    ``best``, of each member's pairs only the one with the most room."""
    def fold(rows: list[np.ndarray], width: int) -> np.ndarray:
        out = np.empty((len(rows), max(1, (1 << width) // 64)), np.uint64)
        for k, r in enumerate(rows):
            while len(r) > out.shape[1]:
                r = r[:len(r) // 2] | r[len(r) // 2:]
            out[k] = r
        return out

    def cell(n, ids, comp, home, block, one, maps):
        o = np.lexsort((ids, n))
        n, ids, comp, home, block = n[o], ids[o], comp[o], home[o], block[o]
        maps = [np.frombuffer(maps[k], np.uint64) for k in o]
        reach = np.searchsorted(n, n * den // num, side="right")
        widths = _width(n)
        # by width: the first row that is as wide, and all from there on at that width
        begin = {w: int(np.searchsorted(widths, w)) for w in np.unique(widths)}
        folded = {w: fold(maps[at:], w) for w, at in begin.items()} if len(n) > 8 else {}
        for i in range(len(n) - 1):
            if reach[i] <= i + 1:
                continue
            j = np.arange(i + 1, reach[i])
            j = j[(comp[j] != comp[i]) & (home[j] | home[i]) & (one | (block[j] != block[i]))]
            if not len(j):
                continue
            w = widths[i]
            mine, other = (folded[w][i - begin[w]], folded[w][j - begin[w]]) if folded else (
                fold([maps[i]], w)[0], fold([maps[k] for k in j], w))
            lost = np.bitwise_count(mine & ~other).sum(1)
            gone = np.bitwise_count(other & ~mine).sum(1)
            most = np.minimum(n[i] - lost.astype(np.int64), n[j] - gone.astype(np.int64))
            room = most * (num + den) - num * (n[i] + n[j])
            if best:
                k = int(np.argmax(room))
                j, room = j[k:k + 1], room[k:k + 1]
            yield ids[i], ids[j[room >= 0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def flush():
            a, b = np.array(list(seen), np.int64).reshape(-1, 2).T
            seen.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

        def work(rows):
            key = rows["token"], rows["band"], rows["i"], rows["j"]
            new = np.zeros(len(key[0]), bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            cuts = np.concatenate(([0], np.flatnonzero(new), [len(new)]))
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y - x > 1:
                    for a, bs in cell(rows["n"][x:y].astype(np.int64), rows["id"][x:y], rows["comp"][x:y],
                                      rows["home"][x:y], rows["block"][x:y], rows["i"][x] == rows["j"][x],
                                      rows["bitmap"][x:y]):
                        a = int(a)
                        seen.update((min(a, b), max(a, b)) for b in bs.tolist())

        carry = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if carry is not None:
                rows = {c: np.concatenate((carry[c], rows[c])) for c in rows}
            last = len(rows["token"]) - 1
            same = np.ones(last + 1, bool)
            for c in ("token", "band", "i", "j"):
                same &= rows[c] == rows[c][last]
            cut = 0 if same.all() else last + 1 - int(np.argmin(same[::-1]))
            work({c: v[:cut] for c, v in rows.items()})
            carry = {c: v[cut:] for c, v in rows.items()}
            if len(seen) > 200_000:
                yield flush()
        if carry is not None:
            work(carry)
        if seen:
            yield flush()
    return run


def _bound(num: int, den: int):
    """The pairs whose signatures leave room for the overlap needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["map_a"], np.uint64), np.frombuffer(r["map_b"], np.uint64)
                while len(x) > len(y):
                    x = x[:len(x) // 2] | x[len(x) // 2:]
                while len(y) > len(x):
                    y = y[:len(y) // 2] | y[len(y) // 2:]
                most = min(r["n_a"] - int(np.bitwise_count(x & ~y).sum()), r["n_b"] - int(np.bitwise_count(y & ~x).sum()))
                if most * (num + den) >= num * (r["n_a"] + r["n_b"]):
                    a.append(r["id_a"])
                    b.append(r["id_b"])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def verify(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (``a, b``) whose sets are alike, by intersecting sorted arrays.

    Each document named sends its set to the cells of its pairs' second
    members; a much-named second member has several cells, its members dealt
    over them.
    """
    pairs = stage(pairs, "pairs")
    cells = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("cells"))
    dealt = stage(pairs.join(stage(cells, "cells"), "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("cells")).cast("int").alias("cell")), "dealt")
    sends = dealt.select(F.col("a").alias("id"), "b", "cell", F.lit(1).alias("role")).unionByName(
        dealt.select(F.col("b").alias("id"), "b", "cell", F.lit(0).alias("role")).distinct())
    listed = stage(sends.groupBy("id").agg(F.collect_list(F.struct("b", "cell", "role")).alias("to")), "sends")
    rows = docs.join(small(listed, sends.count()), "id")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(True)
        for part in _parts(batches, 64):
            ids, out = part.column("id").to_pylist(), {c: [] for c in ("b", "cell", "role", "a", "s")}
            for me, to, s in zip(ids, part.column("to").to_pylist(), _sets(part, n, hasher)):
                data = s.tobytes()
                for t in to:
                    for c, v in (("b", t["b"]), ("cell", t["cell"]), ("role", t["role"]), ("a", me), ("s", data)):
                        out[c].append(v)
                    if len(out["b"]) >= 500:
                        yield batch_of(out)
                        out = {c: [] for c in out}
            if out["b"]:
                yield batch_of(out)

    def batch_of(out):
        kinds = {"b": pa.int64(), "cell": pa.int32(), "role": pa.int32(), "a": pa.int64(), "s": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for part in _parts(batches, 256):
            a, b = [], []
            for row in part.to_pylist():
                s = np.frombuffer(row["s"], np.uint64)
                if row["role"] == 0:
                    pivot, own = (row["b"], row["cell"]), s
                elif pivot == (row["b"], row["cell"]):
                    short, long = (s, own) if len(s) <= len(own) else (own, s)
                    at = np.minimum(np.searchsorted(long, short), max(len(long) - 1, 0))
                    both = int((long[at] == short).sum())
                    if both and den * both >= num * (len(s) + len(own) - both):
                        a.append(row["a"])
                        b.append(row["b"])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sent = rows.select("id", "text", "to").mapInArrow(send, "b bigint, cell int, role int, a bigint, s binary")
    return stage(sent.repartition("b", "cell").sortWithinPartitions("b", "cell", "role")
                 .mapInArrow(intersect, "a bigint, b bigint").distinct(), "links")


def _cell_pairs(rows: DataFrame, merged: DataFrame, known: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """Pairs ``a, b`` of tile rows (``token, id, n``) that are in different
    components so far and whose signatures leave room for the overlap."""
    placed = rows.select("token", "id", "n").join(small(merged), "id", "left").select(
        "token", "id", "n", F.coalesce("component", "id").alias("comp"))
    tiles = stage(placed.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"),
        F.bit_xor(F.xxhash64("id")).alias("who"),
        F.sum(F.xxhash64("id", F.lit(1)).bitwiseAND(0xFFFFFFFF)).alias("total"))
        .filter("x < y").select("token", "m", "who", "total"), "tried")
    # tiles of the same members are tried once
    large = (tiles.filter(f"m > {SMALL}").groupBy("m", "who", "total").agg(F.min("token").alias("token"))
             .select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    # bands of size: a set meets its own band and, as a guest, the next one up
    band = F.floor(F.log("n") / F.log(F.lit(den / num)) + 1e-9).cast("int")
    cells = (placed.join(small(stage(large, "large")), "token").withColumn("own", band)
             .select("*", F.explode(F.array("own", F.col("own") + 1)).alias("band"))
             .withColumn("home", F.col("own") == F.col("band"))
             .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("o"))
             .select("token", "band", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block",
                     "id", "n", "comp", "home"))
    # signatures go only to cells in which a pair can be: of two components, one of them at home
    cells = stage(cells, "cells")
    worth = (cells.groupBy("token", "band", "i", "j").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("home").alias("any"))
             .filter("x < y AND any").select("token", "band", "i", "j"))
    cells = cells.join(small(stage(worth, "worth")), ["token", "band", "i", "j"], "left_semi")
    cells = cells.join(known.select("id", "bitmap"), "id").select(
        "token", "band", "i", "j", "block", "id", "n", "comp", "home", "bitmap")
    pairs = (cells.repartition("token", "band", "i", "j").sortWithinPartitions("token", "band", "i", "j")
             .mapInArrow(_compare(num, den, best), "a bigint, b bigint").distinct())
    if not best:
        return pairs
    # a pair in small tiles only: at most SMALL members meet in each, so pairs grow with the rows
    members = placed.join(tiles.filter(f"m <= {SMALL}").select("token"), "token")
    one, two = ([F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "comp")] for x in "ab")
    fits = f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)"
    shared = (members.select("token", *one).join(members.select("token", *two), "token")
              .filter(f"id_a < id_b AND comp_a <> comp_b AND {fits}")
              .groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("k"))
              .filter(f"k >= least({SHARED}, ceil({num} * least(n_a, n_b) / {den}))"))
    maps = known.select("id", "bitmap")
    signed = (stage(shared, "shared").join(maps.withColumnsRenamed({"id": "id_a", "bitmap": "map_a"}), "id_a")
              .join(maps.withColumnsRenamed({"id": "id_b", "bitmap": "map_b"}), "id_b"))
    return pairs.unionByName(signed.select("id_a", "id_b", "n_a", "n_b", "map_a", "map_b").mapInArrow(
        _bound(num, den), "a bigint, b bigint")).distinct()


def link_documents(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row: two documents link when
    ``den * intersection >= num * union`` of their sets of word ``n``-grams."""
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    known = stage(summaries(docs, n, num, den).withColumn("row", F.monotonically_increasing_id()), "summaries")
    # of repeated rows one stands for the class, or its tiles would hold it several times
    classes = stage(known.filter("n > 0").groupBy("digest").agg(
        F.min("id").alias("rep"), F.min_by("row", "id").alias("rep_row")), "classes")
    reps = small(classes.select("rep", "rep_row").filter("rep IS NOT NULL"))
    # not an equality of columns: rows are dealt by id alone, as the joins that follow need them
    chosen = known.join(reps, (F.col("id") == F.col("rep")) & (F.col("row") - F.col("rep_row") == 0), "left_semi")
    spread = chosen.select(F.explode("prefix").alias("token"), "id", "n")
    tokens = spread.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("pivot")).filter("m > 1")
    rows = stage(spread.join(tokens.select("token", "pivot"), "token"), "tiles")

    # one star per tile: a document tries the pivot it shares most tiles with
    sizes = chosen.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n")).distinct()
    shared = (rows.filter("id <> pivot").groupBy("id", "n", "pivot").agg(F.count(F.lit(1)).alias("k"))
              .join(sizes, "pivot").filter(f"{den} * least(n, pivot_n) >= {num} * greatest(n, pivot_n)"))
    stars = (shared.groupBy("id").agg(F.max_by("pivot", F.struct("k", -F.col("pivot"))).alias("b"))
             .select(F.col("id").alias("a"), "b"))
    links = verify(docs, stars, n, num, den)
    for best in (True, False):
        merged = stage(components(links), "merged")
        links = links.unionByName(verify(docs, _cell_pairs(rows, merged, chosen, num, den, best), n, num, den))
    found = stage(components(links), "components")

    placed = stage(classes.join(found, classes["rep"] == found["id"], "left")
                   .select("digest", F.coalesce("component", "rep").alias("component")), "placed")
    return known.join(placed, "digest", "left").select(
        "id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def link_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: 4-word shingles, 85 of 100."""
    return link_documents(docs, 4, 85, 100).withColumnRenamed("id", "doc_id").select(
        "doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The row of the smallest ``doc_id`` of each component; rows kept are
    unchanged. Rows with a null id are kept."""
    gone = link_documents(docs, n, num, den).filter("id <> component_id").select(F.col("id").alias("_gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
