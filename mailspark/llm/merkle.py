"""Merkle manifest of a dataset: digests, inclusion proofs, verification.

Every node carries the interval ``[lo, hi)`` of the leaf ranks it covers. A
level of the tree is the level below grouped by buckets of ``FAN ** level``
ranks, so a node lies in the bucket of the one ancestor that contains it.
Going down, the nodes of a level are joined to their containing parent by
bucket and containment, and the difference of the two intervals names a node's
siblings: those before ``lo`` stand left of it, those from ``hi`` on right of
it. Two trees are built alike: over the leaves of each group, and over the
groups' roots.

Ranks come from a range partitioning by group and key and the counts of its
partitions, so one group of any size is ranked by many tasks. Levels are
written to the shared folder; each is a third of the one below.

Defined results: nulls in any hashed column count as ``-``; a null group is a
group of its own (first), null keys come first within a group; rows with equal
keys follow by their leaf digest, so repeated rows give equal leaves side by
side and the same tree whatever order they are read in; empty texts are values
of no bytes; texts are read whole; an empty table has no nodes and no root;
other columns do not enter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

FAN = 3
_PATH = "array<struct<left:binary,right:binary>>"


def field_sql(column: str) -> str:
    """A value with its length in UTF-8 bytes; null is ``-``."""
    value = f"cast({column} AS string)"
    return f"coalesce(concat(octet_length({value}), ':', {value}), '-')"


def leaf_digest(columns: list[str]) -> Column:
    """Digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.expr(f"concat({', '.join(field_sql(c) for c in columns)})"), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(kids: Column) -> Column:
    return F.concat_ws("", F.transform(kids, lambda k: _text(k["digest"])))


def _digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, within the group by ``order``) and ``n``,
    the group's number of rows. ``rows`` must be stored, or cheap to read twice.

    Rows are range partitioned, so a large group spans many tasks; only one
    count per group and partition is summed up in windows.
    """
    laid = stage(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                 .withColumn("_at", F.monotonically_increasing_id())
                 .withColumn("_part", F.shiftright("_at", 33)), "ranked")
    pieces = laid.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col(group).alias("_group"), F.col("_part").alias("_piece"),
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(whole).alias("n"))
    return (laid.join(pieces, laid[group].eqNullSafe(pieces["_group"]) & (laid["_part"] == pieces["_piece"]))
            .withColumn("rank", F.col("_at") + F.col("_shift"))
            .drop("_at", "_part", "_group", "_piece", "_shift"))


def levels_of(leaves: DataFrame) -> list[DataFrame]:
    """All levels over ``leaves`` (``grp, n, lo, hi, digest``), leaves first.

    The levels above hold ``kids`` too, the at most FAN nodes an interval was
    made of. A group's levels end where one node is left.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 0
    found, width = [leaves], 1
    while width < largest:
        below = found[-1].filter(F.col("n") > width)
        width *= FAN
        nodes = (below.groupBy("grp", F.floor(F.col("lo") / width).alias("bucket"))
                 .agg(F.first("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                      F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))
                 .select("grp", "n", "lo", "hi", "kids", _digest_of(_joined(F.col("kids"))).alias("digest")))
        found.append(stage(nodes, f"level{len(found)}"))
    return found


def _tops(level: DataFrame, depth: int) -> DataFrame:
    """The nodes of a level that are their group's root."""
    alone = F.col("n") <= FAN ** depth
    return level.filter(alone if depth == 0 else alone & (F.col("n") > FAN ** (depth - 1)))


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """``grp, digest`` of every group's root."""
    found = None
    for depth, level in enumerate(levels):
        tops = _tops(level, depth).select("grp", "digest")
        found = tops if found is None else found.unionByName(tops)
    return found


def _side(kids: Column, keep) -> Column:
    sides = F.transform(F.filter(kids, keep), lambda k: k["digest"])
    return F.aggregate(sides, F.unhex(F.lit("")), lambda a, d: F.concat(a, d))


def _siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """What the parent's interval holds beside ``[lo, hi)``."""
    return F.struct(_side(kids, lambda k: k["hi"] <= lo).alias("left"),
                    _side(kids, lambda k: k["lo"] >= hi).alias("right"))


def leaf_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every leaf with ``path``, its siblings from the leaf up, and the columns
    of ``tops`` (one row per ``grp``, its own ``path`` to continue with)."""
    carried = [c for c in tops.columns if c not in ("grp", "path")]
    known, leaves = None, levels[0]
    for depth in range(len(levels) - 1, 0, -1):
        level = levels[depth]
        paths = _tops(level, depth).select("grp", "lo").join(tops, "grp")
        if known is not None:
            paths = paths.unionByName(known)
        parents = level.select("grp", "lo", "kids").join(paths, ["grp", "lo"])
        if depth == 1:
            break
        known = stage(parents.select("grp", F.explode("kids").alias("k"), "kids", "path", *carried)
                      .select("grp", F.col("k.lo").alias("lo"), *carried, F.concat(
                          F.array(_siblings(F.col("kids"), F.col("k.lo"), F.col("k.hi"))), "path").alias("path")),
                      f"paths{depth - 1}")
    alone = leaves.filter("n = 1").join(tops, "grp")
    if len(levels) == 1:
        return alone
    above = parents.select(F.col("grp").alias("_grp"), F.floor(F.col("lo") / FAN).alias("_bucket"),
                           F.col("lo").alias("_lo"), "kids", "path", *carried)
    inside = ((leaves["grp"] == above["_grp"]) & (F.floor(leaves["lo"] / FAN) == above["_bucket"])
              & (leaves["lo"] >= above["_lo"]))
    below = leaves.filter("n > 1").join(above, inside)
    return (below.withColumn("path", F.concat(F.array(_siblings(F.col("kids"), F.col("lo"), F.col("hi"))), "path"))
            .drop("_grp", "_bucket", "_lo", "kids").unionByName(alone))


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex) that ``leaf`` (bytes) and its siblings lead to."""
    return F.aggregate(path, _text(leaf), lambda acc, s: F.sha2(F.concat(_text(s["left"]), acc, _text(s["right"])), 256))


def proof_text(path: Column) -> Column:
    """All siblings of a path as hex, from the leaf up, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(_text(s["left"]), _text(s["right"]))))


@dataclass(frozen=True)
class Manifest:
    """A dataset's trees. ``leaves`` has the columns given, ``grp`` (the group's
    rank), ``n``, ``lo``, ``hi`` and ``digest``; ``root`` is None for no rows."""

    leaves: DataFrame
    levels: list[DataFrame]
    group_levels: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """``tree, grp, level, lo, hi, digest`` of all nodes: the manifest to keep."""
        found = None
        for tree, levels in (("leaves", self.levels), ("groups", self.group_levels)):
            for depth, level in enumerate(levels):
                rows = level.select(F.lit(tree).alias("tree"), "grp", F.lit(depth).alias("level"), "lo", "hi",
                                    _text(F.col("digest")).alias("digest"))
                found = rows if found is None else found.unionByName(rows)
        return found

    def proofs(self) -> DataFrame:
        """The leaves with ``subroot`` (bytes) and ``path``, up to the dataset's root."""
        subroots = self.group_levels[0].select(F.col("lo").alias("_leaf"), F.col("digest").alias("subroot"))
        empty = self.group_levels[0].select("grp").distinct().withColumn("path", F.array().cast(_PATH))
        tops = (leaf_paths(self.group_levels, empty).select(F.col("lo").alias("_leaf"), "path").join(subroots, "_leaf")
                .withColumnRenamed("_leaf", "grp"))
        return leaf_paths(self.levels, stage(tops, "tops"))


def build_manifest(leaves: DataFrame, group: str, key: str) -> Manifest:
    """Trees over ``leaves``: ``group``, ``key``, ``digest`` (bytes) and others.
    Rows with the same group, key and digest may be very many: a row number
    splits them."""
    rows = stage(leaves.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    placed = ranked(rows, group, [key, "digest", "_tie"]).drop("_tie")
    groups = stage(rows.select(group).distinct().withColumn("_all", F.lit(0)), "groups")
    numbered = ranked(groups, "_all", [group]).select(F.col(group).alias("_name"), F.col("rank").alias("grp"))
    leaves = stage(placed.join(numbered, F.col(group).eqNullSafe(F.col("_name"))).drop("_name")
                   .withColumnRenamed("rank", "lo").withColumn("hi", F.col("lo") + 1), "placed")
    levels = levels_of(leaves.select("grp", "n", "lo", "hi", "digest"))
    levels[0] = leaves
    subroots = stage(roots_of(levels), "subroots")
    n = subroots.count()
    tops = subroots.select(F.lit(0).cast("bigint").alias("grp"), F.lit(n).cast("bigint").alias("n"),
                           F.col("grp").alias("lo"), (F.col("grp") + 1).alias("hi"), "digest")
    group_levels = levels_of(stage(tops, "tops"))
    root = roots_of(group_levels).select(_text(F.col("digest"))).first()
    return Manifest(leaves, levels, group_levels, root[0] if root else None)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``: per row its leaf, roots, proof,
    and the root that the row as tampered with folds to."""
    hit = "crc32(cast(doc_id AS string)) % 2 = 0 AND contains(text, '\\n')"
    changed = f"CASE WHEN {hit} THEN replace(text, '\\n', '') ELSE text END"
    rows = docs.select(*COLUMNS).select(
        "doc_id", "source", leaf_digest(COLUMNS).alias("digest"),
        # only rows that differ carry a second digest
        F.when(F.expr(hit), leaf_digest([*COLUMNS[:-1], changed])).alias("tampered"))
    manifest = build_manifest(rows, "source", "doc_id")
    folded = fold(F.coalesce("tampered", "digest"), F.col("path"))
    root = F.lit(manifest.root).cast("string")
    return (manifest.proofs()
            .select("doc_id", _text(F.col("digest")).alias("leaf"), _text(F.col("subroot")).alias("subroot"),
                    root.alias("root"), F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
                    folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
