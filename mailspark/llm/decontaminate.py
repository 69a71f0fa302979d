"""Benchmark decontamination through a positional inverted index.

The training text is read for term counts, then for the postings (term,
document, position) of the terms that are rarest in some test window. Two
such lists, shifted by their offsets in the window, are intersected; what is
left is checked word by word against the document. Exact windows give the
hits; near ones come from lists that meet within ``slop`` words.
DataFrame and SQL functions only.

Defined results: null texts have no words; documents without words have no
hits; items without words match nothing; repeated documents each get their
row; with no items or documents the result is empty or all clean. A null
``doc_id`` is a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.sqltext import let
from .common import ascii_lower_sql, small, stage, words_sql

WINDOW = 10
# Fixed value: what separates words once A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms_sql(text: str) -> str:
    return words_sql(ascii_lower_sql(text), SEPARATORS)


@dataclass
class Index:
    """``items``: item_id, words. ``pairs``: the two rarest terms of each
    window. ``postings``: term, doc_id, pos of those terms."""

    items: DataFrame
    pairs: DataFrame
    postings: DataFrame
    n_pairs: int
    n_items: int


def build_index(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> Index:
    """Term counts, then postings of the terms that windows are looked up by.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``. Counts combine
    before their shuffle. A window with a term that no document holds is
    dropped: it cannot occur.
    """
    items = stage(items.select("item_id", F.expr(terms_sql("text")).alias("words")).filter("size(words) > 0"),
                  "items")
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    terms = docs.select(F.explode(F.expr(terms_sql("text"))).alias("term"))
    counts = terms.join(small(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    starts = f"sequence(0, size(words) - least({window}, size(words)))"
    spots = (items.select("item_id", "words", F.explode(F.expr(starts)).alias("s"))
             .select("item_id", "s", F.posexplode(F.expr(f"slice(words, s + 1, {window})")).alias("o", "term")))
    ranked = (spots.join(counts, "term", "left").groupBy("item_id", "s").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (F.col("s") + F.col("o")).alias("k"),
                                             "term"))).alias("r"))
        .filter("r[0].n > 0"))
    pairs = stage(ranked.selectExpr("item_id", "r[0].k AS k1", "r[0].term AS term1",
                                    "coalesce(get(r, 1).k, r[0].k) AS k2",
                                    "coalesce(get(r, 1).term, r[0].term) AS term2").distinct(), "pairs")
    keys = pairs.select(F.explode(F.array("term1", "term2")).alias("term")).distinct()
    spread = docs.select("doc_id", F.posexplode(F.expr(terms_sql("text"))).alias("pos", "term"))
    postings = stage(spread.join(small(keys), "term").select("term", "doc_id", "pos"), "postings")
    return Index(items, pairs, postings, pairs.count(), items.count())


def meet(index: Index, slop: int = 0) -> DataFrame:
    """``doc_id, item_id, delta, gap``: where the posting lists of a window's two
    rarest terms meet; ``delta`` is the document position of the item's first
    word, ``gap`` (up to ``slop``) how far the second term is out of place."""
    first = (index.postings.join(small(index.pairs.withColumnRenamed("term1", "term"), index.n_pairs), "term")
             .select("item_id", "doc_id", F.col("term2").alias("term"), (F.col("pos") - F.col("k1")).alias("delta"),
                     (F.col("pos") - F.col("k1") + F.col("k2")).alias("want")))
    second = index.postings.select(F.col("term").alias("t2"), F.col("doc_id").alias("d2"), F.col("pos").alias("p2"))
    same = [F.col("term") == F.col("t2"), F.col("doc_id").eqNullSafe(F.col("d2"))]
    if slop:
        width = slop + 1
        first = first.withColumn("cell", F.explode(F.array(*[
            F.floor(F.col("want") / width) + i for i in (-1, 0, 1)])))
        second = second.withColumn("c2", F.floor(F.col("p2") / width))
        same.append(F.col("cell") == F.col("c2"))
    else:
        same.append(F.col("want") == F.col("p2"))
    gap = F.abs(F.col("p2") - F.col("want"))
    return (first.join(second, same).filter(gap <= slop)
            .select("doc_id", "item_id", "delta", gap.alias("gap")).distinct())


def match_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with ``n_words, hits, matched``.

    ``hits``: sorted word positions inside any exact occurrence of a window;
    ``matched``: the items that occur.
    """
    index = build_index(docs, items, window)
    wanted = (meet(index).join(small(index.items, index.n_items, 20_000), "item_id")
              .groupBy(F.col("doc_id").alias("c_id"))
              .agg(F.collect_list(F.struct("item_id", "delta", "words")).alias("cand")))
    return _verify(docs.select("doc_id", "text"), wanted, window)


def _verify(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    # flags: which item words stand where they should; a run of ``window`` of them is an occurrence
    starts = let("_l", f"least({window}, size(c.words))", let(
        "_f", "transform(c.words, (w, k) -> coalesce(get(_w, c.delta + k) = w, false))",
        "flatten(transform(filter(sequence(0, size(c.words) - _l), s -> forall(slice(_f, s + 1, _l), f -> f)), "
        "s -> sequence(c.delta + s, c.delta + s + _l - 1)))"))
    found = f"filter(transform(cand, c -> struct(c.item_id AS item_id, {starts} AS pos)), h -> size(h.pos) > 0)"
    none = "struct(cast(array() AS array<int>) AS hits, cast(array() AS array<bigint>) AS matched)"
    row = let("_w", terms_sql("text"), "struct(size(_w) AS n_words, CASE WHEN cand IS NULL THEN " + none + " ELSE "
              + let("_h", found, "struct(array_sort(array_distinct(flatten(transform(_h, h -> h.pos)))) AS hits, "
                    "array_distinct(transform(_h, h -> cast(h.item_id AS bigint))) AS matched)") + " END AS m)")
    return (docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["c_id"]), "left")
            .select("doc_id", F.explode(F.array(F.expr(row))).alias("r"))
            .select("doc_id", F.col("r.n_words").alias("n_words"), "r.m.hits", "r.m.matched"))


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 5) -> DataFrame:
    """``doc_id, item_id, delta, gap``: windows whose two rarest terms stand
    within ``slop`` words of where the window has them (``gap`` 0: in place)."""
    return meet(build_index(docs, items, window), slop)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    ids = "array_join(array_sort(transform(matched, i -> cast(i AS string))), ',')"
    return match_windows(docs.select("doc_id", "text"), items.select("item_id", "text")).select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.size("hits").cast("bigint").alias("n_hit"),
        F.size("matched").cast("bigint").alias("n_items"), F.expr(f"sha2({ids}, 256)").alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a window of some item. Rows
    and columns kept are unchanged."""
    keyed = docs.select("doc_id", "text")
    bad = match_windows(keyed, items).filter(F.size("hits") > 0).select(F.col("doc_id").alias("_bad_doc_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_doc_id"]), "left_anti")
