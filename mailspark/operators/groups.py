"""Groups of contacts by company, else product, else name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_default, utrim
from ..session import materialize, shared_dir
from .views import is_sufficient, search

# Group kinds in display order, with their icons.
GROUP_ICONS = {"company": "🏢", "product": "📦", "name": "👤"}
_SOURCE = {"company": "company", "product": "product", "name": "full_name"}
SALTS = 32
HOT_ROWS = 1_000_000   # records of a group beyond which it is dealt over SALTS tasks
TYPE_RANK = {kind: i for i, kind in enumerate(GROUP_ICONS)}


def _first_given(pick) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, column in _SOURCE.items():
        out = out.when(~is_default(F.col(column)), pick(kind, utrim(F.col(column))))
    return out


def with_group(df: DataFrame) -> DataFrame:
    """Add ``group_type``, ``group_key`` and ``group_label`` to each record;
    records with nothing to group by are dropped. Narrow: no shuffle."""
    return (
        df.withColumn("group_type", _first_given(lambda kind, _: F.lit(kind)))
        .withColumn("group_key", _first_given(lambda _, c: F.lower(c)))
        .withColumn("group_label", _first_given(
            lambda kind, c: F.concat(F.lit(GROUP_ICONS[kind] + " "), c)))
        .filter(F.col("group_type").isNotNull())
    )


def group_contacts(df: DataFrame) -> DataFrame:
    """One row per group: ``group_type, group_key, group_name, n, first_file``.

    The name is the spelling of the first file. Counts and names combine
    map-side, so a company with a third of all records shuffles one row per
    task. Members stay rows (:func:`group_members`); they are never gathered
    into one array.
    """
    return (with_group(df).groupBy("group_type", "group_key")
            .agg(F.min_by("group_label", "filename").alias("group_name"),
                 F.count(F.lit(1)).alias("n"),
                 F.min("filename").alias("first_file")))


def group_members(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every record with its group's name and size.

    Groups of more than ``hot_rows`` records are hot. A table has at most its
    number of records over ``hot_rows`` of them, so their keys are broadcast
    (10**11 records: at most 10**5 keys). Only their members are dealt over SALTS tasks, and only they stand SALTS times on
    the right side; every other group stands there once.
    """
    # both uses read one stored copy; else the records would be grouped twice
    found = materialize(group_contacts(df), shared_dir(df.sparkSession, "groups"))
    salts = F.lit(SALTS - 1)
    hot = found.filter(F.col("n") > hot_rows).select("group_type", "group_key", F.lit(True).alias("_hot"))
    members = with_group(df).drop("group_label").join(F.broadcast(hot), ["group_type", "group_key"], "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("filename"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    groups = found.select("group_type", "group_key", "group_name", "n", F.explode(
        F.sequence(F.lit(0), F.when(F.col("n") > hot_rows, salts).otherwise(0))).alias("_salt"))
    return members.join(groups, ["group_type", "group_key", "_salt"]).drop("_salt")


def group_pages(df: DataFrame, page_size: int = 1000) -> DataFrame:
    """Groups with nested members, in pages: ``group_type, group_key,
    group_name, n, page, files``.

    A group of ``n`` records is spread by file name over ``ceil(n/page_size)``
    pages, so no array (and no task) ever holds a whole hot group. Pages of a
    group together hold all of its members.
    """
    members = group_members(df)
    pages = F.ceil(F.col("n") / page_size)
    page = F.pmod(F.xxhash64("filename"), pages).cast("int")
    record = F.struct("filename", *[c for c in df.columns if c != "filename"])
    return (members.withColumn("page", page)
            .groupBy("group_type", "group_key", "page")
            .agg(F.first("group_name").alias("group_name"), F.first("n").alias("n"),
                 F.array_sort(F.collect_list(record)).alias("files")))


def order_groups(groups: DataFrame) -> DataFrame:
    """Companies, then products, then names; larger first; ties by first file."""
    rank = F.when(F.lit(False), F.lit(None).cast("int"))
    for kind, i in TYPE_RANK.items():
        rank = rank.when(F.col("group_type") == kind, F.lit(i))
    return groups.orderBy(rank, F.col("n").desc(), "first_file")


def group_totals(groups: DataFrame) -> DataFrame:
    """Number of groups and of records in them."""
    return groups.agg(F.count(F.lit(1)).alias("n_groups"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def list_groups(view: DataFrame) -> DataFrame:
    """Sufficient records, grouped and ordered."""
    return order_groups(group_contacts(is_sufficient(view)))


def search_groups(view: DataFrame, query: str | None) -> DataFrame:
    """Sufficient records that match the query, grouped and ordered."""
    return order_groups(group_contacts(search(is_sufficient(view), query)))
