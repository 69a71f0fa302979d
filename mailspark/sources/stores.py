"""Result, review, rejection, archive and ledger stores."""

from __future__ import annotations

import time
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import LINE_BREAKS, utrim
from ..session import arrow_uri
from .commits import Batch, find_keys, latest_rows, read_one, read_rows
from .eml import empty_files

# --------------------------------------------------------------------------
# one file per row


def write_files(df: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """Write each row's ``text`` to ``path/name``, in parallel from the tasks.

    Names are decided by the data, so a retried task writes the same file
    again. Works on every file system that Arrow knows.
    """
    uri = arrow_uri(df.sparkSession, path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, root = ((fs.LocalFileSystem(), uri) if uri.startswith("/")
                        else fs.FileSystem.from_uri(uri))
        target.create_dir(root, recursive=True)
        for batch in batches:
            for file_name, content in zip(batch["name"], batch["text"]):
                with target.open_output_stream(f"{root}/{file_name}") as out:
                    out.write((content or "").encode("utf-8", errors="replace"))
            yield pd.DataFrame({"n": [len(batch)]})

    (df.select(F.col(name).alias("name"), F.col(text).alias("text"))
     .mapInPandas(write, "n bigint").agg(F.sum("n")).collect())


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """``filename, path, value`` for every ``.json`` file in a folder."""
    full = (spark.read.option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
            # the metadata name is percent-encoded, except for +
            .select(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
                    .alias("filename"),
                    F.col("_metadata.file_path").alias("path"), "value"))
    empty = empty_files(spark, path, ".json").filter(F.endswith("name", F.lit(".json")))
    return full.unionByName(empty.select(
        F.col("name").alias("filename"),
        F.concat(F.lit(path.rstrip("/") + "/"), "name").alias("path"), F.lit("").alias("value")))


# --------------------------------------------------------------------------
# keyed stores: append a version, read the latest


def _label(batch: str | None) -> str:
    return batch if batch is not None else f"{time.time_ns():020d}"


def upsert(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Add the rows of ``df`` (keyed by ``uid``) as a new version, as a whole.

    A write costs what the batch costs, however large the store is. The same
    batch written again replaces what it wrote.
    """
    written = Batch(df.sparkSession, path, _label(batch), alone=True)
    written.write(".", df)
    written.commit()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row per uid. ``max_by`` combines before the shuffle, so a
    uid rewritten very often still sends one row per task. Rows of one batch
    are told apart by their contents."""
    stored = read_rows(spark, path)
    if stored is None:
        raise FileNotFoundError(f"nothing is committed at {path}")
    return latest_rows(stored).drop("_seq", "_batch")


def write_results(results: DataFrame, path: str, batch: str | None = None) -> None:
    """Store ``uid, value`` (result JSON); only the written uids change."""
    upsert(results.select("uid", "value"), path, batch)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results as ``uid, filename, value``."""
    return read_latest(spark, path).withColumn("filename", F.concat("uid", F.lit(".json")))


def read_result(spark: SparkSession, path: str, uid: str) -> DataFrame:
    """The stored result of one message: one folder of each merged entry is
    read, and the key reaches the parquet scan."""
    stored = read_one(spark, path, uid)
    if stored is None:
        raise FileNotFoundError(f"nothing is committed at {path}")
    return latest_rows(stored).drop("_seq", "_batch").withColumn("filename", F.concat("uid", F.lit(".json")))


def review_rows(judged: DataFrame, when: Column | None = None) -> DataFrame:
    """Review items of rejected messages; ``extracted_data`` is the contact
    where extraction has run, else null."""
    data = (F.col("contact") if "contact" in judged.columns
            else F.lit(None).cast("struct<full_name:string,emails:array<string>,"
                               "phones:array<string>,company:string,position:string,"
                               "product:string>"))
    return (judged.filter("is_spam")
            .select("uid", (when if when is not None else F.current_timestamp()).alias("ts"),
                    "subject", "reason", data.alias("extracted_data")))


def rejection_rows(judged: DataFrame, when: Column | None = None) -> DataFrame:
    """Rejection log entries."""
    return (judged.filter("is_spam")
            .select("uid", (when if when is not None else F.current_timestamp()).alias("ts"),
                    "reason_code", "reason"))


def archive_rows(judged: DataFrame) -> DataFrame:
    """Raw text of accepted messages."""
    return judged.filter(~F.col("is_spam")).select("uid", "raw")


# --------------------------------------------------------------------------
# ledger of handled uids


def ledger_lines(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame | None:
    """Uids of the text files of a ledger kept elsewhere; None without any.

    ``lines``: one uid per line, read in splits of any size. ``auto`` also
    takes files that are one JSON list on their lines; no file is read whole.
    """
    if layout not in ("lines", "auto"):
        raise ValueError(f"unknown ledger layout {layout!r}")
    try:
        stored = spark.read.option("recursiveFileLookup", True).text(path)
    except Exception as err:   # noqa: BLE001 - only "no such path" is handled
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return None
    if not stored.inputFiles():
        return None
    parts = F.split("value", LINE_BREAKS, -1)
    if layout == "auto":
        # a list on one line, or a line of a list that is spread over several
        line = utrim(F.col("value"))
        listed = F.when(F.startswith(line, F.lit("[")) & F.endswith(line, F.lit("]")),
                        F.try_parse_json(line).cast("array<string>"))
        item = F.regexp_extract(line, r'\A"(.*)",?\z', 1)
        bracket = line.isin("[", "]")
        parts = F.coalesce(listed, F.when(bracket, F.array().cast("array<string>")),
                           F.when(item != "", F.array(item)), parts)
    uids = stored.select(F.explode(parts).alias("uid")).select(utrim(F.col("uid")).alias("uid"))
    return uids.filter(F.col("uid") != "")


def read_ledger(spark: SparkSession, path: str, layout: str = "auto",
                except_batch: str | None = None) -> DataFrame:
    """Handled uids, one row each: committed ones and those of text files in the
    folder (or of the file ``path``). ``except_batch`` leaves out what one batch
    committed. A missing ledger is empty."""
    lines, rows = ledger_lines(spark, path, layout), read_rows(spark, path)
    if rows is not None:
        if except_batch is not None:
            rows = rows.filter(F.col("_batch") != except_batch)
        lines = rows.select("uid") if lines is None else lines.unionByName(rows.select("uid"))
    return spark.createDataFrame([], "uid string") if lines is None else lines.distinct()


def handled(spark: SparkSession, path: str, keys: DataFrame, layout: str = "auto",
            except_batch: str | None = None) -> DataFrame | None:
    """Which ``uid`` of ``keys`` are in the ledger; None if it is empty. Reads
    the ledger's folders that may hold them (and text files whole)."""
    found, lines = find_keys(spark, path, keys, except_batch), ledger_lines(spark, path, layout)
    if lines is not None:
        listed = keys.join(lines, "uid", "left_semi")
        found = listed if found is None else found.unionByName(listed)
    return found


def ledger_rows(uids: DataFrame) -> DataFrame:
    """Trimmed uids, without blanks and repeats."""
    return (uids.select(utrim(F.col("uid").cast("string")).alias("uid"))
            .filter(F.col("uid") != "").dropDuplicates(["uid"]))


def append_ledger(uids: DataFrame, path: str, batch: str | None = None) -> None:
    """Add uids that are neither blank nor present, under their batch. A batch
    written again replaces what it wrote."""
    spark, label = uids.sparkSession, _label(batch)
    rows = ledger_rows(uids)
    known = handled(spark, path, rows, except_batch=label)
    upsert(rows if known is None else rows.join(known, "uid", "left_anti"), path, label)


def write_ledger_lines(spark: SparkSession, path: str, target: str) -> None:
    """The ledger as text files of one uid per line."""
    read_ledger(spark, path).write.mode("overwrite").text(target)


# --------------------------------------------------------------------------
# export


def write_export(rows: DataFrame, path: str) -> None:
    """Export rows as CSV with a header, quoted so that line breaks survive."""
    (rows.write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').csv(path))
