"""Message files and raw message text."""

from __future__ import annotations

import email
import email.header
import email.policy
import email.utils
import time
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import message_text
from ..session import arrow_uri

EML_GLOB = "*.[eE][mM][lL]"
# a file stream lists each file of a batch again, by default with a task for each
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
EML_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PARSED_SCHEMA = ("uid string, subject string, sender string, body string, html string, "
                 "raw string, size_bytes bigint, parse_error string")
PARSED = [field.split()[0] for field in PARSED_SCHEMA.split(", ")]
PIECE_ROWS = 32   # messages of a batch that are held parsed


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+\z", "")


def empty_files(spark: SparkSession, path: str, suffix: str, min_age: float = 0) -> DataFrame:
    """``name`` of the zero-length files of a folder, which file scans skip;
    with ``min_age`` those that were last written so many seconds ago.

    Only these names leave the listing.
    """
    from pyarrow import fs

    uri = arrow_uri(spark, path)
    source, root = ((fs.LocalFileSystem(), uri) if uri.startswith("/")
                    else fs.FileSystem.from_uri(uri))
    names = [(info.base_name,) for info in source.get_file_info(fs.FileSelector(root))
             if info.is_file and info.size == 0 and info.base_name.lower().endswith(suffix)
             and not (min_age and info.mtime_ns is not None and time.time() - info.mtime_ns / 1e9 < min_age)]
    return spark.createDataFrame(names, "name string")


def empty_eml(spark: SparkSession, path: str, min_age: float = 0) -> DataFrame:
    """``uid, content`` of the zero-length ``.eml`` files of a folder."""
    return empty_files(spark, path, ".eml", min_age).select(
        file_stem(F.col("name")).alias("uid"), F.unhex(F.lit("")).alias("content"))


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """``uid, content`` for every ``.eml`` file in a folder.

    The uid comes from the path alone, so an anti-join against the ledger
    runs before any content is parsed. A missing folder gives no rows.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", EML_GLOB)
    try:
        files = reader.load(path)
    except Exception as err:   # noqa: BLE001 - only "no such path" is handled
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], "uid string, content binary")
    return files.select(file_stem(F.col("path")).alias("uid"), "content").unionByName(empty_eml(spark, path))


def stream_eml(spark: SparkSession, path: str, files_per_trigger: int = 10_000) -> DataFrame:
    """The same as a stream: each arriving file once. File streams pass over
    zero-length files; ``stream_ingest(..., landing=path)`` adds those.

    Spark lists a batch's files one by one, in as many tasks as files unless the
    session says otherwise; where it does not, a few tasks per core are set."""
    if spark.conf.get(LISTING, None) is None:
        spark.conf.set(LISTING, 4 * spark.sparkContext.defaultParallelism)
    files = (spark.readStream.format("binaryFile").schema(EML_SCHEMA)
             .option("pathGlobFilter", EML_GLOB)
             .option("maxFilesPerTrigger", files_per_trigger).load(path))
    return files.select(file_stem(F.col("path")).alias("uid"), "content")


def _part_text(part) -> str:
    try:
        return part.get_content()
    except Exception:   # noqa: BLE001 - undecodable parts fall back to UTF-8
        return (part.get_payload(decode=True) or b"").decode("utf-8", errors="replace")


def parse_message(content: bytes | str | None, bare_sender: bool = False,
                  eight_bit: bool = False) -> tuple:
    """One raw message to (subject, sender, body, html, raw, size, error)."""
    try:
        raw = content or b""
        if isinstance(raw, (bytes, bytearray)):
            raw = bytes(raw).decode("utf-8", errors="replace")
        raw = raw.replace("\r\n", "\n").replace("\r", "\n")
        policy = email.policy.SMTPUTF8
        msg = (email.message_from_bytes(raw.encode("utf-8", errors="replace"), policy=policy)
               if eight_bit else email.message_from_string(raw, policy=policy))
        body, html = "", None
        parts = msg.walk() if msg.is_multipart() else [msg]
        for part in parts:
            kind = part.get_content_type()
            if kind == "text/plain":
                body = _part_text(part)
                break
            if kind == "text/html" and html is None:
                html = _part_text(part)
        sender = str(msg.get("From", ""))
        if bare_sender:
            sender = email.utils.parseaddr(sender)[1]
        size = len(raw.encode("utf-8", errors="replace"))
        return (str(msg.get("Subject", "")), sender, str(body or ""),
                None if html is None else str(html), raw, size, None)
    except Exception as err:   # noqa: BLE001 - one bad message never stops a run
        return ("", "", "", None, "", 0, f"{type(err).__name__}: {err}")


def parse_messages(df: DataFrame, content: str = "content", bare_sender: bool = False,
                   eight_bit: bool = False, keep_raw: bool = True) -> DataFrame:
    """Raw messages to parsed columns, in one Arrow stage.

    The first ``text/plain`` part is the body; otherwise the first
    ``text/html`` part seen before it is kept as HTML. A message that cannot
    be parsed yields empty fields and ``parse_error``. ``bare_sender`` keeps
    only the address of the From header. By default the message is parsed as
    text, which leaves non-ASCII letters of a part without transfer encoding
    as ``\\uXXXX`` escapes; ``eight_bit`` reads such parts in their charset.
    Without ``keep_raw`` the raw text does not travel back and is empty.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.string()] * 6, pa.int64(), pa.string())
        for batch in batches:
            # a piece at a time: of a batch of large messages no second copy is held
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                uids, columns = piece.column("uid"), [[] for _ in kinds]
                for content in piece.column("content"):
                    parsed = parse_message(content.as_py(), bare_sender, eight_bit)
                    for column, value in zip(columns, parsed if keep_raw else (*parsed[:4], "", *parsed[5:])):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [uids, *[pa.array(c, k) for c, k in zip(columns, kinds[1:])]], names=PARSED)

    return (df.select(F.col("uid").cast("string").alias("uid"), F.col(content).alias("content"))
            .mapInArrow(parse, schema=PARSED_SCHEMA))


def with_text(df: DataFrame) -> DataFrame:
    """Replace ``body`` by the message text and drop ``html``."""
    return df.withColumn("body", message_text(F.col("body"), F.col("html"))).drop("html")


def _decode_words(value: str | None) -> str:
    if value is None:
        return ""
    try:
        out = []
        for part, charset in email.header.decode_header(value):
            if isinstance(part, bytes):
                try:
                    part = part.decode(charset or "utf-8", errors="replace")
                except LookupError:
                    part = part.decode("utf-8", errors="replace")
            out.append(part)
        return "".join(out).strip()
    except Exception:   # noqa: BLE001 - an undecodable header stays as it is
        return value


@pandas_udf(StringType())
def decode_header(values: pd.Series) -> pd.Series:
    """Encoded header words to text; unknown charsets read as UTF-8."""
    return values.map(_decode_words)


def isolate_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable messages, and the dead letters with their error."""
    good = parsed.filter(F.col("parse_error").isNull()).drop("parse_error")
    bad = parsed.filter(F.col("parse_error").isNotNull()).select("uid", "parse_error")
    return good, bad
