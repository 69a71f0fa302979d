"""Language identification by Bayesian fusion of evidence.

Per document: the likelihood of its text under a character-trigram model of
each language; how often a declared language (markup, metadata) and an address
suffix go with each language; and a prior for its host, smoothed towards its
domain, and that towards all documents. The last three are sums over the whole
table, grouped by declared language, suffix, host and domain; sums combine
before their shuffle. The text model is fitted on a bounded sample of labelled
rows; its table has a fixed size.

Defined results: null, empty and letter-free texts have no text evidence and
are rejected (language null); without any labelled text all other texts are
accepted with language null; texts are read whole; missing declarations,
suffixes and hosts say nothing; repeated rows give repeated results; an empty
table gives an empty table; other columns do not enter.
"""

from __future__ import annotations

import html
import math
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small, stage

FIT_ROWS = 4000      # labelled rows that the text model is fitted on, at most
BUCKETS = 1 << 16    # hashed trigrams
TEMPER = 0.25        # weight of a trigram: neighbouring ones overlap
HOST_WEIGHT = 20.0   # rows that the parent's share counts for
MIN_POSTERIOR = 0.5
SHARE = 0.1          # least share of the uniform distribution in each language's: it bounds what an unseen trigram costs
MIN_RATIO = -1.4     # mean log ratio of a trigram's likelihood to the uniform one
PIECE = 1_000_000


def _is_letter() -> np.ndarray:
    table = np.ones(0x10000, bool)
    table[:0x3000] = [chr(i).isalpha() for i in range(0x3000)]
    return table


class Trigrams:
    """Hashed character trigrams of texts, letters only, in lower case."""

    def __init__(self):
        self.letter = _is_letter()

    def of(self, text: str) -> Iterator[np.ndarray]:
        for at in range(0, len(text), PIECE):
            code = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
            code = np.where(self.letter[np.minimum(code, 0xFFFF)], code, 32).astype(np.uint64)
            code = np.concatenate(([np.uint64(32)], code, [np.uint64(32)]))
            code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
            if len(code) > 2:
                h = (code[:-2] * np.uint64(1000003) + code[1:-1]) * np.uint64(1000003) + code[2:]
                yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """Log likelihoods of the buckets from their counts per language.

    Each language is mixed with the uniform distribution. The share is the same
    for all, and SHARE unless the counts are so few that new trigrams must be
    expected more often; so an unseen trigram costs the same however many rows
    were counted.
    """
    total, kinds = counts.sum(), np.count_nonzero(counts.sum(0))
    share = max(SHARE, kinds / max(total + kinds, 1))
    own = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return np.log((1 - share) * own + share / BUCKETS).astype(np.float32)


def fit_text_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log likelihoods per bucket, from ``id, text, lang``.

    The rows of least id hash, FIT_ROWS at most, are counted in tasks; what
    reaches the driver has at most BUCKETS rows per language.
    """
    rows = (labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("id").alias("h"))
            .orderBy("h").limit(FIT_ROWS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams, sums = Trigrams(), {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for t in trigrams.of(text):
                    own += np.bincount(t, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "b": pa.array(at),
                                              "c": pa.array(own[at])})

    counts = (rows.repartition(16).mapInArrow(count, "lang string, b bigint, c bigint").groupBy("lang", "b")
              .agg(F.sum("c").alias("c")).toPandas())
    languages = sorted(counts["lang"].unique())
    table = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[i, own["b"].to_numpy()] += own["c"].to_numpy()
    return languages, likelihoods(table)


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: bool = False) -> DataFrame:
    """``id, host, domain, declared, suffix, n, ll``: number of trigrams and the
    log likelihood per language. With ``markup`` tags are passed over."""
    shipped = rows.sparkSession.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, trigrams = np.ascontiguousarray(shipped.value.T), Trigrams()
        tags = re.compile(r"<(script|style)\b[^>]*>[^<]*(?:<(?!/\1)[^<]*)*|<!--.*?-->|<[^>]*>", re.S | re.I)
        for batch in batches:
            n, ll = [], []
            for text in batch.column("text").to_pylist():
                if text and markup:
                    text = html.unescape(tags.sub(" ", text))
                total, seen = np.zeros(table.shape[1]), 0
                for t in trigrams.of(text or ""):
                    total += table[t].sum(0, dtype=np.float64)
                    seen += len(t)
                n.append(seen)
                ll.append(total.tolist())
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("id", "host", "domain", "declared", "suffix")},
                "n": pa.array(n, pa.int64()), "ll": pa.array(ll, pa.list_(pa.float64()))})

    return rows.select("id", "host", "domain", "declared", "suffix", "text").mapInArrow(
        run, "id bigint, host string, domain string, declared string, suffix string, n bigint, ll array<double>")


def _softmax(logs: str) -> Column:
    return F.expr(f"transform(transform({logs}, x -> exp(x - array_max({logs}))), "
                  f"e -> e / aggregate(transform({logs}, x -> exp(x - array_max({logs}))), 0D, (a, x) -> a + x))")


def _grouped(soft: DataFrame, key: str, k: int) -> DataFrame:
    """``key, sums``: soft counts of the languages per value of a column."""
    sums = soft.filter(F.col(key).isNotNull()).groupBy(key).agg(*[
        F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)])
    return sums.select(key, F.array(*[f"s{i}" for i in range(k)]).alias("sums"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: bool = False,
             accept: tuple[str, ...] | None = None) -> DataFrame:
    """``id, lang, posterior, text_lang, n_trigrams, accepted`` of every row of
    ``id, text, declared, suffix, host, domain``.

    A document is rejected when it has no letters, when its trigrams are
    unlikely in every language, when no language reaches MIN_POSTERIOR, or
    when its language is not in ``accept`` (default: all). A model without
    languages accepts nothing; see ``judge``.
    """
    languages, k = model[0], len(model[0])
    if not k:
        return text_evidence(rows, model, markup).selectExpr(
            "id", "cast(NULL AS string) AS lang", "cast(NULL AS double) AS posterior",
            "cast(NULL AS string) AS text_lang", "n AS n_trigrams", "false AS accepted")
    known = stage(text_evidence(rows, model, markup).withColumn(
        "tempered", F.expr(f"transform(ll, x -> x * {TEMPER}D)")), "evidence")
    # only texts with something to say shape the tables
    soft = known.filter("n > 0").withColumn("p", _softmax("tempered"))
    total = soft.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(k)]).first()
    overall = [(x + 1.0) / (sum(total) + k) for x in total]

    def smoothed(sums: str, parent: str) -> str:
        return (f"zip_with({sums}, {parent}, (s, q) -> (s + {HOST_WEIGHT}D * q) / "
                f"(aggregate({sums}, 0D, (a, x) -> a + x) + {HOST_WEIGHT}D))")

    flat = "array(" + ", ".join(f"{x!r}D" for x in overall) + ")"
    domains = _grouped(soft, "domain", k).selectExpr("domain", f"{smoothed('sums', flat)} AS prior")
    places = soft.filter("host IS NOT NULL").groupBy("host").agg(F.min("domain").alias("domain"), *[
        F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)])
    hosts = stage(places.select("host", "domain", F.array(*[f"s{i}" for i in range(k)]).alias("sums"))
                  .join(domains, "domain", "left")
                  .selectExpr("host", f"{smoothed('sums', f'coalesce(prior, {flat})')} AS prior"), "hosts")

    def weights(key: str) -> DataFrame:
        """log P(value | language), up to what all languages share."""
        seen = _grouped(soft, key, k)
        each = "array(" + ", ".join(f"{max(x, 1e-9)!r}D" for x in total) + ")"
        return stage(seen.selectExpr(key, f"zip_with(sums, {each}, (s, t) -> ln((s + 0.5D) / (t + 1D))) AS {key}_w"),
                     key)

    # one row per host or value: broadcast while they are few, else dealt by Spark, which splits large keys
    joined = (known.join(small(hosts), "host", "left").join(small(weights("declared")), "declared", "left")
              .join(small(weights("suffix")), "suffix", "left"))
    zero = f"array_repeat(0D, {k})"
    fused = (f"zip_with(zip_with(tempered, coalesce(declared_w, {zero}), (a, b) -> a + b), "
             f"zip_with(transform(coalesce(prior, {flat}), x -> ln(x)), coalesce(suffix_w, {zero}), "
             "(a, b) -> a + b), (a, b) -> a + b)")
    named = "array(" + ", ".join(f"'{x}'" for x in languages) + ")"
    wanted = F.lit(True) if accept is None else F.col("lang").isin(*accept)
    return (joined.withColumn("fused", F.expr(fused)).withColumn("p", _softmax("fused"))
            .selectExpr("id", "n", f"CASE WHEN n > 0 THEN {named}[array_position(p, array_max(p)) - 1] END AS lang",
                        "CASE WHEN n > 0 THEN array_max(p) END AS posterior",
                        f"CASE WHEN n > 0 THEN {named}[array_position(ll, array_max(ll)) - 1] END AS text_lang",
                        "array_max(ll) / n AS mean")
            .select("id", "lang", "posterior", "text_lang", F.col("n").alias("n_trigrams"),
                    (F.expr(f"coalesce(n > 0 AND posterior >= {MIN_POSTERIOR} AND mean >= {MIN_RATIO - math.log(BUCKETS)!r}D, false)")
                     & F.coalesce(wanted, F.lit(False))).alias("accepted")))


def judge(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: bool = False) -> DataFrame:
    """``identify``, but where no model could be fitted every text with letters
    is accepted: nothing can be held against it."""
    judged = identify(rows, model, markup)
    return judged if model[0] else judged.withColumn("accepted", F.col("n_trigrams") > 0)


def _code(declared: Column) -> Column:
    """The language part of a declared tag, if it looks like one."""
    code = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", 1))
    return F.when(code != "", code)


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence columns of ``documents``: the declared language is ``lang``, the
    host ``source``, its domain the source's name without a number."""
    return docs.select(F.col("doc_id").alias("id"), "text", _code(F.col("lang")).alias("declared"),
                       F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"),
                       F.regexp_replace("source", r"\d+$", "").alias("domain"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence columns of ``pages``: markup language, the address's last label,
    host and its last two labels."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    # tags of any length, each read once
    tags = F.array_join(F.regexp_extract_all("html", F.lit(r"(?i)<html\b[^>]*+"), F.lit(0)), ">")
    declared = F.regexp_extract(tags, r"(?i)\blang\s*+=\s*+[\"']?([A-Za-z-]+)", 1)
    return pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), _code(declared).alias("declared"),
                        F.element_at(F.split(host, r"\."), -1).alias("suffix"), host.alias("host"),
                        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"))


def model_of(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The text model, with ``documents.lang`` as labels."""
    return fit_text_model(docs.select(F.col("doc_id").alias("id"), "text", "lang"))


def language_digest(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_id, lang, posterior, text_lang, n_trigrams, accepted`` of
    every document (``page_id`` null) and every page (``doc_id`` null)."""
    model, none = model_of(docs), F.lit(None).cast("bigint")
    a = judge(document_rows(docs), model).withColumn("page_id", none).withColumnRenamed("id", "doc_id")
    b = judge(page_rows(pages), model, markup=True).withColumn("doc_id", none).withColumnRenamed("id", "page_id")
    return a.unionByName(b).select("doc_id", "page_id", "lang", "posterior", "text_lang", "n_trigrams", "accepted")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are rejected; rows kept are unchanged."""
    bad = (judge(document_rows(docs), model_of(docs)).filter("NOT accepted")
           .select(F.col("id").alias("_bad_id")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]), "left_anti")
