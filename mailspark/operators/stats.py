"""Summaries, rankings, validation and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import FilterConfig
from ..functions.extract import field_sql, kind_sql
from ..functions.sqltext import case, let as sql_let, string_array
from ..functions.text import utrim
from ..session import materialize, shared_dir
from .rules import compile_patterns

# Keys every stored result must have.
REQUIRED_KEYS = ("full_name", "emails", "phones", "company", "position", "product")

# Fields of a contact whose values are counted.
COUNTED = ("company", "product", "emails", "phones")


def rejection_summary(rejections: DataFrame) -> DataFrame:
    """Rejections per reason code, plus a ``TOTAL`` row. Partial counts only."""
    return (rejections.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))
            .rollup("reason_code").agg(F.sum("n").alias("n"))
            .select(F.coalesce("reason_code", F.lit("TOTAL")).alias("reason_code"), "n"))


def last_rejections(rejections: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` rejections in order of arrival, numbered from 1.

    The limit comes first (top-k per task, then ``n`` rows), so the numbering
    window only ever sees ``n`` rows.
    """
    latest = rejections.orderBy(F.col("ts").desc(), F.col("uid").desc()).limit(n)
    return latest.withColumn("position", F.row_number().over(Window.orderBy("ts", "uid")).cast("int"))


def filter_stats(df: DataFrame, cfg: FilterConfig) -> DataFrame:
    """Rule counts per list and the scalar settings, as one row in the session
    of ``df``."""
    row = {
        "enabled": cfg.enabled,
        "subject_blacklist_items": len(compile_patterns(cfg.subject_blacklist)),
        "body_blacklist_items": len(compile_patterns(cfg.body_blacklist)),
        "sender_blacklist_items": len(cfg.sender_blacklist),
        "company_blacklist_items": len(cfg.company_blacklist),
        "company_whitelist_items": len(cfg.company_whitelist),
        "min_company_length": cfg.min_company_length,
        "min_email_count": cfg.min_email_count,
        "min_contact_info": cfg.min_contact_info,
        "exclude_replies": cfg.exclude_replies,
        "exclude_forwards": cfg.exclude_forwards,
        "max_email_size_mb": float(cfg.max_email_size_mb),
        "min_email_size_kb": float(cfg.min_email_size_kb),
        "require_review_before_delete": cfg.require_review_before_delete,
    }
    kinds = {bool: "boolean", int: "int", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())
    return df.sparkSession.createDataFrame([tuple(row.values())], schema)


def _given(c: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.col(c))


def tagged_values(record: Column) -> Column:
    """Array of ``kind, value``: ``record``, and the company, product, e-mails
    and phones of a contact that are given."""
    def tag(kind: str, v: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"))

    return F.concat(
        F.array(tag("record", record)),
        F.filter(F.array(tag("company", _given("company")), tag("product", _given("product"))),
                 lambda t: t["value"].isNotNull()),
        F.transform("emails", lambda e: tag("email", e)),
        F.transform("phones", lambda p: tag("phone", p)))


def corpus_stats(contacts: DataFrame, approximate: bool = False) -> DataFrame:
    """Record count and distinct companies, e-mails, phones and products.

    Exact form: all values go through one (kind, value) aggregation, so there
    is a single shuffle of distinct values instead of one expanded copy of
    the input per distinct count. ``approximate`` trades that for sketches.
    """
    if approximate:
        lists = contacts.select(
            _given("company").alias("company"), _given("product").alias("product"),
            F.explode_outer(F.concat(
                F.transform("emails", lambda x: F.struct(F.lit("e").alias("k"), x.alias("v"))),
                F.transform("phones", lambda x: F.struct(F.lit("p").alias("k"), x.alias("v"))),
                F.array(F.struct(F.lit("r").alias("k"), F.lit("").alias("v"))))).alias("x"))

        def of(kind: str) -> Column:
            return F.approx_count_distinct(F.when(F.col("x.k") == kind, F.col("x.v")))

        return lists.agg(
            F.sum((F.col("x.k") == "r").cast("bigint")).alias("n_records"),
            F.approx_count_distinct("company").alias("n_companies"),
            of("e").alias("n_emails"), of("p").alias("n_phones"),
            F.approx_count_distinct("product").alias("n_products"))

    distinct = (contacts.select(F.explode(tagged_values(F.lit(""))).alias("t")).select("t.*")
                .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))

    def values(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, 1))

    return distinct.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "record", F.col("n"))), F.lit(0)).alias("n_records"),
        values("company").alias("n_companies"), values("email").alias("n_emails"),
        values("phone").alias("n_phones"), values("product").alias("n_products"))


def top_companies(contacts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent companies; ties in name order."""
    return (contacts.filter(F.coalesce("company", F.lit("")) != "")
            .groupBy("company").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "company").limit(k))


def latest_stats(contacts: DataFrame, order_by: str = "filename", window: int = 10,
                 names: int = 5) -> DataFrame:
    """Record count; over the first ``window`` records, distinct companies and
    the first ``names`` names.

    The sample is a top-k of ``window`` rows; only those are gathered.
    """
    total = contacts.agg(F.count(F.lit(1)).alias("n_records"))
    head = contacts.orderBy(order_by).limit(window)
    name = F.struct(F.col(order_by).alias("o"), F.coalesce("full_name", F.lit("")).alias("v"))
    sample = head.agg(
        F.count_distinct(F.coalesce("company", F.lit(""))).alias("n_companies"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(name)), 1, names),
                                 lambda s: s["v"]), ", ").alias("latest_names"))
    # two one-row results side by side
    return total.withColumn("_k", F.lit(1)).join(
        sample.withColumn("_k", F.lit(1)), "_k").drop("_k")


def validate_results(results: DataFrame, value: str = "value",
                     filename: str = "filename") -> DataFrame:
    """One row per problem: ``filename, issue, detail``.

    Issues: ``INVALID_JSON``, ``NOT_OBJECT``, ``MISSING_KEYS``,
    ``EMAILS_NOT_LIST``, ``PHONES_NOT_LIST``. A missing list counts as both
    missing and not a list.
    """
    staged = (results.select(F.col(filename).alias("filename"),
                             utrim(F.coalesce(F.col(value), F.lit(""))).alias("_text"))
              .withColumn("_v", F.expr("try_parse_json(nullif(_text, ''))")))
    kind = case(("_v IS NULL", "NULL"), default=kind_sql("_text"))
    required = string_array(REQUIRED_KEYS)
    missing = f"array_except({required}, json_object_keys(_text))"

    def kind_of(name: str) -> str:
        return f"coalesce({kind_sql('to_json(' + field_sql('_v', name) + ')')}, 'missing')"

    def issue(cond: str, code: str, detail: str) -> str:
        return f"CASE WHEN {cond} THEN named_struct('issue', '{code}', 'detail', {detail}) END"

    issues = sql_let("_k", kind, "array_compact(array(" + ", ".join((
        issue("_k IS NULL", "INVALID_JSON", "''"),
        issue("_k != 'object'", "NOT_OBJECT", "_k"),
        issue(f"_k = 'object' AND size({missing}) > 0", "MISSING_KEYS",
              f"array_join({missing}, ',')"),
        issue(f"_k = 'object' AND {kind_of('emails')} != 'array'", "EMAILS_NOT_LIST",
              kind_of("emails")),
        issue(f"_k = 'object' AND {kind_of('phones')} != 'array'", "PHONES_NOT_LIST",
              kind_of("phones")))) + "))")
    return (staged.select("filename", F.explode(F.expr(issues)).alias("i"))
            .select("filename", "i.issue", "i.detail"))


def evaluate_verdicts(predicted: DataFrame, truth: DataFrame, pred: str = "is_spam",
                      label: str = "expected") -> DataFrame:
    """Verdicts against labels: counts, confusion cells, accuracy and detection
    rate. One join on uid, then one row."""
    joined = predicted.select("uid", F.col(pred).alias("p")).join(
        truth.select("uid", F.col(label).alias("t")), "uid")

    def cells(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    p, t = F.col("p"), F.col("t")
    counts = joined.agg(
        F.count(F.lit(1)).alias("n"), cells(p == t).alias("n_correct"),
        cells(p & t).alias("true_positive"), cells(p & ~t).alias("false_positive"),
        cells(~p & t).alias("false_negative"), cells(~p & ~t).alias("true_negative"))

    def rate(a: str, b: Column) -> Column:
        return F.when(b > 0, F.round(F.col(a) / b, 6))

    return counts.withColumns({
        "accuracy": rate("n_correct", F.col("n")),
        "detection_rate": rate("true_positive", F.col("true_positive") + F.col("false_negative")),
    })


def renumber(uids: DataFrame, uid: str = "uid", tasks: int | None = None) -> DataFrame:
    """Map all-digit uids, in numeric order, to 1..n: ``uid, new_uid``.

    Ties (``7`` and ``007``) follow the text. Uids are range partitioned by
    that order, so no task sorts all of them, whatever their number, and the
    sorted copy is written once to the shared folder (when this is called): two
    readers of a range partitioning need not see the same bounds. A task numbers
    its own rows; the sizes of the partitions before it, one row each, are
    added. ``tasks`` sets the number of ranges. Every export of a message uses
    this one mapping, so its files stay paired.
    """
    # numeric order of digit strings of any length: without leading zeros, by length, then by text
    digits = (uids.select(F.col(uid).cast("string").alias("uid")).filter(F.col("uid").rlike(r"\A[0-9]+\z")).distinct()
              .withColumn("_t", F.ltrim(F.col("uid"), F.lit("0"))))
    order = [F.length("_t"), F.col("_t"), F.col("uid")]
    laid = materialize(digits.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order)
                       .select("uid", F.monotonically_increasing_id().alias("_at"))
                       .withColumn("_part", F.shiftright("_at", 33)), shared_dir(uids.sparkSession, "renumber"))
    # one row per partition: a window over them is small
    before = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).select(
        F.col("_part"), (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return laid.join(before, "_part").select("uid", (inside + F.col("_before") + 1).cast("bigint").alias("new_uid"))
