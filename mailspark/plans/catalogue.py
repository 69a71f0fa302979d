"""Every registered query: name -> (spark, sf_dir) -> DataFrame.

All queries read whole tables. Lists are joined into text and counts are
bigint so that results compare by value across engines.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import FilterConfig
from ..functions import extract as X
from ..functions import text as T
from ..operators import contacts as C
from ..operators import groups as G
from ..operators import risk as R
from ..operators import rule_table as RT
from ..operators import rules as B
from ..operators import stats as S
from ..operators import views as V
from ..session import shared_dir
from ..sources import eml, stores
from ..sources import tables as A
from ..sources.commits import compact
from ..streaming import jobs as J
from . import hooks as H
from . import ingest as I
from . import search as Q
from . import sketches as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHIPPED = FilterConfig.shipped()
# rules that read the contact or the size, with limits the tables can cross
CONTACT_CFG = SHIPPED.with_(
    min_company_length=2, min_email_count=1, min_contact_info=2,
    company_blacklist=("Google", "Apple", "NATION_3 "), company_whitelist=())
WHITELIST_CFG = FilterConfig(min_company_length=0, min_contact_info=0,
                             company_whitelist=("Vega", "BUILDING", "pineapple"))
SIZE_CFG = FilterConfig(min_company_length=0, min_contact_info=0, max_email_size_mb=0.004,
                        min_email_size_kb=0.5)
SEARCH_QUERY = "  Vega "


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: Column | str) -> Column:
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def contact_columns(df: DataFrame, *more) -> DataFrame:
    c = F.col("contact")
    return df.select("uid", c["full_name"].alias("full_name"), joined(c["emails"]).alias("emails"),
                     joined(c["phones"]).alias("phones"), c["company"].alias("company"),
                     c["position"].alias("position"), c["product"].alias("product"), *more)


# ---- extraction ----------------------------------------------------------


@query
def extract_emails(spark, sf):
    return A.messages(spark, sf).select("uid", joined(X.extract_emails(F.col("body"))).alias("emails"))


@query
def extract_phones(spark, sf):
    return A.messages(spark, sf).select("uid", joined(X.extract_phones(F.col("body"))).alias("phones"))


@query
def extract_product(spark, sf):
    return A.messages(spark, sf).select("uid", X.extract_product(F.col("body")).alias("product"))


@query
def rule_contacts(spark, sf):
    return contact_columns(C.rule_contact(A.messages(spark, sf)))


@query
def quality_score(spark, sf):
    scored = A.contacts(spark, sf).withColumn(
        "contact", X.contact(*[F.col(f) for f in X.CONTACT_FIELDS]))
    return scored.select("uid", big(X.quality_score(F.col("contact"))).alias("score"))


def second_records(messages: DataFrame) -> DataFrame:
    """A second extractor for pairing: the sender's name, domain and address;
    it delivers nothing for automatic senders."""
    sender = F.col("sender")
    company = F.when(F.col("size_bytes") % 2 == 0, F.lit("")).otherwise(
        F.substring_index(sender, "@", -1))
    record = X.contact(F.substring_index(sender, "@", 1), F.array(sender), X.empty_strings(),
                       company, F.lit("Не указано"), F.lit(""))
    return (messages.filter(~F.startswith(sender, F.lit("noreply")))
            .select("uid", record.alias("contact")))


@query
def best_contact(spark, sf):
    m = A.messages(spark, sf)
    return contact_columns(C.best_contact(C.rule_contact(m), second_records(m)),
                           big("score_a").alias("score_a"), big("score_b").alias("score_b"))


@query
def contact_fallback(spark, sf):
    m = A.messages(spark, sf)
    return contact_columns(C.with_fallback(C.rule_contact(m), second_records(m)))


@query
def pick_entities(spark, sf):
    return C.pick_entities(A.entities(spark, sf))


@query
def pick_entities_window(spark, sf):
    return C.ranked_entities(A.entities(spark, sf))


@query
def model_contacts(spark, sf):
    return contact_columns(C.model_contact(A.messages(spark, sf), A.entities(spark, sf)))


@query
def extractor_choice(spark, sf):
    m = A.messages(spark, sf)
    replies = A.replies(spark, sf)
    engines = [C.extract_contacts(m, e, replies=replies).withColumn("engine", F.lit(e))
               for e in ("rules", "table", "best")]
    rows = engines[0].unionByName(engines[1]).unionByName(engines[2])
    c = F.col("contact")
    return rows.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n"),
        big(F.sum(X.quality_score(c))).alias("total_score"),
        F.count(F.when(c["company"] != "", 1)).alias("n_company"),
        big(F.sum(F.size(c["emails"]))).alias("n_emails"))


@query
def prompts(spark, sf):
    p = X.format_prompt(F.col("body"))
    return (A.messages(spark, sf).withColumn("prompt", p)
            .select("uid", F.md5("prompt").alias("prompt_md5"), big(F.length("prompt")).alias("chars")))


@query
def reply_unwrap(spark, sf):
    return A.replies(spark, sf).select("uid", X.unwrap_json("reply").alias("json"))


@query
def normalize_contact(spark, sf):
    return contact_columns(C.reply_contact(A.replies(spark, sf)))


@query
def load_json_safe(spark, sf):
    return A.replies(spark, sf).select("uid", X.load_json_safe("reply").alias("json"))


# ---- text and messages ---------------------------------------------------


@query
def html_text(spark, sf):
    pages = A.table(spark, sf, "pages")
    return (pages.withColumn("t", T.html_to_text(F.col("html")))
            .select("page_id", F.md5("t").alias("text_md5"), big(F.length("t")).alias("chars"),
                    big(T.octets(F.col("t"))).alias("octets")))


@query
def message_text(spark, sf):
    """Pages as messages through the MIME stage, then their text."""
    parsed = eml.with_text(eml.parse_messages(A.raw_pages(spark, sf), keep_raw=False))
    return parsed.select("uid", "subject", "sender", F.md5("body").alias("body_md5"))


@query
def parse_messages(spark, sf):
    parsed = eml.parse_messages(A.raw_messages(A.messages(spark, sf)), keep_raw=False)
    return parsed.select("uid", "subject", "sender", F.md5("body").alias("body_md5"),
                         (F.col("size_bytes") > F.octet_length("body")).alias("raw_is_larger"))


@query
def decode_header(spark, sf):
    """Subjects encoded as header words and decoded again."""
    m = A.messages(spark, sf)
    word = F.concat(F.lit("=?utf-8?B?"),
                    F.regexp_replace(F.base64(F.encode("subject", "UTF-8")), r"\s", ""), F.lit("?="))
    header = F.concat(word, F.lit(" =?koi8-r?Q?=C3?= "), F.col("sender"))
    return m.select("uid", eml.decode_header(header).alias("header"))


@query
def fold_text(spark, sf):
    return A.contacts(spark, sf).select(
        "uid", T.fold(F.col("company")).alias("company"),
        joined(T.fold_array(F.col("emails"))).alias("emails"))


# ---- basic filter --------------------------------------------------------


@query
def subject_blacklist(spark, sf):
    return A.messages(spark, sf).select(
        "uid", B.subject_hit(F.col("subject"), SHIPPED.subject_blacklist).alias("hit"))


@query
def body_blacklist(spark, sf):
    return A.messages(spark, sf).select(
        "uid", B.body_hit(F.col("body"), SHIPPED.body_blacklist).alias("hit"))


@query
def sender_blacklist(spark, sf):
    return A.messages(spark, sf).select(
        "uid", B.sender_hit(F.col("sender"), SHIPPED.sender_blacklist).alias("hit"))


@query
def reply_filter(spark, sf):
    return A.thread_messages(spark, sf).select("uid", B.is_reply(F.col("subject")).alias("hit"))


@query
def forward_filter(spark, sf):
    return A.thread_messages(spark, sf).select("uid", B.is_forward(F.col("subject")).alias("hit"))


def _codes(df: DataFrame, cfg: FilterConfig, phase: str) -> DataFrame:
    return B.basic_verdict(df, cfg, phase).select("uid", "is_spam", "reason_code", "reason")


@query
def thread_verdict(spark, sf):
    cfg = FilterConfig(exclude_replies=True, exclude_forwards=True, min_contact_info=0)
    return _codes(A.thread_messages(spark, sf), cfg, "pre")


@query
def company_blacklist(spark, sf):
    return A.contacts(spark, sf).select(
        "uid", B.company_in(F.col("company"), SHIPPED.company_blacklist).alias("hit"))


@query
def company_whitelist(spark, sf):
    return _codes(A.contacts(spark, sf), WHITELIST_CFG, "post")


@query
def contact_rules(spark, sf):
    """Company blacklist, company length, e-mail count and contact count."""
    return _codes(A.contacts(spark, sf), CONTACT_CFG, "post")


@query
def size_limits(spark, sf):
    return _codes(A.messages(spark, sf), SIZE_CFG, "pre")


@query
def basic_verdict(spark, sf):
    return _codes(A.messages(spark, sf), SHIPPED, "pre")


@query
def should_process(spark, sf):
    return B.should_process(A.messages(spark, sf), SHIPPED).select(
        "uid", "should_process", "reason_code")


@query
def rule_hits(spark, sf):
    return B.rule_hits(A.messages(spark, sf), B.text_rules(SHIPPED)).select(
        "uid", big("rule_id").alias("rule_id"), "kind", "pattern")


@query
def rule_hit_verdict(spark, sf):
    return B.verdict_from_hits(B.rule_hits(A.messages(spark, sf), B.text_rules(SHIPPED)))


@query
def rule_usage(spark, sf):
    m = A.messages(spark, sf)
    rules = B.text_rules(SHIPPED)
    return B.rule_usage(B.rule_hits(m, rules), B.rules_frame(m, rules)).select(
        big("rule_id").alias("rule_id"), "kind", "pattern", "n_messages")


# a phrase of each document, its other characters as wildcards; each source's senders;
# and a subject rule per nation in which no letter is certain
TABLE_RULES = """SELECT min(doc_id) AS rule_id, 'body' AS kind, pattern FROM
 (SELECT doc_id, regexp_replace(substring(text, 41, 40), '[^A-Za-zÀ-ÖØ-Þà-öø-þ ]', '.'{0}) AS pattern FROM documents) p
 WHERE length(pattern) = 40 GROUP BY pattern
UNION ALL SELECT 1000000000 + min(doc_id), 'sender', concat(source, '@*') FROM documents GROUP BY source
UNION ALL SELECT 2000000000 + n_nationkey, 'subject', concat('[a-n][', n_nationkey, lower(substring(n_name, 1, 1)), ']') FROM nation"""


@query
def rule_table(spark, sf):
    docs, nation = A.table(spark, sf, "documents"), A.table(spark, sf, "nation")
    rules = spark.sql(TABLE_RULES.format("").replace("FROM documents", "FROM {docs}").replace("FROM nation", "FROM {nation}"),
                      docs=docs, nation=nation)
    return RT.rule_table_hits(A.messages(spark, sf), rules)


# ---- risk ----------------------------------------------------------------


def _hits(spark, sf, patterns, weight) -> DataFrame:
    m = A.messages(spark, sf)
    hits = R.count_hits("both", patterns)
    return (m.select("uid", F.concat("body", "subject").alias("both"))
            .select("uid", hits.alias("h"))
            .select("uid", big("h").alias("hits"), big(R.points(F.col("h"), weight)).alias("points")))


@query
def spam_points(spark, sf):
    return _hits(spark, sf, R.SPAM_PATTERNS, R.SPAM_WEIGHT)


@query
def phishing_points(spark, sf):
    return _hits(spark, sf, R.PHISHING_PATTERNS, R.PHISHING_WEIGHT)


@query
def formatting_points(spark, sf):
    return _hits(spark, sf, R.FORMATTING_PATTERNS, R.FORMATTING_WEIGHT)


@query
def email_points(spark, sf):
    m = A.messages(spark, sf).withColumn("emails", X.extract_emails(F.col("body")))
    return m.select("uid", R.suspicious_emails(F.col("emails")).alias("suspicious"))


@query
def text_quality(spark, sf):
    return A.messages(spark, sf).select(
        "uid", big(R.text_quality_points(F.col("body"))).alias("points"))


@query
def ml_points(spark, sf):
    scored = R.with_risk(A.scored_messages(spark, sf).drop("body", "subject"), SHIPPED)
    return scored.select("uid", F.round("ml_points", 6).alias("points"))


def _with_emails(m: DataFrame) -> DataFrame:
    return m.withColumn("emails", X.extract_emails(F.col("body")))


@query
def risk_score(spark, sf):
    """All components, with the extracted e-mails and the joined probability."""
    scored = R.with_risk(_with_emails(A.scored_messages(spark, sf)), SHIPPED, phase="post")
    return scored.select("uid", *[big(c).alias(c) for c in (
        "spam_points", "phishing_points", "formatting_points", "email_points", "text_points")],
        F.round("risk_score", 6).alias("risk_score"))


@query
def risk_factors(spark, sf):
    scored = R.with_risk(_with_emails(A.scored_messages(spark, sf)), SHIPPED, phase="post")
    return scored.select("uid", joined("risk_factors").alias("factors"))


@query
def advanced_verdict(spark, sf):
    return R.advanced_verdict(A.scored_messages(spark, sf), SHIPPED.with_(risk_threshold=40)).select(
        "uid", "is_spam", "reason_code", "reason")


@query
def risk_profile(spark, sf):
    return R.risk_profile(A.messages(spark, sf), SHIPPED).select(
        "uid", F.round("risk_score", 6).alias("risk_score"), "risk_level", "risk_label",
        "ml_spam_probability", joined("risk_factors").alias("factors"), "sender", "subject",
        "company", "recommendation")


# ---- dataflow ------------------------------------------------------------


def _label_ledger(spark, sf) -> DataFrame:
    return A.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("uid"))


def _user_ledger(spark, sf) -> DataFrame:
    return A.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"))


@query
def drop_processed(spark, sf):
    return I.drop_processed(A.messages(spark, sf), _label_ledger(spark, sf)).select(
        "uid", "sender", "size_bytes")


@query
def only_missing(spark, sf):
    return I.only_missing(A.messages(spark, sf), _user_ledger(spark, sf)).select(
        "uid", "sender", "size_bytes")


@query
def split_spam(spark, sf):
    accepted, rejected = I.split_spam(B.basic_verdict(A.messages(spark, sf), SHIPPED))
    return (accepted.select("uid", F.lit("accepted").alias("side"), F.lit(None).cast("string").alias("reason_code"))
            .unionByName(rejected.select("uid", F.lit("rejected").alias("side"), "reason_code")))


@query
def isolate_errors(spark, sf):
    """Every seventh message has a From header that cannot be parsed."""
    raw = A.raw_messages(A.messages(spark, sf))
    broken = F.regexp_replace("content", "\\AFrom: [^\n]*", "From: a@[")
    raw = raw.withColumn("content", F.when(F.col("uid").cast("bigint") % 7 == 0, broken).otherwise(F.col("content")))
    parsed = eml.parse_messages(raw, keep_raw=False)
    good, bad = eml.isolate_errors(parsed)
    sides = (good.select("sender", F.lit(1).alias("g"))
             .unionByName(bad.select(F.lit("").alias("sender"), F.lit(0).alias("g"))))
    return sides.groupBy("sender").agg(
        big(F.sum("g")).alias("n_good"), big(F.sum(1 - F.col("g"))).alias("n_bad"))


def _stored(spark, store: I.Stores) -> DataFrame:
    """What a job left behind, one row per uid."""
    rejected = stores.read_latest(spark, store.rejections).select(
        "uid", F.lit("rejected").alias("status"), "reason_code", F.lit("").alias("emails"),
        F.lit("").alias("product"))
    got = stores.read_results(spark, store.results).withColumn(
        "contact", X.normalize_contact("value"))
    accepted = got.select(
        "uid", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason_code"),
        joined(F.col("contact")["emails"]).alias("emails"),
        F.col("contact")["product"].alias("product"))
    return rejected.unionByName(accepted)


def _with_raw(m: DataFrame) -> DataFrame:
    return m.withColumn("raw", F.col("body"))


@query
def ingest_accepted(spark, sf):
    store = I.Stores(shared_dir(spark, "ingest"))
    stores.append_ledger(_label_ledger(spark, sf), store.ledger)
    I.ingest(_with_raw(A.messages(spark, sf)), store, SHIPPED)
    return _stored(spark, store)


@query
def ingest_replayed(spark, sf):
    """A batch with an odd label, run twice; then the same messages in another one."""
    store = I.Stores(shared_dir(spark, "replayed"))
    stores.append_ledger(_label_ledger(spark, sf), store.ledger)
    for label in ("nightly run-1 50%/ё=+", "nightly run-1 50%/ё=+", "late"):
        I.ingest(_with_raw(A.messages(spark, sf)), store, SHIPPED, batch=label)
    return _stored(spark, store)


@query
def reprocess_results(spark, sf):
    store = I.Stores(shared_dir(spark, "reprocess"))
    done = I.only_missing(_label_ledger(spark, sf), _user_ledger(spark, sf))
    stores.write_results(done.select("uid", F.lit('{"product": "kept"}').alias("value")), store.results)
    I.reprocess(_with_raw(A.messages(spark, sf)), store, SHIPPED, missing_only=True)
    return _stored(spark, store)


# ---- stores --------------------------------------------------------------


@query
def eml_roundtrip(spark, sf):
    """Conversation turns to message files, read back and parsed."""
    path = shared_dir(spark, "eml")
    raw = A.raw_messages(A.thread_messages(spark, sf))
    stores.write_files(raw.select(F.concat("uid", F.lit(".EML")).alias("name"),
                                  F.col("content").alias("text")), path)
    parsed = eml.with_text(eml.parse_messages(eml.read_eml(spark, path), keep_raw=False))
    return parsed.select("uid", "subject", "sender", F.md5("body").alias("body_md5"))


@query
def results_roundtrip(spark, sf):
    """Result files, one per supplier, read as the contact view."""
    path = shared_dir(spark, "results")
    results = A.supplier_results(spark, sf)
    stores.write_files(results.select(F.concat("uid", F.lit(".json")).alias("name"),
                                      F.col("value").alias("text")), path)
    view = V.scan_contacts(stores.read_result_files(spark, path))
    return view.select("filename", "full_name", "company", "position",
                       joined("emails").alias("emails"), "product", "parse_status")


@query
def results_upsert(spark, sf):
    """Supplier results, then new values for the suppliers that are customers'
    neighbours in number; the latest value per uid remains."""
    path = shared_dir(spark, "upsert")
    stores.write_results(A.supplier_results(spark, sf), path)
    newer = A.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("uid"), F.col("n_name").alias("value"))
    stores.write_results(newer, path)
    return stores.read_results(spark, path)


@query
def ledger_roundtrip(spark, sf):
    path = shared_dir(spark, "ledger")
    stores.append_ledger(_user_ledger(spark, sf), path)
    stores.append_ledger(_label_ledger(spark, sf), path)
    return stores.read_ledger(spark, path)


@query
def ledger_json(spark, sf):
    """Uids kept elsewhere as JSON lists, one file per quality; then committed
    ones, merged into folders by key."""
    path = shared_dir(spark, "ledger")
    lists = A.table(spark, sf, "labels").groupBy("quality").agg(F.to_json(F.collect_list(
        F.col("doc_id").cast("string"))).alias("text"))
    stores.write_files(lists.select(F.concat(F.col("quality").cast("string"), F.lit(".json")).alias("name"), "text"), path)
    stores.append_ledger(_user_ledger(spark, sf), path, "first")
    stores.append_ledger(_label_ledger(spark, sf), path, "second")      # all there already
    compact(spark, path, keys_only=True, everything=True)
    return stores.read_ledger(spark, path)


@query
def stored_contact(spark, sf):
    """One result of a store of several batches, merged into folders by key."""
    path = shared_dir(spark, "upsert")
    for rows in (A.supplier_results(spark, sf), A.table(spark, sf, "nation").select(
            F.col("n_nationkey").cast("string").alias("uid"), F.col("n_name").alias("value"))):
        stores.write_results(rows, path)
    compact(spark, path, everything=True)
    return stores.read_result(spark, path, "7")


@query
def indexed_search(spark, sf):
    """Replies, most of them merged and indexed; a later batch without postings replaces some."""
    path = shared_dir(spark, "indexed")
    replies = A.replies(spark, sf).select("uid", F.col("reply").alias("value"))
    even = F.col("uid").cast("bigint") % 2 == 0
    stores.write_results(replies.filter(even), path)
    stores.write_results(replies.filter(~even), path)
    compact(spark, path, everything=True)
    Q.index_results(spark, path)
    stores.write_results(A.supplier_results(spark, sf), path)
    return Q.search_results(spark, path, " 00000001").select("filename", "full_name", "company")


def _sketched_store(spark, sf) -> str:
    """Replies in two batches, merged and sketched, and a batch without sketches that replaces some by the same."""
    path = shared_dir(spark, "sketched")
    replies = A.replies(spark, sf).select("uid", F.col("reply").alias("value"))
    even = F.col("uid").cast("bigint") % 2 == 0
    stores.write_results(replies.filter(even), path, "even")
    stores.write_results(replies.filter(~even), path, "odd")
    compact(spark, path, everything=True)
    K.sketch_results(spark, path)
    stores.write_results(replies.filter(F.col("uid").cast("bigint") % 3 == 0), path)
    return path


@query
def sketched_stats(spark, sf):
    """The exact counts, and whether those of the sketches lie within their error of them."""
    path = _sketched_store(spark, sf)
    exact = S.corpus_stats(V.normalize_view(stores.read_results(spark, path), read=S.COUNTED))
    told = K.sketched_stats(spark, path).select(*[F.col(c).alias(f"_{c}") for c in exact.columns])
    # two one-row results side by side
    both = exact.withColumn("_k", F.lit(1)).join(told.withColumn("_k", F.lit(1)), "_k")
    return both.select(*[big(c).alias(c) for c in exact.columns],
                       *[(F.abs(F.col(f"_{c}") - F.col(c)) <= K.ERROR * F.col(c)).alias(f"{c}_near") for c in exact.columns])


@query
def frequent_products(spark, sf):
    """Products are few, so their counts are exact; rows of both versions count."""
    return K.frequent_values(spark, _sketched_store(spark, sf), "product", 10).select("value", big("n").alias("n"))


@query
def review_upsert(spark, sf):
    path = shared_dir(spark, "review")
    m = A.messages(spark, sf)
    stores.upsert(stores.review_rows(B.basic_verdict(m, SHIPPED)), path)
    stores.upsert(stores.review_rows(B.basic_verdict(m, SHIPPED.with_(subject_blacklist=()))), path)
    return stores.read_latest(spark, path).select("uid", "subject", "reason")


@query
def raw_archive(spark, sf):
    path = shared_dir(spark, "archive")
    judged = B.basic_verdict(_with_raw(A.messages(spark, sf)), SHIPPED)
    stores.upsert(stores.archive_rows(judged), path)
    return stores.read_latest(spark, path).select("uid", F.md5("raw").alias("raw_md5"))


# ---- contacts ------------------------------------------------------------


def _view(spark, sf) -> DataFrame:
    return A.contacts(spark, sf)


@query
def sufficient_contacts(spark, sf):
    return V.is_sufficient(_view(spark, sf)).select("filename", "company", "full_name")


@query
def normalize_view(spark, sf):
    view = V.normalize_view(A.replies(spark, sf).select("filename", F.col("reply").alias("value")))
    return view.select("filename", "full_name", "company", "position",
                       joined("emails").alias("emails"), joined("phones").alias("phones"),
                       "product", "raw_content", "parse_status")


@query
def scan_contacts(spark, sf):
    view = V.scan_contacts(A.replies(spark, sf).select("filename", F.col("reply").alias("value")))
    return view.groupBy("parse_status").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("company").alias("n_companies"))


@query
def search_contacts(spark, sf):
    return V.search(_view(spark, sf), SEARCH_QUERY).select("filename", "company")


@query
def search_company(spark, sf):
    return V.search_company(_view(spark, sf), "Building").select("filename", "company")


@query
def get_contact(spark, sf):
    return V.get_contact(_view(spark, sf), "77.json").select("filename", "company", "position")


@query
def group_contacts(spark, sf):
    return G.group_contacts(_view(spark, sf))


@query
def group_totals(spark, sf):
    return G.group_totals(G.group_contacts(_view(spark, sf))).select(
        "n_groups", big("n_files").alias("n_files"))


@query
def group_members(spark, sf):
    return G.group_members(_view(spark, sf)).select(
        "filename", "group_type", "group_key", "group_name", "n")


@query
def group_pages(spark, sf):
    """Pages put together again: members and first file per group."""
    pages = G.group_pages(_view(spark, sf), page_size=100)
    return pages.groupBy("group_type", "group_key").agg(
        F.min("group_name").alias("group_name"), big(F.max("n")).alias("n"),
        big(F.sum(F.size("files"))).alias("n_members"),
        F.min(F.get("files", F.lit(0))["filename"]).alias("first_file"))


@query
def list_groups(spark, sf):
    return G.list_groups(_view(spark, sf))


@query
def search_groups(spark, sf):
    return G.search_groups(_view(spark, sf), "nation_1")


@query
def export_rows(spark, sf):
    return V.export_contacts(_view(spark, sf), "grade f", localized=False)


@query
def crm_rows(spark, sf):
    rows = V.crm_rows(_view(spark, sf))
    return rows.select("name", "company", joined("emails").alias("emails"),
                       joined("phones").alias("phones"), "position")


@query
def sheet_rows(spark, sf):
    return V.sheet_rows(_view(spark, sf))


# ---- statistics ----------------------------------------------------------


def _rejections(spark, sf) -> DataFrame:
    """Rejected messages, stamped with the time of the user's last event."""
    ts = A.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("uid")).agg(
        F.max("ts").alias("ts"))
    judged = B.basic_verdict(A.messages(spark, sf), SHIPPED)
    return (judged.filter("is_spam").select("uid", "reason_code", "reason")
            .join(ts, "uid", "left")
            .withColumn("ts", F.coalesce("ts", F.lit("2020-01-01").cast("timestamp"))))


@query
def rejection_summary(spark, sf):
    return S.rejection_summary(_rejections(spark, sf)).select("reason_code", big("n").alias("n"))


@query
def last_rejections(spark, sf):
    return S.last_rejections(_rejections(spark, sf), 5).select(
        big("position").alias("position"), "uid", "reason")


@query
def corpus_stats(spark, sf):
    stats = S.corpus_stats(_view(spark, sf))
    return stats.select(*[big(c).alias(c) for c in stats.columns])


@query
def top_companies(spark, sf):
    return S.top_companies(_view(spark, sf), 10)


@query
def latest_stats(spark, sf):
    return S.latest_stats(_view(spark, sf))


@query
def validate_results(spark, sf):
    return S.validate_results(A.replies(spark, sf), value="reply")


@query
def evaluate_verdicts(spark, sf):
    truth = A.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("uid"), (F.col("toxic") == 1).alias("expected"))
    return S.evaluate_verdicts(B.basic_verdict(A.messages(spark, sf), SHIPPED), truth)


@query
def renumber(spark, sf):
    """All message uids: documents, spread out, and non-numeric thread uids."""
    docs = A.table(spark, sf, "documents").select(
        F.concat((F.col("doc_id") * 3).cast("string"), F.col("n_chars").cast("string")).alias("uid"))
    threads = A.thread_messages(spark, sf).select("uid")
    return S.renumber(docs.unionByName(threads))


# ---- streaming and user functions ---------------------------------------


@query
def stream_ingest(spark, sf):
    store = I.Stores(shared_dir(spark, "stream-ingest"))
    stream = _with_raw(A.message_stream(spark, sf))
    J.stream_ingest(stream, store, SHIPPED, shared_dir(spark, "ckpt")).awaitTermination()
    return _stored(spark, store)


@query
def stream_eml_ingest(spark, sf):
    """Conversation turns as arriving message files."""
    path, store = shared_dir(spark, "landing"), I.Stores(shared_dir(spark, "eml-ingest"))
    raw = A.raw_messages(A.thread_messages(spark, sf))
    stores.write_files(raw.select(F.concat("uid", F.lit(".eml")).alias("name"),
                                  F.col("content").alias("text")), path)
    J.stream_ingest(eml.stream_eml(spark, path), store, SHIPPED,
                    shared_dir(spark, "ckpt")).awaitTermination()
    return _stored(spark, store).select("uid", "status", "reason_code", "emails")


@query
def stream_dedupe(spark, sf):
    """Remembered uids expire; all arrivals lie in one batch, within the delay."""
    arrivals = A.table_stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"),
                                                         F.col("ts").cast("timestamp").alias("ts"))
    out = shared_dir(spark, "dedupe")
    J.run_to_table(J.stream_dedupe(arrivals, "ts"), out, shared_dir(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(out).select("uid")


@query
def stream_rejection_counts(spark, sf):
    counts = J.stream_rejection_counts(A.message_stream(spark, sf), SHIPPED)
    out = shared_dir(spark, "counts")
    J.run_to_table(counts, out, shared_dir(spark, "ckpt"), mode="update").awaitTermination()
    stored = spark.read.option("basePath", out).parquet(out)
    return stored.groupBy("reason_code").agg(F.max_by("n", "_seq").alias("n"))


def shout(text: str, config) -> str:
    """A stand-in extractor: the longest line as the product."""
    line = max(text.split("\n"), key=len)
    return '{"full_name": "", "emails": [], "phones": "", "company": "%s", "product": "%d"}' % (
        config["company"], len(line))


@query
def extractor_hook(spark, sf):
    reply = H.with_extractor(A.messages(spark, sf), shout, {"company": "Acme"})
    return C.flat(C.reply_contact(reply)).select("uid", "company", "product")


def make_scorer():
    return lambda text: min(len(text), 400) / 400.0


@query
def scorer_hook(spark, sf):
    scored = H.with_scorer(A.messages(spark, sf), make_scorer)
    return scored.select("uid", F.round("ml_spam_probability", 6).alias("probability"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Messages judged and extracted, counted per verdict."""
    judged = R.verdict(A.messages(spark, sf), SHIPPED)
    contact = X.rule_record(F.col("body"))
    return (judged.withColumn("contact", contact)
            .withColumn("reason_code", F.coalesce("reason_code", F.lit("ACCEPTED")))
            .groupBy("reason_code").agg(
                F.count(F.lit(1)).alias("n"),
                big(F.sum(F.size("contact.emails"))).alias("n_emails"),
                big(F.sum(F.size("contact.phones"))).alias("n_phones"),
                F.count(F.when(F.col("contact.product") != "", 1)).alias("n_products")))


QUERIES["judged_contacts"] = flagship
