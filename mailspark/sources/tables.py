"""The star-schema and document tables read as messages, contacts, replies.

There are no mail tables among the inputs, so these adapters derive them.
``documents`` become messages; since their prose holds almost no mail
vocabulary, a phrase is added to each message, chosen by ``doc_id``. Orders
joined to their customer become contacts. The CASE texts are plain SQL that
the oracle queries reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import octets
from ..session import spread

# (subject, sender, lines added to the body); None keeps the document's own.
PHRASES = (
    ("You are a WINNER of the lottery", "promo@spam.com",
     ("Congratulations! Claim your free iphone prize",)),
    (None, None, ("Please verify your account today", "your account will be closed")),
    ("Re: Meeting schedule", None, ("See you tomorrow",)),
    ("Fwd: Price list", "anna@techcorp.example.com", ("Интересует: CRM система.",)),
    ("Запрос цены", "petr.orlov@zavod.example",
     ("Нужен каталог насосов", "пишите на petr.orlov@zavod.example,",
      "связь: +7 (901) 234-56-78")),
    (None, None, ("contacts: ivan.petrov@mail.example, IVAN.PETROV@mail.example,",
                  "+7 (903) 456-78-90, 8-800-555-1234, 8 (903) 456-78-90")),
    ("TODAY ONLY!!! VIAGRA AT HALF PRICE!!!", "pharmacy@outlet.example",
     ("CLICK HERE NOW TO ORDER A BOX!!!", "viagra without prescription $$$")),
    (None, "noreply@marketing.example.com", ("Join our program",)),
    ("Security notice", None,
     ("Microsoft support: urgent security update.",
      "Tap here to confirm your credentials immediately")),
    ("Investment", None,
     ("Dear customer, we are happy to inform you", "make money fast, guaranteed profit",)),
    (None, None, ("The Nigerian prince needs a wire transfer of a million dollars",)),
    ("Заявка", None, ("заявка - поставка оборудования,", "8 495 123 45 67 и 84951234567")),
    (None, None, ("visit http://tinyurl.example/abc", "please confirm your identity")),
    ("??? 1234567890", None, ("!!!!! ?????",)),
    (None, "robot7@shop.example.com", ("system error: repair now",)),
    ("Unusual activity", None,
     ("unusual sign-in, urgent action required", "system maintenance upgrade tonight")),
    ("RE: offer", None, ("Хочу получить смету на монтаж склада",)),
    ("A partnership with Google", None, ("see googleXcom and google-com",)),
    (None, None, ("write to test123@mail.example or temporary@box.example",)),
    ("Question about spare parts", "mary.jones@mill.example",
     ("Which bearings fit the old press?", "Call +7 (902) 345-67-89 or mary.jones@mill.example")),
    ("Account", "verify@securityalert.example",
     ("you must know: your account password expired, act now!!!",
      "click to update the credentials", "unusual access, security reason",
      "free money, no risk, sure return, guaranteed jackpot")),
    ("URGENT claim", "info@fund.example",
     ("Dear friend, please verify the account details, re-verify account information",
      "apple support urgent, http://bit.example, system alert fix, do immediately",
      "account may be suspended, click and confirm password, virus detected",
      "you won a prize, earn dollars, act immediately")),
)
PERIOD = 29   # residues beyond the phrases keep the document as it is


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(values: list[str | None]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
    return f"CASE doc_id % {PERIOD} {whens} END"


SUBJECT_CASE = _case([s and _quoted(s) for s, _, _ in PHRASES])
SENDER_CASE = _case([s and _quoted(s) for _, s, _ in PHRASES])
EXTRA_CASE = _case(["concat(" + ", ".join(f"chr(10), {_quoted(x)}" for x in extra) + ")"
                    for _, _, extra in PHRASES])
SENDER_DEFAULT = "concat(source, '@', lang, '.example.com')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def messages_from(docs: DataFrame) -> DataFrame:
    """``documents`` (batch or stream) to ``uid, subject, sender, body,
    size_bytes``."""
    subject = f"coalesce({SUBJECT_CASE}, substring(substring_index(text, chr(10), 1), 1, 80))"
    return docs.select(
        F.expr("cast(doc_id AS string)").alias("uid"),
        F.expr(subject).alias("subject"),
        F.expr(f"coalesce({SENDER_CASE}, {SENDER_DEFAULT})").alias("sender"),
        F.expr(f"concat(text, coalesce({EXTRA_CASE}, ''))").alias("body"),
    ).withColumn("size_bytes", octets(F.col("body")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return messages_from(spread(docs, "doc_id"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files (one file or a folder of them)."""
    base = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    # a glob, because a stream cannot take a single file as its base path
    return spark.readStream.schema(schema).parquet(f"{base}/{{{name}}}.parquet")


def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_stream(spark, sf_dir, "documents")
    return messages_from(docs.select("doc_id", "text", "lang", "source"))


def scored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a spam probability where ``labels`` has the document."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("uid"),
        F.expr("toxic * 0.85D + (1 - quality) * 0.05D").alias("ml_spam_probability"))
    return messages(spark, sf_dir).join(labels, "uid", "left")


# Shared CASE texts of the contact adapter.
CONTACT_SQL = {
    "full_name": "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 "
                 "THEN 'Не указано' ELSE c_name END",
    # one company holds a third of all records, in two spellings
    "company": "CASE WHEN o_orderkey % 6 = 0 THEN 'VEGA Trading' WHEN o_orderkey % 3 = 0 "
               "THEN 'Vega Trading' WHEN o_orderkey % 10 = 1 THEN '' WHEN o_orderkey % 10 = 2 "
               "THEN ' не найдено ' WHEN o_orderkey % 50 = 4 THEN 'Pineapple' "
               "WHEN o_orderkey % 50 = 5 THEN 'X' ELSE concat(n_name, ' ', c_mktsegment) END",
    "position": "CASE WHEN o_orderkey % 4 = 0 THEN 'Не указано' ELSE o_orderpriority END",
    "product": "CASE WHEN o_orderkey % 5 = 0 THEN 'Не найдено' WHEN o_orderkey % 5 = 1 THEN '' "
               "ELSE concat('Grade ', o_orderstatus) END",
    "e1": "CASE WHEN o_orderkey % 4 < 3 THEN concat(lower(replace(c_name, '#', '.')), '@', "
          "lower(n_name), '.example') END",
    "e2": "CASE WHEN o_orderkey % 8 = 1 THEN concat('sales@', lower(n_name), '.example') "
          "WHEN o_orderkey % 8 = 3 THEN ' ' END",
    "p1": "CASE WHEN o_orderkey % 3 <> 1 THEN concat('+7 9', lpad(cast(o_custkey AS string), "
          "9, '0')) END",
}


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uid, filename`` and the contact fields, one per order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    e1, e2, p1 = (F.expr(CONTACT_SQL[k]) for k in ("e1", "e2", "p1"))
    return joined.select(
        F.expr("cast(o_orderkey AS string)").alias("uid"),
        F.expr("concat(cast(o_orderkey AS string), '.json')").alias("filename"),
        *[F.expr(CONTACT_SQL[k]).alias(k) for k in ("full_name", "company", "position", "product")],
        F.array_compact(F.array(e1, e2)).alias("emails"),
        F.array_compact(F.array(p1)).alias("phones"))


def _json_list(arr: Column) -> Column:
    quoted = F.transform(arr, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))


def _pair(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{key}": '), value)


def _string(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _object(*pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uid, filename, reply``: one JSON reply per contact in eight shapes."""
    c = spread(contacts(spark, sf_dir), "uid")
    name, company, position, product = (
        _string(F.col(k)) for k in ("full_name", "company", "position", "product"))
    emails, phones = _json_list(F.col("emails")), _json_list(F.col("phones"))
    plain = _object(_pair("full_name", name), _pair("emails", emails), _pair("phones", phones),
                    _pair("company", company), _pair("position", position),
                    _pair("product", product))
    shapes = [
        plain,
        _string(F.replace(plain, F.lit('"'), F.lit('\\"'))),
        _object(_pair("full_name", name),
                _pair("emails", _string(F.array_join("emails", ", "))),
                _pair("phones", F.lit("84951234567")), _pair("company", company)),
        _object(_pair("full_name", F.lit("null")), _pair("emails", F.lit("null")),
                _pair("phones", F.lit("0")), _pair("company", F.lit("true")),
                _pair("position", F.lit("12")), _pair("product", product)),
        F.substring(plain, 1, 25),
        F.lit(""),
        F.concat(F.lit("["), emails, F.lit("]")),
        _object(_pair("Company", company), _pair("id", F.lit("7")),
                _pair("contact_Name", name), _pair("emails", emails), _pair("phones", phones)),
    ]
    n = F.col("uid").cast("bigint") % len(shapes)
    reply = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, shape in enumerate(shapes):
        reply = reply.when(n == i, shape)
    return c.select("uid", "filename", reply.alias("reply"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the messages as labelled entities: ``uid, pos, label, word,
    score``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select(F.col("doc_id").cast("string").alias("uid"),
                        F.posexplode(F.split("text", " ")).alias("pos", "word"))
    label = F.expr("CASE pos % 7 WHEN 0 THEN 'PER' WHEN 1 THEN 'org' WHEN 2 THEN 'Person' "
                   "WHEN 3 THEN 'ORGANIZATION' WHEN 4 THEN 'LOC' ELSE 'MISC' END")
    return words.select("uid", F.col("pos").cast("bigint").alias("pos"), label.alias("label"),
                        "word", F.expr("cast((pos * 7) % 10 AS double) / 10").alias("score"))


def raw_messages(parsed: DataFrame) -> DataFrame:
    """``uid, content``: messages as RFC 822 text with encoded subject and body."""
    def b64(c: Column) -> Column:
        return F.base64(F.encode(c, "UTF-8"))

    subject = F.when(F.col("subject") == "", F.lit("")).otherwise(
        F.concat(F.lit("=?utf-8?B?"), F.regexp_replace(b64(F.col("subject")), r"\s", ""),
                 F.lit("?=")))
    head = F.concat(F.lit("From: "), F.col("sender"), F.lit("\nTo: sales@example.com\nSubject: "),
                    subject, F.lit("\nMIME-Version: 1.0\n"))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\n"
                           "Content-Transfer-Encoding: base64\n\n"), b64(F.col("body")))
    return parsed.select("uid", F.concat(head, plain).alias("content"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uid, content``: pages as messages; every second one also has a plain part."""
    pages = table(spark, sf_dir, "pages")
    html = F.concat(F.lit("Content-Type: text/html; charset=utf-8\n"
                          "Content-Transfer-Encoding: base64\n\n"),
                    F.base64(F.encode("html", "UTF-8")))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\n\n"), F.col("url"))
    sep = "\n--part\n"
    both = F.concat(F.lit("Content-Type: multipart/alternative; boundary=part\n"), F.lit(sep),
                    html, F.lit(sep), plain, F.lit("\n--part--\n"))
    head = F.lit("From: web@example.com\nSubject: page\nMIME-Version: 1.0\n")
    return pages.select(
        F.col("page_id").cast("string").alias("uid"),
        F.concat(head, F.when(F.col("page_id") % 2 == 0, both).otherwise(html)).alias("content"))


def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages; later turns are replies."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("uid"),
        F.concat(F.when(F.col("turn") > 0, F.lit("RE: ")).otherwise(
            F.when(F.col("role") == "system", F.lit("Fwd: ")).otherwise(F.lit("Fw: "))),
            F.lit("thread "), F.col("conv_id").cast("string")).alias("subject"),
        F.concat("role", F.lit("@chat.example.com")).alias("sender"),
        F.col("text").alias("body"),
    ).withColumn("size_bytes", octets(F.col("body")))


def supplier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result JSON per supplier: ``uid, value``."""
    s = table(spark, sf_dir, "supplier")
    value = _object(_pair("full_name", F.lit('"Sales"')), _pair("emails", F.concat(
        F.lit('["info@s'), F.col("s_suppkey").cast("string"), F.lit('.example"]'))),
        _pair("phones", F.lit("[]")), _pair("company", _string(F.col("s_name"))),
        _pair("position", F.lit('""')), _pair("product", F.lit('""')))
    return s.select(F.col("s_suppkey").cast("string").alias("uid"), value.alias("value"))
