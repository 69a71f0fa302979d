"""Extraction from text: e-mails, phones, product; reply handling; scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .sqltext import case, let as sql_let, quote
from .text import WHITESPACE, count_nonblank, is_default, java_regex, let, lines, utrim

# Extraction patterns.
EMAIL_PATTERN = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_PATTERN = r"(?:(?:\+7|8)\s*)?(?:\(?\d{3}\)?\s*)?\d{3}[\s-]?\d{2}[\s-]?\d{2}"
# Words that introduce a product request.
PRODUCT_TRIGGERS = ("интересует", "нужен", "нужно", "хочу", "заявка", "запрос", "по продукту")

# Names and order of the contact fields.
CONTACT_FIELDS = ("full_name", "emails", "phones", "company", "position", "product")
CONTACT_TYPE = ("struct<full_name:string,emails:array<string>,phones:array<string>,"
                "company:string,position:string,product:string>")

# The same matches, entering each run of local-part characters once: at its
# start or where the match before ended, then at its first word boundary.
_LOCAL = "[A-Z0-9._%+-]"
_EMAIL_SEARCH = (rf"(?:\G|(?<!{_LOCAL}))(?:(?!\b){_LOCAL})*+(\b{_LOCAL}++@[A-Z0-9.-]+\.[A-Z]{{2,}}\b)")

_MIN_PHONE_DIGITS = 10
_MAX_PRODUCT_LINE = 200
_MAX_PRODUCT = 120


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def dedupe_by(arr: Column, key) -> Column:
    """Keep the first element for each key, in order, in O(n log n).

    Sort by (key, position), keep the head of each run of equal keys, then
    restore the original order.
    """
    def heads(run: Column) -> Column:
        first = F.filter(run, lambda e, i: (i == 0) | (F.get(run, i - 1)["k"] != e["k"]))
        back = F.array_sort(F.transform(
            first, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))
        return F.transform(back, lambda e: e["v"])

    def dedupe(a: Column) -> Column:
        keyed = F.transform(a, lambda v, i: F.struct(
            key(v).alias("k"), i.alias("i"), v.alias("v")))
        return F.when(F.size(a) < 2, a).otherwise(let(F.array_sort(keyed), heads))

    return let(arr, dedupe)


def extract_emails(c: Column) -> Column:
    """All e-mail addresses, first spelling per lower-cased address."""
    found = F.regexp_extract_all(c, F.lit(java_regex(_EMAIL_SEARCH)), F.lit(1))
    # the pattern needs an @: most texts skip the regex
    return F.when(F.contains(c, F.lit("@")), dedupe_by(found, F.lower)) \
            .otherwise(empty_strings())


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{Nd}+", "")


def extract_phones(c: Column) -> Column:
    """Phone candidates with at least ten digits, first spelling per digit string."""
    found = F.regexp_extract_all(c, F.lit(java_regex(PHONE_PATTERN)), F.lit(0))
    tidy = F.transform(found, lambda p: F.regexp_replace(utrim(p), java_regex(r"\s+"), " "))
    long_enough = F.filter(tidy, lambda p: F.length(_digits(p)) >= _MIN_PHONE_DIGITS)
    # every candidate ends in two digits
    return F.when(c.rlike(r"\p{Nd}\p{Nd}"), dedupe_by(long_enough, _digits)) \
            .otherwise(empty_strings())


def extract_product(c: Column) -> Column:
    """Tail of the first line that asks for a product."""
    triggers = "|".join(PRODUCT_TRIGGERS)
    leading = java_regex(rf"\A(?:{triggers})\s*[:\-]?\s*")
    asked = F.filter(F.transform(lines(c), utrim),
                     lambda ln: (F.length(ln) <= _MAX_PRODUCT_LINE) & F.lower(ln).rlike(triggers))
    tails = F.transform(asked, lambda ln: F.btrim(
        F.regexp_replace(F.lower(ln), leading, ""), F.lit(" .;,-")))
    hits = F.filter(tails, lambda t: F.length(t) >= 3)
    product = F.coalesce(F.substring(F.get(hits, F.lit(0)), 1, _MAX_PRODUCT), F.lit(""))
    words = F.array(*[F.lit(t) for t in PRODUCT_TRIGGERS])
    any_word = let(F.lower(c), lambda t: F.exists(words, lambda w: F.contains(t, w)))
    return F.when(any_word, product).otherwise(F.lit(""))


def contact(full_name: Column, emails: Column, phones: Column, company: Column,
            position: Column, product: Column) -> Column:
    parts = (full_name, emails, phones, company, position, product)
    return F.struct(*[p.alias(n) for n, p in zip(CONTACT_FIELDS, parts)])


def rule_record(body: Column) -> Column:
    """Contact found by rules alone: e-mails, phones and product."""
    body = F.coalesce(body, F.lit(""))
    blank = F.lit("")
    return contact(blank, extract_emails(body), extract_phones(body), blank, blank,
                   extract_product(body))


def blank_record() -> Column:
    blank = F.lit("")
    return contact(blank, empty_strings(), empty_strings(), blank, blank, blank)


def quality_score(record: Column) -> Column:
    """2 points per filled text field, 1 per e-mail and phone; null scores 0."""
    texts = sum((F.when(is_default(record[f]), 0).otherwise(2)
                 for f in ("full_name", "company", "position", "product")), F.lit(0))
    lists = count_nonblank(record["emails"]) + count_nonblank(record["phones"])
    return F.when(record.isNull(), 0).otherwise(texts + lists).cast("int")


def better(a: Column, b: Column) -> Column:
    """``b`` only when it scores strictly higher than ``a``."""
    return F.when(quality_score(b) > quality_score(a), b).otherwise(a)


# --------------------------------------------------------------------------
# model replies

# Fixed value: the instruction sent to a model, before and after the text.
PROMPT_HEAD = (
    "Проанализируй текст письма и выдели персональные данные, присылай даные в кодровке "
    "UTF-8, начни поддерживать русский язык, найди в письме продукт которым "
    "интересовались. Ответ строго в JSON:\n"
    "    {\n"
    "    \"full_name\": \"\",\n"
    "    \"emails\": [],\n"
    "    \"phones\": [],\n"
    "    \"company\": \"\",\n"
    "    \"position\": \"\",\n"
    "    \"product\": \"\"\n"
    "    }\n"
    "\n"
    "    Текст письма:\n"
    "    "
)
PROMPT_TAIL = "\n    "


def format_prompt(c: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), c, F.lit(PROMPT_TAIL))


# Kind of JSON text by its first character.
_FIRST = {"{": "object", "[": "array", '"': "string", "t": "bool", "f": "bool", "n": "null",
          **{c: "number" for c in "-0123456789"}}
_KIND_MAP = "map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in _FIRST.items()) + ")"
NO_STRINGS = "cast(array() AS array<string>)"
_STRIP = quote(WHITESPACE)


def trim_sql(x: str) -> str:
    return f"trim(BOTH {_STRIP} FROM {x})"


def kind_sql(json: str) -> str:
    """Kind of valid, trimmed JSON text: object, array, string, bool, null or
    number; null for null or empty text."""
    return f"try_element_at({_KIND_MAP}, left({json}, 1))"


def field_sql(v: str, name: str) -> str:
    return f"try_variant_get({v}, '$.{name}', 'variant')"


def text_sql(v: str, null_text: str = "None") -> str:
    """A variant as display text: strings bare, true/false as True/False, null
    as ``null_text``, numbers as written, nested values as JSON."""
    kind = kind_sql("_j")
    return sql_let("_j", f"to_json({v})", case(
        (f"{kind} = 'string'", f"cast({v} AS string)"), (f"{kind} = 'null'", quote(null_text)),
        (f"{kind} = 'bool'", "initcap(_j)"), default="_j"))


def truthy_sql(v: str) -> str:
    """False for null, false, zero, empty text, empty array and empty object."""
    return sql_let("_j", f"to_json({v})", case(
        ("_j IS NULL OR _j IN ('null', 'false', '\"\"', '[]', '{}')", "false"),
        (f"{kind_sql('_j')} = 'number'", f"cast({v} AS double) != 0"), default="true"))


def items_sql(v: str, null_text: str = "None") -> str:
    """Elements of a variant array as display text."""
    return f"transform(cast({v} AS array<variant>), _x -> {text_sql('_x', null_text)})"


def unwrap_sql(text: str) -> str:
    """JSON text of a reply, decoding JSON-in-a-string once; ``{}`` on failure."""
    def settle(t: str, inner: str) -> str:
        return sql_let(f"{t}v", f"try_parse_json(nullif({t}, ''))", case(
            (f"{t}v IS NULL", "'{}'"), (f"{kind_sql(t)} = 'string'", inner), default=t))

    second = sql_let("_b", trim_sql("cast(_av AS string)"), settle("_b", "'{}'"))
    return sql_let("_a", trim_sql(f"coalesce({text}, '')"), settle("_a", second))


def unwrap_json(column: str) -> Column:
    return F.expr(unwrap_sql(column))


def load_json_safe(column: str) -> Column:
    """The text when it is a JSON object, else ``{}``."""
    return F.expr(case((f"{kind_sql(trim_sql(column))} = 'object' AND "
                        f"try_parse_json({column}) IS NOT NULL", column), default="'{}'"))


def _strings_sql(f: str, null_text: str) -> str:
    kind = sql_let("_k", kind_sql(f"to_json({f})"), case(
        ("_k = 'string'", f"transform(split(cast({f} AS string), ','), _e -> {trim_sql('_e')})"),
        ("_k = 'array'", items_sql(f, null_text)),
        (truthy_sql(f), f"array({text_sql(f, null_text)})"), default=NO_STRINGS))
    return f"filter(coalesce({kind}, {NO_STRINGS}), _e -> {trim_sql('_e')} != '')"


def normalize_sql(text: str, null_text: str = "None") -> str:
    """Contact struct from reply JSON: six fields, strings and string lists."""
    parts = []
    for name in CONTACT_FIELDS:
        value = (_strings_sql("_f", null_text) if name in ("emails", "phones")
                 else f"coalesce({text_sql('_f', null_text)}, '')")
        parts.append(f"{quote(name)}, {sql_let('_f', field_sql('_v', name), value)}")
    record = f"named_struct({', '.join(parts)})"
    given = case((f"{kind_sql(trim_sql('_t'))} = 'object'", "try_parse_json(_t)"))
    return sql_let("_t", text, sql_let("_v", f"coalesce({given}, parse_json('{{}}'))", record))


def normalize_contact(column: str, null_text: str = "None") -> Column:
    """Contact record from the JSON text in ``column``.

    ``null_text`` is the text of a JSON null; pass ``""`` to treat it as absent.
    """
    return F.expr(normalize_sql(column, null_text))


def parse_reply(column: str, null_text: str = "None") -> Column:
    """Raw model reply to contact record."""
    return F.expr(normalize_sql(unwrap_sql(column), null_text))


def contact_json(record: Column) -> Column:
    """Contact record as the JSON text that the results store holds."""
    return F.to_json(record)
