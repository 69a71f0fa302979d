"""Stored results as a searchable contact view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.extract import (NO_STRINGS, field_sql, items_sql, kind_sql, text_sql, trim_sql,
                                 truthy_sql)
from ..functions.sqltext import case, let as sql_let, quote
from ..functions.text import compute_once, fold, is_default, nonblank, utrim

# Placeholders of the view.
NOT_GIVEN, NOT_FOUND = "Не указано", "Не найдено"
BAD_JSON_COMPANY, BAD_FILE_COMPANY = "Не удалось распарсить", "Не удалось прочитать"
BAD_POSITION = "Проверьте формат файла"
BAD_JSON_NAME, BAD_FILE_NAME = "Не JSON: ", "Ошибка: "
# Accepted spellings of the text fields.
ALIASES = {
    "full_name": ("full_name", "Full_name", "fullName"),
    "company": ("company", "Company"),
    "position": ("position", "Position"),
    "product": ("product", "Product"),
}
_DEFAULTS = {"full_name": NOT_GIVEN, "company": NOT_GIVEN,
             "position": NOT_GIVEN, "product": NOT_FOUND}
# Names of non-object results in an error text.
_TYPE_NAMES = {"array": "list", "string": "str", "bool": "bool", "null": "NoneType"}

VIEW_FIELDS = ("full_name", "company", "position", "emails", "phones", "product", "raw_content")


def _list_sql(name: str) -> str:
    """List as is; a single truthy value becomes a one-element list."""
    built = case((f"{kind_sql('to_json(_f)')} = 'array'", items_sql("_f")),
                 (truthy_sql("_f"), f"array({text_sql('_f')})"), default=NO_STRINGS)
    return f"coalesce({sql_let('_f', field_sql('_v', name), built)}, {NO_STRINGS})"


def _text_field_sql(field: str) -> str:
    """First truthy spelling of a field, else its default."""
    tries = [sql_let("_f", field_sql("_v", alias), case((truthy_sql("_f"), text_sql("_f"))))
             for alias in ALIASES[field]]
    return f"coalesce({', '.join(tries)}, {quote(_DEFAULTS[field])})"


def _name_sql() -> str:
    """The full name; when absent, the value of the first key, in document
    order, that contains ``name`` and holds text or a list."""
    usable = ("filter(map_entries(from_json(_text, 'map<string,variant>')), _e -> "
              f"contains(lower(_e.key), 'name') AND {kind_sql('to_json(_e.value)')} "
              "IN ('string', 'array'))")
    other = sql_let("_w", f"get({usable}, 0).value", text_sql("_w"))
    return sql_let("_n", _text_field_sql("full_name"), case(
        (f"_n = {quote(NOT_GIVEN)}", f"coalesce({other}, _n)"), default="_n"))


def normalize_view(df: DataFrame, value: str = "value", filename: str = "filename",
                   read: tuple[str, ...] = VIEW_FIELDS) -> DataFrame:
    """One view row per stored result file, with the fields that will be ``read``.

    Accepts objects, objects encoded once more as a JSON string, other key
    spellings, and scalars where lists are expected. What cannot be read
    becomes a placeholder row; ``parse_status`` tells them apart
    (``ok``, ``not_json``, ``not_object``).
    """
    keep = [c for c in df.columns if c not in (value, *VIEW_FIELDS)]
    staged = df.select(*keep, F.col(filename).alias("_name"),
                       utrim(F.coalesce(F.col(value), F.lit(""))).alias("_content"))
    # a JSON string is parsed once more; if that fails it has no fields
    is_string = f"{kind_sql('_content')} = 'string'"
    inner = case((f"NOT {is_string}", "_o"), default="try_parse_json(nullif(_t, ''))")
    kind = case(("_o IS NULL", "NULL"), ("_i IS NULL", "'object'"),
                default=kind_sql(trim_sql("_t")))
    parsed = sql_let("_o", "try_parse_json(nullif(_content, ''))", sql_let(
        "_t", case((is_string, "cast(_o AS string)"), default="_content"), sql_let(
            "_i", inner, "named_struct('_text', _t, '_v', coalesce(_i, parse_json('{}')), "
                         f"'_kind', {kind})")))
    status = case(("_kind IS NULL", "'not_json'"), ("_kind = 'object'", "'ok'"),
                  default="'not_object'")
    staged = (compute_once(staged, {"_p": F.expr(parsed)})
              .select(*keep, "_name", "_content", "_p.*")
              .withColumn("parse_status", F.expr(status)))

    def by_status(ok: str, bad_json: str, bad_object: str) -> Column:
        return F.expr(case(("parse_status = 'ok'", ok), ("parse_status = 'not_json'", bad_json),
                           default=bad_object))

    number = "CASE WHEN _text RLIKE '[.eE]' THEN 'float' ELSE 'int' END"
    type_name = case(*[(f"_kind = '{k}'", quote(label)) for k, label in _TYPE_NAMES.items()],
                     default=number)
    error = f"concat({quote(chr(39))}, {type_name}, {quote(chr(39))}, ' object has no attribute ', \"'get'\")"
    fields = {
        "full_name": by_status(_name_sql(), f"concat({quote(BAD_JSON_NAME)}, _name)",
                               f"concat({quote(BAD_FILE_NAME)}, _name)"),
        "company": by_status(_text_field_sql("company"), quote(BAD_JSON_COMPANY),
                             quote(BAD_FILE_COMPANY)),
        "position": by_status(_text_field_sql("position"), quote(BAD_POSITION),
                              quote(BAD_POSITION)),
        "emails": by_status(_list_sql("emails"), NO_STRINGS, NO_STRINGS),
        "phones": by_status(_list_sql("phones"), NO_STRINGS, NO_STRINGS),
        "product": by_status(_text_field_sql("product"), "''", quote(NOT_FOUND)),
        "raw_content": by_status("_content", "_content", error),
    }
    # what nobody reads is left out here: the optimizer prunes no part of a generated row
    fields = {name: fields[name] for name in VIEW_FIELDS if name in read}
    return compute_once(staged, fields).select(*keep, *fields, "parse_status")


def sufficient(company: Column, full_name: Column, emails: Column, phones: Column) -> Column:
    """A company, and any e-mail, phone or name."""
    def any_nonblank(arr: Column) -> Column:
        return F.coalesce(F.exists(arr, nonblank), F.lit(False))

    return ~is_default(company) & (
        any_nonblank(emails) | any_nonblank(phones) | ~is_default(full_name))


def is_sufficient(df: DataFrame) -> DataFrame:
    """Keep records worth showing."""
    return df.filter(sufficient(F.col("company"), F.col("full_name"),
                                F.col("emails"), F.col("phones")))


def _found(query: str) -> Column:
    q = F.lit(query)
    texts = [F.contains(fold(F.col(c)), q) for c in ("full_name", "company", "position", "product")]
    lists = [F.coalesce(F.exists(F.col(c), lambda x: F.contains(fold(x), q)), F.lit(False))
             for c in ("emails", "phones")]
    hit = texts[0]
    for t in (*texts[1:], *lists):
        hit = hit | t
    return hit


def search(df: DataFrame, query: str | None) -> DataFrame:
    """Records with ``query`` in any field, ignoring case; a blank query finds
    nothing."""
    q = (query or "").lower().strip()
    return df.filter(_found(q)) if q else df.limit(0)


def search_company(df: DataFrame, query: str) -> DataFrame:
    """Records with ``query`` in the company, ignoring case."""
    return df.filter(F.contains(fold(F.col("company")), F.lit(query.lower())))


def get_contact(df: DataFrame, filename: str) -> DataFrame:
    """The record of one file; the equality reaches the scan."""
    return df.filter(F.col("filename") == filename)


# Headers of the export.
EXPORT_HEADERS = {
    "filename": "Файл", "full_name": "Полное имя", "company": "Компания",
    "position": "Должность", "emails": "Emails", "phones": "Телефоны",
    "product": "Интересуемый продукт", "raw_content": "Содержимое",
}


def _joined(name: str, sep: str) -> Column:
    return F.coalesce(F.array_join(name, sep), F.lit(""))


def export_contacts(df: DataFrame, query: str | None = None, localized: bool = True) -> DataFrame:
    """Eight export columns, lists joined with ``", "``; a query filters first."""
    q = (query or "").lower().strip()
    rows = df.filter(_found(q)) if q else df
    cols = []
    for name, header in EXPORT_HEADERS.items():
        c = _joined(name, ", ") if name in ("emails", "phones") else F.col(name)
        if name == "raw_content" and name not in df.columns:
            c = F.lit("")
        cols.append(c.alias(header if localized else name))
    return rows.select(*cols)


def crm_rows(df: DataFrame) -> DataFrame:
    """Rows for a CRM: name, company, e-mails, phones, position."""
    return df.select(F.col("full_name").alias("name"), "company", "emails", "phones", "position")


def sheet_rows(df: DataFrame) -> DataFrame:
    """Rows for a spreadsheet: six columns, lists joined with a comma."""
    return df.select("full_name", _joined("emails", ",").alias("emails"),
                     _joined("phones", ",").alias("phones"), "company", "position", "product")


def scan_contacts(results: DataFrame) -> DataFrame:
    """Stored results to the view of sufficient records."""
    return is_sufficient(normalize_view(results))
