"""Personal data: patterns propose, validators confirm, context words score.

Column expressions only: no Python, no shuffle. Each kind has one pattern; the
leftmost non-overlapping matches of a kind are checked and failing ones are
dropped. Spans of different kinds may overlap.

Defined results: null or empty texts have no spans; a text of any length is
read whole; repeated rows give repeated results; an empty table gives an empty
table. Working values live inside expressions, so columns of any name pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sqltext import let, quote
from .spans import digest_text, redact_sql, sorted_spans, span_sql

KINDS = ("email", "ip", "card", "phone", "iban")

# What the kinds look like. A match may start where the one
# before ended or where no longer run of the same characters covers it; so
# each run is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+",
}
PLAIN_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
}
GUARDS = {
    "email": "instr({t}, '@') > 0", "ip": "instr({t}, '.') > 0", "card": "true",
    "phone": "instr({t}, '+') > 0", "iban": "true",
}
# How sure a confirmed match is, and the words nearby that raise
# (by 0.2) or lower (by 0.3) that.
CONFIDENCE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|contact|write to|courriel|correo",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|debit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|appel|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = "version|release|order no|isbn|example only|serial"


def luhn_sql(digits: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    d = let("_d", f"cast(substring({digits}, _n - _k + 1, 1) AS int)",
            "CASE WHEN _k % 2 = 0 THEN CASE WHEN _d > 4 THEN 2 * _d - 9 ELSE 2 * _d END ELSE _d END")
    return let("_n", f"length({digits})",
               f"aggregate(sequence(1, _n), 0, (_a, _k) -> _a + {d}) % 10 = 0")


def mod97_sql(code: str) -> str:
    """Whether an account code passes the mod-97 check."""
    value = ("CASE WHEN ascii(_c) >= 65 THEN (_a * 100 + ascii(_c) - 55) % 97 "
             "ELSE (_a * 10 + ascii(_c) - 48) % 97 END")
    moved = f"concat(substring({code}, 5), left({code}, 4))"
    return f"aggregate(split({moved}, ''), 0, (_a, _c) -> {value}) = 1"


def _valid(kind: str) -> str:
    if kind == "ip":
        return ("forall(split(m, '[.]'), _x -> length(ltrim('0', _x)) < 4 AND "
                "cast(concat('0', left(ltrim('0', _x), 3)) AS int) < 256)")
    if kind == "card":
        return let("_g", "regexp_replace(m, '[ -]', '')",
                   f"CASE WHEN length(_g) BETWEEN 12 AND 19 THEN {luhn_sql('_g')} ELSE false END")
    if kind == "phone":
        return "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 9 AND 15"
    if kind == "iban":
        edges = ("right(get(_p, _i), 1) rlike '[A-Za-z0-9]' OR left(get(_p, _i + 1), 1) rlike '[A-Za-z0-9]'")
        return let("_g", "replace(m, ' ', '')",
                   f"CASE WHEN {edges} THEN false WHEN length(_g) BETWEEN 15 AND 34 THEN {mod97_sql('_g')} "
                   "ELSE false END")
    return "true"


def pii_sql(text: str, kinds: tuple[str, ...] = KINDS) -> str:
    parts = []
    for kind in kinds:
        score = (f"{CONFIDENCE[kind]}D + CASE WHEN near rlike {quote(CONTEXT[kind])} THEN 0.2D ELSE 0D END "
                 f"- CASE WHEN near rlike {quote(AGAINST)} THEN 0.3D ELSE 0D END")
        parts.append(span_sql(text, kind, KINDS.index(kind), PATTERNS[kind], _valid(kind), score,
                              GUARDS[kind].format(t=text)))
    return sorted_spans(parts)


def find_pii(text: str = "text", kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans ``start, rank, end, kind, score`` of a text column, in code points,
    end exclusive. ``text`` names the column."""
    column = "`" + text.replace("`", "``") + "`"
    return F.expr(let("_t", f"coalesce({column}, '')", pii_sql("_t", kinds)))


def redact_pii(df: DataFrame, text: str = "text", min_score: float = 0.0,
               kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``df`` with the spans of at least ``min_score`` replaced by ``[KIND]``.
    Null texts stay null; all other columns are left alone."""
    column = "`" + text.replace("`", "``") + "`"
    kept = f"filter({pii_sql('_t', kinds)}, _k -> _k.score >= {float(min_score)}D)"
    return df.withColumn(text, F.expr(let("_t", column, f"CASE WHEN _t IS NOT NULL THEN "
                                          f"{let('_f', kept, redact_sql('_t', '_f'))} END")))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``doc_id, text``."""
    base = "filter(_s, s -> s.rank < 4)"
    fields = ", ".join(f"size(filter(_s, s -> s.kind = '{k}')) AS n_{k}" for k in KINDS[:4])
    row = let("_t", "coalesce(text, '')", let("_s", pii_sql("_t"), (
        f"struct({fields}, sha2({digest_text(base)}, 256) AS base_sha256, {digest_text('_s')} AS spans)")))
    return (docs.select("doc_id", F.explode(F.array(F.expr(row))).alias("r"))
            .select("doc_id", *[F.col(f"r.n_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:4]],
                    "r.base_sha256", "r.spans"))
