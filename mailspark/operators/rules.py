"""Basic filter: ordered rules, first match gives the reason."""

from __future__ import annotations

import re
import warnings
from functools import reduce
from typing import Iterable, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FilterConfig
from ..functions.sqltext import quote, string_array
from ..functions.text import (casefold_ascii, compute_once, is_plain, let, match_start_any,
                              search_any)

# Reason codes in evaluation order.
CODES = (
    "SUBJECT", "BODY", "SENDER", "REPLY", "FORWARD", "COMPANY_BLACKLIST",
    "COMPANY_EMPTY", "NOT_WHITELISTED", "COMPANY_SHORT", "FEW_EMAILS",
    "NO_CONTACT", "TOO_LARGE", "TOO_SMALL",
)
PRIORITY = {code: i for i, code in enumerate(CODES, start=1)}

_MB = 1024 * 1024
_KB = 1024


def compile_patterns(patterns: Iterable[str]) -> list[str]:
    """Regexes for a rule list: ``*`` is ``.*``, invalid entries are dropped."""
    good = []
    for pattern in patterns:
        regex = pattern.replace("*", ".*")
        try:
            re.compile(regex, re.IGNORECASE)
        except re.error as err:
            warnings.warn(f"invalid pattern dropped: {pattern!r}: {err}", stacklevel=2)
            continue
        good.append(regex)
    return good


def subject_hit(subject: Column, patterns: Iterable[str]) -> Column:
    return search_any(subject, compile_patterns(patterns))


def body_hit(body: Column, patterns: Iterable[str]) -> Column:
    return search_any(body, compile_patterns(patterns))


def sender_hit(sender: Column, patterns: Iterable[str]) -> Column:
    """Sender rules are anchored at the start only."""
    return match_start_any(sender, compile_patterns(patterns))


def is_reply(subject: Column) -> Column:
    return F.startswith(F.lower(subject), F.lit("re:"))


def is_forward(subject: Column) -> Column:
    return F.startswith(F.lower(subject), F.lit("fwd:"))


def company_in(company: Column, names: Iterable[str]) -> Column:
    """True when the company contains any entry, ignoring case."""
    entries = F.expr(string_array(n.lower() for n in names))
    return (company != "") & let(
        F.lower(company), lambda c: F.exists(entries, lambda n: F.contains(c, n)))


def list_size(arr: Column) -> Column:
    return F.coalesce(F.size(arr), F.lit(0))


class Inputs(NamedTuple):
    subject: Column
    body: Column
    sender: Column
    size: Column
    company: Column
    emails: Column
    phones: Column


def inputs(df: DataFrame, phase: str = "pre") -> Inputs:
    """Columns the rules read.

    ``phase="pre"`` filters before extraction: there is no contact yet, so
    company, e-mails and phones are empty. ``phase="post"`` reads them.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")

    def listed(name: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.coalesce(F.col(name), empty) if name in df.columns else empty

    size = (F.coalesce(F.col("size_bytes"), F.lit(0)) if "size_bytes" in df.columns
            else F.lit(0)).cast("bigint")
    if phase == "pre":
        empty = F.array().cast("array<string>")
        contact = (F.lit(""), empty, empty)
    elif phase == "post":
        contact = (text("company"), listed("emails"), listed("phones"))
    else:
        raise ValueError(f"phase must be 'pre' or 'post', not {phase!r}")
    return Inputs(text("subject"), text("body"), text("sender"), size, *contact)


def reason_code(x: Inputs, cfg: FilterConfig, in_body: Column | None = None) -> Column:
    """First matching rule as a code, null when none matches.

    One CASE chain: cheap and decisive checks come first, later branches run
    only for rows that passed the earlier ones. ``in_body`` is the outcome of
    the body rules, where that is known.
    """
    none = F.lit(None).cast("string")
    if not cfg.enabled:
        return none
    branches: list[tuple[str, Column]] = []
    if cfg.subject_blacklist:
        branches.append(("SUBJECT", subject_hit(x.subject, cfg.subject_blacklist)))
    if cfg.body_blacklist:
        branches.append(("BODY", body_hit(x.body, cfg.body_blacklist) if in_body is None else in_body))
    if cfg.sender_blacklist:
        branches.append(("SENDER", sender_hit(x.sender, cfg.sender_blacklist)))
    if cfg.exclude_replies:
        branches.append(("REPLY", is_reply(x.subject)))
    if cfg.exclude_forwards:
        branches.append(("FORWARD", is_forward(x.subject)))
    if cfg.company_blacklist:
        branches.append(("COMPANY_BLACKLIST", company_in(x.company, cfg.company_blacklist)))
    if cfg.company_whitelist:
        branches.append(("COMPANY_EMPTY", x.company == ""))
        branches.append(("NOT_WHITELISTED", ~company_in(x.company, cfg.company_whitelist)))
    branches.append(("COMPANY_SHORT",
                     (x.company != "") & (F.length(x.company) < cfg.min_company_length)))
    if cfg.min_email_count > 0:
        branches.append(("FEW_EMAILS", list_size(x.emails) < cfg.min_email_count))
    branches.append(("NO_CONTACT",
                     list_size(x.emails) + list_size(x.phones) < cfg.min_contact_info))
    if cfg.max_email_size_mb > 0:
        branches.append(("TOO_LARGE", x.size / F.lit(float(_MB)) > cfg.max_email_size_mb))
    if cfg.min_email_size_kb > 0:
        branches.append(("TOO_SMALL", x.size / F.lit(float(_KB)) < cfg.min_email_size_kb))
    return reduce(lambda w, b: w.when(b[1], b[0]), branches, F.when(F.lit(False), none))


def _one_decimal(n: Column, unit: int) -> Column:
    """``n / unit`` with one decimal, ties to even, in integer arithmetic."""
    scaled = n * 10
    whole, rest = F.floor(scaled / unit).cast("bigint"), scaled % unit
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    tenths = whole + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def reason_text(code: Column, x: Inputs, cfg: FilterConfig) -> Column:
    """Wording for a reason code."""
    n_contacts = list_size(x.emails) + list_size(x.phones)

    def say(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                          for p in parts])

    wording = {
        "SUBJECT": say("Subject matches blacklist: ", F.substring(x.subject, 1, 50)),
        "BODY": say("Body contains blacklisted content"),
        "SENDER": say("Sender ", x.sender, " is blacklisted"),
        "REPLY": say("Email is a reply (Re:)"),
        "FORWARD": say("Email is forwarded (Fwd:)"),
        "COMPANY_BLACKLIST": say("Company '", x.company,
                                 "' is blacklisted (generic/useless company)"),
        "COMPANY_EMPTY": say("Company name is empty (whitelist mode requires company)"),
        "NOT_WHITELISTED": say("Company '", x.company, "' not in whitelist"),
        "COMPANY_SHORT": say("Company name too short: ", x.company, " (",
                             F.length(x.company), " chars)"),
        "FEW_EMAILS": say("Not enough emails: ", list_size(x.emails),
                          f" (min: {cfg.min_email_count})"),
        "NO_CONTACT": say("Not enough contact info: ", n_contacts,
                          f" (min: {cfg.min_contact_info})"),
        "TOO_LARGE": say("Email size ", _one_decimal(x.size, _MB),
                         f"MB exceeds limit {cfg.max_email_size_mb}MB"),
        "TOO_SMALL": say("Email size ", _one_decimal(x.size, _KB),
                         f"KB is below minimum {cfg.min_email_size_kb}KB"),
    }
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in CODES:
        out = out.when(code == name, wording[name])
    return out


def basic_verdict(df: DataFrame, cfg: FilterConfig, phase: str = "pre") -> DataFrame:
    """Add ``is_spam``, ``reason_code`` and ``reason``. Narrow: no shuffle."""
    x = inputs(df, phase)
    judged = compute_once(df, {"reason_code": reason_code(x, cfg)})
    return (judged.withColumn("is_spam", F.col("reason_code").isNotNull())
            .withColumn("reason", reason_text(F.col("reason_code"), x, cfg)))


def should_process(df: DataFrame, cfg: FilterConfig, phase: str = "pre") -> DataFrame:
    """Negated verdict: ``should_process`` and the reason for a refusal."""
    judged = basic_verdict(df, cfg, phase)
    return judged.withColumn("should_process", ~F.col("is_spam")).drop("is_spam")


# --------------------------------------------------------------------------
# rules as data

# rule kind -> (reason code, column it reads, how it matches)
_KINDS = {
    "subject": ("SUBJECT", "subject", search_any),
    "body": ("BODY", "body", search_any),
    "sender": ("SENDER", "sender", match_start_any),
}


class Rule(NamedTuple):
    rule_id: int
    kind: str
    pattern: str


def text_rules(cfg: FilterConfig) -> list[Rule]:
    """The pattern rules of a configuration, numbered in evaluation order."""
    lists = (("subject", cfg.subject_blacklist), ("body", cfg.body_blacklist),
             ("sender", cfg.sender_blacklist))
    pairs = [(kind, p) for kind, patterns in lists for p in patterns]
    return [Rule(i, kind, p) for i, (kind, p) in enumerate(pairs, start=1)]


def rule_hits(df: DataFrame, rules: Iterable[Rule], chunk: int = 500) -> DataFrame:
    """One row per (message, matching rule): ``uid, rule_id, kind, pattern``.

    Each rule is a literal condition, so its pattern is compiled once per
    task and no message/rule pairs are formed: a message leaves the scan with
    just its matches. Very long rule lists run as several passes of ``chunk``
    rules, which bounds the size of one expression.
    """
    rules = list(rules)
    x = inputs(df)

    def label_sql(rule: Rule) -> str:
        return (f"named_struct('rule_id', {rule.rule_id}, 'kind', {quote(rule.kind)}, "
                f"'pattern', {quote(rule.pattern)})")

    def one_pass(part: list[Rule]) -> DataFrame:
        hits = []
        for kind, (_, column, match) in _KINDS.items():
            source = getattr(x, column)
            compiled = [(r, p) for r in part if r.kind == kind
                        for p in compile_patterns([r.pattern])]
            plain = [(r, p) for r, p in compiled if match is search_any and is_plain(p)]
            if plain:
                # text rules share one folded copy of the message
                needles = F.expr("array(" + ", ".join(
                    f"named_struct('needle', {quote(p.lower())}, 'rule', {label_sql(r)})"
                    for r, p in plain) + ")")
                hits.append(let(casefold_ascii(source), lambda t: F.transform(
                    F.filter(needles, lambda n: F.contains(t, n["needle"])),
                    lambda n: n["rule"])))
            others = [F.when(match(source, [p]), F.expr(label_sql(r))) for r, p in compiled
                      if (r, p) not in plain]
            if others:
                hits.append(F.filter(F.array(*others), lambda h: h.isNotNull()))
        if not hits:
            return df.select("uid").limit(0).select(
                "uid", F.lit(0).alias("rule_id"), F.lit("").alias("kind"), F.lit("").alias("pattern"))
        return (df.select("uid", F.explode(F.concat(*hits)).alias("h"))
                .select("uid", "h.rule_id", "h.kind", "h.pattern"))

    passes = [one_pass(rules[i:i + chunk]) for i in range(0, len(rules), chunk)]
    if not passes:
        raise ValueError("rule_hits needs at least one rule")
    return reduce(DataFrame.unionByName, passes)


def verdict_from_hits(hits: DataFrame) -> DataFrame:
    """Reason of the highest-priority rule hit for each message."""
    code = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, (name, _, _) in _KINDS.items():
        code = code.when(F.col("kind") == kind, name)
    return hits.groupBy("uid").agg(
        F.min_by(code, F.col("rule_id")).alias("reason_code"),
        F.count(F.lit(1)).alias("n_hits"))


def rule_usage(hits: DataFrame, spark_rules: DataFrame) -> DataFrame:
    """Messages hit per rule, including rules that never fired.

    Counts are pre-aggregated before the join, so its left side has one row
    per rule that fired.
    """
    counts = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return (spark_rules.join(counts, "rule_id", "left")
            .withColumn("n_messages", F.coalesce("n_messages", F.lit(0)).cast("bigint")))


def rules_frame(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Rules as a small literal table in the session of ``df``."""
    rows = ", ".join(f"({r.rule_id}, {quote(r.kind)}, {quote(r.pattern)})" for r in rules)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(rule_id, kind, pattern)")
