"""Secret scans through a trigram inverted index.

Each rule's regex gives a Boolean trigram query: its parse tree tells the
literal strings of which any match holds one, and these are an OR of
alternatives, each an AND of trigrams. Postings (trigram, document) hold the trigrams some query names;
intersecting them gives each rule's candidates, and only those are verified
by the regex. A rule without a mandatory literal of three characters scans
every text. Column expressions and joins only: no Python.

Defined results: null or empty texts have no spans; texts are read whole;
repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sqltext import let, quote, string_array
from .spans import digest_text, redact_sql, sorted_spans, span_sql


MOST = 64         # literals that are kept apart
WIDEST = 8        # characters of a class that is spelled out


@dataclass(frozen=True)
class Rule:
    """``valid`` is a condition on the match ``m``."""

    kind: str
    pattern: str
    valid: str = "true"


# The shipped rules, base ones first.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?+ *+[:=] *+["']?+[A-Za-z0-9+/_.=-]++""",
         r"""length(regexp_extract(m, '^[A-Za-z_]+["\']?+ *+[:=] *+["\']?+(.*)$', 1)) >= 12"""),
    Rule("access", r"AKIA[A-Z0-9]++", "length(m) >= 18"),
    Rule("hex", r"[0-9a-f]{16,}+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")


def trigrams(literal: str) -> tuple[str, ...]:
    """The trigrams that a text with ``literal`` must hold, in lower case."""
    low = literal.lower()
    return tuple(dict.fromkeys(low[i:i + 3] for i in range(len(low) - 2)))


def _literals(tree) -> tuple[set[str] | None, list[set[str]]]:
    """What a parsed pattern matches: all of its strings where they are few, else
    None; and sets of strings of which any match holds one of each."""
    runs, held, whole = {""}, [], True     # strings that the part since the last unknown can be

    def cut() -> None:
        nonlocal runs, whole
        held.append(runs)
        runs, whole = {""}, False

    def extend(strings: set[str]) -> None:
        nonlocal runs
        if len(runs) * len(strings) > MOST:
            cut()
        runs = {a + b for a, b in product(runs, strings)}

    for op, arg in tree:
        name = str(op)
        strings: set[str] | None = None
        if name == "LITERAL":
            strings = {chr(arg)}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            codes = [range(a, a + 1) if str(o) == "LITERAL" else range(a[0], a[1] + 1) for o, a in arg]
            if sum(map(len, codes)) <= WIDEST:
                strings = {chr(c) for r in codes for c in r}
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            strings = {""}
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            strings, inside = _literals(arg[-1] if name == "SUBPATTERN" else arg)
            held += inside
        elif name == "BRANCH":
            ways = [_literals(way) for way in arg[1]]
            if all(s is not None for s, _ in ways):
                strings = set().union(*[s for s, _ in ways])
            elif all(_best(s, inside) for s, inside in ways):
                held.append(set().union(*[_best(s, inside) for s, inside in ways]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = arg
            own, inside = _literals(body)
            if least:
                held += inside
            if own is not None and int(most) == 1:
                strings = own | {""} if least == 0 else own
            elif own is not None and least:
                for _ in range(min(least, MOST)):     # then perhaps more of it
                    extend(own)
        if strings is None or len(strings) > MOST or not all(s.isascii() for s in strings):
            cut()
        else:
            extend(strings)
    return (runs if whole else None), held + [runs]


def _best(strings: set[str] | None, held: list[set[str]]) -> set[str]:
    """Of the sets the one with the longest least string, if it has trigrams."""
    sets = ([strings] if strings else []) + [h for h in held if h]
    best = max(sets, key=lambda h: (min(map(len, h)), -len(h)), default=set())
    return best if best and min(map(len, best)) >= 3 else set()


@lru_cache(maxsize=4096)
def literals(pattern: str) -> tuple[str, ...]:
    """Strings of which any match of ``pattern`` holds one, in some case; none
    where the pattern has no such strings of three characters, or is written in
    a way that Python and Java read differently."""
    if re.search(r"\(\?[a-zA-Z]*[uU]", pattern):     # other letters count as the same
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")     # nested sets and set operations
            tree = re._parser.parse(pattern)
    except (re.error, Warning, OverflowError):
        return ()
    if tree.state.flags & re.VERBOSE:
        return ()
    found = {s.lower() for s in _best(*_literals(tree))}
    return tuple(sorted(s for s in found if not any(o != s and o in s for o in found)))


def trigram_query(rule: Rule) -> tuple[tuple[str, ...], ...]:
    """OR of ANDs of trigrams; empty where the rule must scan fully."""
    return tuple(trigrams(x) for x in literals(rule.pattern))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``gram, key``: documents that hold each trigram that some query names.

    Postings are narrow and written by the scan's own tasks; the query's
    trigrams bound their number per document, whatever its length.
    """
    grams = sorted({g for r in rules for alt in trigram_query(r) for g in alt})
    lowered = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    found = F.expr(f"filter({string_array(grams)}, g -> contains(t, g))")
    return lowered.select("key", F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key, rules``: per document, the rules whose query its postings meet.

    The postings are intersected per document: a partial aggregate collects
    the few query trigrams of each document, then every Boolean query is
    evaluated on that set.
    """
    held = index.groupBy("key").agg(F.collect_set("gram").alias("g"))
    tests = []
    for rule in rules:
        alternatives = trigram_query(rule)
        if alternatives:
            meets = " OR ".join(f"size(array_except({string_array(a)}, g)) = 0" for a in alternatives)
            tests.append(f"CASE WHEN {meets} THEN '{rule.kind}' END")
    return (held.select("key", F.expr(f"array_compact(array({', '.join(tests)}))").alias("rules"))
            .filter(F.size("rules") > 0))


def _spans(rules: tuple[Rule, ...]) -> str:
    parts = []
    for rank, rule in enumerate(rules):
        guard = f"array_contains(_r, '{rule.kind}')" if trigram_query(rule) else "true"
        score = "0.9D" if rule.kind in BASE[:2] else ("0.95D" if trigram_query(rule) else "0.5D")
        parts.append(span_sql("_t", rule.kind, rank, rule.pattern, rule.valid, score, guard))
    return sorted_spans(parts)


def _scan(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """``key, t, spans`` for every row of ``docs``; candidates have one row per key."""
    verdicts = candidates(postings(docs, rules, key, text), rules)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    verdicts = verdicts.withColumnRenamed("key", "v_key")
    joined = rows.join(verdicts, rows["key"].eqNullSafe(verdicts["v_key"]), "left")
    spans = let("_r", f"coalesce(rules, cast(array() AS array<string>))",
                let("_t", "coalesce(t, '')", _spans(rules)))
    return joined.select("key", "t", F.expr(spans).alias("spans"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``key, spans`` for every row of ``docs`` (spans in code points).

    Rows are matched to their candidates by an equality join on the key;
    repeated rows, and rows without a key, share their candidates.
    """
    return _scan(docs, rules, key, text).select("key", "spans")


def mask_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key, text`` of every row, with every secret replaced by ``[KIND]``."""
    masked = F.expr(let("_t", "t", f"CASE WHEN _t IS NOT NULL THEN {redact_sql('_t', 'spans')} END"))
    return _scan(docs, rules, key, text).select(F.col("key").alias(key), masked.alias(text))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``doc_id, text``."""
    base = digest_text("filter(spans, s -> s.rank < 3)")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}")
              for k in BASE]
    found = find_secrets(docs)
    return found.select(F.col("key").alias("doc_id"), *counts, F.expr(f"sha2({base}, 256)").alias("base_sha256"),
                        F.expr(digest_text("spans")).alias("spans"))
