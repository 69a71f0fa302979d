"""Regex matches with their code-point positions, as column expressions.

``split`` and ``regexp_extract_all`` walk the same matches of a pattern, so
the pieces between matches and the matches themselves give every start and end
without Python. Both run the Java engine: patterns here use possessive
repeats, so no text can make them recurse or rescan.
"""

from __future__ import annotations

from typing import Sequence

from ..functions.sqltext import let, quote

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"
NO_SPANS = f"cast(array() AS array<{SPAN}>)"


def span_sql(text: str, kind: str, rank: int, pattern: str, valid: str, score: str,
             guard: str, width: int = 40) -> str:
    """SQL for the spans of one kind in the string expression ``text``.

    ``valid`` is a condition on the match ``m``; failing matches are dropped.
    ``score`` is an expression on ``m`` and ``near`` (lower-case text of up to
    ``width`` characters on either side). ``guard`` is a cheap condition
    without which the pattern cannot match.
    """
    pieces, hits = f"split({text}, {quote(pattern)}, -1)", f"regexp_extract_all({text}, {quote(pattern)}, 0)"
    near = f"lower(concat(right(get(_p, _i), {width}), ' ', left(get(_p, _i + 1), {width})))"
    one = (f"struct(_b AS start, {rank} AS rank, _b + length(m) AS end, '{kind}' AS kind, "
           f"cast({let('near', near, score)} AS double) AS score)")
    # state: position after the last match, index of the match, spans so far
    step = let("m", "get(_m, _s.i)", let("_i", "_s.i", let(
        "_b", "_s.at + length(get(_p, _i))",
        f"struct(_b + length(m) AS at, _i + 1 AS i, "
        f"CASE WHEN {valid} THEN concat(_s.out, array({one})) ELSE _s.out END AS out)")))
    fold = (f"aggregate(_m, struct(0 AS at, 0 AS i, {NO_SPANS} AS out), "
            f"(_s, _x) -> {step}, _s -> _s.out)")
    spans = let("_m", hits, f"CASE WHEN size(_m) = 0 THEN {NO_SPANS} ELSE {let('_p', pieces, fold)} END")
    return f"CASE WHEN {guard} THEN {spans} ELSE {NO_SPANS} END"


def sorted_spans(parts: Sequence[str]) -> str:
    """All spans of a text by start, then rank of their kind."""
    return f"array_sort(concat({', '.join(parts)}))"


def digest_text(spans: str) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    return (f"array_join(transform({spans}, s -> concat(s.kind, ':', cast(s.start AS string), ':', "
            f"cast(s.end AS string))), ',')")


def redact_sql(text: str, spans: str) -> str:
    """``text`` with each span replaced by ``[KIND]``; where spans overlap, the
    first by start takes the whole union."""
    step = ("CASE WHEN s.start < a.at THEN CASE WHEN s.end <= a.at THEN a "
            "ELSE struct(s.end AS at, a.out AS out) END "
            f"ELSE struct(s.end AS at, concat(a.out, array(substring({text}, a.at + 1, s.start - a.at), "
            "concat('[', upper(s.kind), ']'))) AS out) END")
    fold = (f"aggregate({spans}, struct(0 AS at, cast(array() AS array<string>) AS out), (a, s) -> {step}, "
            f"a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))")
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {fold} END"


# ------------------------------------------------------------------ DuckDB


def duck_spans(kind: str, rank: int, pattern: str, valid: str, text: str = "t") -> str:
    """The same spans in DuckDB: a list of ``{start, rank, stop, kind}``.

    ``valid`` may use the match ``m`` and the texts before (``x``) and after
    (``y``) it.
    """
    p = pattern.replace("'", "''")
    hits, pieces = f"regexp_extract_all({text}, '{p}', 0)", f"regexp_split_to_array({text}, '{p}')"
    return f"""(SELECT coalesce(list(struct_pack(start := b, rank := {rank}, stop := b + length(m), kind := '{kind}') ORDER BY i)
      FILTER ({valid}), []) FROM (SELECT i, m, x, y, (sum(length(x)) OVER (ORDER BY i) + coalesce(sum(length(m)) OVER (ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b
      FROM (SELECT unnest({hits}) AS m, unnest(({pieces})[:len({hits})]) AS x, unnest(({pieces})[2:]) AS y,
      generate_subscripts({hits}, 1) AS i)))"""


def duck_digest(spans: str) -> str:
    return (f"array_to_string(list_transform({spans}, lambda q: "
            "q.kind || ':' || q.start || ':' || q.stop), ',')")
