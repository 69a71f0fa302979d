"""Text helpers: trimming, line splitting, folding, HTML to text, regex dialect."""

from __future__ import annotations

import json
import re
from html.entities import html5, name2codepoint
from typing import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .sqltext import string_array

# Characters stripped from both ends of a string, and matched by \s.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# The same set as the inside of a bracket expression (valid in Java and RE2).
WS_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Line boundaries; \r\n counts once.
LINE_BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Strings that mean "absent", compared in lower case.
DEFAULT_STRINGS = ("", "не указано", "не найдено")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Binding through a one-element ``transform`` keeps an expensive expression
    from being repeated when the optimizer moves the result into a filter.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that no later filter can pull apart.

    A plain projection is inlined into filters above it: every use of a
    column then repeats its expression, and surviving rows evaluate it again.
    Generating the values from a one-row array keeps them computed once.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def utrim(c: Column) -> Column:
    """Strip every Unicode whitespace character from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAKS, -1)


def fold(c: Column) -> Column:
    """Lower-cased text for search; null becomes the empty string."""
    return F.lower(F.coalesce(c, F.lit("")))


def fold_array(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")),
                       lambda x: F.lower(F.coalesce(x, F.lit(""))))


def is_default(c: Column) -> Column:
    return F.lower(utrim(F.coalesce(c, F.lit("")))).isin(*DEFAULT_STRINGS)


def nonblank(c: Column) -> Column:
    return utrim(F.coalesce(c, F.lit(""))) != ""


def count_nonblank(arr: Column) -> Column:
    return F.coalesce(F.size(F.filter(arr, nonblank)), F.lit(0))


def octets(c: Column) -> Column:
    """UTF-8 byte length."""
    return F.octet_length(c).cast("bigint")


# --------------------------------------------------------------------------
# regex dialect


def java_regex(pattern: str) -> str:
    """Express a case-insensitive Unicode search pattern in Java syntax.

    Flags: i ignore case, d only ``\\n`` ends a line for ``.``, U Unicode
    classes. ``\\s`` becomes the explicit whitespace set (Java leaves out
    U+001C..U+001F), and a literal ``[`` or ``&&`` inside a bracket
    expression is escaped because Java gives it a meaning.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(WS_CLASS if in_class else f"[{WS_CLASS}]")
            i += 2
        elif two == r"\Z":
            out.append(r"\z")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        elif not in_class and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        elif in_class and pattern.startswith("A-Z", i):
            # two letters (İ and the Kelvin sign) fold to lower case only
            out.append("A-Za-z")
            i += 3
        elif in_class and two[0] in "[&":
            out.append("\\" + two[0])
            i += 1
        else:
            if two[0] == "[":
                in_class = True
                # a ] right after [ or [^ is a literal
                lead = re.match(r"\[\^?\]", pattern[i:])
                if lead:
                    out.append(lead.group().replace("]", r"\]"))
                    i += lead.end()
                    continue
            elif two[0] == "]":
                in_class = False
            out.append(two[0])
            i += 1
    return "(?idU)" + "".join(out)


_PLAIN_ASCII = re.compile(r"[A-Za-z0-9 @_,:;!%/'\"=<>~`-]+")


def is_plain(pattern: str) -> bool:
    """True when the pattern is ASCII text without any regex operator."""
    return bool(_PLAIN_ASCII.fullmatch(pattern))


def casefold_sql(x: str) -> str:
    """Lower case, plus the three letters that case-insensitive regexes equate
    with an ASCII letter although ``lower`` does not (İ, ı and ſ)."""
    return f"lower(replace(replace(replace({x}, 'ſ', 's'), 'ı', 'i'), 'İ', 'i'))"


def casefold_ascii(c: Column) -> Column:
    for special, plain in (("ſ", "s"), ("ı", "i"), ("İ", "i")):
        c = F.replace(c, F.lit(special), F.lit(plain))
    return F.lower(c)


def plain_needles(patterns: Iterable[str]) -> tuple[list[str], list[str]]:
    """The plain patterns as lower-cased substrings, and the other patterns."""
    patterns = list(dict.fromkeys(patterns))
    plain = list(dict.fromkeys(p.lower() for p in patterns if is_plain(p)))
    other = [p for p in patterns if not is_plain(p)]
    # a needle that contains a shorter needle can add nothing
    plain = [p for p in plain if not any(q != p and q in p for q in plain)]
    return plain, other


def words_found(c: Column, words: Iterable[str]) -> Column:
    """Which of ``words`` (ASCII, lower case) occur in ``c``, ignoring case; null
    where ``c`` is null.

    For tens of words and more: ``contains`` compares at every byte, Python's
    search skips ahead. Texts go as bytes, which need not be valid UTF-8.
    """
    needles = [(w.encode(), w) for w in words]

    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [w for needle, w in needles if needle in t]
                         for t in texts.to_pylist()], pa.list_(pa.string()))

    return find(casefold_ascii(c).cast("binary"))


def search_any(c: Column, patterns: Iterable[str]) -> Column:
    """True when any pattern is found in ``c`` (case-insensitive search).

    Plain ASCII patterns become substring tests on one folded copy of the
    text, several times cheaper than a long regex alternation; the rest
    become one alternation.
    """
    plain, other = plain_needles(patterns)
    hit = F.lit(False)
    if plain:
        needles = F.expr(string_array(plain))
        hit = let(casefold_ascii(c), lambda t: F.exists(needles, lambda p: F.contains(t, p)))
    if other:
        alternation = "|".join(f"(?:{java_regex(p)})" for p in other)
        rx = c.rlike(alternation)
        hit = (hit | rx) if plain else rx
    return F.coalesce(hit, F.lit(False))


def match_start_any(c: Column, patterns: Iterable[str]) -> Column:
    """True when any pattern matches at the start of ``c``."""
    patterns = list(dict.fromkeys(patterns))
    if not patterns:
        return F.lit(False)
    alternation = "|".join(f"(?:{java_regex(p)})" for p in patterns)
    return F.coalesce(c.rlike(rf"\A(?:{alternation})"), F.lit(False))


# --------------------------------------------------------------------------
# HTML

# Elements whose text is not part of the visible text.
_HIDDEN = ("script", "style", "template", "rt", "rp")
# possessive repeats: the engine loops instead of recursing, whatever a tag holds
_TAG = (r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
        r"""|<[a-zA-Z/!?][^>]*+>""")
# Code points 128..159 as a browser reads them.
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def _entity_table() -> dict[str, str]:
    """Named references, the common HTML 4 names first (lookups scan in order)."""
    names = {n: chr(cp) for n, cp in sorted(name2codepoint.items())}
    table = {n: names[n] for n in ("amp", "quot", "lt", "gt", "nbsp", "copy", "middot")}
    table.update(names)
    for name, text in html5.items():
        table.setdefault(name.rstrip(";"), text)
    return table


ENTITIES = _entity_table()


def _decode_piece(piece: Column, table: Column) -> Column:
    """Decode one text piece that starts with ``&`` (others pass unchanged)."""
    num = r"\A&#0*+([1-9][0-9]{0,6}|(?<=0));?"
    hexa = r"\A&#[xX]0*+([1-9a-fA-F][0-9a-fA-F]{0,5}|(?<=0));?"
    named = r"\A&([a-zA-Z][a-zA-Z0-9.-]*);?"
    too_long = r"\A&#(?:[0-9]+|[xX][0-9a-fA-F]+);?"

    def point(code: Column) -> Column:
        # UTF-32 bytes of the code point; surrogates and beyond-range become U+FFFD
        ok = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        raw = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(ok, F.translate(raw, "".join(map(chr, range(128, 160))), _CP1252)) \
                .otherwise(F.lit("�"))

    name = F.regexp_extract(piece, named, 1)
    return (
        F.when(~piece.startswith("&"), piece)
        .when(piece.rlike(num + r"(?![0-9])"),
              F.concat(point(F.concat(F.lit("0"), F.regexp_extract(piece, num, 1)).cast("bigint")),
                       F.regexp_replace(piece, num, "")))
        .when(piece.rlike(hexa + r"(?![0-9a-fA-F])"),
              F.concat(point(F.conv(F.concat(F.lit("0"), F.regexp_extract(piece, hexa, 1)), 16, 10).cast("bigint")),
                       F.regexp_replace(piece, hexa, "")))
        .when(piece.rlike(too_long),
              F.concat(F.lit("�"), F.regexp_replace(piece, too_long, "")))
        .when(name != "",
              # an unknown name keeps its text and loses the semicolon
              F.concat(F.coalesce(F.element_at(table, name), F.concat(F.lit("&"), name)),
                       F.regexp_replace(piece, named, "")))
        .otherwise(piece)
    )


def decode_entities(c: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    decoded = F.concat_ws("", F.transform(F.split(c, "(?=&)"), lambda p: _decode_piece(p, table)))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


# Stands for a < that opens nothing; a code point that no text may exchange.
_OPEN = "\ufdd0"


def _markable(text: Column) -> Column:
    """``text`` with every ``<`` hidden that no ``>``, and every ``<!--`` that no
    ``-->`` follows: no pattern starts there, only to read to the end in vain."""
    def before(whole: Column, end: Column) -> Column:
        return F.left(whole, F.length(whole) - F.length(end))

    rest = F.substring_index(text, "-->", -1)
    return let(rest, lambda rest: let(F.substring_index(rest, ">", -1), lambda tail: F.when(
        F.contains(rest, F.lit("<!--")) | F.contains(tail, F.lit("<")), F.concat(
            before(text, rest), F.replace(before(rest, tail), F.lit("<!--"), F.lit(_OPEN + "!--")),
            F.translate(tail, "<", _OPEN))).otherwise(text)))


def html_to_text(c: Column) -> Column:
    """Visible text nodes, each stripped, blanks dropped, joined by newlines.
    Linear in the text, whatever is left unclosed."""
    text = F.coalesce(c, F.lit(""))
    # a reference cut off by the end of the document stays literal text
    text = F.regexp_replace(text, r"&([a-zA-Z#])\z", "$1")
    text = F.regexp_replace(
        text, r"&([a-zA-Z][a-zA-Z0-9.-]*+|#[0-9]++|#[xX][0-9a-fA-F]++)\z", "&amp;$1")
    # comments and hidden elements end the text node around them
    hidden = "|".join(rf"<{t}\b[^>]*+>.*?(?:</{t}\s*+>|\z)" for t in _HIDDEN)
    text = let(text, lambda t: F.regexp_replace(_markable(t), rf"(?is)<!--.*?-->|{hidden}", "<r>"))
    nodes = F.transform(F.split(text, _TAG, -1), lambda n: utrim(decode_entities(
        F.when(F.contains(n, F.lit(_OPEN)), F.translate(n, _OPEN, "<")).otherwise(n))))
    return F.array_join(F.filter(nodes, lambda n: n != ""), "\n")


def message_text(body: Column, html: Column) -> Column:
    """Plain text when present, else the text of the HTML part, else empty."""
    return (F.when(F.coalesce(body, F.lit("")) != "", body)
            .when(html.isNotNull(), html_to_text(html))
            .otherwise(F.lit("")))
