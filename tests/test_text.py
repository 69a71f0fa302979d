import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from mailspark.functions import text as T

V = F.col("v")


def random_texts(alphabet, n=200, size=30, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_strip_equals_python(rows):
    texts = random_texts("ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   　​")
    assert rows(texts, T.utrim(V)) == [t.strip() for t in texts]


def test_lines_equal_python(rows):
    texts = random_texts("ab\n\r\x0b\x0c\x1c\x1d\x1e\x85  ")
    got = rows(texts, T.lines(V))
    # a trailing line break adds one empty line here; everything else agrees
    for text, parts in zip(texts, got):
        expected = text.splitlines()
        assert parts[:len(expected)] == expected
        assert all(p == "" for p in parts[len(expected):])


def test_whitespace_class_in_patterns(rows):
    texts = random_texts("ab \x1c\x1f\x85\xa0 ​", seed=2)
    assert rows(texts, V.rlike(T.java_regex(r"a\s+b"))) == [
        bool(re.search(r"a\s+b", t)) for t in texts]
    assert rows(texts, V.rlike(T.java_regex(r"a[\s-]b"))) == [
        bool(re.search(r"a[\s-]b", t)) for t in texts]


@pytest.mark.parametrize("pattern", [
    r"(?P<x>a)b", r"a[[]b", r"a[&&]b", r"x\Z", r"[]a]b", r"a.b", r"\bкот\b", r"\d{2}",
])
def test_dialect(rows, pattern):
    texts = ["ab", "a[b", "a&b", "x", "x\n", "]b", "a\nb", "a\rb", "a b", "Кот", "котик", "яa",
             "٣٤", "12", "ſ"]
    assert rows(texts, V.rlike(T.java_regex(pattern))) == [
        bool(re.search(pattern, t, re.I)) for t in texts]


def test_search_any_equals_regex_search(rows):
    patterns = ["casino", "click here", "kiss", "google.com", "free.*money", "Яндекс", "re-verify"]
    texts = ["CASINO", "casıno", "CASİNO", "kiſs", "Kiss", "googleXcom",
             "free\nmoney", "free big MONEY", "ЯНДЕКС", "re-Verify", "none", "", "cas ino"]
    compiled = [re.compile(p, re.I) for p in patterns]
    assert rows(texts, T.search_any(V, patterns)) == [
        any(c.search(t) for c in compiled) for t in texts]


def test_search_any_null_and_no_patterns(rows):
    assert rows([None, "a"], T.search_any(V, ["a"])) == [False, True]
    assert rows(["a"], T.search_any(V, [])) == [False]
    assert rows(["a"], T.match_start_any(V, [])) == [False]


def test_start_match(rows):
    patterns = [".*@spam.com", "notification@.*", "google.com.*"]
    senders = ["user@spam.com", "x notification@a", "notification@a", "GOOGLE.COM/x",
               "a\n@spam.com", "me@google.com"]
    compiled = [re.compile(p, re.I) for p in patterns]
    assert rows(senders, T.match_start_any(V, patterns)) == [
        any(c.match(s) for c in compiled) for s in senders]


HTML = {
    "<p>one</p><p> two </p>": "one\ntwo",
    "a<!-- hidden <b> -->b": "a\nb",
    "<script>var t='</p>'</script>x<style>p{}</style>": "x",
    "x<script>never closed": "x",
    "<template><b>no</b></template>yes": "yes",
    "&lt;b&gt; &amp; &quot;q&quot; &#65;&#x42; &eacute;": '<b> & "q" AB é',
    "&nbsp;\xa0<p>&nbsp;t&nbsp;</p>": "t",
    "&#151;": "—",
    "&unknown; x": "&unknown x",
    '<a title="a>b">link</a>': "link",
    "2 < 3 and 4 > 1": "2 < 3 and 4 > 1",
    "a&amp<b>c</b>&amp, d": "a&\nc\n&, d",
    "cut &am": "cut &am",
    "cut &amp": "cut &amp",
    "<!DOCTYPE html><html></html>": "",
    "": "",
    "plain": "plain",
}


def test_html_to_text(rows):
    assert rows(list(HTML), T.html_to_text(V)) == list(HTML.values())
    assert rows([None], T.html_to_text(V)) == [""]


def test_html_large_document_stays_linear(rows):
    page = "<p class='x'>word</p>\n" * 20000
    assert rows([page], F.length(T.html_to_text(V))) == [5 * 20000 - 1]


def test_message_text(spark):
    df = spark.createDataFrame([("plain", "<p>h</p>"), ("", "<p>h</p>"), (None, "<b>x</b>"),
                                ("", None)], "body string, html string")
    got = [r[0] for r in df.select(T.message_text(F.col("body"), F.col("html"))).collect()]
    assert got == ["plain", "h", "x", ""]


def test_defaults_and_fold(rows):
    assert rows(["", " ", "Не Указано", "не найдено ", None, "x"], T.is_default(V)) == [
        True, True, True, True, True, False]
    assert rows([None, "АбВ"], T.fold(V)) == ["", "абв"]
    assert rows(["я", "😀"], T.octets(V)) == [2, 4]


class TextNodes(HTMLParser):
    """Text nodes of a page, told by the standard parser."""

    hidden = ("script", "style", "template", "rt", "rp")

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes, self.current, self.open = [], "", []

    def end_node(self, *_):
        if not self.open and self.current.strip():
            self.nodes.append(self.current.strip())
        self.current = ""

    handle_comment = handle_decl = handle_pi = end_node

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag in self.hidden:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.end_node()
        if self.open and self.open[-1] == tag:
            self.open.pop()

    def handle_data(self, data):
        self.current += data

    def handle_entityref(self, name):
        self.current += T.ENTITIES.get(name, "&" + name)

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        self.current += T._CP1252[code - 128] if 128 <= code < 160 else chr(code)


def test_pages_against_the_standard_parser(rows):
    pieces = ["<p>", "</p>", "<div class='a>b'>", "<br/>", "word ", " two&amp;three", "&eacute", "&#233;",
              "&#x416;", "&nbsp;", "<!-- c <b> -->", "<script>if (a<b) x('</p>');</script>", "\n", "<b>", "</b>",
              "<style>p{}</style>", "1 < 2 ", "&unknown;", "<template>t<i>u</i></template>", "é", "<!DOCTYPE html>"]
    rng = random.Random(8)
    pages = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) + "<hr>" for _ in range(300)]
    want = []
    for page in pages:
        parser = TextNodes()
        parser.feed(page)
        parser.close()
        parser.end_node()
        want.append("\n".join(parser.nodes))
    assert rows(pages, T.html_to_text(V)) == want


def test_html_of_any_shape_is_linear(spark):
    import time

    from mailspark.functions.text import html_to_text
    many = "<p " + "a='1' b=\"2\" " * 100_000 + ">x</p>y"
    open_quote = "<a href=\"" * 100_000 + "z"
    rows = spark.createDataFrame([(1, many), (2, open_quote), (3, "<b>a</b> 1 < 2 <i"), (4, "&#00000065;&#x00000041;&#0;")],
                                 "i int, t string").withColumn("o", html_to_text(F.col("t")))
    start = time.time()
    got = {r.i: r.o for r in rows.select("i", "o").collect()}
    assert time.time() - start < 60
    assert got[1] == "x\ny" and got[2] == open_quote and got[3] == "a\n1 < 2 <i" and got[4] == "AA�"


def test_long_dotted_run_is_linear(spark):
    import time

    from mailspark.functions.extract import extract_emails
    rows = spark.createDataFrame([("a." * 500_000 + " x@y.com, .q@w.org жab.c@d.ru a@b.co.d@e.fr",)], "t string")
    start = time.time()
    got = rows.select(extract_emails(F.col("t")).alias("o")).first().o
    assert time.time() - start < 20
    assert got == ["x@y.com", "q@w.org", ".c@d.ru", "a@b.co", ".d@e.fr"]


@pytest.mark.parametrize("opening", ["<!--", "<script ", "<style", "<script>", "<a href='", "<template x", "<", "&#1",
                                     "</script ", "-->", "<!-->", "<style><!--"])
def test_unclosed_markup_is_read_once(rows, opening):
    """A megabyte of it ends in seconds."""
    start = time.time()
    got = rows(["a" + opening * (1_000_000 // len(opening)) + "b"], T.html_to_text(V))[0]
    assert time.time() - start < 20 and got.startswith("a")


def test_unclosed_markup(rows):
    cases = {"a<!-- b": "a<!-- b", "x <script a>y": "x", "x <script y": "x <script y", "<p>1</p><script>2 < 3": "1",
             "<!-- <script> -->a<script>--></script>b": "a\nb", "a<!--x-->b<p>c <d": "a\nb\nc <d", "1 < 2 <b>3</b> 4 <": "1 < 2\n3\n4 <"}
    assert rows(list(cases), T.html_to_text(V)) == list(cases.values())
