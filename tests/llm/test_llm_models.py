"""Tokens, extraction, neighbours, languages, toxicity and the pipeline."""

import base64
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.llm import bpe, hnsw, html_crf, langid, queries, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(
        bytes.split, bpe.read_ranks(public_tokenizers.path(bpe.RANKS)).splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, tokenizer):
    rng = random.Random(4)
    texts = [None, "", "a", "  \n\n hello  world\t\x1c\x1d x", "don't I'll ’s ½ ²³ ٣٤ 日本語 x \x85 y", "a" * 700, "ab" * 300 + " " + "!?" * 300,
             " " * 600 + "x" + " " * 5, "".join(rng.choice("abcdefghij") for _ in range(1500)), "<|endoftext|> x", "\x00\x01 é̀ ñ", "a", "a",
             "".join(chr(rng.choice([32, 65, 97, 233, 8364, 128512, 0x301, 10, 9, 48, 95, 39])) for _ in range(2000)), "ǅ ᾳ ʼ ª º µ x²"]
    got = {r.doc_id: r for r in bpe.encode(docs(texts), carry=("key", "n")).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and (got[i].key, got[i].n) == ("k", 2)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    data = bpe.decode(bpe.encode(docs(texts)).select("doc_id", F.when(F.col("doc_id") > 0, F.col("ids")).alias("ids"))).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in data} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode_digest(docs([])).count() == 0


def test_every_token_encodes_to_itself(tokenizer):
    """What the contraction of several pairs at once in long matches rests on."""
    assert all(tokenizer.encode_single_token(t) == r and tokenizer._encode_single_piece(t) == [r]
               for t, r in tokenizer._mergeable_ranks.items())


# ------------------------------------------------------------------ pages


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id="topmenu" class="menu"><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div>
<div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div><article><h1>A fine&nbsp;day</h1>
<p>It was long,  with <b>many <i>people</b> in the park &amp; they
sang.<p>Rain came later; nobody left.<script>var x = "<p>no</p>";</script></p></article>
<aside><p>Other things you may like.</p></aside><div id="comments"><div class="comment"><p>I liked this, thanks.</p></div></div>
<form><p>Send us a message</p></form><footer>&copy; 2020</footer></body></html>"""


@tables
def test_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_crf.fit_model(pages)
    odd = [(None, "u", None), (1, None, ""), (2, "u", PAGE), (3, "u", "<div>" * 30_000 + "x"), (4, "u", "<p " + "a=b " * 50_000 + ">x"),
           (5, "u", "</p>" * 30_000), (6, "u", "<!-- open"), (7, "u", "<p '" * 2000), (8, "u", "plain text"), (2, "u", PAGE)]
    df = spark.createDataFrame([(*r, "x", 1) for r in odd], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_crf.extract(df, model).collect()
    assert len(got) == len(odd) and all(r.text is not None for r in got)
    want = "A fine day\nIt was long, with many people in the park & they sang.\nRain came later; nobody left."
    assert [r.text for r in got if r.page_id == 2] == [want, want]
    own = {r.page_id: r.text for r in html_crf.extract_digest(pages).collect()}
    rows = pages.collect()
    right = 0
    for r in rows:
        blocks = html_crf.parse(r.html)
        right += own[r.page_id] == "\n".join(b.text for b, y in zip(blocks, html_crf.labels(blocks)) if y)
    assert right >= 0.98 * len(rows)
    assert html_crf.extract_digest(df.limit(0)).count() == 0


def test_pages_are_not_lost_to_skipped_elements():
    def texts(page):
        return [b.text for b in html_crf.parse(page)]
    assert texts("<html><head><title>t</title><meta a=b><body><p>one</p>") == ["one"]
    assert texts("<head><title>t</title><style>x</style><p>one</p></head><p>two") == ["one", "two"]
    assert texts("<head><title>t</title>bare text<p>two") == ["bare text", "two"]
    assert html_crf.parse("<head><p>one")[0].marks == {"<p>"}
    assert texts("<p>a<svg/>b</p><p>c<math x='1'/>d</p><svg><text>no</text></svg><p>e</p>") == ["ab", "cd", "e"]
    assert texts("<p>a</p><video src=x><p>b</p><svg><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><script>if (x) <p>b</p>") == ["a"]
    assert len(texts("<video><p>x</p>" * 20_000)) == 20_000


@tables
def test_extraction_without_labelled_pages(spark):
    """Article markup renamed in every page: most of the articles is still found, most of the rest left."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "(?i)<(/?)(article|main)\\b", "<$1div"))
    assert plain.filter(F.col("html").rlike("(?i)<(article|main)[ >]")).count() == 0
    got = {r.page_id: set(r.text.split("\n")) for r in html_crf.extract_digest(plain).collect()}
    good = found = wanted = 0
    for r in pages.collect():
        blocks = html_crf.parse(r.html)
        want = {b.text for b, y in zip(blocks, html_crf.labels(blocks)) if y}
        good, found, wanted = good + len(want & got[r.page_id]), found + len(got[r.page_id]), wanted + len(want)
    print("precision", good / found, "recall", good / wanted)
    assert good / wanted > 0.9 and good / found > 0.9
    few = html_crf.extract_digest(plain.limit(1)).first()
    assert few.n_chars > 0


@tables
def test_extraction_of_other_layouts(spark):
    """Held-out pages, rewritten: blocks found by their labels."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(90).collect()]
    model = html_crf.fit(pages[::2])
    held = html_crf.rewritten([html_crf.parse(p) for p in pages[1::2]], seed=99)
    good = total = 0
    for x, y in held:
        blocks = [html_crf.Block("", 0, "", frozenset(), ())] * len(y)
        original, html_crf.features = html_crf.features, lambda b, x=x: x
        try:
            states = html_crf.viterbi(blocks, model)
        finally:
            html_crf.features = original
        good += sum(a == b for a, b in zip(states, y))
        total += len(y)
    assert good / total > 0.95


# ------------------------------------------------------------------ vectors


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x[300:420] = x[300]                      # one vector many times
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1050, [0.0] * 16, 1), (1100, [float("nan")] * 16, 1),
                                                           (1150, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (50, x[50].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    got = {}
    for r in hnsw.nearest_digest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 600, 50))
    hits = 0
    for q, found in got.items():
        sims = unit @ unit[q]
        sims[q] = -9
        order = np.lexsort((np.arange(600), -np.round(sims, 12)))[:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(f[2] - sims[f[1]]) < 1e-12 for f in found)
        hits += len({f[1] for f in found} & set(order.tolist()))
    assert hits >= 0.9 * 5 * len(got)
    assert [f[1] for f in got[300]] == [301, 302, 303, 304, 305]
    assert hnsw.nearest_digest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in hnsw.nearest_digest(few).collect()] == [(0, 1)]


def test_neighbours_nearly_equal(spark):
    """Multiples of one vector, more than a search keeps, and copies with tiny
    noise: single precision cannot rank them, the double score does."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    for i in range(200, 500):
        x[i] = x[200] * (1 + (i - 200) * 0.37)
    for i in range(500, 600):
        x[i] = x[500] + 1e-5 * rng.normal(size=16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in hnsw.nearest_digest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(200, 600, 50):
        score = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
        score[q] = -9
        assert got[q] == np.lexsort((np.arange(700), -score))[:5].tolist(), q


# ------------------------------------------------------------------ languages, toxicity


@tables
def test_languages(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.model_of(table.filter("doc_id % 2 = 0"))
    held = table.filter("doc_id % 2 = 1")
    rows = langid.document_rows(held.withColumn("lang", F.lit(None).cast("string")))    # nothing declared
    right = langid.identify(rows, model).join(held.select(F.col("doc_id").alias("id"), F.col("lang").alias("true")), "id")
    share = right.agg(F.avg((F.col("lang") == F.col("true")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert share[0] > 0.97 and share[1] == 1.0
    odd = docs([None, "", "12345 !!! ---", "the of and to", "x" * 2_500_000])
    got = {r.id: r for r in langid.identify(langid.document_rows(odd), model).collect()}
    assert [got[i].accepted for i in range(3)] == [False] * 3 and got[0].lang is None and got[3].lang == "en"
    assert [r.doc_id for r in langid.drop_unidentified(table.limit(20).union(odd.select(*table.columns))).filter("doc_id < 3").collect()
            if r.text in (None, "", "12345 !!! ---")] == []
    assert langid.identify(langid.document_rows(odd.limit(0)), model).count() == 0
    assert langid.identify(langid.document_rows(odd), ([], np.zeros((0, langid.BUCKETS)))).filter("accepted").count() == 0


SENTENCES = ["The committee will meet again next Thursday to discuss the budget for the new library.",
             "Please send your completed application form to the office before the end of June.",
             "Le conseil municipal se réunira jeudi prochain pour examiner le budget de la bibliothèque.",
             "Der Ausschuss trifft sich am nächsten Donnerstag, um den Haushalt zu besprechen.",
             "El comité se reunirá el próximo jueves para hablar del presupuesto de la biblioteca."]
NOISE = ["qwxz kjvq zzxw pqjx vkqz xjqw zvkx qpzj wxkq", "Комитет соберётся в следующий четверг"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_verdicts_do_not_depend_on_rows_fitted(spark, docs, monkeypatch):
    held = langid.document_rows(docs(SENTENCES + NOISE).withColumn("lang", F.lit(None).cast("string")))
    table, got = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), []
    for size in (200, 4000):
        monkeypatch.setattr(langid, "FIT_ROWS", size)
        got.append({r.id: r.accepted for r in langid.identify(held, langid.model_of(table)).collect()})
    assert got[0] == got[1] == {i: i < len(SENTENCES) for i in range(len(SENTENCES + NOISE))}


def test_no_labelled_text_rejects_no_text(spark, docs):
    df = docs([None, "", "123 !!", *SENTENCES]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in langid.drop_unidentified(df).collect()) == list(range(3, 3 + len(SENTENCES)))


def test_evidence_decides_short_texts(spark):
    """A text that fits two languages takes that of its host, or the declared one."""
    model = (["aa", "bb"], np.log(np.full((2, langid.BUCKETS), 1 / langid.BUCKETS)).astype(np.float32))
    t = langid.Trigrams()
    for i, text in enumerate(("foo foo foo", "bar bar bar")):
        for x in t.of(text):
            model[1][i, x] += 3
    rows = [(i, "foo foo foo", "aa", "de", "a.x.de", "x.de") for i in range(40)] + [
        (100 + i, "bar bar bar", "bb", "fr", "b.y.fr", "y.fr") for i in range(40)] + [
        (200, "zzz", None, None, "a.x.de", "x.de"), (201, "zzz", None, None, "b.y.fr", "y.fr"), (202, "zzz", "bb", None, None, None),
        (203, "zzz", None, "de", None, None), (204, "zzz", None, None, "new.y.fr", "y.fr")]
    df = spark.createDataFrame(rows, "id bigint, text string, declared string, suffix string, host string, domain string")
    got = {r.id: r.lang for r in langid.identify(df, model).collect()}
    assert [got[i] for i in (0, 100, 200, 201, 202, 203, 204)] == ["aa", "bb", "aa", "bb", "bb", "aa", "bb"]


@tables
def test_page_evidence(spark):
    rows = spark.createDataFrame([(1, "https://Blog.Site.example.FR/en/1", '<html lang="fr-CA"><body>x'), (2, None, None), (3, "nonsense", "<p>")],
                                 "page_id bigint, url string, html string")
    got = {r.id: r for r in langid.page_rows(rows).collect()}
    assert (got[1].host, got[1].domain, got[1].suffix, got[1].declared) == ("blog.site.example.fr", "example.fr", "fr", "fr")
    assert got[2].host is None and got[2].declared is None and got[3].host is None
    # a language far into the tag, in a second tag, and tags that never end
    far = ["<html " + 'data-x="1" ' * 2_000 + 'lang="de">', '<html class=a><HTML Lang = it>', "<html " * 200_000, "<html lang" + " " * 1_000_000 + ">"]
    rows = spark.createDataFrame([(i, None, h) for i, h in enumerate(far)], "page_id bigint, url string, html string")
    assert {r.id: r.declared for r in langid.page_rows(rows).collect()} == {0: "de", 1: "it", 2: None, 3: None}


def test_toxicity_chain(spark, docs):
    rng = random.Random(9)
    bad, poor = ["grubel", "snarfen"], ["lorem", "ipsum"]
    texts, marks = [], []
    for i in range(400):
        w = [rng.choice("alpha beta gamma delta omega kappa sigma".split()) for _ in range(30)]
        low, tox = rng.random() < 0.3, rng.random() < 0.25
        if low:
            w.insert(3, rng.choice(poor))
        if tox:
            w.insert(5, rng.choice(bad) + rng.choice(["", "!", "s", "ung"]))
        texts.append(" ".join(w))
        marks.append((i, int(not low), int(tox)))
    labels = spark.createDataFrame(marks[:300], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_digest(docs(texts + [None, "", "grubel " * 100_000]), labels).collect()}
    held = [got[i].toxic == bool(marks[i][2]) for i in range(300, 400)]
    assert len(got) == 403 and sum(held) >= 97 and not got[400].toxic and got[402].toxic
    none = labels.limit(0)
    assert not any(r.toxic for r in toxicity.toxicity_digest(docs(texts[:3]), none).collect())
    assert toxicity.toxicity_digest(docs([]), none).count() == 0


def test_toxicity_sample(spark):
    """Ids of least hash, whatever the table's size; repeated and null marks."""
    marks = spark.range(5000).selectExpr("id", "cast(id % 3 = 0 AS int) AS toxic").unionByName(
        spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None)], "id bigint, toxic int"))
    whole = [r.id for r in marks.filter("id IS NOT NULL").select("id").distinct().orderBy(F.shiftrightunsigned(F.xxhash64("id"), 1)).collect()]
    for limit in (20, 1000, 5000, 9000):
        got = toxicity.sample_marks(marks, ["toxic"], limit).collect()
        assert {r.id for r in got} == set(whole[:limit]) and len(got) == min(limit, 5000)
    assert {r.id: r.toxic for r in got}[3] == 0.0
    assert toxicity.sample_marks(marks.limit(0), ["toxic"]).count() == 0


def test_linear_model_is_at_the_gradient(spark):
    """The fitted loss cannot be lowered much: plain gradient descent from there stays."""
    rng = np.random.default_rng(3)
    n, y = 400, (rng.random(400) < 0.4).astype(float)
    held = [[w for w in range(6) if rng.random() < (0.8 if y[i] == (w < 3) else 0.2)] for i in range(n)]
    row, col = np.repeat(np.arange(n), [len(h) for h in held]), np.array([w for h in held for w in h], np.int64)
    m = toxicity.fit_linear(row, col, n, np.empty((n, 0)), y)
    x = np.zeros((n, len(m.ids)))
    for i, h in enumerate(held):
        x[i, [k for k, w in enumerate(m.ids) if w in h]] = 1
    weight = np.where(y > 0, np.sqrt(0.5 / y.mean()), np.sqrt(0.5 / (1 - y.mean())))
    weight /= weight.sum()
    p = 1 / (1 + np.exp(-(x @ m.words + m.bias)))
    assert np.abs(x.T @ ((p - y) * weight) + toxicity.L2 * m.words).max() < 0.01
    assert len(m.ids) == 6 and (m.words[:3] > 0).all() and (m.words[3:] < 0).all()


# ------------------------------------------------------------------ queries and pipeline


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    result = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted(tuple(r) for r in result.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


@tables
def test_pipeline(spark, db, tokenizer, tmp_path):
    import corpus_pipeline as C
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in C.STAGES:
        out = step(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    languages, near, leaks, private, tokens = kept
    assert languages.count() == 200                       # all are texts in some language
    from mailspark.llm import decontaminate, jaccard, pii
    groups = {r.id: r.component_id for r in jaccard.link_documents(languages, 5, 8, 10).collect()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, c in groups.items() if i == c)
    hit = {r.doc_id for r in decontaminate.contamination(near, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert {r.doc_id for r in leaks.collect()} == {r.doc_id for r in near.collect()} - hit
    assert leaks.count() == private.count() and private.select(pii.find_pii().alias("s")).filter("size(s) > 0").count() == 0
    texts = {r.doc_id: r.text for r in private.collect()}
    assert {r.doc_id: r.ids for r in tokens.collect()} == {i: tokenizer.encode_ordinary(t) for i, t in texts.items()}
