import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mailspark.config import FilterConfig
from mailspark.functions.text import words_found
from mailspark.operators import risk as R

SHIPPED = FilterConfig.shipped()
# subject, body, (spam, phishing, formatting) hits, text points, score, level
GOLDEN = [
    ("CLICK HERE!!! WIN MONEY!!!", "Click now for money! Urgent! Act now immediately!",
     (2, 1, 1), 0, 21, "LOW"),
    ("CLICK HERE NOW!!! Verify account IMMEDIATELY!!!",
     "You won $1,000,000!!! Click here now to claim your prize!!!!! Act NOW!",
     (4, 2, 2), 4, 46, "MEDIUM"),
    ("", "", (0, 0, 0), 3, 3, "LOW"),
    ("VIAGRA for sale!!!", "Click here for best prices", (0, 0, 1), 0, 4, "LOW"),
    ("Предложение", "Здравствуйте, интересует автоматизация", (0, 0, 1), 3, 7, "LOW"),
    ("Verify Your Account", "Your account has been suspended. Click to verify immediately.",
     (4, 2, 0), 0, 34, "LOW"),
]


def frame(spark, data):
    return spark.createDataFrame([(str(i), *d) for i, d in enumerate(data)],
                                 "uid string, subject string, body string")


def test_golden_scores(spark):
    df = frame(spark, [g[:2] for g in GOLDEN])
    got = R.with_risk(df, SHIPPED).orderBy("uid").collect()
    levels = R.risk_profile(df, SHIPPED).orderBy("uid").collect()
    for row, level, (_, _, hits, text, score, name) in zip(got, levels, GOLDEN):
        assert (row.spam_hits, row.phishing_hits, row.formatting_hits) == hits
        assert row.text_points == text and row.risk_score == score
        assert level.risk_level == name and level.company == "Unknown"


def test_counts_equal_plain_regex_search(spark):
    """Rewritten patterns and word lookups against the patterns as given."""
    rng = random.Random(11)
    words = sorted({w for groups in R.NEEDED_WORDS.values() for g in groups for w in g})
    words += ["you", "your", "i am", "we are", "i", "am", "we", "are", "no risk", "no", "act", "do",
              "action required", "for", "will be", "may be", "will", "may", "be", "virus detected",
              "sign-in", "HELLO WORLD THERE ", "$$", "xxx", "===", "!!", "абвгдежзийкл", "ſure",
              "Know", "re-confirm", "bit", "@", "http"]
    gaps = [" ", " ", "  ", "\n", "\t", "\n ", "", " \n\n", ", ", " " * 40, "\x1c", "\xa0", "\r\n"]
    texts = []
    for _ in range(3000):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            w = rng.choice(words)
            parts += [w.upper() if rng.random() < .2 else w, rng.choice(gaps)]
        texts.append("".join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    lists = {"a": R.SPAM_PATTERNS, "b": R.PHISHING_PATTERNS, "c": R.FORMATTING_PATTERNS}
    singles = {f"{k}{n}": (p,) for k, ps in lists.items() for n, p in enumerate(ps)}
    got = df.select("i", R.hit_counts("t", singles).alias("h")).orderBy("i").collect()
    for name, (pattern,) in singles.items():
        compiled = re.compile(pattern, re.I)
        for text, row in zip(texts, got):
            assert bool(row.h[name]) == bool(compiled.search(text)), (pattern, text)


def test_one_very_long_line_is_linear(spark):
    body = "verify system error please confirm http @ click confirm urgent " * 20_000
    start = time.time()
    R.with_risk(frame(spark, [("", body), ("", "A" * 1_000_000)]), SHIPPED).collect()
    assert time.time() - start < 60


def test_text_quality_against_brute_force(spark):
    rng = random.Random(2)
    alphabet = "ab  .!,;:?12²٣①\n\xa0é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)]

    def plain(t):
        n = max(len(t), 1)
        return ((3 if len(t.split()) < 5 else 0)
                + (4 if sum(c in "!?.,;:" for c in t) / n > 0.15 else 0)
                + (3 if sum(c.isdigit() for c in t) / n > 0.2 else 0))
    df = frame(spark, [("", t) for t in texts])
    got = df.select(F.col("uid").cast("int").alias("i"), R.text_quality_points(F.col("body")).alias("p"))
    assert [r.p for r in got.orderBy("i").collect()] == [plain(t) for t in texts]


@pytest.mark.parametrize("email,bad", [
    ("test123@x.com", True), ("TEMPorary@x.com", True), ("12345@x.com", True), ("1234@x.com", False),
    ("noreply@x.com", True), ("notifications.all@x.com", True), ("ann@x.com", False)])
def test_suspicious_emails(spark, email, bad):
    df = spark.createDataFrame([([email],), ([],), (None,)], "e array<string>")
    assert [r[0] for r in df.select(R.suspicious_emails(F.col("e"))).collect()] == [bad, False, False]


def test_probability_and_factors(spark):
    df = frame(spark, [("s", "one two three four five six")] * 3).withColumn(
        "ml_spam_probability", F.expr("CASE uid WHEN '0' THEN 0.9D WHEN '1' THEN 0.5D END"))
    got = R.with_risk(df, SHIPPED).orderBy("uid").collect()
    assert [r.risk_score for r in got] == [18.0, 10.0, 0.0]
    assert got[0].risk_factors == ["High spam probability (90.0%)", "ML analysis risk: 18pts"]
    assert got[1].risk_factors == ["ML analysis risk: 10pts"]
    off = R.with_risk(df, SHIPPED.with_(ml_enabled=False)).orderBy("uid").collect()
    assert [r.risk_score for r in off] == [0.0, 0.0, 0.0]


def test_factor_wording(spark):
    (row,) = R.with_risk(frame(spark, [GOLDEN[1][:2]]), SHIPPED).collect()
    assert row.risk_factors == [
        "Spam patterns detected (4 matches, +20pts)", "Phishing indicators (2 matches, +14pts)",
        "Suspicious formatting (2 issues, +8pts)", "Poor text quality (+4pts)"]


def test_advanced_verdict(spark):
    df = frame(spark, [GOLDEN[1][:2], ("viagra", "x"), ("hi", "all is fine with this text")])
    cfg = SHIPPED.with_(subject_blacklist=("viagra",), body_blacklist=())
    rows = R.advanced_verdict(df, cfg.with_(risk_threshold=46)).orderBy("uid").collect()
    assert [r.reason_code for r in rows] == ["RISK", "SUBJECT", None]
    assert rows[0].reason == (
        "High spam risk score: 46/100. Reasons: Spam patterns detected (4 matches, +20pts), "
        "Phishing indicators (2 matches, +14pts), Suspicious formatting (2 issues, +8pts)")
    assert rows[1].risk_score is None       # rejected by a rule: not scored
    assert [r.reason_code for r in R.advanced_verdict(df, cfg).orderBy("uid").collect()] == [
        None, "SUBJECT", None]


def test_switching_the_basic_rules_off_keeps_the_risk_filter(spark):
    df = frame(spark, [GOLDEN[1][:2]])
    off = SHIPPED.with_(enabled=False, risk_threshold=40)
    assert R.advanced_verdict(df, off).first().reason_code == "RISK"
    assert R.advanced_verdict(df, off.with_(disable_covers_risk=True)).first().reason_code is None


def test_verdict_looks_words_up_outside_of_the_jvm(spark):
    """Found words are those that ``contains`` finds, in any string; the verdict compares no word at every byte."""
    words = ["now", "virus detected", "$$", "re-verify", "won"]
    texts = ["KNOW", "virus  detected", "VIRUS DETECTED $", "a$$re-verify", "ſ wonow", "", None, "абвnow"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = rows.unionByName(spark.sql("SELECT 99 AS i, cast(unhex('C36E6F77FFE2776F6E') AS string) AS t"))
    got = rows.select("i", words_found(F.col("t"), words).alias("w"), F.when(F.col("t").isNotNull(), F.filter(
        F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("t"), w))).alias("want")).collect()
    assert all(r.w == r.want for r in got) and [r.w for r in got if r.i == 99] == [["now", "won"]]
    df = frame(spark, [("hi", "please RESET PASSWORD"), ("hi", None), (None, "google-com"), ("a lottery", "x")])
    judged = R.verdict(df, SHIPPED)
    assert [r.reason_code for r in judged.orderBy("uid").collect()] == ["BODY", None, "BODY", "SUBJECT"]
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
