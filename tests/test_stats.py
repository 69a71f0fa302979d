import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mailspark.config import FilterConfig
from mailspark.operators import stats as S


def test_renumber_against_sorting(spark):
    rng = random.Random(9)
    uids = [str(rng.randrange(10**rng.randrange(1, 25))) for _ in range(3000)]
    uids += ["007", "7", "07", "0", "00", "9" * 60, "8" * 400, "abc", "1a", "", "-5", "1.0"] + uids[:500]
    df = spark.createDataFrame([(u,) for u in uids], "uid string")
    want = sorted({u for u in uids if u.isdigit()}, key=lambda u: (int(u), u))
    for tasks in (None, 2, 60):
        got = S.renumber(df, tasks=tasks).orderBy("new_uid").collect()
        assert [(r.uid, r.new_uid) for r in got] == [(u, i) for i, u in enumerate(want, 1)]


def test_renumber_empty(spark):
    assert S.renumber(spark.createDataFrame([("x",)], "uid string")).count() == 0


def test_rejections(spark):
    start = datetime(2024, 1, 1)
    data = [(str(i), start + timedelta(seconds=i // 2), "SUBJECT" if i % 3 else "BODY", f"r{i}")
            for i in range(20)]
    df = spark.createDataFrame(data, "uid string, ts timestamp, reason_code string, reason string")
    summary = {r.reason_code: r.n for r in S.rejection_summary(df).collect()}
    assert summary == {"SUBJECT": 13, "BODY": 7, "TOTAL": 20}
    last = S.last_rejections(df, 3).orderBy("position").collect()
    assert [(r.position, r.uid) for r in last] == [(1, "17"), (2, "18"), (3, "19")]


def test_filter_stats(spark):
    row = S.filter_stats(spark.range(1), FilterConfig.shipped()).first()
    assert len(row) == 14
    assert (row.subject_blacklist_items, row.body_blacklist_items, row.sender_blacklist_items,
            row.company_blacklist_items, row.company_whitelist_items) == (26, 36, 12, 15, 0)
    assert row.enabled and row.require_review_before_delete and row.max_email_size_mb == 1000


CONTACT = "filename string, full_name string, company string, emails array<string>, phones array<string>, product string"


def contacts(spark):
    return spark.createDataFrame(
        [(f"{i:03}.json", f"n{i}", ["A", "B", "", None, "A"][i % 5], [f"e{i % 7}", "x"], [],
          "P" if i % 2 else "") for i in range(50)], CONTACT)


def test_corpus_stats(spark):
    want = (50, 2, 8, 0, 1)
    assert tuple(S.corpus_stats(contacts(spark)).first()) == want
    assert tuple(S.corpus_stats(contacts(spark), approximate=True).first()) == want
    assert tuple(S.corpus_stats(contacts(spark).limit(0)).first()) == (0, 0, 0, 0, 0)


def test_top_and_latest(spark):
    assert [tuple(r) for r in S.top_companies(contacts(spark), 1).collect()] == [("A", 20)]
    assert tuple(S.latest_stats(contacts(spark)).first()) == (50, 3, "n0, n1, n2, n3, n4")
    assert tuple(S.latest_stats(contacts(spark).limit(0)).first()) == (0, 0, "")


def test_validate(spark):
    data = {"ok": '{"full_name": "", "emails": [], "phones": [], "company": "", "position": "", "product": ""}',
            "missing": '{"emails": [], "phones": "1"}', "bad": "{", "empty": "", "list": "[]"}
    df = spark.createDataFrame(list(data.items()), "filename string, value string")
    got = {(r.filename, r.issue, r.detail) for r in S.validate_results(df).collect()}
    assert got == {("missing", "MISSING_KEYS", "full_name,company,position,product"),
                   ("missing", "PHONES_NOT_LIST", "string"), ("bad", "INVALID_JSON", ""),
                   ("empty", "INVALID_JSON", ""), ("list", "NOT_OBJECT", "array")}


def test_evaluate(spark):
    pred = spark.createDataFrame([("1", True), ("2", True), ("3", False), ("4", False)], "uid string, is_spam boolean")
    truth = spark.createDataFrame([("1", True), ("2", False), ("3", True), ("9", True)], "uid string, expected boolean")
    row = S.evaluate_verdicts(pred, truth).first()
    assert (row.n, row.n_correct, row.true_positive, row.false_positive, row.false_negative,
            row.accuracy, row.detection_rate) == (3, 1, 1, 1, 1, 0.333333, 0.5)
