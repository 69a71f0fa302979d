import random
import warnings

import pytest
from pyspark.sql import functions as F

from mailspark.config import FilterConfig
from mailspark.operators import rules as B

UNIT = FilterConfig(
    subject_blacklist=("unsubscribe", "viagra", "casino", "winner"),
    body_blacklist=("click here", "bitcoin", "limited offer"),
    sender_blacklist=("*@spam.com", "*noreply*", "notification@*"),
    min_company_length=2, min_contact_info=1, max_email_size_mb=10, min_email_size_kb=1,
    company_blacklist=("Google", "Яндекс", "Microsoft"))
SCHEMA = ("uid string, subject string, body string, sender string, size_bytes bigint, "
          "company string, emails array<string>, phones array<string>")
GOOD = dict(subject="Hello", body="Normal text", sender="a@b.com", size_bytes=5000,
            company="TechCorp", emails=["a@b.com"], phones=[])


def judge(spark, cfg, *cases, phase="post"):
    names = ("subject", "body", "sender", "size_bytes", "company", "emails", "phones")
    data = [(str(i), *({**GOOD, **c}[n] for n in names)) for i, c in enumerate(cases)]
    df = B.basic_verdict(spark.createDataFrame(data, SCHEMA), cfg, phase)
    return [(r.reason_code, r.reason) for r in df.orderBy(F.col("uid").cast("int")).collect()]


def codes(*args, **kw):
    return [c for c, _ in judge(*args, **kw)]


def test_each_rule(spark):
    got = judge(
        spark, UNIT, {}, dict(subject="You are a VIAGRA winner"), dict(body="CLICK here now"),
        dict(sender="user@spam.com"), dict(sender="noreply@c.com"),
        dict(sender="notification@s.com"), dict(company="A"), dict(company="GOOGLE"),
        dict(company="яндекс"), dict(company="My Google Partner"), dict(emails=[], phones=[]),
        dict(emails=None, phones=["1"]), dict(emails=None, phones=None),
        dict(size_bytes=11 * 2**20), dict(size_bytes=500), dict(company=""), dict(company=None))
    assert [c for c, _ in got] == [
        None, "SUBJECT", "BODY", "SENDER", "SENDER", "SENDER", "COMPANY_SHORT",
        "COMPANY_BLACKLIST", "COMPANY_BLACKLIST", "COMPANY_BLACKLIST", "NO_CONTACT", None,
        "NO_CONTACT", "TOO_LARGE", "TOO_SMALL", None, None]
    assert got[0][1] is None
    assert got[1][1] == "Subject matches blacklist: You are a VIAGRA winner"
    assert got[3][1] == "Sender user@spam.com is blacklisted"
    assert got[6][1] == "Company name too short: A (1 chars)"
    assert got[10][1] == "Not enough contact info: 0 (min: 1)"
    assert got[13][1] == "Email size 11.0MB exceeds limit 10MB"
    assert got[14][1] == "Email size 0.5KB is below minimum 1KB"


def test_first_rule_wins(spark):
    assert codes(spark, UNIT, dict(subject="casino", body="bitcoin", sender="x@spam.com"),
                 dict(body="bitcoin", sender="x@spam.com"),
                 dict(company="Google", size_bytes=1)) == ["SUBJECT", "BODY", "COMPANY_BLACKLIST"]


def test_disabled(spark):
    assert judge(spark, UNIT.with_(enabled=False), dict(subject="viagra")) == [(None, None)]


def test_replies_and_forwards(spark):
    cfg = UNIT.with_(exclude_replies=True, exclude_forwards=True)
    assert codes(spark, cfg, dict(subject="Re: x"), dict(subject="RE: x"), dict(subject="Fwd: x"),
                 dict(subject="Fw: x"), dict(subject=" Re: x")) == [
        "REPLY", "REPLY", "FORWARD", None, None]


def test_whitelist(spark):
    cfg = UNIT.with_(company_whitelist=("TechCorp", "StartUp Inc"))
    assert codes(spark, cfg, dict(company="my techcorp ltd"), dict(company="OtherCompany"),
                 dict(company="")) == [None, "NOT_WHITELISTED", "COMPANY_EMPTY"]


def test_email_count(spark):
    got = judge(spark, UNIT.with_(min_email_count=2), {}, dict(emails=["a", "b"]))
    assert got == [("FEW_EMAILS", "Not enough emails: 1 (min: 2)"), (None, None)]


def test_before_extraction_the_contact_is_empty(spark):
    assert codes(spark, UNIT, {}, dict(company="Google"), phase="pre") == ["NO_CONTACT"] * 2
    assert codes(spark, UNIT.with_(min_contact_info=0), dict(company="Google"), phase="pre") == [None]
    with pytest.raises(ValueError):
        codes(spark, UNIT, {}, phase="later")


def test_sizes_round_half_to_even(spark):
    cfg = FilterConfig(min_contact_info=0, min_email_size_kb=10)
    sizes = [256, 768, 1280, 1, 51, 52, 1024 * 9 + 972, 1024 * 9 + 973]
    want = [f"Email size {n / 1024:.1f}KB is below minimum 10KB" for n in sizes]
    assert [r for _, r in judge(spark, cfg, *[dict(size_bytes=n) for n in sizes])] == want


def test_large_inputs(spark):
    cfg = FilterConfig.shipped()
    assert codes(spark, cfg, dict(subject="A" * 10_000, body="x " * 500_000),
                 dict(body="y" * 1_000_000 + " bitcoin")) == [None, "BODY"]


def test_invalid_patterns_are_dropped(spark):
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert B.compile_patterns(["good*", "(bad"]) == ["good.*"]
    assert len(caught) == 1


def test_should_process(spark):
    df = spark.createDataFrame([("1", "casino"), ("2", "hi")], "uid string, subject string")
    got = B.should_process(df, UNIT.with_(min_contact_info=0, min_email_size_kb=0))
    assert {r.uid: r.should_process for r in got.collect()} == {"1": False, "2": True}


def test_hits_agree_with_the_case_chain(spark):
    cfg = FilterConfig.shipped()
    rng = random.Random(5)
    words = ["casino", "click here now", "hello", "google.com", "WINNER", "bitcoin", "\n", "act now",
             "special offer", "nigerian prince", "re-verify", "wire transfer"]
    senders = ["noreply@a.com", "x@spam.com", "test@b.com", "ann@corp.com", "no-reply@z", "fake@q"]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    data = [(str(i), pick(3), pick(4), rng.choice(senders)) for i in range(300)]
    df = spark.createDataFrame(data, "uid string, subject string, body string, sender string")
    chain = {r.uid: r.reason_code for r in B.basic_verdict(df, cfg).collect() if r.reason_code}
    for chunk in (500, 7):
        hits = B.rule_hits(df, B.text_rules(cfg), chunk=chunk)
        assert {r.uid: r.reason_code for r in B.verdict_from_hits(hits).collect()} == chain
    usage = {r.rule_id: r.n_messages for r in B.rule_usage(
        hits, B.rules_frame(df, B.text_rules(cfg))).collect()}
    assert len(usage) == 74 and sum(usage.values()) == hits.count() and 0 in usage.values()


def test_config_from_mapping():
    cfg = FilterConfig.from_dict({"subject_blacklist": ["a"], "min_contact_info": 0, "note": 1,
                                  "ml_filter": {"enabled": True, "risk_threshold": 50}})
    assert cfg.subject_blacklist == ("a",) and cfg.ml_enabled and cfg.risk_threshold == 50
    assert cfg.min_company_length == 2 and cfg.max_email_size_mb == -1 and cfg.extra == {"note": 1}
    shipped = FilterConfig.shipped()
    assert [len(x) for x in (shipped.subject_blacklist, shipped.body_blacklist,
                             shipped.sender_blacklist, shipped.company_blacklist)] == [26, 36, 12, 15]
