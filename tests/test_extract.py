import json
import random
import re

from pyspark.sql import functions as F

from mailspark.functions import extract as X

V = F.col("v")


def test_known_contacts(rows):
    texts = [
        "contacts: ivan.petrov@mail.ru, +7 (999) 888-77-66, 8-800-555-1234, director@company.com",
        "call +7-999-123-45-67.", "8 495 123 45 67, 89991234567", "A@x.com a@X.com", "яa@x.com",
        "", "card 1234567890123456"]
    assert rows(texts, X.extract_emails(V)) == [
        ["ivan.petrov@mail.ru", "director@company.com"], [], [], ["A@x.com"], [], [], []]
    assert rows(texts, X.extract_phones(V)) == [
        ["+7 (999) 888-77-66"], [], ["8 495 123 45 67", "89991234567"], [], [], [],
        ["1234567890"]]


def plain_dedupe(values, key):
    seen, out = set(), []
    for v in values:
        if key(v) not in seen:
            seen.add(key(v))
            out.append(v)
    return out


def test_emails_and_phones_against_brute_force(rows):
    rng = random.Random(3)
    parts = ["a@x.com", "A@X.com", "b.c+d@mail.example.org", "@", "no@tld", "+7 (999) 123-45-67",
             "8 999 1234567", "89991234567", "8\xa0999\t123 45 67", "123-45-67", "(495) 1234567",
             "٣٤٥٦٧٨٩٠١٢", "12345678901234567890", " ", "\n", ", ", "x", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    email = re.compile(X.EMAIL_PATTERN, re.I)
    phone = re.compile(X.PHONE_PATTERN)
    digits = lambda p: re.sub(r"\D+", "", p)
    want_emails = [plain_dedupe(email.findall(t), str.lower) for t in texts]
    want_phones = [plain_dedupe(
        [p for p in (re.sub(r"\s+", " ", m) for m in phone.findall(t)) if len(digits(p)) >= 10],
        digits) for t in texts]
    assert rows(texts, X.extract_emails(V)) == want_emails
    assert rows(texts, X.extract_phones(V)) == want_phones


def test_many_emails_in_one_message(rows):
    text = " ".join(f"u{i % 3000}@x.com" for i in range(9000))
    assert rows([text], X.extract_emails(V)) == [[f"u{i}@x.com" for i in range(3000)]]


def test_product(rows):
    cases = {
        "Пишу по поводу заявки на услугу.": "",
        "Интересует: CRM": "crm",
        "\nИщу решение для автоматизации. Интересует CRM система с интеграцией 1С.\nНужен отчет":
            "ищу решение для автоматизации. интересует crm система с интеграцией 1с",
        "хочу -\nХочу xy\r\nЗапрос: Дашборд.": "дашборд",
        "нужен " + "ы" * 300: "",
        "нужен " + "ы" * 150: "ы" * 120,
        "по продукту - Склад;": "склад",
        "": "",
    }
    assert rows(list(cases), X.extract_product(V)) == list(cases.values())


def record(**kw):
    base = dict(full_name="", emails=[], phones=[], company="", position="", product="")
    return tuple({**base, **kw}[k] for k in X.CONTACT_FIELDS)


def test_quality_score_and_choice(spark):
    full = record(full_name="A", emails=["e"], phones=["p"], company="C", position="P", product="X")
    default = record(full_name="не указано", emails=[" "], company="Не найдено")
    one = record(emails=["a@b"])
    df = spark.createDataFrame([(full, default), (default, one), (one, one), (default, None)],
                               f"a {X.CONTACT_TYPE}, b {X.CONTACT_TYPE}")
    got = df.select(X.quality_score(F.col("a")), X.quality_score(F.col("b")),
                    X.better(F.col("a"), F.col("b"))).collect()
    assert [(r[0], r[1]) for r in got] == [(10, 0), (0, 1), (1, 1), (0, 0)]
    assert [tuple(r[2]) for r in got] == [full, one, one, default]


REPLIES = [
    '{"full_name": "A", "emails": ["e"], "phones": [], "company": "C", "position": "", "product": ""}',
    json.dumps('{"full_name": "B", "emails": "a@x, b@x, "}'),
    '{"phones": 123, "emails": null, "company": null, "product": true, "position": 1.5}',
    '{"emails": ["a", " ", null, 5, true], "phones": 0}',
    "[1, 2]", '"just text"', "not json", "", "   ", "null", "7",
    json.dumps(json.dumps('{"full_name": "deep"}')),
    '{"emails": {"a": 1}, "phones": false}',
]


def plain_reply(reply):
    """What the reply means, written independently on the json module."""
    raw, data = (reply or "").strip(), {}
    for _ in range(2):
        try:
            parsed = json.loads(raw) if raw else {}
        except ValueError:
            parsed = {}
        if not isinstance(parsed, str):
            data = parsed
            break
        raw = parsed.strip()
    data = data if isinstance(data, dict) else {}
    text = lambda v: v if isinstance(v, str) else (
        json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else str(v))

    def strings(v):
        if isinstance(v, str):
            v = [x.strip() for x in v.split(",")]
        elif not isinstance(v, list):
            v = [v] if v else []
        return [text(x) for x in v if text(x).strip()]
    return tuple(strings(data.get(k, "")) if k in ("emails", "phones") else text(data.get(k, ""))
                 for k in X.CONTACT_FIELDS)


def test_replies(rows):
    got = rows(REPLIES, X.parse_reply("v"))
    assert [tuple(r) for r in got] == [plain_reply(r) for r in REPLIES]


def test_null_text_option(rows):
    (got,) = rows(['{"company": null, "full_name": "x"}'], X.parse_reply("v", null_text=""))
    assert got["company"] == "" and got["full_name"] == "x"


def test_load_json_safe(rows):
    cases = {'{"a": 1}': '{"a": 1}', "[1]": "{}", "{bad": "{}", "": "{}", '"{}"': "{}"}
    assert rows(list(cases), X.load_json_safe("v")) == list(cases.values())


def test_prompt(rows):
    (got,) = rows(["BODY {x}"], X.format_prompt(V))
    assert got.startswith("Проанализируй") and "Текст письма:\n    BODY {x}\n" in got
