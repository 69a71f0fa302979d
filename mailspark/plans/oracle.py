"""Independent SQL for each registered query, in DuckDB's dialect."""

from __future__ import annotations

from ..functions import extract as X
from ..functions.text import DEFAULT_STRINGS, LINE_BREAKS, WHITESPACE, WS_CLASS
from ..operators import risk as R
from ..operators import rules as B
from ..operators import views as V
from ..sources import tables as A
from . import catalogue as K


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = q(WHITESPACE)


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def is_default(x: str) -> str:
    return f"(lower({trim(f'coalesce({x}, {q(str())})')}) IN ({', '.join(map(q, DEFAULT_STRINGS))}))"


def found(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)}, 'i')"


def any_of(x: str, patterns) -> str:
    return found(x, "|".join(f"(?:{p.replace('*', '.*')})" for p in patterns))


def dedupe(lst: str, key) -> str:
    keys = f"list_transform({lst}, lambda y: {key('y')})"
    return f"list_filter({lst}, lambda x, i: list_position({keys}, {key('x')}) = i)"


def text_list(lst: str) -> str:
    return f"coalesce(array_to_string({lst}, '|'), '')"


MESSAGES = f"""messages AS MATERIALIZED (
 SELECT *, CAST(strlen(body) AS BIGINT) AS size_bytes FROM (
  SELECT CAST(doc_id AS VARCHAR) AS uid,
   coalesce({A.SUBJECT_CASE}, substring(split_part(text, chr(10), 1), 1, 80)) AS subject,
   coalesce({A.SENDER_CASE}, {A.SENDER_DEFAULT}) AS sender,
   concat(text, coalesce({A.EXTRA_CASE}, '')) AS body
  FROM documents))"""

EMAILS_RAW = f"regexp_extract_all(body, {q(X.EMAIL_PATTERN)}, 0, 'i')"
_phone = X.PHONE_PATTERN.replace(r"[\s-]", f"[{WS_CLASS}-]").replace(
    r"\s", f"[{WS_CLASS}]").replace(r"\d", r"\p{Nd}")
PHONES_RAW = (f"list_filter(list_transform(regexp_extract_all(body, {q(_phone)}, 0), "
              f"lambda x: regexp_replace(x, {q(f'[{WS_CLASS}]+')}, ' ', 'g')), "
              r"lambda x: length(regexp_replace(x, '\P{Nd}', '', 'g')) >= 10)")
_triggers = "|".join(X.PRODUCT_TRIGGERS)
_leading = rf"^(?:{_triggers})[{WS_CLASS}]*[:\-]?[{WS_CLASS}]*"
PRODUCT = f"""coalesce(substring(list_filter(list_transform(list_filter(
  list_transform(string_split_regex(body, {q(LINE_BREAKS)}), lambda l: {trim('l')}),
  lambda l: length(l) <= 200 AND regexp_matches(lower(l), {q(_triggers)})),
  lambda l: trim(regexp_replace(lower(l), {q(_leading)}, ''), ' .;,-')),
  lambda l: length(l) >= 3)[1], 1, 120), '')"""
RULES = f"""raw_rules AS MATERIALIZED (
 SELECT *, {EMAILS_RAW} AS er, {PHONES_RAW} AS pr, {PRODUCT} AS product FROM messages),
rule_contacts AS MATERIALIZED (
 SELECT uid, subject, sender, body, size_bytes, product,
  {dedupe('er', lambda v: f'lower({v})')} AS emails,
  {dedupe('pr', lambda v: f"regexp_replace({v}, {q(chr(92) + 'P{Nd}')}, '', 'g')")} AS phones
 FROM raw_rules)"""


def rows(lst: str, pred: str) -> str:
    return f"len(list_filter({lst}, lambda x: {pred}))"


def score(name: str, company: str, position: str, product: str, emails: str, phones: str) -> str:
    texts = " + ".join(f"CASE WHEN {is_default(c)} THEN 0 ELSE 2 END"
                       for c in (name, company, position, product))
    lists = " + ".join(rows(c, f"{trim('x')} <> ''") for c in (emails, phones))
    return f"CAST({texts} + {lists} AS BIGINT)"


def basic_code(cfg, company="''", n_emails="0", n_phones="0") -> str:
    cases = []
    if cfg.subject_blacklist:
        cases.append((any_of("subject", cfg.subject_blacklist), "SUBJECT"))
    if cfg.body_blacklist:
        cases.append((any_of("body", cfg.body_blacklist), "BODY"))
    if cfg.sender_blacklist:
        start = "|".join(f"(?:{p.replace('*', '.*')})" for p in cfg.sender_blacklist)
        cases.append((found("sender", f"^(?:{start})"), "SENDER"))
    if cfg.exclude_replies:
        cases.append(("starts_with(lower(subject), 're:')", "REPLY"))
    if cfg.exclude_forwards:
        cases.append(("starts_with(lower(subject), 'fwd:')", "FORWARD"))

    def contains_any(names):
        return " OR ".join(f"contains(lower({company}), {q(n.lower())})" for n in names)
    if cfg.company_blacklist:
        cases.append((f"({contains_any(cfg.company_blacklist)})", "COMPANY_BLACKLIST"))
    if cfg.company_whitelist:
        cases.append((f"{company} = ''", "COMPANY_EMPTY"))
        cases.append((f"NOT ({contains_any(cfg.company_whitelist)})", "NOT_WHITELISTED"))
    cases.append((f"{company} <> '' AND length({company}) < {cfg.min_company_length}", "COMPANY_SHORT"))
    if cfg.min_email_count > 0:
        cases.append((f"{n_emails} < {cfg.min_email_count}", "FEW_EMAILS"))
    cases.append((f"{n_emails} + {n_phones} < {cfg.min_contact_info}", "NO_CONTACT"))
    if cfg.max_email_size_mb > 0:
        cases.append((f"size_bytes / 1048576.0::DOUBLE > {cfg.max_email_size_mb}", "TOO_LARGE"))
    if cfg.min_email_size_kb > 0:
        cases.append((f"size_bytes / 1024.0::DOUBLE < {cfg.min_email_size_kb}", "TOO_SMALL"))
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in cases) + " END"


def one_decimal(unit: int) -> str:
    """Half-even rounding of a byte count, on exact decimals."""
    whole = f"((size_bytes * 10) // {unit})"
    rest = f"((size_bytes * 10) % {unit})"
    tenths = (f"({whole} + CASE WHEN {rest} * 2 > {unit} OR ({rest} * 2 = {unit} "
              f"AND {whole} % 2 = 1) THEN 1 ELSE 0 END)")
    return f"concat({tenths} // 10, '.', {tenths} % 10)"


def reason(cfg, company="''", n_emails="0", n_phones="0") -> str:
    say = {
        "SUBJECT": "concat('Subject matches blacklist: ', substring(subject, 1, 50))",
        "BODY": "'Body contains blacklisted content'",
        "SENDER": "concat('Sender ', sender, ' is blacklisted')",
        "REPLY": "'Email is a reply (Re:)'",
        "FORWARD": "'Email is forwarded (Fwd:)'",
        "COMPANY_BLACKLIST": f"concat('Company ''', {company}, ''' is blacklisted (generic/useless company)')",
        "COMPANY_EMPTY": "'Company name is empty (whitelist mode requires company)'",
        "NOT_WHITELISTED": f"concat('Company ''', {company}, ''' not in whitelist')",
        "COMPANY_SHORT": f"concat('Company name too short: ', {company}, ' (', length({company}), ' chars)')",
        "FEW_EMAILS": f"concat('Not enough emails: ', {n_emails}, ' (min: {cfg.min_email_count})')",
        "NO_CONTACT": f"concat('Not enough contact info: ', {n_emails} + {n_phones}, ' (min: {cfg.min_contact_info})')",
        "TOO_LARGE": f"concat('Email size ', {one_decimal(1048576)}, 'MB exceeds limit {cfg.max_email_size_mb}MB')",
        "TOO_SMALL": f"concat('Email size ', {one_decimal(1024)}, 'KB is below minimum {cfg.min_email_size_kb}KB')",
    }
    if "subject" not in K_COLUMNS.get(company, ("subject",)):
        for k in ("SUBJECT", "SENDER", "TOO_LARGE", "TOO_SMALL"):
            say.pop(k)
    return "CASE reason_code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in say.items()) + " END"


# contact rows carry no subject, sender or size
K_COLUMNS = {"company": ("company",)}


def judged(cfg, source="messages") -> str:
    return (f"judged AS MATERIALIZED (SELECT *, reason_code IS NOT NULL AS is_spam, {reason(cfg)} AS reason "
            f"FROM (SELECT *, {basic_code(cfg)} AS reason_code FROM {source}))")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def hits(patterns) -> str:
    return "(" + " + ".join(f"CAST({found('t', p)} AS INTEGER)" for p in patterns) + ")"


_gap, _word = f"[{WS_CLASS}]+", f"[^{WS_CLASS}]+"
TEXT_POINTS = rf"""(CASE WHEN len(list_filter(string_split_regex(body, {q(_gap)}), lambda w: w <> '')) < 5 THEN 3 ELSE 0 END
 + CASE WHEN length(regexp_replace(body, '[^!?.,;:]', '', 'g')) / greatest(length(body), 1)::DOUBLE > 0.15 THEN 4 ELSE 0 END
 + CASE WHEN length(regexp_replace(body, '[^\p{{Nd}}]', '', 'g')) / greatest(length(body), 1)::DOUBLE > 0.2 THEN 3 ELSE 0 END)"""
SUSPICIOUS = rows("emails", found("x", "|".join(R.EMAIL_PATTERNS))) + " > 0"
PROBABILITY = "toxic * 0.85 + (1 - quality) * 0.05"


def risk(emails: str | None, probability: bool) -> str:
    """CTEs up to ``risk``: points, score and factors per message."""
    base = "rule_contacts" if emails else "messages"
    prob = f"coalesce(CAST({PROBABILITY} AS DOUBLE), 0)" if probability else "CAST(0 AS DOUBLE)"
    source = f"{base} b LEFT JOIN labels l ON b.uid = CAST(l.doc_id AS VARCHAR)" if probability else base
    email = f"CASE WHEN {SUSPICIOUS} THEN 15 ELSE 0 END" if emails else "0"
    return f"""hits AS MATERIALIZED (SELECT *, {hits(R.SPAM_PATTERNS)} AS sh, {hits(R.PHISHING_PATTERNS)} AS ph,
  {hits(R.FORMATTING_PATTERNS)} AS fh, {TEXT_POINTS} AS tp, {email} AS ep
 FROM (SELECT *, concat(body, subject) AS t, {prob} AS prob FROM {source})),
points AS (SELECT *, least(30, sh * 5) AS sp, least(35, ph * 7) AS pp, least(20, fh * 4) AS fp, prob * 20 AS mp FROM hits),
risk AS MATERIALIZED (SELECT *, greatest(0, least(100, sp + pp + fp + ep + mp + tp)) AS risk_score,
 list_filter([
  CASE WHEN sp > 0 THEN concat('Spam patterns detected (', sh, ' matches, +', sp, 'pts)') END,
  CASE WHEN pp > 0 THEN concat('Phishing indicators (', ph, ' matches, +', pp, 'pts)') END,
  CASE WHEN fp > 0 THEN concat('Suspicious formatting (', fh, ' issues, +', fp, 'pts)') END,
  CASE WHEN ep > 0 THEN 'Suspicious email addresses detected (+15pts)' END,
  CASE WHEN mp > 0 AND prob > 0.8 THEN concat('High spam probability (', printf('%.1f', prob * 100), '%)') END,
  CASE WHEN mp > 0 THEN concat('ML analysis risk: ', CAST(round_even(mp, 0) AS BIGINT), 'pts') END,
  CASE WHEN tp > 0 THEN concat('Poor text quality (+', tp, 'pts)') END], lambda f: f IS NOT NULL) AS factors
 FROM points)"""


CONTACTS = f"""contacts AS MATERIALIZED (
 SELECT CAST(o_orderkey AS VARCHAR) AS uid, concat(o_orderkey, '.json') AS filename,
  {', '.join(f'{A.CONTACT_SQL[k]} AS {k}' for k in ('full_name', 'company', 'position', 'product'))},
  list_filter([{A.CONTACT_SQL['e1']}, {A.CONTACT_SQL['e2']}], lambda x: x IS NOT NULL) AS emails,
  list_filter([{A.CONTACT_SQL['p1']}], lambda x: x IS NOT NULL) AS phones
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

_list = "concat('[', array_to_string(list_transform({0}, lambda x: concat('\"', x, '\"')), ','), ']')"
_E, _P = _list.format("emails"), _list.format("phones")
_S = {k: f"concat('\"', {k}, '\"')" for k in ("full_name", "company", "position", "product")}
REPLIES = f"""shapes AS (SELECT *, {_E} AS ej, {_P} AS pj, concat('{{"full_name": ', {_S['full_name']}, ', "emails": ', {_E},
  ', "phones": ', {_P}, ', "company": ', {_S['company']}, ', "position": ', {_S['position']},
  ', "product": ', {_S['product']}, '}}') AS plain FROM contacts),
replies AS MATERIALIZED (SELECT uid, filename, CASE CAST(uid AS BIGINT) % 8
  WHEN 0 THEN plain
  WHEN 1 THEN concat('"', replace(plain, '"', '\\"'), '"')
  WHEN 2 THEN concat('{{"full_name": ', {_S['full_name']}, ', "emails": "', array_to_string(emails, ', '),
     '", "phones": 84951234567, "company": ', {_S['company']}, '}}')
  WHEN 3 THEN concat('{{"full_name": null, "emails": null, "phones": 0, "company": true, "position": 12, "product": ',
     {_S['product']}, '}}')
  WHEN 4 THEN substring(plain, 1, 25) WHEN 5 THEN '' WHEN 6 THEN concat('[', ej, ']')
  ELSE concat('{{"Company": ', {_S['company']}, ', "id": 7, "contact_Name": ', {_S['full_name']}, ', "emails": ', ej,
     ', "phones": ', pj, '}}') END AS reply FROM shapes)"""

# a JSON string is decoded once; the flag tells whether the text parses
DECODED = """decoded AS MATERIALIZED (SELECT *, CASE WHEN json_valid(reply) THEN
   CASE WHEN json_type(reply) = 'VARCHAR' THEN json_extract_string(reply, '$') ELSE reply END END AS inner_text
 FROM replies),
parsed AS MATERIALIZED (SELECT *, CASE WHEN json_valid(inner_text) THEN inner_text ELSE '{}' END AS j FROM decoded)"""


def jtype(path: str) -> str:
    return f"coalesce(json_type(j, '$.{path}'), 'MISSING')"


def jstr(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


def norm_text(path: str) -> str:
    return (f"CASE {jtype(path)} WHEN 'MISSING' THEN '' WHEN 'NULL' THEN 'None' "
            f"WHEN 'BOOLEAN' THEN concat(upper({jstr(path)}[1]), {jstr(path)}[2:]) ELSE {jstr(path)} END")


def norm_list(path: str) -> str:
    items = (f"CASE {jtype(path)} WHEN 'VARCHAR' THEN list_transform(string_split({jstr(path)}, ','), lambda x: {trim('x')}) "
             f"WHEN 'ARRAY' THEN json_extract_string(j, '$.{path}[*]') "
             f"WHEN 'MISSING' THEN CAST([] AS VARCHAR[]) WHEN 'NULL' THEN CAST([] AS VARCHAR[]) "
             f"ELSE CASE WHEN {jstr(path)} = '0' THEN CAST([] AS VARCHAR[]) ELSE [{jstr(path)}] END END")
    return f"list_filter({items}, lambda x: {trim('x')} <> '')"


NORMALIZED = ("normalized AS MATERIALIZED (SELECT uid, "
              + ", ".join(f"{norm_text(p)} AS {p}" for p in ("full_name", "company", "position", "product"))
              + ", " + ", ".join(f"{norm_list(p)} AS {p}" for p in ("emails", "phones"))
              + " FROM (SELECT * REPLACE (CASE WHEN json_type(j) = 'OBJECT' THEN j ELSE '{}' END AS j) FROM parsed))")


def view_text(field: str, default: str) -> str:
    tries = [f"CASE WHEN {jtype(a)} NOT IN ('MISSING', 'NULL') AND {jstr(a)} NOT IN ('', '0', 'false') "
             f"THEN CASE WHEN {jtype(a)} = 'BOOLEAN' THEN 'True' ELSE {jstr(a)} END END"
             for a in V.ALIASES[field]]
    return f"coalesce({', '.join(tries)}, {q(default)})"


def view_list(path: str) -> str:
    return (f"CASE {jtype(path)} WHEN 'ARRAY' THEN json_extract_string(j, '$.{path}[*]') "
            f"WHEN 'MISSING' THEN CAST([] AS VARCHAR[]) WHEN 'NULL' THEN CAST([] AS VARCHAR[]) "
            f"ELSE CASE WHEN {jstr(path)} IN ('0', '') THEN CAST([] AS VARCHAR[]) ELSE [{jstr(path)}] END END")


def by_status(ok: str, bad_json: str, bad_object: str) -> str:
    return f"CASE parse_status WHEN 'ok' THEN {ok} WHEN 'not_json' THEN {bad_json} ELSE {bad_object} END"


_none = "CAST([] AS VARCHAR[])"
VIEW = f"""status AS (SELECT *, CASE WHEN inner_text IS NULL THEN 'not_json' WHEN json_type(j) = 'OBJECT' THEN 'ok'
  ELSE 'not_object' END AS parse_status FROM parsed),
named AS (SELECT *, {view_text('full_name', V.NOT_GIVEN)} AS fn FROM status),
view AS MATERIALIZED (SELECT filename, parse_status,
 {by_status(f"CASE WHEN fn = {q(V.NOT_GIVEN)} AND json_type(j, '$.contact_Name') IS NOT NULL THEN json_extract_string(j, '$.contact_Name') WHEN fn = {q(V.NOT_GIVEN)} AND json_type(j, '$.full_name') = 'VARCHAR' THEN json_extract_string(j, '$.full_name') ELSE fn END",
            f"concat({q(V.BAD_JSON_NAME)}, filename)", f"concat({q(V.BAD_FILE_NAME)}, filename)")} AS full_name,
 {by_status(view_text('company', V.NOT_GIVEN), q(V.BAD_JSON_COMPANY), q(V.BAD_FILE_COMPANY))} AS company,
 {by_status(view_text('position', V.NOT_GIVEN), q(V.BAD_POSITION), q(V.BAD_POSITION))} AS position,
 {by_status(view_text('product', V.NOT_FOUND), "''", q(V.NOT_FOUND))} AS product,
 {by_status(view_list('emails'), _none, _none)} AS emails, {by_status(view_list('phones'), _none, _none)} AS phones,
 {by_status(trim('reply'), trim('reply'), q("'list' object has no attribute 'get'"))} AS raw_content FROM named)"""

SUFFICIENT = (f"(NOT {is_default('company')} AND ({rows('emails', trim('x') + chr(60) + '>' + q(''))} > 0 "
              f"OR {rows('phones', trim('x') + chr(60) + '>' + q(''))} > 0 OR NOT {is_default('full_name')}))")
GROUPED = f"""keyed AS MATERIALIZED (SELECT *, CASE WHEN NOT {is_default('company')} THEN 'company'
   WHEN NOT {is_default('product')} THEN 'product' WHEN NOT {is_default('full_name')} THEN 'name' END AS group_type,
  CASE WHEN NOT {is_default('company')} THEN {trim('company')} WHEN NOT {is_default('product')} THEN {trim('product')}
   ELSE {trim('full_name')} END AS shown FROM selected),
groups AS MATERIALIZED (SELECT group_type, lower(shown) AS group_key,
  arg_min(concat(CASE group_type WHEN 'company' THEN '🏢 ' WHEN 'product' THEN '📦 ' ELSE '👤 ' END, shown), filename) AS group_name,
  count(*) AS n, min(filename) AS first_file FROM keyed WHERE group_type IS NOT NULL GROUP BY ALL)"""
ALL_SELECTED = "selected AS (SELECT * FROM contacts)"


def match(query: str) -> str:
    texts = " OR ".join(f"contains(lower(coalesce({c}, '')), {q(query)})"
                        for c in ("full_name", "company", "position", "product"))
    lists = " OR ".join(rows(c, f"contains(lower(x), {q(query)})") + " > 0" for c in ("emails", "phones"))
    return f"({texts} OR {lists})"


# visible text of a page, node by node
_hidden = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "template", "rt", "rp"))
_tag = r"""<[a-zA-Z/!?][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>|<[a-zA-Z/!?][^>]*>"""
# a reference cut off by the end of the page stays as it is
_whole = "regexp_replace(html, '&([a-zA-Z][a-zA-Z0-9.-]*)$', '&amp;" + chr(92) + "1')"
_nodes = f"string_split_regex(regexp_replace({_whole}, {q(f'(?is)<!--.*?-->|{_hidden}')}, '<r>', 'g'), {q(_tag)})"
_entity = "n"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\xa0"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    # the semicolon may be missing before a tag or another character
    _entity = (f"regexp_replace({_entity}, '&{_name}(?:;|([^a-zA-Z0-9;.-])|$)', "
               + q(_char + chr(92) + "1") + ", 'g')")
HTML_TEXT = (f"array_to_string(list_filter(list_transform({_nodes}, lambda n: {trim(_entity)}), "
             f"lambda n: n <> ''), chr(10))")

THREADS = """threads AS (SELECT concat(conv_id, '-', turn) AS uid,
  concat(CASE WHEN turn > 0 THEN 'RE: ' WHEN role = 'system' THEN 'Fwd: ' ELSE 'Fw: ' END, 'thread ', conv_id) AS subject,
  concat(role, '@chat.example.com') AS sender, text AS body, CAST(strlen(text) AS BIGINT) AS size_bytes FROM conversations)"""

ENTITIES = f"""words AS (SELECT CAST(doc_id AS VARCHAR) AS uid, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
labelled AS MATERIALIZED (SELECT uid, {trim('word')} AS word, pos, ((pos * 7) % 10) / 10.0::DOUBLE AS score,
  CASE WHEN pos % 7 IN (0, 2) THEN 'full_name' WHEN pos % 7 IN (1, 3) THEN 'company' END AS role FROM words),
ranked AS MATERIALIZED (SELECT uid, role, word FROM labelled WHERE role IS NOT NULL AND word <> ''
  QUALIFY row_number() OVER (PARTITION BY uid, role ORDER BY length(word) DESC, score DESC, pos) = 1),
picked AS MATERIALIZED (SELECT uid, coalesce(max(CASE WHEN role = 'full_name' THEN word END), '') AS full_name,
  coalesce(max(CASE WHEN role = 'company' THEN word END), '') AS company FROM ranked GROUP BY uid)"""

SECOND = """second AS MATERIALIZED (SELECT uid, split_part(sender, '@', 1) AS b_name, [sender] AS b_emails,
  CASE WHEN size_bytes % 2 = 0 THEN '' ELSE split_part(sender, '@', 2) END AS b_company
 FROM messages WHERE NOT starts_with(sender, 'noreply'))"""
_score_a = score("''", "''", "''", "product", "emails", "phones")
_score_b = score("b_name", "b_company", "'Не указано'", "''", "b_emails", "CAST([] AS VARCHAR[])")
PAIRED = f"""paired AS MATERIALIZED (SELECT r.*, b_name, b_emails, b_company, s.uid IS NOT NULL AS has_b,
  {_score_a} AS score_a, CASE WHEN s.uid IS NULL THEN 0 ELSE {_score_b} END AS score_b
 FROM rule_contacts r LEFT JOIN second s ON r.uid = s.uid)"""


def pick_b(cond: str, more: str = "") -> str:
    return f"""SELECT uid, CASE WHEN {cond} THEN b_name ELSE '' END AS full_name,
 CASE WHEN {cond} THEN {text_list('b_emails')} ELSE {text_list('emails')} END AS emails,
 CASE WHEN {cond} THEN '' ELSE {text_list('phones')} END AS phones,
 CASE WHEN {cond} THEN b_company ELSE '' END AS company,
 CASE WHEN {cond} THEN 'Не указано' ELSE '' END AS position,
 CASE WHEN {cond} THEN '' ELSE product END AS product{more} FROM paired"""


_RULES = K.B.text_rules(K.SHIPPED)


def _rule_hit(rule) -> str:
    pattern = rule.pattern.replace("*", ".*")
    return found(rule.kind, f"^(?:{pattern})" if rule.kind == "sender" else pattern)


RULE_HITS = "rules(rule_id, kind, pattern) AS (VALUES " + ", ".join(
    f"(CAST({r.rule_id} AS BIGINT), {q(r.kind)}, {q(r.pattern)})" for r in _RULES) + """),
fired AS MATERIALIZED (SELECT uid, unnest(list_filter([""" + ", ".join(
    f"CASE WHEN {_rule_hit(r)} THEN CAST({r.rule_id} AS BIGINT) END" for r in _RULES) + """], lambda x: x IS NOT NULL)) AS rule_id FROM messages),
rule_hits AS MATERIALIZED (SELECT uid, rule_id, kind, pattern FROM fired JOIN rules USING (rule_id))"""

LEDGER = "SELECT CAST(doc_id AS VARCHAR) FROM labels"
USERS = "SELECT CAST(user_id AS VARCHAR) FROM events"
REJECTED = f"""stamped AS MATERIALIZED (SELECT j.uid, reason_code, reason, coalesce(e.ts, TIMESTAMP '2020-01-01') AS ts
 FROM judged j LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS uid, max(ts) AS ts FROM events GROUP BY ALL) e ON j.uid = e.uid
 WHERE is_spam)"""


def stored(where: str = "") -> str:
    return f"""SELECT uid, CASE WHEN code IS NULL THEN 'accepted' ELSE 'rejected' END AS status, code AS reason_code,
 CASE WHEN code IS NULL THEN {text_list('emails')} ELSE '' END AS emails,
 CASE WHEN code IS NULL THEN product ELSE '' END AS product FROM final {where}"""


def final(code: str, source: str) -> str:
    return f"final AS (SELECT *, {code} AS code FROM {source})"


_advanced = f"coalesce({basic_code(K.SHIPPED)}, CASE WHEN risk_score >= 60 THEN 'RISK' END)"
FULL = (MESSAGES, RULES, risk("emails", True))
PLAIN_RISK = (MESSAGES, RULES, risk(None, False),
              f"final AS (SELECT r.uid, {_advanced.replace('risk_score', 'k.risk_score')} AS code, r.emails, r.phones, r.product "
              "FROM (SELECT * FROM rule_contacts) r JOIN (SELECT uid, risk_score FROM risk) k ON r.uid = k.uid)")

_contact = (f"uid, full_name, {text_list('emails')} AS emails, {text_list('phones')} AS phones, "
            "company, position, product")

SQL: dict[str, str] = {
    "extract_emails": with_(MESSAGES, RULES) + f"SELECT uid, {text_list('emails')} AS emails FROM rule_contacts",
    "extract_phones": with_(MESSAGES, RULES) + f"SELECT uid, {text_list('phones')} AS phones FROM rule_contacts",
    "extract_product": with_(MESSAGES, RULES) + "SELECT uid, product FROM rule_contacts",
    "rule_contacts": with_(MESSAGES, RULES) + f"SELECT uid, '' AS full_name, {text_list('emails')} AS emails, "
                     f"{text_list('phones')} AS phones, '' AS company, '' AS position, product FROM rule_contacts",
    "quality_score": with_(CONTACTS) + f"SELECT uid, {score('full_name', 'company', 'position', 'product', 'emails', 'phones')} AS score FROM contacts",
    "best_contact": with_(MESSAGES, RULES, SECOND, PAIRED) + pick_b("score_b > score_a", ", score_a, score_b"),
    "contact_fallback": with_(MESSAGES, RULES, SECOND, PAIRED) + pick_b("has_b"),
    "pick_entities": with_(ENTITIES) + "SELECT * FROM picked",
    "pick_entities_window": with_(ENTITIES) + "SELECT uid, role, word FROM ranked",
    "model_contacts": with_(MESSAGES, RULES, ENTITIES) + f"""SELECT r.uid, coalesce(full_name, '') AS full_name,
 {text_list('emails')} AS emails, {text_list('phones')} AS phones, coalesce(company, '') AS company, '' AS position, product
 FROM rule_contacts r LEFT JOIN picked p ON r.uid = p.uid""",
    "extractor_choice": with_(MESSAGES, RULES, CONTACTS, REPLIES, DECODED, NORMALIZED) + f"""
, both_ AS (SELECT {score("''", "''", "''", "r.product", "r.emails", "r.phones")} AS sa, len(r.emails) AS ea,
   n.uid IS NOT NULL AS has, {score('n.full_name', 'n.company', 'n.position', 'n.product', 'n.emails', 'n.phones')} AS sb,
   len(n.emails) AS eb, n.company AS cb FROM rule_contacts r LEFT JOIN normalized n ON r.uid = n.uid),
 scored AS (SELECT sa, ea, CASE WHEN has THEN sb ELSE 0 END AS sb, coalesce(eb, 0) AS eb, coalesce(cb, '') AS cb FROM both_)
SELECT 'rules' AS engine, count(*) AS n, CAST(sum(sa) AS BIGINT) AS total_score, CAST(0 AS BIGINT) AS n_company, CAST(sum(ea) AS BIGINT) AS n_emails FROM scored
UNION ALL SELECT 'table', count(*), CAST(sum(sb) AS BIGINT), count(*) FILTER (WHERE cb <> ''), CAST(sum(eb) AS BIGINT) FROM scored
UNION ALL SELECT 'best', count(*), CAST(sum(greatest(sa, sb)) AS BIGINT), count(*) FILTER (WHERE sb > sa AND cb <> ''),
 CAST(sum(CASE WHEN sb > sa THEN eb ELSE ea END) AS BIGINT) FROM scored""",
    "prompts": with_(MESSAGES) + f"""SELECT uid, md5(p) AS prompt_md5, length(p) AS chars
 FROM (SELECT uid, concat({q(X.PROMPT_HEAD)}, body, {q(X.PROMPT_TAIL)}) AS p FROM messages)""",
    "reply_unwrap": with_(CONTACTS, REPLIES, DECODED) + "SELECT uid, j AS json FROM parsed",
    "normalize_contact": with_(CONTACTS, REPLIES, DECODED, NORMALIZED) + f"SELECT {_contact} FROM normalized",
    "load_json_safe": with_(CONTACTS, REPLIES) + """SELECT uid, CASE WHEN json_valid(reply) THEN
 CASE WHEN json_type(reply) = 'OBJECT' THEN reply ELSE '{}' END ELSE '{}' END AS json FROM replies""",
    "html_text": f"""SELECT page_id, md5(t) AS text_md5, length(t) AS chars, CAST(strlen(t) AS BIGINT) AS octets
 FROM (SELECT page_id, {HTML_TEXT} AS t FROM pages)""",
    "message_text": f"""SELECT CAST(page_id AS VARCHAR) AS uid, 'page' AS subject, 'web@example.com' AS sender,
 md5(CASE WHEN page_id % 2 = 0 THEN {HTML_TEXT} ELSE {HTML_TEXT} END) AS body_md5 FROM pages""".replace(
        f"CASE WHEN page_id % 2 = 0 THEN {HTML_TEXT} ELSE", "CASE WHEN page_id % 2 = 0 THEN url ELSE"),
    "parse_messages": with_(MESSAGES) + "SELECT uid, subject, sender, md5(body) AS body_md5, true AS raw_is_larger FROM messages",
    "decode_header": with_(MESSAGES) + f"SELECT uid, {trim('concat(subject, chr(1094), chr(32), sender)')} AS header FROM messages",
    "fold_text": with_(CONTACTS) + f"SELECT uid, lower(company) AS company, {text_list('list_transform(emails, lambda x: lower(x))')} AS emails FROM contacts",
    "subject_blacklist": with_(MESSAGES) + f"SELECT uid, {any_of('subject', K.SHIPPED.subject_blacklist)} AS hit FROM messages",
    "body_blacklist": with_(MESSAGES) + f"SELECT uid, {any_of('body', K.SHIPPED.body_blacklist)} AS hit FROM messages",
    "sender_blacklist": with_(MESSAGES) + "SELECT uid, " + found("sender", "^(?:" + "|".join(
        p.replace("*", ".*") for p in K.SHIPPED.sender_blacklist) + ")") + " AS hit FROM messages",
    "reply_filter": with_(THREADS) + "SELECT uid, starts_with(lower(subject), 're:') AS hit FROM threads",
    "forward_filter": with_(THREADS) + "SELECT uid, starts_with(lower(subject), 'fwd:') AS hit FROM threads",
    "thread_verdict": with_(THREADS) + """SELECT uid, reason_code IS NOT NULL AS is_spam, reason_code,
 CASE reason_code WHEN 'REPLY' THEN 'Email is a reply (Re:)' WHEN 'FORWARD' THEN 'Email is forwarded (Fwd:)' END AS reason
 FROM (SELECT uid, CASE WHEN subject LIKE 'RE:%' THEN 'REPLY' WHEN subject LIKE 'Fwd:%' THEN 'FORWARD' END AS reason_code FROM threads)""",
    "company_blacklist": with_(CONTACTS) + "SELECT uid, (" + " OR ".join(
        f"contains(lower(company), {q(n.lower())})" for n in K.SHIPPED.company_blacklist) + ") AS hit FROM contacts",
    "size_limits": with_(MESSAGES, judged(K.SIZE_CFG)) + "SELECT uid, is_spam, reason_code, reason FROM judged",
    "basic_verdict": with_(MESSAGES, judged(K.SHIPPED)) + "SELECT uid, is_spam, reason_code, reason FROM judged",
    "should_process": with_(MESSAGES, judged(K.SHIPPED)) + "SELECT uid, NOT is_spam AS should_process, reason_code FROM judged",
    "rule_hits": with_(MESSAGES, RULE_HITS) + "SELECT uid, rule_id, kind, pattern FROM rule_hits",
    "rule_hit_verdict": with_(MESSAGES, RULE_HITS) + """SELECT uid, upper(arg_min(kind, rule_id)) AS reason_code,
 count(*) AS n_hits FROM rule_hits GROUP BY uid""",
    "rule_usage": with_(MESSAGES, RULE_HITS) + """SELECT r.rule_id, r.kind, r.pattern, count(f.uid) AS n_messages
 FROM rules r LEFT JOIN fired f ON r.rule_id = f.rule_id GROUP BY ALL""",
    "rule_table": with_(MESSAGES, "table_rules AS (" + K.TABLE_RULES.format(", 'g'") + ")",
                        "held AS MATERIALIZED (SELECT *, (SELECT lower(max_by(x, length(x))) FROM unnest(string_split(pattern, '.')) u(x)) AS piece "
                        "FROM table_rules)", "low AS MATERIALIZED (SELECT *, lower(body) AS low FROM messages)") + """
SELECT uid, CAST(rule_id AS BIGINT) AS rule_id, kind, pattern FROM low JOIN held ON CASE
 WHEN kind = 'body' THEN CASE WHEN contains(low, piece) THEN regexp_matches(body, pattern, 'i') ELSE false END
 WHEN kind = 'sender' THEN regexp_matches(sender, concat('^(?:', replace(pattern, '*', '.*'), ')'), 'i')
 ELSE regexp_matches(subject, pattern, 'i') END""",
    "email_points": with_(MESSAGES, RULES) + f"SELECT uid, {SUSPICIOUS} AS suspicious FROM rule_contacts",
    "text_quality": with_(MESSAGES) + f"SELECT uid, CAST({TEXT_POINTS} AS BIGINT) AS points FROM messages",
    "ml_points": f"""SELECT CAST(d.doc_id AS VARCHAR) AS uid, round(coalesce(CAST({PROBABILITY} AS DOUBLE), 0) * 20, 6) AS points
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "risk_score": with_(*FULL) + """SELECT uid, CAST(sp AS BIGINT) AS spam_points, CAST(pp AS BIGINT) AS phishing_points,
 CAST(fp AS BIGINT) AS formatting_points, CAST(ep AS BIGINT) AS email_points, CAST(tp AS BIGINT) AS text_points,
 round(risk_score, 6) AS risk_score FROM risk""",
    "risk_factors": with_(*FULL) + f"SELECT uid, {text_list('factors')} AS factors FROM risk",
    "advanced_verdict": with_(MESSAGES, risk(None, True)) + f"""SELECT uid, reason_code IS NOT NULL AS is_spam, reason_code,
 CASE WHEN reason_code = 'RISK' THEN concat('High spam risk score: ', CAST(round_even(risk_score, 0) AS BIGINT), '/100. Reasons: ',
  array_to_string(factors[1:3], ', ')) ELSE {reason(K.SHIPPED)} END AS reason
 FROM (SELECT *, coalesce({basic_code(K.SHIPPED)}, CASE WHEN risk_score >= 40 THEN 'RISK' END) AS reason_code FROM risk)""",
    "risk_profile": with_(MESSAGES, risk(None, False)) + f"""SELECT uid, round(risk_score, 6) AS risk_score,
 CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 CASE WHEN risk_score >= 80 THEN '🔴 CRITICAL' WHEN risk_score >= 60 THEN '🟠 HIGH' WHEN risk_score >= 40 THEN '🟡 MEDIUM' ELSE '🟢 LOW' END AS risk_label,
 CAST(0 AS DOUBLE) AS ml_spam_probability, {text_list('factors')} AS factors, sender, substring(subject, 1, 50) AS subject,
 'Unknown' AS company, CASE WHEN risk_score >= 80 THEN 'BLOCK' WHEN risk_score >= 60 THEN 'REVIEW' ELSE 'PROCESS' END AS recommendation FROM risk""",
    "drop_processed": with_(MESSAGES) + f"SELECT uid, sender, size_bytes FROM messages WHERE uid NOT IN ({LEDGER})",
    "only_missing": with_(MESSAGES) + f"SELECT uid, sender, size_bytes FROM messages WHERE uid NOT IN ({USERS})",
    "split_spam": with_(MESSAGES, judged(K.SHIPPED)) + """SELECT uid, CASE WHEN is_spam THEN 'rejected' ELSE 'accepted' END AS side,
 reason_code FROM judged""",
    "isolate_errors": with_(MESSAGES) + """SELECT CASE WHEN bad THEN '' ELSE sender END AS sender,
 count(*) FILTER (NOT bad) AS n_good, count(*) FILTER (bad) AS n_bad
 FROM (SELECT sender, CAST(uid AS BIGINT) % 7 = 0 AS bad FROM messages) GROUP BY 1""",
    "ingest_accepted": with_(*PLAIN_RISK) + stored(f"WHERE uid NOT IN ({LEDGER})"),
    "ingest_replayed": with_(*PLAIN_RISK) + stored(f"WHERE uid NOT IN ({LEDGER})"),
    "reprocess_results": with_(MESSAGES, RULES, final(basic_code(K.SHIPPED), "rule_contacts")) + f"""
, kept AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS uid FROM labels WHERE CAST(doc_id AS VARCHAR) NOT IN ({USERS}))
{stored('WHERE uid NOT IN (SELECT uid FROM kept)')}
UNION ALL SELECT uid, 'accepted', NULL, '', 'kept' FROM kept""",
    "eml_roundtrip": with_(THREADS) + "SELECT uid, subject, sender, md5(body) AS body_md5 FROM threads",
    "results_roundtrip": """SELECT concat(s_suppkey, '.json') AS filename, 'Sales' AS full_name, s_name AS company,
 'Не указано' AS position, concat('info@s', s_suppkey, '.example') AS emails, 'Не найдено' AS product, 'ok' AS parse_status FROM supplier""",
    "results_upsert": """SELECT coalesce(n.uid, s.uid) AS uid, coalesce(n.value, s.value) AS value,
 concat(coalesce(n.uid, s.uid), '.json') AS filename
 FROM (SELECT CAST(s_suppkey AS VARCHAR) AS uid, concat('{"full_name": "Sales", "emails": ["info@s', s_suppkey,
   '.example"], "phones": [], "company": "', s_name, '", "position": "", "product": ""}') AS value FROM supplier) s
 FULL JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS uid, n_name AS value FROM nation) n ON s.uid = n.uid""",
    "ledger_json": "SELECT CAST(user_id AS VARCHAR) AS uid FROM events UNION SELECT CAST(doc_id AS VARCHAR) FROM labels",
    "ledger_roundtrip": "SELECT CAST(user_id AS VARCHAR) AS uid FROM events UNION SELECT CAST(doc_id AS VARCHAR) FROM labels",
    "stored_contact": """SELECT '7' AS uid, coalesce((SELECT n_name FROM nation WHERE n_nationkey = 7), (SELECT
 concat('{"full_name": "Sales", "emails": ["info@s7.example"], "phones": [], "company": "', s_name,
   '", "position": "", "product": ""}') FROM supplier WHERE s_suppkey = 7)) AS value, '7.json' AS filename""",
    "indexed_search": with_(CONTACTS, REPLIES, DECODED, VIEW) + f"""SELECT filename, full_name, company FROM view
 WHERE {match('00000001')} AND filename NOT IN (SELECT concat(s_suppkey, '.json') FROM supplier)
UNION ALL SELECT concat(s_suppkey, '.json'), 'Sales', s_name FROM supplier WHERE contains(s_name, '00000001')
 OR contains(concat('info@s', s_suppkey, '.example'), '00000001')""",
    "sketched_stats": with_(CONTACTS, REPLIES, DECODED, VIEW) + """SELECT count(*) AS n_records, count(DISTINCT nullif(company, '')) AS n_companies,
 (SELECT count(DISTINCT e) FROM (SELECT unnest(emails) AS e FROM view)) AS n_emails,
 (SELECT count(DISTINCT p) FROM (SELECT unnest(phones) AS p FROM view)) AS n_phones,
 count(DISTINCT nullif(product, '')) AS n_products,
 true AS n_records_near, true AS n_companies_near, true AS n_emails_near, true AS n_phones_near, true AS n_products_near FROM view""",
    "frequent_products": with_(CONTACTS, REPLIES, DECODED, VIEW) + """SELECT product AS value,
 count(*) + count(*) FILTER (CAST(replace(filename, '.json', '') AS BIGINT) % 3 = 0) AS n
 FROM view WHERE product <> '' GROUP BY product ORDER BY n DESC, product LIMIT 10""",
    "review_upsert": with_(MESSAGES) + f"""SELECT uid, subject, CASE WHEN body_code IS NULL THEN concat('Subject matches blacklist: ', substring(subject, 1, 50))
 WHEN body_code = 'BODY' THEN 'Body contains blacklisted content' ELSE concat('Sender ', sender, ' is blacklisted') END AS reason
 FROM (SELECT *, {basic_code(K.SHIPPED)} AS code, {basic_code(K.SHIPPED.with_(subject_blacklist=()))} AS body_code FROM messages)
 WHERE code IS NOT NULL""",
    "raw_archive": with_(MESSAGES, judged(K.SHIPPED)) + "SELECT uid, md5(body) AS raw_md5 FROM judged WHERE NOT is_spam",
    "sufficient_contacts": with_(CONTACTS) + f"SELECT filename, company, full_name FROM contacts WHERE {SUFFICIENT}",
    "normalize_view": with_(CONTACTS, REPLIES, DECODED, VIEW) + f"""SELECT filename, full_name, company, position,
 {text_list('emails')} AS emails, {text_list('phones')} AS phones, product, raw_content, parse_status FROM view""",
    "scan_contacts": with_(CONTACTS, REPLIES, DECODED, VIEW) + f"""SELECT parse_status, count(*) AS n,
 count(DISTINCT company) AS n_companies FROM view WHERE {SUFFICIENT} GROUP BY parse_status""",
    "search_contacts": with_(CONTACTS) + f"SELECT filename, company FROM contacts WHERE {match('vega')}",
    "search_company": with_(CONTACTS) + "SELECT filename, company FROM contacts WHERE contains(lower(company), 'building')",
    "get_contact": with_(CONTACTS) + "SELECT filename, company, position FROM contacts WHERE filename = '77.json'",
    "group_contacts": with_(CONTACTS, ALL_SELECTED, GROUPED) + "SELECT * FROM groups",
    "group_totals": with_(CONTACTS, ALL_SELECTED, GROUPED) + "SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_files FROM groups",
    "group_members": with_(CONTACTS, ALL_SELECTED, GROUPED) + """SELECT filename, k.group_type, group_key, group_name, n
 FROM keyed k JOIN groups g ON k.group_type = g.group_type AND lower(k.shown) = g.group_key""",
    "group_pages": with_(CONTACTS, ALL_SELECTED, GROUPED) + "SELECT group_type, group_key, group_name, n, n AS n_members, first_file FROM groups",
    "list_groups": with_(CONTACTS, f"selected AS (SELECT * FROM contacts WHERE {SUFFICIENT})", GROUPED) + "SELECT * FROM groups",
    "search_groups": with_(CONTACTS, f"selected AS (SELECT * FROM contacts WHERE {SUFFICIENT} AND {match('nation_1')})", GROUPED)
                     + "SELECT * FROM groups",
    "export_rows": with_(CONTACTS) + f"""SELECT filename, full_name, company, position, array_to_string(emails, ', ') AS emails,
 array_to_string(phones, ', ') AS phones, product, '' AS raw_content FROM contacts WHERE {match('grade f')}""",
    "crm_rows": with_(CONTACTS) + f"""SELECT full_name AS name, company, {text_list('emails')} AS emails, {text_list('phones')} AS phones,
 position FROM contacts""",
    "sheet_rows": with_(CONTACTS) + """SELECT full_name, array_to_string(emails, ',') AS emails, array_to_string(phones, ',') AS phones,
 company, position, product FROM contacts""",
    "rejection_summary": with_(MESSAGES, judged(K.SHIPPED)) + """SELECT coalesce(reason_code, 'TOTAL') AS reason_code, count(*) AS n
 FROM judged WHERE is_spam GROUP BY ROLLUP (reason_code)""",
    "last_rejections": with_(MESSAGES, judged(K.SHIPPED), REJECTED) + """SELECT row_number() OVER (ORDER BY ts, uid) AS position, uid, reason
 FROM (SELECT * FROM stamped ORDER BY ts DESC, uid DESC LIMIT 5)""",
    "corpus_stats": with_(CONTACTS) + """SELECT count(*) AS n_records, count(DISTINCT nullif(company, '')) AS n_companies,
 (SELECT count(DISTINCT e) FROM (SELECT unnest(emails) AS e FROM contacts)) AS n_emails,
 (SELECT count(DISTINCT p) FROM (SELECT unnest(phones) AS p FROM contacts)) AS n_phones,
 count(DISTINCT nullif(product, '')) AS n_products FROM contacts""",
    "top_companies": with_(CONTACTS) + """SELECT company, count(*) AS n FROM contacts WHERE company <> '' GROUP BY company
 ORDER BY n DESC, company LIMIT 10""",
    "latest_stats": with_(CONTACTS) + """, head AS (SELECT * FROM contacts ORDER BY filename LIMIT 10)
SELECT (SELECT count(*) FROM contacts) AS n_records, (SELECT count(DISTINCT company) FROM head) AS n_companies,
 (SELECT string_agg(full_name, ', ' ORDER BY filename) FROM (SELECT * FROM head ORDER BY filename LIMIT 5)) AS latest_names""",
    "validate_results": with_(CONTACTS, REPLIES) + """, typed AS (SELECT filename, CASE WHEN NOT json_valid(reply) THEN 'bad'
  ELSE json_type(reply) END AS t, CASE WHEN json_valid(reply) AND json_type(reply) = 'OBJECT' THEN reply ELSE '{}' END AS j FROM replies),
 kinds AS (SELECT *, array_to_string(list_filter(['full_name', 'emails', 'phones', 'company', 'position', 'product'],
   lambda k: NOT list_contains(json_keys(j), k)), ',') AS missing,
  CASE json_type(j, '$.emails') WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'number' END AS ek,
  CASE json_type(j, '$.phones') WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'number' END AS pk
  FROM typed)
SELECT filename, 'INVALID_JSON' AS issue, '' AS detail FROM kinds WHERE t = 'bad'
UNION ALL SELECT filename, 'NOT_OBJECT', CASE t WHEN 'ARRAY' THEN 'array' ELSE 'string' END FROM kinds WHERE t NOT IN ('bad', 'OBJECT')
UNION ALL SELECT filename, 'MISSING_KEYS', missing FROM kinds WHERE t = 'OBJECT' AND missing <> ''
UNION ALL SELECT filename, 'EMAILS_NOT_LIST', ek FROM kinds WHERE t = 'OBJECT' AND ek <> 'array'
UNION ALL SELECT filename, 'PHONES_NOT_LIST', pk FROM kinds WHERE t = 'OBJECT' AND pk <> 'array'""",
    "evaluate_verdicts": with_(MESSAGES, judged(K.SHIPPED)) + """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_spam = (toxic = 1)) AS n_correct,
  count(*) FILTER (WHERE is_spam AND toxic = 1) AS true_positive, count(*) FILTER (WHERE is_spam AND toxic <> 1) AS false_positive,
  count(*) FILTER (WHERE NOT is_spam AND toxic = 1) AS false_negative, count(*) FILTER (WHERE NOT is_spam AND toxic <> 1) AS true_negative
  FROM judged JOIN labels ON uid = CAST(doc_id AS VARCHAR))
SELECT *, round(n_correct / n::DOUBLE, 6) AS accuracy,
 CASE WHEN true_positive + false_negative > 0 THEN round(true_positive / (true_positive + false_negative)::DOUBLE, 6) END AS detection_rate FROM c""",
    "renumber": """SELECT uid, row_number() OVER (ORDER BY CAST(uid AS HUGEINT), uid) AS new_uid
 FROM (SELECT DISTINCT concat(doc_id * 3, n_chars) AS uid FROM documents)""",
    "stream_ingest": with_(*PLAIN_RISK) + stored(),
    "stream_eml_ingest": with_(THREADS, "messages AS (SELECT * FROM threads)", RULES, risk(None, False),
                               PLAIN_RISK[-1]) + f"SELECT uid, status, reason_code, emails FROM ({stored()})",
    "stream_dedupe": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid FROM events",
    "stream_rejection_counts": with_(*PLAIN_RISK) + "SELECT code AS reason_code, count(*) AS n FROM final WHERE code IS NOT NULL GROUP BY ALL",
    "extractor_hook": with_(MESSAGES) + """SELECT uid, 'Acme' AS company, CAST(list_max(list_transform(string_split(body, chr(10)),
 lambda l: length(l))) AS VARCHAR) AS product FROM messages""",
    "scorer_hook": with_(MESSAGES) + """SELECT uid, round(least(length(substring(concat(subject, '. ', body), 1, 512)), 400) / 400.0::DOUBLE, 6)
 AS probability FROM messages""",
    "judged_contacts": with_(*PLAIN_RISK) + """SELECT coalesce(code, 'ACCEPTED') AS reason_code, count(*) AS n,
 CAST(sum(len(emails)) AS BIGINT) AS n_emails, CAST(sum(len(phones)) AS BIGINT) AS n_phones,
 count(*) FILTER (WHERE product <> '') AS n_products FROM final GROUP BY ALL""",
}
for _name, _patterns, (_each, _cap) in (
        ("spam_points", R.SPAM_PATTERNS, R.SPAM_WEIGHT),
        ("phishing_points", R.PHISHING_PATTERNS, R.PHISHING_WEIGHT),
        ("formatting_points", R.FORMATTING_PATTERNS, R.FORMATTING_WEIGHT)):
    SQL[_name] = with_(MESSAGES) + (
        f"SELECT uid, CAST(h AS BIGINT) AS hits, CAST(least({_cap}, h * {_each}) AS BIGINT) AS points "
        f"FROM (SELECT uid, {hits(_patterns)} AS h FROM (SELECT uid, concat(body, subject) AS t FROM messages))")
for _name, _cfg in (("company_whitelist", K.WHITELIST_CFG), ("contact_rules", K.CONTACT_CFG)):
    _cfg = _cfg.with_(subject_blacklist=(), body_blacklist=(), sender_blacklist=(), max_email_size_mb=-1)
    SQL[_name] = with_(CONTACTS) + (
        f"SELECT uid, reason_code IS NOT NULL AS is_spam, reason_code, "
        f"{reason(_cfg, 'company', 'len(emails)', 'len(phones)')} AS reason FROM (SELECT *, "
        f"{basic_code(_cfg, 'company', 'len(emails)', 'len(phones)')} AS reason_code FROM contacts)")
