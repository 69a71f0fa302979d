"""Risk score 0-100 and the verdict built on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FilterConfig
from ..functions.sqltext import let as sql_let, quote, string_array
from ..functions.text import (WS_CLASS, casefold_sql, compute_once, java_regex, let, plain_needles,
                              search_any, words_found)
from .rules import compile_patterns, inputs, reason_code, reason_text

# Pattern lists. Searched in body + subject, ignoring case.
SPAM_PATTERNS = (
    r"(?:click|tap|verify|confirm|update)\s+(?:now|immediately|immediately)",
    r"(?:verify|confirm|update).*account",
    r"(?:urgent|immediately|asap).*(?:action|click|verify)",
    r"(?:you(?:r)?)?.*(?:account|password|credentials).*(?:expired|suspended|locked)",
    r"won|won\s+(?:you|a|the|grand|prize)",
    r"(?:congratulations|claim|winner|prize|jackpot)",
    r"(?:free|claim).{0,30}(?:money|cash|prize|iphone|amazon)",
    r"ransomware|malware|trojan|virus detected",
    r"(?:microsoft|apple|amazon|google).*(?:support|security|urgent)",
    r"system\s+(?:error|alert|warning).*(?:repair|fix|update)",
    r"(?:cheap|discount|order).{0,20}(?:viagra|cialis|phentermine|xanax)",
    r"(?:make|earn|get).{0,30}(?:money|dollars|fast|quick)",
    r"(?:guaranteed|sure|no\s+risk).*(?:profit|earn|return)",
    r"(?:nigerian|prince|inheritance|lottery|fund)",
)
PHISHING_PATTERNS = (
    r"(?:click|tap).{0,30}(?:confirm|verify|update).*(?:credentials|password|account)",
    r"please\s+(?:click|confirm|verify).*(?:identity|account|credentials)",
    r"(?:re-?confirm|re-?verify).*(?:details|information|account)",
    r"unusual\s+(?:activity|access|sign-?in)",
    r"(?:act\s+)?now|(?:do\s+)?immediately|urgent\s+action\s+required",
    r"(?:your\s+)?account\s+(?:will|may)\s+be\s+(?:closed|suspended|limited)",
    r"(?:for\s+)?security\s+(?:reason|purpose|update)",
    r"(?:system|account).*(?:maintenance|upgrade|update)",
)
FORMATTING_PATTERNS = (
    r"[!]{3,}|\?{3,}|={10,}",
    r"([A-Z]{5,}\s+){2,}",
    r"(?:http|ftp).*(?:tiny|bit|short)",
    r"@.*(?:bit|tiny|short)",
    r"(?:i\s+am|we\s+are)\s+(?:happy|pleased|delighted).*(?:inform|notify)",
    r"(?:dear|valued|beloved)\s+(?:customer|user|friend)",
    r"\$\$+|XXX+|[^\x00-\x7F]{10,}",
)
# Searched in each extracted e-mail, ignoring case.
EMAIL_PATTERNS = (r"test\d+@", r"temp\w+@", r"[0-9]{5,}@", r"noreply@", r"notification.*@")
# Fixed values: (points per match, cap).
SPAM_WEIGHT, PHISHING_WEIGHT, FORMATTING_WEIGHT = (5, 30), (7, 35), (4, 20)

# Whitespace inside one line, and a line break with the whitespace around it.
_SPACE = rf"[{WS_CLASS}&&[^\n]]+"
_BREAK = rf"[{WS_CLASS}&&[^\n]]*+\n[{WS_CLASS}]*+"


def _on_line(first: str, then: str, across: str | None = None) -> str:
    """Search form of ``first.*then`` that reads each line once.

    The first ``first`` on a line leaves the most room for ``then``, so the
    line is entered through it and never through a later one (atomic group).
    The plain form retries every ``first`` and is quadratic on long lines.
    ``across`` is the form of ``first`` that contains a line break; each break
    is used at most once, which keeps that branch linear too.
    """
    inline = rf"(?m)^(?>.*?(?:{first})).*(?:{then})"
    return inline if across is None else rf"{inline}|(?:{across}).*(?:{then})"


# Search-equivalent forms for the Java engine (a search asks only whether a
# match exists): optional prefixes dropped, nested repetition flattened,
# ``X.*Y`` made linear. Patterns not listed are used as they are.
SEARCH_FORMS = {
    SPAM_PATTERNS[1]: _on_line("verify|confirm|update", "account"),
    SPAM_PATTERNS[2]: _on_line("urgent|immediately|asap", "action|click|verify"),
    SPAM_PATTERNS[3]: _on_line("account|password|credentials", "expired|suspended|locked"),
    SPAM_PATTERNS[4]: "won",
    SPAM_PATTERNS[8]: _on_line("microsoft|apple|amazon|google", "support|security|urgent"),
    SPAM_PATTERNS[9]: _on_line(rf"system{_SPACE}(?:error|alert|warning)", "repair|fix|update",
                               rf"system{_BREAK}(?:error|alert|warning)"),
    SPAM_PATTERNS[12]: _on_line(rf"guaranteed|sure|no{_SPACE}risk", "profit|earn|return",
                                rf"no{_BREAK}risk"),
    PHISHING_PATTERNS[0]: _on_line(r"(?:click|tap).{0,30}?(?:confirm|verify|update)",
                                   "credentials|password|account"),
    PHISHING_PATTERNS[1]: _on_line(rf"please{_SPACE}(?:click|confirm|verify)",
                                   "identity|account|credentials",
                                   rf"please{_BREAK}(?:click|confirm|verify)"),
    PHISHING_PATTERNS[2]: _on_line("re-?confirm|re-?verify", "details|information|account"),
    PHISHING_PATTERNS[4]: r"now|immediately|urgent\s+action\s+required",
    PHISHING_PATTERNS[5]: r"account\s+(?:will|may)\s+be\s+(?:closed|suspended|limited)",
    PHISHING_PATTERNS[6]: r"security\s+(?:reason|purpose|update)",
    PHISHING_PATTERNS[7]: _on_line("system|account", "maintenance|upgrade|update"),
    FORMATTING_PATTERNS[1]: r"(?<![A-Za-z])[A-Za-z]{5,}+\s++[A-Za-z]{5,}+\s",
    FORMATTING_PATTERNS[2]: _on_line("http|ftp", "tiny|bit|short"),
    FORMATTING_PATTERNS[3]: _on_line("@", "bit|tiny|short"),
    FORMATTING_PATTERNS[4]: _on_line(
        rf"(?:i{_SPACE}am|we{_SPACE}are){_SPACE}(?:happy|pleased|delighted)", "inform|notify",
        rf"(?:i{_SPACE}am|we{_SPACE}are){_BREAK}(?:happy|pleased|delighted)"
        rf"|(?:i{_BREAK}am|we{_BREAK}are)\s+(?:happy|pleased|delighted)"),
    # its words are looked up like the others; this is the rest of it
    FORMATTING_PATTERNS[6]: r"[^\x00-\x7F]{10}",
}


# Words that a match cannot do without: one of each group, ignoring case. They
# are looked up first, as plain substrings; the regex runs only where all
# groups are present.
NEEDED_WORDS = {
    SPAM_PATTERNS[0]: (("click", "tap", "verify", "confirm", "update"), ("now", "immediately")),
    SPAM_PATTERNS[1]: (("verify", "confirm", "update"), ("account",)),
    SPAM_PATTERNS[2]: (("urgent", "immediately", "asap"), ("action", "click", "verify")),
    SPAM_PATTERNS[3]: (("account", "password", "credentials"), ("expired", "suspended", "locked")),
    SPAM_PATTERNS[4]: (("won",),),
    SPAM_PATTERNS[5]: (("congratulations", "claim", "winner", "prize", "jackpot"),),
    SPAM_PATTERNS[6]: (("free", "claim"), ("money", "cash", "prize", "iphone", "amazon")),
    SPAM_PATTERNS[7]: (("ransomware", "malware", "trojan", "virus detected"),),
    SPAM_PATTERNS[8]: (("microsoft", "apple", "amazon", "google"), ("support", "security", "urgent")),
    SPAM_PATTERNS[9]: (("system",), ("error", "alert", "warning"), ("repair", "fix", "update")),
    SPAM_PATTERNS[10]: (("cheap", "discount", "order"), ("viagra", "cialis", "phentermine", "xanax")),
    SPAM_PATTERNS[11]: (("make", "earn", "get"), ("money", "dollars", "fast", "quick")),
    SPAM_PATTERNS[12]: (("guaranteed", "sure", "risk"), ("profit", "earn", "return")),
    SPAM_PATTERNS[13]: (("nigerian", "prince", "inheritance", "lottery", "fund"),),
    PHISHING_PATTERNS[0]: (("click", "tap"), ("confirm", "verify", "update"),
                           ("credentials", "password", "account")),
    PHISHING_PATTERNS[1]: (("please",), ("click", "confirm", "verify"),
                           ("identity", "account", "credentials")),
    PHISHING_PATTERNS[2]: (("reconfirm", "re-confirm", "reverify", "re-verify"),
                           ("details", "information", "account")),
    PHISHING_PATTERNS[3]: (("unusual",), ("activity", "access", "signin", "sign-in")),
    PHISHING_PATTERNS[4]: (("now", "immediately", "urgent"),),
    PHISHING_PATTERNS[5]: (("account",), ("closed", "suspended", "limited")),
    PHISHING_PATTERNS[6]: (("security",), ("reason", "purpose", "update")),
    PHISHING_PATTERNS[7]: (("system", "account"), ("maintenance", "upgrade", "update")),
    FORMATTING_PATTERNS[0]: (("!!!", "???", "=========="),),
    FORMATTING_PATTERNS[2]: (("http", "ftp"), ("tiny", "bit", "short")),
    FORMATTING_PATTERNS[3]: (("@",), ("bit", "tiny", "short")),
    FORMATTING_PATTERNS[4]: (("happy", "pleased", "delighted"), ("inform", "notify")),
    FORMATTING_PATTERNS[5]: (("dear", "valued", "beloved"), ("customer", "user", "friend")),
    FORMATTING_PATTERNS[6]: (("$$", "xxx"),),
}
# Patterns that say no more than "one of these words".
WORDS_DECIDE = {SPAM_PATTERNS[4], SPAM_PATTERNS[5], SPAM_PATTERNS[7], SPAM_PATTERNS[13],
                FORMATTING_PATTERNS[0]}


def search_form(pattern: str) -> str:
    form = SEARCH_FORMS.get(pattern)
    if form is None:
        return java_regex(pattern)
    # class intersections above are already Java syntax
    return "(?idU)" + form.replace(r"\s", f"[{WS_CLASS}]")


def needed_words(lists: dict[str, tuple[str, ...]]) -> list[str]:
    """The needed words of all patterns, each once."""
    return list(dict.fromkeys(w for group in lists.values() for p in group
                              for words in NEEDED_WORDS.get(p, ()) for w in words))


def hit_counts(column: str, lists: dict[str, tuple[str, ...]], found: str | None = None) -> Column:
    """Struct with the number of patterns of each list found in ``column``.

    ``found`` names a column of the needed words that the text holds; without
    it the text is folded once and all needed words are looked up in it once.
    """
    words = needed_words(lists)

    def hit(p: str) -> str:
        tests = [f"arrays_overlap(_present, {string_array(g)})" for g in NEEDED_WORDS.get(p, ())]
        regex = f"_text RLIKE {quote(search_form(p))}"
        if p == FORMATTING_PATTERNS[6]:
            # either word, or ten non-ASCII characters where there are any
            tests = [f"{tests[0]} OR (octet_length(_text) != length(_text) AND {regex})"]
        elif p not in WORDS_DECIDE:
            tests.append(regex)
        return f"cast(({' AND '.join(tests)}) AS int)"

    counts = ", ".join(f"'{name}', {' + '.join(map(hit, group))}" for name, group in lists.items())
    present = found or sql_let("_low", casefold_sql("_text"),
                               f"filter({string_array(words)}, _w -> contains(_low, _w))")
    return F.expr(sql_let("_text", column, sql_let("_present", present, f"named_struct({counts})")))


def count_hits(column: str, patterns: tuple[str, ...]) -> Column:
    """Number of patterns found in ``column``."""
    return hit_counts(column, {"n": patterns})["n"]


def points(hits: Column, weight: tuple[int, int]) -> Column:
    each, cap = weight
    return F.least(F.lit(cap), hits * each)


def suspicious_emails(emails: Column) -> Column:
    alternation = "|".join(f"(?:{java_regex(p)})" for p in EMAIL_PATTERNS)
    return F.coalesce(F.exists(emails, lambda e: e.rlike(alternation)), F.lit(False))


# Digits beyond the decimal-number category that still count as digits.
_OTHER_DIGITS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}"
    r"\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
# ASCII first: the long class is consulted beyond ASCII only
_DIGIT = rf"[0-9[\x{{80}}-\x{{10ffff}}&&[\p{{Nd}}{_OTHER_DIGITS}]]]+"


def text_quality_points(body: Column) -> Column:
    """3 for fewer than five words, 4 for much punctuation, 3 for many digits."""
    word, gap = rf"[^{WS_CLASS}]++", rf"[{WS_CLASS}]++"
    five_words = rf"\A[{WS_CLASS}]*+{word}(?:{gap}{word}){{4}}"

    def judge(size: Column) -> Column:
        punct = F.length(F.regexp_replace(body, "[^!?.,;:]+", ""))
        digits = size - F.length(F.regexp_replace(body, _DIGIT, ""))
        whole = F.greatest(size, F.lit(1))
        return (F.when(~body.rlike(five_words), 3).otherwise(0)
                + F.when(punct / whole > 0.15, 4).otherwise(0)
                + F.when(digits / whole > 0.2, 3).otherwise(0))

    return let(F.length(body), judge)


def with_risk(df: DataFrame, cfg: FilterConfig, phase: str = "pre",
              probability: str | None = "ml_spam_probability",
              only: Column | None = None) -> DataFrame:
    """Add hit counts, component points, ``risk_score`` and ``risk_factors``.

    ``probability`` names a column with the classifier's spam probability
    (null counts as 0); it is read only when the model filter is enabled.
    Every component is computed once, as a column. Rows outside ``only`` are
    not scored and get null. Narrow: no shuffle.
    """
    x = inputs(df, phase)
    text = F.concat(x.body, x.subject)   # body first, no separator
    gate = (lambda c: c) if only is None else (lambda c: F.when(only, c))
    has_prob = cfg.ml_enabled and probability is not None and probability in df.columns
    prob = F.coalesce(F.col(probability), F.lit(0.0)) if has_prob else F.lit(0.0)
    lists = {"spam_hits": SPAM_PATTERNS, "phishing_hits": PHISHING_PATTERNS,
             "formatting_hits": FORMATTING_PATTERNS}
    both = df.withColumn("_both", text).withColumn("_found", words_found(gate(text), needed_words(lists)))
    measured = compute_once(both, {"_hits": gate(hit_counts("_both", lists, "_found")),
                                   "_text": gate(text_quality_points(x.body))})
    scored = (
        measured.select("*", "_hits.*")
        .withColumns({
            "spam_points": points(F.col("spam_hits"), SPAM_WEIGHT),
            "phishing_points": points(F.col("phishing_hits"), PHISHING_WEIGHT),
            "formatting_points": points(F.col("formatting_hits"), FORMATTING_WEIGHT),
            "email_points": F.when(suspicious_emails(x.emails), 15).otherwise(0),
            "ml_points": (prob * 20).cast("double"),
            "text_points": F.col("_text"),
        })
        .drop("_hits", "_text", "_both", "_found")
    )
    total = reduce(lambda a, b: a + b, [F.col(c) for c in (
        "spam_points", "phishing_points", "formatting_points", "email_points",
        "ml_points", "text_points")])
    return (scored
            .withColumn("risk_score", gate(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))))
            .withColumn("risk_factors", risk_factors(prob)))


def _whole(c: Column) -> Column:
    return F.rint(c).cast("bigint").cast("string")


def risk_factors(prob: Column) -> Column:
    """One text per non-zero component, in a fixed order."""
    def pattern_factor(name: str, hits: str, unit: str, pts: str) -> Column:
        return F.when(F.col(pts) > 0, F.concat(
            F.lit(f"{name} ("), F.col(hits).cast("string"), F.lit(f" {unit}, +"),
            F.col(pts).cast("string"), F.lit("pts)")))

    factors = F.array(
        pattern_factor("Spam patterns detected", "spam_hits", "matches", "spam_points"),
        pattern_factor("Phishing indicators", "phishing_hits", "matches", "phishing_points"),
        pattern_factor("Suspicious formatting", "formatting_hits", "issues",
                       "formatting_points"),
        F.when(F.col("email_points") > 0, F.lit("Suspicious email addresses detected (+15pts)")),
        F.when((F.col("ml_points") > 0) & (prob > 0.8), F.concat(
            F.lit("High spam probability ("), F.format_string("%.1f", prob * 100), F.lit("%)"))),
        F.when(F.col("ml_points") > 0, F.concat(
            F.lit("ML analysis risk: "), _whole(F.col("ml_points")), F.lit("pts"))),
        F.when(F.col("text_points") > 0, F.concat(
            F.lit("Poor text quality (+"), F.col("text_points").cast("string"), F.lit("pts)"))),
    )
    return F.filter(factors, lambda f: f.isNotNull())


def risk_level(score: Column) -> Column:
    return (F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH")
            .when(score >= 40, "MEDIUM").otherwise("LOW"))


# The level as displayed.
LEVEL_LABELS = {"CRITICAL": "🔴 CRITICAL", "HIGH": "🟠 HIGH",
                "MEDIUM": "🟡 MEDIUM", "LOW": "🟢 LOW"}


def level_label(level: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, label in LEVEL_LABELS.items():
        out = out.when(level == name, label)
    return out


def recommendation(score: Column) -> Column:
    return F.when(score >= 80, "BLOCK").when(score >= 60, "REVIEW").otherwise("PROCESS")


def risk_profile(df: DataFrame, cfg: FilterConfig, phase: str = "pre",
                 probability: str | None = "ml_spam_probability") -> DataFrame:
    """Full risk picture per message; blocks nothing."""
    x = inputs(df, phase)
    # a company that is present but empty stays empty
    company = (F.coalesce(F.col("company"), F.lit("Unknown"))
               if phase == "post" and "company" in df.columns else F.lit("Unknown"))
    has_prob = cfg.ml_enabled and probability is not None and probability in df.columns
    prob = F.coalesce(F.col(probability), F.lit(0.0)) if has_prob else F.lit(0.0)
    scored = with_risk(df, cfg, phase, probability)
    level = risk_level(F.col("risk_score"))
    return scored.select(
        "uid", "risk_score", level.alias("risk_level"), level_label(level).alias("risk_label"),
        prob.alias("ml_spam_probability"), "risk_factors", x.sender.alias("sender"),
        F.substring(x.subject, 1, 50).alias("subject"), company.alias("company"),
        recommendation(F.col("risk_score")).alias("recommendation"))


def advanced_verdict(df: DataFrame, cfg: FilterConfig, phase: str = "pre",
                     probability: str | None = "ml_spam_probability") -> DataFrame:
    """Basic rules first; a message that passes them is spam when its risk
    reaches the threshold. Adds ``is_spam``, ``reason_code``, ``reason`` and
    ``risk_score``."""
    x = inputs(df, phase)
    plain, other = plain_needles(compile_patterns(cfg.body_blacklist)) if cfg.enabled else ([], [])
    in_body = F.size("_in_body") > 0
    read = df.withColumn("_in_body", words_found(x.body, plain)) if plain else df
    judged = compute_once(read, {"_basic": reason_code(
        x, cfg, (in_body | search_any(x.body, other) if other else in_body) if plain else None)}).drop("_in_body")
    # the basic rules are cheaper: what they reject is not scored
    scored = with_risk(judged, cfg, phase, probability, only=F.col("_basic").isNull())
    risky = F.col("risk_score") >= cfg.risk_threshold
    if cfg.disable_covers_risk and not cfg.enabled:
        risky = F.lit(False)
    risk_reason = F.concat(
        F.lit("High spam risk score: "), _whole(F.col("risk_score")), F.lit("/100. Reasons: "),
        F.array_join(F.slice("risk_factors", 1, 3), ", "))
    return (
        scored
        .withColumn("reason_code", F.coalesce("_basic", F.when(risky, F.lit("RISK"))))
        .withColumn("is_spam", F.col("reason_code").isNotNull())
        .withColumn("reason", F.when(F.col("reason_code") == "RISK", risk_reason)
                    .otherwise(reason_text(F.col("reason_code"), x, cfg)))
        .select(*df.columns, "is_spam", "reason_code", "reason", "risk_score")
    )


def verdict(df: DataFrame, cfg: FilterConfig, phase: str = "pre") -> DataFrame:
    """The verdict new mail gets: with risk scoring when the model filter is
    enabled, else the basic rules alone."""
    if cfg.ml_enabled:
        return advanced_verdict(df, cfg, phase)
    from .rules import basic_verdict
    return basic_verdict(df, cfg, phase).withColumn("risk_score", F.lit(None).cast("double"))
