"""Filter settings: scalar limits and rule lists.

Rule lists are driver-side configuration (tens of entries). Everything built
from them becomes literals inside Column expressions, never a joined table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Mapping

# The shipped rule lists.
SUBJECT_BLACKLIST = (
    "unsubscribe", "viagra", "cialis", "casino", "lottery", "winner",
    "click here", "limited offer", "act now", "google.com", "special offer",
    "free money",
    "verify account", "urgent action required", "confirm identity",
    "update payment", "unusual activity", "suspended account",
    "locked account", "re-verify", "re-confirm",
    "inherit", "inheritance", "nigerian prince", "claim prize", "tax refund",
)
BODY_BLACKLIST = (
    "unsubscribe", "viagra", "cialis", "casino", "cryptocurrency", "bitcoin",
    "click here now", "limited time", "buy now", "google.com",
    "MicrosoftOutlook", "xanax", "phentermine", "pharmacy", "cheap drugs",
    "verify your account", "confirm your credentials", "update your password",
    "reset password", "click to verify", "click to confirm",
    "act immediately", "urgent action", "do not ignore",
    "unusual activity detected", "account suspended", "account locked",
    "african bank", "nigerian", "inheritance money", "claim your money",
    "wire transfer", "bank account details", "nigerian prince",
    "lottery winner", "million dollars",
)
SENDER_BLACKLIST = (
    "*@spam.com", "*noreply*", "notification@*", "google.com*",
    "MicrosoftOutlook", "*no-reply*", "*automated*", "*mailer-daemon*",
    "*robot*", "*bot@*", "*test@*", "*fake*",
)
COMPANY_BLACKLIST = (
    "Google", "Яндекс", "Microsoft", "Apple", "Amazon", "Facebook", "Meta",
    "Twitter", "LinkedIn", "Instagram", "YouTube", "GitHub", "StackOverflow",
    "google.com", "MicrosoftOutlook",
)


@dataclass(frozen=True)
class FilterConfig:
    """Settings of the basic filter and the risk filter.

    Field defaults apply when a key is missing; :meth:`shipped` is the
    configuration the tool is distributed with.
    """

    enabled: bool = True
    subject_blacklist: tuple[str, ...] = ()
    body_blacklist: tuple[str, ...] = ()
    sender_blacklist: tuple[str, ...] = ()
    company_blacklist: tuple[str, ...] = ()
    company_whitelist: tuple[str, ...] = ()
    min_company_length: int = 2
    min_email_count: int = 0
    min_contact_info: int = 1
    exclude_replies: bool = False
    exclude_forwards: bool = False
    max_email_size_mb: float = -1
    min_email_size_kb: float = 0
    require_review_before_delete: bool = False
    # risk filter
    ml_enabled: bool = False
    spam_threshold: float = 0.7   # kept as a setting; no verdict reads it
    risk_threshold: float = 60
    # When true, enabled=False also switches the risk filter off. The default
    # keeps the established behaviour: only the basic rules are switched off.
    disable_covers_risk: bool = False
    extra: Mapping[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def shipped(cls, **changes: Any) -> "FilterConfig":
        base = cls(
            subject_blacklist=SUBJECT_BLACKLIST,
            body_blacklist=BODY_BLACKLIST,
            sender_blacklist=SENDER_BLACKLIST,
            company_blacklist=COMPANY_BLACKLIST,
            min_company_length=0,
            min_contact_info=0,
            max_email_size_mb=1000,
            require_review_before_delete=True,
            ml_enabled=True,
        )
        return replace(base, **changes)

    @classmethod
    def from_dict(cls, settings: Mapping[str, Any]) -> "FilterConfig":
        """Build from a parsed ``spam_filters`` mapping (missing keys → defaults)."""
        settings = dict(settings or {})
        ml = dict(settings.pop("ml_filter", None) or {})
        known = {
            "enabled", "subject_blacklist", "body_blacklist", "sender_blacklist",
            "company_blacklist", "company_whitelist", "min_company_length",
            "min_email_count", "min_contact_info", "exclude_replies",
            "exclude_forwards", "max_email_size_mb", "min_email_size_kb",
            "require_review_before_delete", "disable_covers_risk",
        }
        args = {
            k: tuple(v) if isinstance(v, (list, tuple)) else v
            for k, v in settings.items() if k in known
        }
        if "enabled" in ml:
            args["ml_enabled"] = bool(ml["enabled"])
        for key in ("spam_threshold", "risk_threshold"):
            if key in ml:
                args[key] = ml[key]
        rest = {k: v for k, v in settings.items() if k not in known}
        return cls(**args, extra=rest)

    def with_(self, **changes: Any) -> "FilterConfig":
        return replace(self, **changes)
