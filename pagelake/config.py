"""Engine configuration.

One driver-side dataclass. Lists are turned into literal arrays / static
predicates when a plan is built, so Catalyst constant-folds them; nothing here
is shipped per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def split_list(raw: str) -> list[str]:
    """Comma list -> trimmed entries, blanks dropped."""
    return [x.strip() for x in (raw or "").split(",") if x.strip()]


# --------------------------------------------------------------------------
# FIXED VALUES -- defaults that must equal the behaviour being reproduced.
# --------------------------------------------------------------------------
STRIP_TAGS = ["nav", "footer", "header", "aside", "script", "style", "noscript", "iframe"]
STRIP_CLASSES = ["sidebar", "advertisement", "ad-container", "social-share", "cookie-banner", "popup"]
AD_WORDS = ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "promoted", "promo"]
CODE_SYMBOLS = "{ } [ ] ; = => // /* */ ( ) < > :: -> | & % #"
CANDIDATE_LABELS = ("Food,History,Sport,Technology,Space,Science,Politics,"
                    "Business,Health,Entertainment,Travel,Nature,Art,"
                    "Education,Music,Film,Literature,Religion,Philosophy,"
                    "Gaming,News,Finance,Fashion,Automotive,Pets")
UNCATEGORIZED = "Uncategorized"
AUTO_CREATED_DESCRIPTION = "Auto-created by AI classifier"
JOB_STATUSES = ["pending", "running", "paused", "completed", "failed", "stopped"]
CRAWL_MODES = ["single", "rule_based", "infinite", "category"]
JS_MODES = ["auto", "always", "never"]
LOG_LEVELS = ["debug", "info", "warning", "error", "critical"]
# Documented defaults (the code default for both lists is empty).
DOC_BLOCKED_DOMAINS = ["facebook.com", "instagram.com", "twitter.com", "x.com"]
DOC_SKIP_EXTENSIONS = [".pdf", ".jpg", ".png", ".mp4", ".zip"]
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class EngineConfig:
    max_pages_per_job: int = 10000
    max_crawl_depth: int = 50
    js_detection_threshold: float = 5.0
    blocked_domains: tuple[str, ...] = ()
    skip_extensions: tuple[str, ...] = ()
    min_text_density: float = 0.25
    min_block_words: int = 20
    strip_tags: tuple[str, ...] = tuple(STRIP_TAGS)
    strip_classes: tuple[str, ...] = tuple(STRIP_CLASSES)
    min_symbol_density: float = 0.08
    code_symbols: str = CODE_SYMBOLS
    classification_provider: str = "none"
    confidence_threshold: float = 0.4
    max_words: int = 500
    candidate_labels: tuple[str, ...] = tuple(split_list(CANDIDATE_LABELS))
    rule_min_confidence: float = 0.15
    log_retention_days: int = 30
    max_log_entries_per_job: int = 50000
    export_cap: int = 10000
    llm_max_chars: int = 3000
    # name -> keywords; INI names arrive lower-cased
    default_categories: dict = field(default_factory=dict)

    @property
    def symbol_chars(self) -> str:
        """Distinct characters of the symbol tokens, in first-seen order."""
        seen: list[str] = []
        for ch in "".join(self.code_symbols.split()):
            if ch not in seen:
                seen.append(ch)
        return "".join(seen)


DEFAULT = EngineConfig()
