"""Tunable parameters and the fixed values results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values.  These must stay exactly as written for results to match:
# word lists, regex fragments, thresholds and hosts, in their natural order.
# ---------------------------------------------------------------------------

# Title blacklist (relevance filter).  Each entry is one whole-word regex
# fragment, matched case-insensitively against the title only.
BLACKLIST_TERMS: tuple[str, ...] = (
    "eske[rn]?", "boks", "omvisning",
    "deksel", "etui", "cover", "panzerglass", "skjermfilm", "skjermbeskytter",
    "popgrip", "popsocket", "stativ",
    "lader[en]?", "ladekabel", "charger", "kabel",
    "kjøper", "ønsker å kjøpe", "ønsker å kjøp", "søker", "wanted", "vil kjøpe",
    "henter på dagen",
    "deler", "reparasjon", "repair", "knust",
    "tilbehør", "accessories",
    "oppover",
)

# Composite score keywords: plain substrings of lower(title + " " + description).
POSITIVE_KEYWORDS: tuple[str, ...] = (
    "pent brukt", "god stand", "meget pent", "som ny", "perfekt", "flott",
    "original eske", "med eske", "kvittering", "garanti", "komplett", "ubrukt",
    "ny ", "batteri 1",
)
NEGATIVE_KEYWORDS: tuple[str, ...] = (
    "knust", "skadet", "riper", "bulk", "defekt", "feil", "selges som den er",
    "ikke funksjonell", "krever reparasjon", "icloud", "activation lock",
    "brukt mye", "sprekk", "flekk",
)

# Hosts a listing link or an image may point to (exact or dotted suffix).
ALLOWED_EXACT_HOSTS: tuple[str, ...] = ("finn.no", "finncdn.no")
ALLOWED_HOST_SUFFIXES: tuple[str, ...] = (".finn.no", ".finncdn.no")
BASE_URL = "https://www.finn.no"

# Characters Python's str.isspace() accepts (what str.split()/strip() and the
# re module's \s treat as blanks); Java's and RE2's \s differ from it.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# The same blanks as a plain character set (for trimming without a regex).
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Export columns, in order.
EXPORT_COLUMNS: tuple[str, ...] = (
    "id", "query", "title", "price_nok", "price_score", "composite_score",
    "condition_score", "battery_pct", "ai_summary", "red_flags",
    "location", "url", "scraped_at",
)
# A CSV cell starting with one of these is prefixed with an apostrophe.
CSV_FORMULA_PREFIXES: tuple[str, ...] = ("=", "+", "-", "@", "\t", "\r")

# Image CDN size segment and its replacement.
IMAGE_SIZE_PATTERN = r"/dynamic/\d+x\d+[a-z]*/"
IMAGE_SIZE_TARGET = "/dynamic/960x720c/"

SUSPICIOUS_PRICE_SCORE = -60.0      # candidates must score strictly above
MAX_GALLERY_IMAGES = 8
MIN_GALLERY_WIDTH = 100             # narrower thumbnails are skipped
MIN_DETAIL_DESCRIPTION = 20         # a detail text must be longer than this
DEFAULT_CONDITION = 5               # stored report without a condition


@dataclass(frozen=True)
class Params:
    """Run-time settings with the reference defaults."""

    pages: int = 3
    ai_limit: int = 5
    deep_scan: bool = False     # every listing's detail page is read before the report, not the candidates' only
    min_price: int | None = 500
    cache_ttl_hours: float = 6.0
    retention_days: int = 60
    deals_limit: int = 10
    drops_limit: int = 10
    suspicious_threshold: float = SUSPICIOUS_PRICE_SCORE
    blacklist: tuple[str, ...] = BLACKLIST_TERMS
    positive_keywords: tuple[str, ...] = POSITIVE_KEYWORDS
    negative_keywords: tuple[str, ...] = NEGATIVE_KEYWORDS
    allowed_exact_hosts: tuple[str, ...] = ALLOWED_EXACT_HOSTS
    allowed_host_suffixes: tuple[str, ...] = ALLOWED_HOST_SUFFIXES

    def __post_init__(self) -> None:
        # Same lower bounds the command line enforces.
        if self.pages < 1:
            raise ValueError("pages must be >= 1")
        if self.ai_limit < 0:
            raise ValueError("ai_limit must be >= 0")
        if self.min_price is not None and self.min_price < 0:
            raise ValueError("min_price must be >= 0")
        if self.deals_limit < 1 or self.drops_limit < 1:
            raise ValueError("limits must be >= 1")
