"""String functions: query normalisation, price/id/battery extraction, display.

All are built-in expressions (regexp_* / string functions) so they stay inside
whole-stage codegen.  Regexes spell out character classes instead of relying
on ``\\s``/``\\b``/``\\d`` because Java, RE2 and Python disagree on those
outside ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.unicode import ascii_digits, casefold
from pricelens.params import (
    IMAGE_SIZE_PATTERN, IMAGE_SIZE_TARGET, PY_WHITESPACE_CHARS, PY_WHITESPACE_CLASS,
)

WS = PY_WHITESPACE_CLASS
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"          # a "word" character for whole-word tests
NOT_WORD = r"[^\p{L}\p{N}_]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Strip every Unicode blank from both ends (``trim`` only strips spaces).

    ``btrim`` with an explicit character set works on the UTF-8 bytes
    directly, no regex and no string conversion of large texts."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE_CHARS))


def normalize_query(c) -> Column:
    """Trim, collapse inner blanks to one space, case-fold."""
    return casefold(F.regexp_replace(py_strip(c), rf"{WS}+", " "))


def parse_price(c) -> Column:
    """First ``digit[digits blanks dots]*`` run -> whole number, else NULL.

    Plain spaces, NBSP and dots are thousands separators; any other blank
    left inside the number makes it unparseable ("5 500" -> NULL) while
    trailing blanks are ignored.  A number beyond the BIGINT type is NULL.
    """
    run = F.regexp_extract(_c(c), rf"({DIGIT}[{DIGIT}{WS[1:-1]}.]*)", 1)
    digits = ascii_digits(py_strip(F.regexp_replace(run, r"[ \x{A0}.]", "")))
    return F.when(digits.rlike(r"^[0-9]+$"), digits.try_cast("bigint"))


def listing_id_from_url(c) -> Column:
    """``finnkode=<digits>``, else a path segment of 6+ digits, else the URL."""
    u = _c(c)
    by_param = F.regexp_extract(u, rf"finnkode=({DIGIT}+)", 1)
    by_path = F.regexp_extract(u, rf"/({DIGIT}{{6,}})(?:[/?]|\n?\z)", 1)
    return F.coalesce(F.nullif(by_param, F.lit("")), F.nullif(by_path, F.lit("")), u)


def upgrade_image_url(c) -> Column:
    """Replace the first CDN size segment with the large one."""
    return F.regexp_replace(_c(c), r"(?s)^(.*?)" + IMAGE_SIZE_PATTERN.replace(r"\d", DIGIT),
                            "$1" + IMAGE_SIZE_TARGET)


def battery_digits(text) -> Column:
    """Digits of the first ``NN%``/``NNN %`` in the text, NULL without a percent sign."""
    t = _c(text)
    return F.when(F.contains(t, F.lit("%")), F.regexp_extract(t, rf"({DIGIT}{{2,3}}){WS}*%", 1))


def battery_number(digits) -> Column:
    """The matched digits as a number, unchecked (NULL if none)."""
    m = ascii_digits(_c(digits))
    return F.when(m.rlike(r"^[0-9]+$"), m.try_cast("int"))


def battery_match(text) -> Column:
    """The first ``NN%``/``NNN %`` number in the text, unchecked (NULL if none)."""
    return battery_number(battery_digits(text))


def battery_from_text(text) -> Column:
    """Battery health for scoring: the first match only, kept if 50..100."""
    b = battery_match(text)
    return F.when(b.between(50, 100), b)


def storage_of(title) -> Column:
    """``<n> GB`` from the first whole-word ``<n>GB`` in the title."""
    n = F.regexp_extract(_c(title), rf"(?<!{WORD})({DIGIT}+){WS}*[Gg][Bb](?!{WORD})", 1)
    return F.when(n != "", F.concat(n, F.lit(" GB")))


def city_of(location) -> Column:
    """Text before the first comma, stripped; a dash when unknown."""
    loc = _c(location)
    return F.when(loc.isNull() | (loc == ""), F.lit("—")).otherwise(
        py_strip(F.split_part(loc, F.lit(","), F.lit(1))))


def format_price(p) -> Column:
    """``12 345 kr``; NULL and 0 print as a dash."""
    v = _c(p).cast("bigint")
    return F.when(v.isNull() | (v == 0), F.lit("—")).otherwise(
        F.concat(F.replace(F.format_number(v, 0), F.lit(","), F.lit(" ")), F.lit(" kr")))


def location_text(t) -> Column:
    """A card location: no digit in the first 3 chars, longer than 2; first line."""
    s = py_strip(t)
    ok = (~F.substring(s, 1, 3).rlike(DIGIT)) & (F.length(s) > 2)
    return F.when(ok, py_strip(F.split_part(s, F.lit("\n"), F.lit(1))))
