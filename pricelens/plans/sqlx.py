"""SQL (DuckDB dialect) twins of the Column functions, for the oracle.

Each builder returns an expression string.  Literals that are doubles in
Spark are cast to DOUBLE here: DuckDB would otherwise read ``0.3`` as an exact
DECIMAL and round differently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pricelens.params import (
    ALLOWED_EXACT_HOSTS, ALLOWED_HOST_SUFFIXES, BASE_URL, IMAGE_SIZE_TARGET,
    NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS, PY_WHITESPACE_CHARS, PY_WHITESPACE_CLASS,
)

WS = PY_WHITESPACE_CLASS
DIGIT = r"\p{Nd}"
NOT_WORD = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def py_round(e: str, digits: int) -> str:
    """Same exact half-even rounding as ``functions.numeric.py_round``; the
    argument is bound once through a one-element lambda."""
    s = d(float(10 ** digits))
    k = d(134217729.0)
    body = (f"CASE WHEN x IS NULL THEN NULL "
            f"WHEN x * {s} - floor(x * {s}) = {d(0.5)} AND "
            f"(((x * {k}) - ((x * {k}) - x)) * {s} - x * {s}) + (x - ((x * {k}) - ((x * {k}) - x))) * {s} > 0 "
            f"THEN ceil(x * {s}) "
            f"WHEN x * {s} - floor(x * {s}) = {d(0.5)} AND "
            f"(((x * {k}) - ((x * {k}) - x)) * {s} - x * {s}) + (x - ((x * {k}) - ((x * {k}) - x))) * {s} < 0 "
            f"THEN floor(x * {s}) ELSE round_even(x * {s}, 0) END / {s}")
    return f"(list_transform([CAST(({e}) AS DOUBLE)], lambda x: {body})[1])"


def clamp(e: str, lo: float, hi: float) -> str:
    return f"greatest({d(lo)}, least({d(hi)}, {e}))"


def py_strip(e: str) -> str:
    chars = " || ".join(f"chr({ord(ch)})" for ch in PY_WHITESPACE_CHARS)
    return f"trim({e}, {chars})"


def normalize_query(e: str) -> str:
    collapsed = f"regexp_replace({py_strip(e)}, {q(WS + '+')}, ' ', 'g')"
    return f"replace(lower({collapsed}), 'ß', 'ss')"


def parse_price(e: str) -> str:
    run = f"regexp_extract({e}, {q(f'({DIGIT}[{DIGIT}{WS[1:-1]}.]*)')}, 1)"
    digits = py_strip(f"regexp_replace({run}, {q('[ \\x{A0}.]')}, '', 'g')")
    return (f"(CASE WHEN regexp_full_match({digits}, '[0-9]+') "
            f"THEN TRY_CAST({digits} AS BIGINT) END)")


def listing_id_from_url(e: str) -> str:
    by_param = f"regexp_extract({e}, {q(f'finnkode=({DIGIT}+)')}, 1)"
    by_path = f"regexp_extract({e}, {q(f'/({DIGIT}{{6,}})(?:[/?]|\\n?\\z)')}, 1)"
    return f"coalesce(nullif({by_param}, ''), nullif({by_path}, ''), {e})"


def upgrade_image_url(e: str) -> str:
    pat = r"/dynamic/\p{Nd}+x\p{Nd}+[a-z]*/"
    return f"regexp_replace({e}, {q(pat)}, {q(IMAGE_SIZE_TARGET)})"


def battery_match(text: str) -> str:
    m = f"regexp_extract({text}, {q(f'({DIGIT}{{2,3}}){WS}*%')}, 1)"
    return f"(CASE WHEN regexp_full_match({m}, '[0-9]+') THEN CAST({m} AS INTEGER) END)"


def battery_from_text(text: str) -> str:
    b = battery_match(text)
    return f"(CASE WHEN {b} BETWEEN 50 AND 100 THEN {b} END)"


def storage_of(title: str) -> str:
    pat = f"(?:^|{NOT_WORD})({DIGIT}+){WS}*[Gg][Bb](?:$|{NOT_WORD})"
    n = f"regexp_extract({title}, {q(pat)}, 1)"
    return f"(CASE WHEN {n} <> '' THEN {n} || ' GB' END)"


def city_of(loc: str) -> str:
    return (f"(CASE WHEN {loc} IS NULL OR {loc} = '' THEN '—' "
            f"ELSE {py_strip(f'split_part({loc}, {q(chr(44))}, 1)')} END)")


def format_price(p: str) -> str:
    v = f"CAST({p} AS BIGINT)"
    return (f"(CASE WHEN {v} IS NULL OR {v} = 0 THEN '—' "
            f"ELSE replace(format('{{:,}}', {v}), ',', ' ') || ' kr' END)")


def location_text(t: str) -> str:
    s = py_strip(t)
    return (f"(CASE WHEN NOT regexp_matches(substr({s}, 1, 3), {q(DIGIT)}) AND length({s}) > 2 "
            f"THEN {py_strip(f'split_part({s}, chr(10), 1)')} END)")


def price_score(p: str, median: str) -> str:
    raw = f"((CAST({p} AS DOUBLE) - {median}) / {median} * {d(100.0)})"
    return f"(CASE WHEN {p} <> 0 AND {median} > 0 THEN {py_round(raw, 2)} END)"


def score_text(title: str, desc: str) -> str:
    return f"lower(concat_ws(' ', coalesce({title}, ''), coalesce({desc}, '')))"


def keyword_hits(text: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({text}, {q(w)}) THEN 1 ELSE 0 END)"
                            for w in words) + ")"


def composite_score(title: str, desc: str, ps: str, reviewed_battery: str | None = None) -> str:
    text = score_text(title, desc)
    price_part = f"(CASE WHEN {ps} IS NULL THEN {d(20.0)} ELSE {clamp(f'{d(20.0)} - {ps} * {d(0.5)}', 0.0, 40.0)} END)"
    bat = battery_from_text(text)
    if reviewed_battery is not None:
        bat = f"coalesce({reviewed_battery}, {bat})"
    battery_part = (f"(CASE WHEN ({bat}) IS NULL THEN {d(18.0)} "
                    f"ELSE least({d(30.0)}, CAST({bat} AS DOUBLE) * {d(0.3)}) END)")
    dl = "length(" + py_strip(f"coalesce({desc}, '')") + ")"
    length_adj = (f"(CASE WHEN {dl} > 200 THEN {d(3.0)} WHEN {dl} > 80 THEN {d(1.5)} "
                  f"WHEN {dl} = 0 THEN {d(-4.0)} ELSE {d(0.0)} END)")
    content = (f"({d(15.0)} + CAST({keyword_hits(text, POSITIVE_KEYWORDS)} AS DOUBLE) * {d(2.5)}"
               f" - CAST({keyword_hits(text, NEGATIVE_KEYWORDS)} AS DOUBLE) * {d(6.0)} + {length_adj})")
    total = f"({price_part} + {battery_part} + {clamp(content, 0.0, 30.0)})"
    return py_round(f"least({d(100.0)}, {total})", 1)


def price_band(ps: str) -> str:
    return (f"(CASE WHEN {ps} IS NULL THEN 'unscored' WHEN {ps} < -15 THEN 'well_below' "
            f"WHEN {ps} < -5 THEN 'below' WHEN {ps} > 15 THEN 'well_above' "
            f"WHEN {ps} > 5 THEN 'above' ELSE 'near' END)")


def condition_band(cs: str) -> str:
    return (f"(CASE WHEN {cs} IS NULL THEN NULL WHEN {cs} >= 8 THEN 'good' "
            f"WHEN {cs} >= 5 THEN 'fair' ELSE 'poor' END)")


SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def absolute_url(h: str, base: str = BASE_URL) -> str:
    scheme = base.split(":", 1)[0]
    return (f"(CASE WHEN regexp_matches({h}, {q(SCHEME_RE)}) THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {q(scheme + ':')} || {h} "
            f"WHEN starts_with({h}, '/') OR starts_with({h}, '?') OR starts_with({h}, '#') "
            f"THEN {q(base)} || {h} ELSE {q(base + '/')} || {h} END)")


def url_scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, {q(SCHEME_RE)}, 1))"


def url_host(u: str) -> str:
    netloc = f"regexp_extract({u}, {q(NETLOC_RE)}, 1)"
    hostinfo = f"regexp_replace({netloc}, '^.*@', '')"
    return f"lower({py_strip(f'regexp_extract({hostinfo}, {q(chr(94) + '([^:]*)')}, 1)')})"


def host_allowed(host: str, exact=ALLOWED_EXACT_HOSTS, suffixes=ALLOWED_HOST_SUFFIXES) -> str:
    parts = []
    if exact:
        parts.append(f"{host} IN ({', '.join(q(h) for h in exact)})")
    parts += [f"ends_with({host}, {q(s)})" for s in suffixes]
    return f"({host} <> '' AND ({' OR '.join(parts) or 'false'}))"


def safe_listing_url(u: str, exact=ALLOWED_EXACT_HOSTS, suffixes=ALLOWED_HOST_SUFFIXES) -> str:
    ok = f"{url_scheme(u)} IN ('http', 'https') AND {host_allowed(url_host(u), exact, suffixes)}"
    return f"(CASE WHEN {ok} THEN {u} END)"


def image_url_allowed(u: str, exact=ALLOWED_EXACT_HOSTS, suffixes=ALLOWED_HOST_SUFFIXES) -> str:
    ok = f"({url_scheme(u)} = 'https' AND {host_allowed(url_host(u), exact, suffixes)})"
    return f"coalesce({ok}, false)"
