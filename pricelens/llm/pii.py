"""PII: format-preserving Feistel pseudonyms, in built-in SQL functions only.

Found values are validated (Luhn sum, number ranges, calendar), numbered
within their format as a pair of residues ``(l, r)`` modulo ``(a, b)``, and
permuted by an alternating Feistel network keyed with SHA-256: each round adds
a keyed digest of one half to the other, so every format is mapped one to one
onto itself and equal values get equal pseudonyms in all documents.  Separators
stay; a card number keeps a right check digit, a date stays a date.  E-mail
names and access-key ids are permuted letter by letter within their classes
(lower, upper, digit) by a network on the two halves of the string.

Formats: e-mail names, North American and other ``+`` phone numbers (area
codes and exchanges that start with 0 or 1 too where ``+1``, parentheses or
separators mark a number; they are permuted among themselves, so that a valid
number stays valid; any 10 digits, or 11 from a 1 on, that make a valid number
count without marks), card numbers (13-19 digits, Luhn), IPv4 addresses, social security numbers, dates
1800-2199 (``2020-01-31``, ``31.01.2020``, ``31/01/2020``; ``01/31/2020``
where it can't be read day first), ``AKIA`` key ids.  What fails its
validation stays as it is.

It is one projection: no shuffle, so hot sources and repeated rows do not
matter.  Null text stays null, text without a value is unchanged.  Other
columns pass through, whatever their names; ``n_pii`` is replaced.  An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_YEAR, _MONTH, _DAY = r"(?:1[89]|2[01])[0-9]{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])"
#: kind -> pattern (without its surroundings), tried in this order.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "key": r"AKIA[0-9A-Z]{16}",
    "phone": r"(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?:1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|1?[2-9][0-9]{2}[2-9][0-9]{6})",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\.[0-9])",
    "ssn": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
    "iso": rf"{_YEAR}-{_MONTH}-{_DAY}",
    "dot": rf"{_DAY}\.{_MONTH}\.{_YEAR}",
    "slash": rf"[0-3][0-9]/[0-3][0-9]/{_YEAR}",
    "card": r"(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})",
    "intl": r"\+[2-9][0-9](?:[ .-]?[0-9]){6,13}",
}
PATTERN = r"(?<![0-9A-Za-z]|[0-9][.,-])(?:" + "|".join(KINDS.values()) + r")(?![0-9A-Za-z])"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""(aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + CASE
    WHEN i % 2 = 1 THEN CAST(substr({_DIGITS}, -i, 1) AS INT)
    WHEN CAST(substr({_DIGITS}, -i, 1) AS INT) > 4 THEN 2 * CAST(substr({_DIGITS}, -i, 1) AS INT) - 9
    ELSE 2 * CAST(substr({_DIGITS}, -i, 1) AS INT) END) % 10 = 0)"""
_DATE = {"iso": "try_to_timestamp(m, 'yyyy-MM-dd')", "dot": "try_to_timestamp(m, 'dd.MM.yyyy')", "slash": "try_to_timestamp(m, 'dd/MM/yyyy')"}
_US = "try_to_timestamp(m, 'MM/dd/yyyy')"
_FIRST = "DATE'1800-01-01'"


def _kind() -> str:
    """The kind of a match ``m`` once validated, else null."""
    cases = []
    for kind, pattern in KINDS.items():
        if kind == "slash":
            cases.append(f"WHEN m RLIKE {_sql('^' + pattern + '$')} AND {_DATE['slash']} IS NOT NULL THEN 'slash'")
            cases.append(f"WHEN m RLIKE {_sql('^' + pattern + '$')} AND {_US} IS NOT NULL THEN 'us'")
            continue
        if kind == "phone":
            cases.append(f"WHEN m RLIKE {_sql('^(?:' + pattern + ')$')} THEN IF(substr({_DIGITS}, -10, 1) >= '2' AND substr({_DIGITS}, -7, 1) >= '2', 'phone', 'phone01')")
            continue
        valid = {"card": _LUHN, **{k: f"{v} IS NOT NULL" for k, v in _DATE.items()}}.get(kind, "true")
        cases.append(f"WHEN m RLIKE {_sql('^(?:' + pattern + ')$')} AND {valid} THEN '{kind}'")
    return "CASE " + " ".join(cases) + " END"


def _pair(kind: str, l: str, a: str, r: str, b: str) -> str:  # noqa: E741
    return f"WHEN '{kind}' THEN named_struct('l', CAST({l} AS BIGINT), 'a', CAST({a} AS BIGINT), 'r', CAST({r} AS BIGINT), 'b', CAST({b} AS BIGINT))"


def _number() -> str:
    """``(l, a, r, b)`` of a match ``x.m`` with its digits ``x.d`` and kind ``x.k``."""
    octet = lambda i: f"CAST(split(x.m, '[.]')[{i}] AS INT)"
    ten = "substr(x.d, -10)"
    body = "substr(x.d, {skip} + 1, length(x.d) - {skip} - {tail})"
    halves = lambda t: (f"coalesce(CAST(nullif(substr({t}, 1, length({t}) DIV 2), '') AS BIGINT), 0)", f"pow(10, length({t}) DIV 2)", f"CAST(substr({t}, length({t}) DIV 2 + 1) AS BIGINT)", f"pow(10, length({t}) - length({t}) DIV 2)")
    area, rest = "CAST(substr(x.m, 1, 3) AS INT)", "((CAST(substr(x.m, 5, 2) AS INT) - 1) * 9999 + CAST(substr(x.m, 8, 4) AS INT) - 1)"
    odd = f"IF(substr({ten}, 1, 1) < '2', CAST({ten} AS BIGINT), 2000000000 + (CAST(substr({ten}, 1, 3) AS BIGINT) - 200) * 2000000 + CAST(substr({ten}, 4, 7) AS BIGINT))"
    cases = [
        _pair("phone01", f"({odd}) DIV 60000", "60000", f"({odd}) % 60000", "60000"),
        _pair("phone", f"CAST(substr({ten}, 1, 3) AS INT) - 200", "800", f"CAST(substr({ten}, 4, 7) AS INT) - 2000000", "8000000"),
        _pair("ip", f"{octet(0)} * 256 + {octet(1)}", "65536", f"{octet(2)} * 256 + {octet(3)}", "65536"),
        _pair("ssn", f"{area} - 1 - IF({area} > 666, 1, 0)", "898", rest, "989901"),
        _pair("card", *halves(body.format(skip=0, tail=1))),
        _pair("intl", *halves(body.format(skip=2, tail=0))),
    ]
    # the ordinal among the 88497 = 9 * 9833 dates with days from 13 on: each month has 12 fewer
    us = f"(datediff(CAST({_US.replace('(m,', '(x.m,')} AS DATE), {_FIRST}) - 12 * ((CAST(substr(x.m, 7, 4) AS INT) - 1800) * 12 + CAST(substr(x.m, 1, 2) AS INT)))"
    cases.append(_pair("us", f"{us} % 9", "9", f"{us} DIV 9", "9833"))
    for kind, parsed in _DATE.items():
        day = f"datediff(CAST({parsed.replace('(m,', '(x.m,')} AS DATE), {_FIRST})"
        cases.append(_pair(kind, f"{day} % 189", "189", f"{day} DIV 189", "773"))
    return "CASE x.k " + " ".join(cases) + " END"


def _rounds(key: str) -> str:
    def prf(half: str, mod: str) -> str:
        return f"CAST(conv(substr(sha2(concat_ws('|', {key}, x.k, i, {half}), 256), 1, 15), 16, 10) AS BIGINT) % {mod}"

    return f"""IF(x.n IS NULL, NULL, aggregate(sequence(1, {ROUNDS}), named_struct('l', x.n.l, 'r', x.n.r), (s, i) -> IF(i % 2 = 1,
        named_struct('l', (s.l + {prf('s.r', 'x.n.a')}) % x.n.a, 'r', s.r),
        named_struct('l', s.l, 'r', (s.r + {prf('s.l', 'x.n.b')}) % x.n.b))))"""


def _string_rounds(key: str) -> str:
    """The network on the halves of a name ``x.name``."""

    def shifted(half: str, other: str) -> str:
        c, h = f"substr({half}, p, 1)", f"CAST(conv(substr(sha2(concat_ws('|', {key}, x.k, i, {other}), 512), 4 * ((p - 1) % 32) + 1, 4), 16, 10) AS INT)"
        moved = lambda first, n: f"chr({first} + (ascii({c}) - {first} + {h}) % {n})"
        return f"""IF(length({half}) = 0, '', array_join(transform(sequence(1, length({half})), p -> CASE
            WHEN {c} BETWEEN 'a' AND 'z' THEN {moved(97, 26)} WHEN {c} BETWEEN 'A' AND 'Z' THEN {moved(65, 26)}
            WHEN {c} BETWEEN '0' AND '9' THEN {moved(48, 10)} ELSE {c} END), ''))"""

    return f"""IF(x.name IS NULL, NULL, aggregate(sequence(1, {ROUNDS}),
        named_struct('l', substr(x.name, 1, length(x.name) DIV 2), 'r', substr(x.name, length(x.name) DIV 2 + 1)),
        (s, i) -> IF(i % 2 = 1, named_struct('l', {shifted('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {shifted('s.r', 's.l')})),
        s -> concat(s.l, s.r)))"""


def _written() -> str:
    """The pseudonym of ``x`` in the form of the match."""
    odd = "(x.f.l * 60000 + x.f.r)"
    ends = {"phone": "concat(substr(x.d, 1, length(x.d) - 10), lpad(x.f.l + 200, 3, '0'), lpad(x.f.r + 2000000, 7, '0'))",
            "phone01": f"concat(substr(x.d, 1, length(x.d) - 10), IF({odd} < 2000000000, lpad({odd}, 10, '0'), concat(({odd} - 2000000000) DIV 2000000 + 200, lpad({odd} % 2000000, 7, '0'))))",
            "ssn": "concat(lpad(x.f.l + 1 + IF(x.f.l >= 665, 1, 0), 3, '0'), lpad(x.f.r DIV 9999 + 1, 2, '0'), lpad(x.f.r % 9999 + 1, 4, '0'))",
            "card": "_card", "intl": "concat(substr(x.d, 1, 2), lpad(x.f.l, (length(x.d) - 2) DIV 2, '0'), lpad(x.f.r, (length(x.d) - 1) DIV 2, '0'))"}
    body = "concat(lpad(x.f.l, (length(x.d) - 1) DIV 2, '0'), lpad(x.f.r, length(x.d) DIV 2, '0'))"
    digit = f"CAST(substr({body}, -i, 1) AS INT)"
    check = f"""(10 - aggregate(sequence(1, length(x.d) - 1), 0, (s, i) -> s + CASE WHEN i % 2 = 0 THEN {digit}
        WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10) % 10"""
    ends["card"] = f"concat({body}, {check})"

    def filled(digits: str) -> str:
        return f"""array_join(transform(sequence(1, length(x.m)), j -> IF(substr(x.m, j, 1) BETWEEN '0' AND '9',
            substr({digits}, length(regexp_replace(substr(x.m, 1, j), '[^0-9]', '')), 1), substr(x.m, j, 1))), '')"""

    day = f"date_add({_FIRST}, CAST(x.f.r * 189 + x.f.l AS INT))"
    cases = [f"WHEN '{k}' THEN {filled(v)}" for k, v in ends.items()]
    cases += [f"WHEN '{k}' THEN date_format({day}, '{form}')" for k, form in (("iso", "yyyy-MM-dd"), ("dot", "dd.MM.yyyy"), ("slash", "dd/MM/yyyy"))]
    us = "CAST(x.f.r * 9 + x.f.l AS INT)"
    before = f"(datediff(add_months({_FIRST}, n), {_FIRST}) - 12 * n)"  # such dates before month n
    near = f"CAST(CAST({us} AS BIGINT) * 4800 DIV 88497 AS INT)"
    month = f"array_max(filter(sequence(greatest({near} - 1, 0), {near} + 1), n -> {before} <= {us}))"
    cases += [f"WHEN 'us' THEN date_format(date_add({_FIRST}, {us} + 12 * {month} + 12), 'MM/dd/yyyy')",
              "WHEN 'ip' THEN concat_ws('.', x.f.l DIV 256, x.f.l % 256, x.f.r DIV 256, x.f.r % 256)",
              "WHEN 'email' THEN concat(x.s, substr(x.m, instr(x.m, '@')))", "WHEN 'key' THEN concat('AKIA', x.s)"]
    return "CASE x.k " + " ".join(cases) + " ELSE x.m END"


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` replaced, and ``n_pii``, their number.

    ``key`` is the secret of the permutation: the same key links values across
    runs, another key gives unrelated pseudonyms.
    """
    spark = docs.sparkSession
    d = docs.drop("n_pii")
    some, m, parts, x, secret = (fresh(n, docs.columns) for n in ("_some", "_m", "_parts", "_x", "_secret"))
    # The key comes from a one-row table as a scalar subquery: no plan or event log shows it.
    row = spark.sql("SELECT * FROM VALUES (:key) AS t(key)", args={"key": key})
    found = F.col(text).rlike("[0-9@]") & F.col(text).rlike(PATTERN)
    d = d.withColumn(some, F.coalesce(found, F.lit(False)))
    d = d.withColumns({
        m: F.when(F.col(some), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))),
        parts: F.when(F.col(some), F.split(text, PATTERN)),
        secret: F.when(F.col(some), row.scalar()),
    })
    d = d.withColumn(x, F.expr(f"transform(`{m}`, m -> named_struct('m', m, 'd', {_DIGITS}, 'k', {_kind()}))"))
    d = d.withColumn(x, F.expr(f"""transform(`{x}`, x -> named_struct('m', x.m, 'd', x.d, 'k', x.k, 'n', {_number()},
        'name', CASE x.k WHEN 'email' THEN substring_index(x.m, '@', 1) WHEN 'key' THEN substr(x.m, 5) END))"""))
    d = d.withColumn(x, F.expr(f"transform(`{x}`, x -> named_struct('m', x.m, 'd', x.d, 'k', x.k, 'f', {_rounds(f'`{secret}`')}, 's', {_string_rounds(f'`{secret}`')}))"))
    d = d.withColumn(x, F.expr(f"transform(`{x}`, x -> named_struct('k', x.k, 'v', {_written()}))"))
    return d.withColumns({
        text: F.when(F.col(some), F.expr(f"array_join(zip_with(`{parts}`, `{x}`, (p, x) -> concat(p, coalesce(x.v, ''))), '')")).otherwise(F.col(text)),
        "n_pii": F.when(F.col(some), F.size(F.filter(x, lambda v: v["k"].isNotNull()))).otherwise(F.lit(0)).cast("long"),
    }).drop(some, m, parts, x, secret)
