"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` stages the counts of a text, ``verdict`` turns a table of
``Rule`` rows into one boolean expression over them.  Only built-in functions
run; nothing is shuffled, so hot sources and copies do not matter.

Null text counts as empty (no words: fails).  Very long texts cost
``n log n`` in their words.  Other columns pass through untouched, whatever
their names; the operator's own columns (the measures, ``base_failed``,
``kept``) replace those of the same name.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the supported languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "for", "that", "with", "on", "was", "by",
    "der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para",
)


@dataclass(frozen=True)
class Rule:
    """``low <= scale * numerator / denominator <= high`` (bounds may be None)."""

    name: str
    numerator: str
    denominator: str
    scale: int
    low: int | None = None
    high: int | None = None


#: The threshold table; every bound is an exact integer comparison.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 10, 20, 120),
    Rule("symbol_ratio", "n_symbols", "n_words", 100, None, 10),
    Rule("stop_word_ratio", "n_stop", "n_words", 100, 2, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", 100, None, 34),  # one repeat in three lines passes
    Rule("repeat_ratio", "n_repeat_words", "n_words", 100, None, 50),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read (no filtering)."""
    w, ls, s, p = (fresh(n, docs.columns) for n in ("_w", "_l", "_s", "_p"))
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({
        w: F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
        ls: F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size(w).cast("long"),
        "n_lines": F.size(ls).cast("long"),
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_stop": F.size(F.filter(F.col(w), lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).cast("long"),
        # every 3-word window with its place, equal windows side by side
        s: F.expr(f"""array_sort(CASE WHEN size(`{w}`) < 3 THEN array() ELSE
            transform(sequence(0, size(`{w}`) - 3), i -> struct(xxhash64(`{w}`[i], `{w}`[i + 1], `{w}`[i + 2]) AS h, i AS i)) END)"""),
    })
    d = d.withColumn(p, F.expr(f"""sort_array(transform(filter(`{s}`, (e, k) ->
        (k > 0 AND `{s}`[k - 1].h = e.h) OR (k < size(`{s}`) - 1 AND `{s}`[k + 1].h = e.h)), e -> e.i))"""))
    return d.withColumn("n_repeat_words", F.expr(f"""aggregate(`{p}`, named_struct('n', 0L, 'end', 0),
        (a, p) -> named_struct('n', a.n + 3L - greatest(a.end - p, 0), 'end', p + 3), a -> a.n)""")
    ).drop(w, ls, s, p)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One conjunction for the whole table; a zero denominator fails its rule."""
    out = F.lit(True)
    for r in rules:
        num, den = F.lit(r.scale) * F.col(r.numerator), F.col(r.denominator)
        out = out & (den > 0)
        if r.low is not None:
            out = out & (num >= F.lit(r.low) * den)
        if r.high is not None:
            out = out & (num <= F.lit(r.high) * den)
    return out


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``."""
    d = measures(docs, text).withColumn("base_failed", base_failed())
    return d.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same conjunction as SQL text."""
    parts = []
    for r in rules:
        parts.append(f"{r.denominator} > 0")
        if r.low is not None:
            parts.append(f"{r.scale} * {r.numerator} >= {r.low} * {r.denominator}")
        if r.high is not None:
            parts.append(f"{r.scale} * {r.numerator} <= {r.high} * {r.denominator}")
    return " AND ".join(parts)
