"""Case folding and decimal digits over all of Unicode, as built-in expressions.

The tables follow from Python's own ``str.casefold`` and ``unicodedata``, so
that the results equal ``s.casefold()`` and ``int(digits)`` there.  Texts
without other than ASCII characters, nearly all, never meet them.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^[\x00-\x7F]*$"


def _points():
    return (chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that fold to one other, what they fold to, and those that fold to several."""
    changed = [(c, c.casefold()) for c in _points() if c.casefold() != c]
    changed += [(chr(c), chr(c).lower()) for c in range(65, 91)]
    single = [(c, f) for c, f in changed if len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single), tuple((c, f) for c, f in changed if len(f) > 1)


@cache
def _digits() -> tuple[str, str]:
    own = [c for c in _points() if unicodedata.category(c) == "Nd"]
    return "".join(own), "".join(str(unicodedata.digit(c)) for c in own)


def casefold(text: Column) -> Column:
    """``str.casefold`` of the text.  Characters that fold to several are rare
    but for one: the others are looked for only where one of them occurs."""
    source, target, several = _folds()
    common = "\u00df"
    rest = [(c, f) for c, f in several if c != common]
    one = F.replace(F.translate(text, source, target), F.lit(common), F.lit("ss"))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in rest])
    wide = F.when(text.rlike("[" + "".join(c for c, _ in rest) + "]"), F.aggregate(pairs, one, lambda t, x: F.replace(t, x["c"], x["f"]))).otherwise(one)
    return F.when(text.rlike(_PLAIN), F.lower(text)).otherwise(wide)


def ascii_digits(text: Column) -> Column:
    """The text with every decimal digit written as 0 to 9."""
    source, target = _digits()
    return F.when(text.rlike(_PLAIN), text).otherwise(F.translate(text, source, target))
