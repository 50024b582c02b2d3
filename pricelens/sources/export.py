"""CSV / JSON export of listings (13 fixed columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.functions.times import iso_text
from pricelens.params import CSV_FORMULA_PREFIXES, EXPORT_COLUMNS


def csv_safe(c: Column) -> Column:
    """Prefix an apostrophe to text starting with a spreadsheet formula char."""
    return F.when(F.substring(c, 1, 1).isin(list(CSV_FORMULA_PREFIXES)),
                  F.concat(F.lit("'"), c)).otherwise(c)


def export_rows(listings: DataFrame, query: str | None = None) -> DataFrame:
    """One row per stored listing (all of them, active or not) of ``query``
    (every search when None), with review fields flattened and flags joined."""
    df = listings if query is None else listings.filter(F.col("query") == query)
    r = F.col("ai_report")
    ts = F.col("scraped_at")
    iso = F.when(ts.isNotNull(), iso_text(ts, aware=True))
    return df.select(
        "id", "query", "title", "price_nok", "price_score", "composite_score",
        r["condition_score"].alias("condition_score"),
        r["battery_pct"].alias("battery_pct"),
        r["summary"].alias("ai_summary"),
        F.nullif(F.array_join(r["red_flags"], "; "), F.lit("")).alias("red_flags"),
        "location", "url", iso.alias("scraped_at"))


def guard_csv(rows: DataFrame) -> DataFrame:
    """Apply the formula guard to every text column (numbers untouched)."""
    return rows.select(*[csv_safe(F.col(f.name)).alias(f.name)
                         if isinstance(f.dataType, T.StringType) else F.col(f.name)
                         for f in rows.schema.fields])


def write_csv(rows: DataFrame, path: str) -> None:
    """Header + RFC-4180 quoting; blanks kept as written; NULL as an empty cell."""
    (guard_csv(rows).select(*EXPORT_COLUMNS).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", '""').option("nullValue", "")
     .csv(path))


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, NULLs kept, no guard, non-ASCII as is."""
    (rows.select(*EXPORT_COLUMNS).write.mode("overwrite")
     .option("ignoreNullFields", False).json(path))
