from datetime import datetime

from pyspark.sql import functions as F

from pricelens import schemas

_seq = [0]


def listing(id, price=5000, at=None, query="iphone 13", title="iPhone 13", description="",
            report=None, price_score=-5.0, composite=None, image_urls=None, location=None):
    from tests.conftest import T0
    _seq[0] += 1
    return dict(id=str(id), query=query, title=title, price_nok=price, url=f"https://www.finn.no/item/{id}",
                location=location, scraped_at=at or T0, seq=_seq[0], image_urls=image_urls or [],
                description=description, scan_id=None, price_score=price_score,
                composite_score=composite, ai_report=report)


from pyspark.sql import types as T

BATCH_SCHEMA = T.StructType(list(schemas.OBSERVATIONS.fields) + [
    T.StructField("price_score", T.DoubleType()), T.StructField("composite_score", T.DoubleType()),
    T.StructField("ai_report", schemas.AI_REPORT)])


def batch(spark, rows):
    cols = BATCH_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], BATCH_SCHEMA)


def report(condition=8, battery=None, flags=None, summary=""):
    return (condition, battery, flags or [], summary)


def rows(df, *cols, order=None):
    d = df.select(*cols)
    if order:
        d = d.orderBy(*order)
    return [tuple(r) for r in d.collect()]
