"""Corpus pipeline over ``documents``.

Language ID, near-duplicate removal, benchmark decontamination, pseudonyms for
personal data, token ids.  Each stage takes all that the one before kept, and
its decisions take effect; ``run`` writes every stage's rows to the shared
folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import bpe, decontaminate, jaccard, language, pii
from pricelens.llm.common import staged
from pricelens.llm.queries import PII_KEY, TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with the predicted one in ``lang``.

    Null texts, texts without a letter and texts that no learned language
    explains go.  A text without any known n-gram, too short to be judged,
    keeps its ``lang``.  If nothing is labelled, nothing is learned: all
    texts with a letter stay as they are.
    """
    known = docs.where(~language.held_out())
    model = language.train(known)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model, floor=language.calibrated(known, model)).where(F.col("lang_pred") != "und")
    return found.withColumn("lang", F.when(F.col("score") > 0, F.col("lang_pred")).otherwise(F.coalesce("lang", "lang_pred"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least ``doc_id``."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with pseudonyms in ``text`` and ``n_chars`` of the new text."""
    done = pii.pseudonymised(docs, PII_KEY)
    return done.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids, with the text they decode to."""
    coded = bpe.encode(docs, TOKENIZER)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The stages train a model, walk links and permute by key: no SQL for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
