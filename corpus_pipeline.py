"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, tokens. Every stage works on what the one before kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.llm import bpe, decontaminate, langid, secret_scan, simhash
from framewright.llm.common import BATCH_ROWS, fresh, table
from framewright.session import cut


#: Characters from which a text is long enough to be held against its declared language; scores from which a prediction
#: stands against that, and up to which it says nothing (0.5 is a tie of two languages).
LONG_ENOUGH, SURE, UNSURE = 300, 0.6, 0.502


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a language of the corpus, and in the one they declare.

    Null texts and texts without letters go. Of texts of at least LONG_ENOUGH characters, those go whose best languages are as good as tied,
    so that none is recognised, and those surely written in another language than `lang` says. A null `lang` becomes the language predicted.
    Shorter texts are no evidence and stay. Repeated rows are judged alike; extra columns are kept. Without labels, only texts without letters go.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    model = langid.learn(docs)
    if not model.languages:
        return docs.where(langid.lettered()("text"))
    name = fresh(docs, "language_found")
    found, score = F.col(f"{name}.lang_pred"), F.col(f"{name}.score")
    strange = (F.length("text") >= LONG_ENOUGH) & ((score <= UNSURE) | ((F.col("lang") != found) & (score >= SURE)))
    judge = langid.predictor(model).asNondeterministic()  # judged once, not for each use of the result
    kept = docs.withColumn(name, judge("text")).where((found != "und") & ~F.coalesce(strange, F.lit(False)))
    return kept.withColumn("lang", F.coalesce("lang", found)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest id. Null texts and empty ones are one group; one of several rows with one id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item. Null texts hold none; repeated rows are kept or dropped alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind; n_chars follows the text. A null text stays null; every row stays."""
    columns = [c for c in docs.columns if c not in ("text", "n_chars")]
    clean = docs.select(*columns, secret_scan.redactor()("text").alias("text"))
    return clean.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the text that is left and decode it again: the number of ids, their hash and that of the decoded text. A null text has none; repeated rows are repeated."""
    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("simhash_dedup", near_duplicates), ("decontamination", decontamination), ("secret_scan", secrets), ("bpe", tokens)]
#: SQL can express neither cross parsing nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
