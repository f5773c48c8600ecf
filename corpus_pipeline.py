"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of
documents: toxic documents go, then exact copies, then all but one of each near-duplicate
group, then the passages that an earlier document has; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import exact_dedup, near_dedup, packing, substring_dedup, toxicity
from crestline.llm.common import drop_scratch, settle


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the ordinal model, fitted on this corpus's labels, finds toxic. Every row is judged by its text: null and empty texts, repeated rows and rows without an id stay or go likewise."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, "toxic", split_flag=True))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal texts stays, by id; null and empty texts are equal, a null id comes last, and of repeated rows one stays."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All but one of each group of documents linked by a similarity of 0.8 or more. Texts without words and rows without an id stay, and so do all rows of an id that stays."""
    return near_dedup.drop_near_copies(docs, 80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; every row stays, a null text stays null.

    Rows with one id, repeated rows too, do not take passages from each other; a row without an id keeps all.
    A cut can fall inside a character; what is left of one is dropped. n_chars, where the
    table has it, counts the characters of the new text.
    """
    cut = substring_dedup.cut_repeats(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    column = {name: F.col("doc")[name] for name in docs.columns}
    same = column["text"].isNull() | (F.col("n_removed") == 0)
    changed = F.when(same, column["text"]).otherwise(substring_dedup.whole_characters(F.col("kept_bytes")))
    column["text"] = changed
    if "n_chars" in column:
        column["n_chars"] = F.when(same, column["n_chars"]).otherwise(F.char_length(changed).cast(docs.schema["n_chars"].dataType))
    return cut.select(*(made.alias(name) for name, made in column.items()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids in sequences of 2,048; a null or empty text is one end mark, a repeated row is packed again."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("packing", packed),
]

#: Toxicity is a fitted model and packing needs a tokenizer: SQL cannot express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        drop_scratch(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
