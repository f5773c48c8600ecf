"""Token counts from an exact length histogram.

Documents are aggregated by encoded length. Suffix sums over the lengths then answer, for
every context limit: documents and tokens at or above it, tokens left when each document
is cut at it, and any quantile. Only the histogram is ever sorted, in blocks of lengths.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BPE_JSON, BPE_RANKS, ByteBpe, documents, per_text, settle

BLOCK = 1024


def encoded_lengths(docs: DataFrame, ranks_path: str = BPE_RANKS, json_path: str = BPE_JSON) -> DataFrame:
    """doc_id, n_tokens; an empty or null text has none."""

    def lengths(texts: list[str]) -> list[pa.Array]:
        bpe = ByteBpe.load(ranks_path, json_path)
        return [pa.array([len(bpe.encode(t)) for t in texts], pa.int64())]

    return per_text(docs, "n_tokens long", lengths)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    return lengths.groupBy(F.col(length_col).alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per length: length, n_docs, docs_at_least, tokens_at_least, docs_below, truncated_tokens.

    truncated_tokens is what remains when every document is cut at `length` ids. Sums run
    within blocks of `block` lengths; a block's own start comes from the sums of whole blocks,
    of which there are (longest document / block).
    """
    rows = histogram.withColumns({"block": F.floor(F.col("length") / block), "tokens": F.col("length") * F.col("n_docs")})
    down = Window.orderBy(F.desc("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = blocks.select("block", (F.sum("d").over(down) - F.col("d")).alias("docs_later"), (F.sum("t").over(down) - F.col("t")).alias("tokens_later"), F.sum("d").over(Window.partitionBy()).alias("docs_all"), F.sum("t").over(Window.partitionBy()).alias("tokens_all"))
    within = Window.partitionBy("block").orderBy(F.desc("length"))
    summed = rows.join(later, "block").select(
        "length",
        "n_docs",
        (F.col("docs_later") + F.sum("n_docs").over(within)).alias("docs_at_least"),
        (F.col("tokens_later") + F.sum("tokens").over(within)).alias("tokens_at_least"),
        "docs_all",
        "tokens_all",
    )
    return summed.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("docs_all") - F.col("docs_at_least")).alias("docs_below"),
        (F.col("tokens_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def at_limits(sums: DataFrame, limits: DataFrame, limit_col: str = "context_limit") -> DataFrame:
    """context_limit, docs_over, tokens_over, truncated_tokens for any limits, present as lengths or not.

    The answer at a limit follows from the next greater length's suffix sums, found by an as-of
    pass over lengths and limits together; past the longest document nothing is cut.
    """
    lengths = sums.select(F.col("length").alias("at"), "docs_at_least", "tokens_at_least", F.lit(1).alias("kind"))
    asked = limits.select(F.col(limit_col).cast("long").alias("at"), F.lit(None).cast("long").alias("docs_at_least"), F.lit(None).cast("long").alias("tokens_at_least"), F.lit(0).alias("kind"))
    total = sums.agg(F.max("tokens_at_least").alias("total"))
    after = Window.orderBy("at", F.desc("kind")).rowsBetween(1, Window.unboundedFollowing)
    found = lengths.union(asked).select("at", "kind", *(F.coalesce(F.first(c, True).over(after), F.lit(0)).alias(c) for c in ("docs_at_least", "tokens_at_least")))
    return (
        found.where("kind = 0")
        .crossJoin(F.broadcast(total))  # one row
        .select(F.col("at").alias(limit_col), F.col("docs_at_least").alias("docs_over"), F.col("tokens_at_least").alias("tokens_over"), (F.coalesce("total", F.lit(0)) - F.col("tokens_at_least") + F.col("at") * F.col("docs_at_least")).alias("truncated_tokens"))
    )


def quantile(sums: DataFrame, q: float) -> Column | None:
    """The least length that at least a share q of the documents do not exceed; None without documents."""
    ranked = sums.withColumn("total", F.max("docs_at_least").over(Window.partitionBy()))
    row = ranked.where((F.col("docs_below") + F.col("n_docs")) >= F.greatest(F.ceil(q * F.col("total")), F.lit(1))).agg(F.min("length")).first()
    return row[0]


def token_counts(docs: DataFrame, ranks_path: str = BPE_RANKS, json_path: str = BPE_JSON) -> DataFrame:
    """suffix_sums over all docs. Repeated rows count once each; no documents give no rows."""
    return suffix_sums(settle(length_histogram(encoded_lengths(docs, ranks_path, json_path))))


def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
