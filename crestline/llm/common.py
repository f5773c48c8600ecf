"""Helpers that the training-data operators share.

Every operator reads two columns of its input (an id and a text) and ignores the
rest, so extra columns cannot clash with the names it makes.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
END_OF_TEXT = "<|endoftext|>"

_scratch: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set by setCheckpointDir. Where neither is, a local session gets a temporary folder; on a cluster that is an error, as executors would not share it."""
    context = spark.sparkContext
    if configured := context.getConf().get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if (own := context._jsc.sc().getCheckpointDir()).isDefined():
        return own.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="crestline-"))
    return shared_dir(spark)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new table name; drop_scratch drops the table."""
    own = f"{name}_{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(own)
    return own


def drop_scratch(spark: SparkSession) -> None:
    """Drop this application's scratch tables; to be called when results that read them are written."""
    for name in _scratch.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: what follows survives lost executors and reads it, not recomputes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id and text; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of a few rows at a time, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).to_pylist()


def release() -> None:
    """Give unused memory of this Python worker back, as idle workers live on beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run):
    """run for mapInArrow, with release() after the last batch."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def per_text(docs: DataFrame, schema: str, of_text) -> DataFrame:
    """doc_id and the columns of schema, which of_text(list of texts) returns as a list of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([ids, *of_text(texts)], names=names)

    names = ["doc_id", *(part.split()[0] for part in schema.split(", "))]
    return id_and_text(docs).mapInArrow(tidy(run), f"doc_id long, {schema}")


_loaded: dict[tuple, object] = {}


class ByteBpe:
    """Byte-level BPE ids, equal to those of the tokenizers file at json_path.

    The ranks file holds the same vocabulary and encodes several times faster; a text
    with the one special token in it goes through the tokenizers library itself.
    """

    def __init__(self, ranks_path: str = BPE_RANKS, json_path: str = BPE_JSON):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        self.whole = None

    @classmethod
    def load(cls, ranks_path: str = BPE_RANKS, json_path: str = BPE_JSON) -> ByteBpe:
        key = (ranks_path, json_path)
        if key not in _loaded:
            _loaded[key] = cls(*key)
        return _loaded[key]

    def encode(self, text: str) -> np.ndarray:
        if END_OF_TEXT not in text:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), by hooking to the least neighbour and pointer jumping.

    Each round is one aggregation with map-side combining and one join, written to the
    shared folder; a chain of n links takes about log n rounds. Only a count reaches the driver.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("hooked"))
        jump = labels.select(F.col("id").alias("hooked"), F.col("component").alias("jumped"))
        moved = settle(
            hooked.join(jump, "hooked", "left").select("id", F.least("hooked", F.coalesce("jumped", "hooked")).alias("component"), F.col("component").alias("before"))
        )
        labels = moved.select("id", "component")
        if moved.where("component <> before").isEmpty():
            return labels


def hash_bucket(column: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n))
