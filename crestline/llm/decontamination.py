"""Benchmark decontamination by winnowing.

A window is ten consecutive words of a benchmark item, or the whole of a shorter item. Of
each window the least hash of its runs of five words is kept as fingerprint; equal windows
have equal fingerprints, so training and test fingerprints that meet lead to every shared
window. A fixed-size bit filter of the test fingerprints drops almost all training
fingerprints where they are read. What is left extends to its windows, which are joined
as text, and hit windows that overlap merge into spans.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, release, settle
from .words import WORD, Block, blocks, utf8

WINDOW = 10
GRAM = 5
#: Bits of the filter: 1 MB in each task, however long the benchmark is. A fuller filter lets more through to the join.
FILTER_BITS = 1 << 23
REMEMBERED_WORDS = 1 << 18
SENT_WINDOWS = 1 << 14
ITEM_ROWS = "item_id string, fingerprint long, window binary, length int"
FOUND_ROWS = "doc_id long, text_hash long, n_words long, fingerprint long, window binary, start long, length int"


class WordHashes(dict):
    """64-bit hashes by word; only short words are remembered, and never too many."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def fingerprints(hashes: np.ndarray, length: int) -> np.ndarray:
    """For each run of length words, the least hash of its runs of GRAM words (or of itself, if it is shorter)."""
    gram = min(GRAM, length)
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    n = len(hashes) - gram + 1
    grams = np.zeros(n, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    least = grams[: len(hashes) - length + 1].copy()
    for k in range(1, length - gram + 1):
        np.minimum(least, grams[k : k + len(least)], out=least)
    return least


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, fingerprint, window (its words, joined by one space) and length: one row per window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for row in range(batch.num_rows):
                words = WORD.findall(batch.column(1)[row].as_py().lower())
                length = min(WINDOW, len(words))
                values = fingerprints(known.of(words), length).view(np.int64) if words else np.zeros(0, np.int64)
                for at in range(0, len(values), SENT_WINDOWS):
                    part = values[at : at + SENT_WINDOWS]
                    texts = [b" ".join(words[k : k + length]) for k in range(at, at + len(part))]
                    each = pa.array(np.full(len(part), row))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(each), pa.array(part), pa.array(texts, pa.binary()), pa.array(np.full(len(part), length, np.int32))], names=["item_id", "fingerprint", "window", "length"])

    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), utf8(F.col(text_col)).alias("text")).mapInArrow(run, ITEM_ROWS)


def bit_filter(rows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Two bits of each fingerprint set in a filter of so many bits. Spark merges them; bits / 64 numbers at most come back."""
    places = F.explode(F.array(F.col("fingerprint").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("fingerprint", 40).bitwiseAND(F.lit(bits - 1))))
    merged = rows.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask"))
    found = np.zeros(bits // 64, np.int64)
    for word, mask in merged.collect():
        found[word] = mask
    return found.view(np.uint64)


def passing(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    last = np.uint64(len(found) * 64 - 1)

    def has(at: np.ndarray) -> np.ndarray:
        return (found[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    at = np.flatnonzero(has(values & last))
    return at[has((values[at] >> np.uint64(40)) & last)]


def selected(hashes: np.ndarray, length: int, found: np.ndarray) -> np.ndarray:
    """Starts of the windows whose fingerprint passes. Neighbours with one fingerprint are looked up once."""
    values = fingerprints(hashes, length)
    if not len(values):
        return np.zeros(0, np.int64)
    changes = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    ends = np.append(changes[1:], len(values))
    at = passing(found, values[changes])
    sizes = ends[at] - changes[at]
    return np.repeat(changes[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def document_windows(docs: DataFrame, lengths: list[int], found: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two kinds of rows: one for each document with its n_words (window null), and one for each window of a given length whose fingerprint passes the filter."""

    def windows(block: Block, hashes: np.ndarray) -> Iterator[tuple]:
        segment = block.segment
        for length in lengths:
            starts = selected(hashes, length, found)
            starts = starts[segment[starts] == segment[starts + length - 1]] if len(starts) else starts
            values = fingerprints(hashes, length)[starts].view(np.int64) if len(starts) else []
            for at, value in zip(starts.tolist(), values, strict=True):
                k = segment[at]
                yield block.row[k], value, b" ".join(block.words[at : at + length]), block.first[k] + at - block.begin[k], length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        names = [c.split()[0] for c in FOUND_ROWS.split(", ")]
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            for block in blocks(batch.column(2), WORD, WINDOW - 1):
                np.add.at(n_words, block.row, np.diff(block.begin) - block.carried)
                rows = windows(block, known.of(block.words))
                while part := list(itertools.islice(rows, SENT_WINDOWS)):
                    row, value, window, start, length = zip(*part, strict=True)
                    at = pa.array(row, pa.int64())
                    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.nulls(len(part), pa.int64())]
                    columns += [pa.array(value, pa.int64()), pa.array(window, pa.binary()), pa.array(start, pa.int64()), pa.array(length, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            nothing = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), *nothing], names=names)
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, FOUND_ROWS)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, members).

    documents: doc_id, text_hash, n_words, one row per row of docs. spans: doc_id, text_hash, start, length and
    window_id, one row per place where an item's window occurs. members: window_id, item_id.
    """
    rows = settle(item_windows(items))
    distinct = settle(rows.select("fingerprint", "window", "length").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    lengths = sorted(r.length for r in distinct.select("length").distinct().collect())
    found = settle(document_windows(docs, lengths, bit_filter(distinct), id_col, text_col))
    extended = found.where("window IS NOT NULL").join(distinct.select("fingerprint", "window", "window_id"), ["fingerprint", "window"])
    spans = settle(extended.select("doc_id", "text_hash", "start", "length", "window_id").distinct())
    members = rows.join(distinct.select("window", "window_id"), "window").select("window_id", "item_id").distinct()
    return found.where("window IS NULL").select("doc_id", "text_hash", "n_words"), spans, members


def per_document(spans: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_hit (words inside any window, each counted once) and windows (the sorted ids of its windows)."""
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))
    places = spans.withColumn("end", F.col("start") + F.col("length")).withColumn("fresh", fresh)
    return places.groupBy("doc_id", "text_hash").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("window_id")).alias("windows"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of docs.

    Documents with one set of windows share its list of items, which is made once. A null or
    empty text, of a document or an item, has no words; repeated rows of docs give a row each, rows
    with one id and other texts are told apart by the text; repeated items count once by id, and a
    null item_id is the empty string. Empty tables give no rows, or no hits. Other columns are not read.
    """
    documents, spans, members = hits(docs, items, id_col, text_col)
    keyed = settle(per_document(spans).withColumn("set_key", F.sha2(F.array_join("windows", ","), 256)))
    each = keyed.groupBy("set_key").agg(F.first("windows").alias("windows")).select("set_key", F.explode("windows").alias("window_id"))
    listed = each.join(members, "window_id").groupBy("set_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    named = listed.select("set_key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = keyed.select("doc_id", "text_hash", "n_hit", "set_key").join(named, "set_key")
    found = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n_hit", "n_items", "items_sha256")
    joined = documents.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without any hit."""
    _, spans, _ = hits(docs, items)
    bad = spans.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("hash"))
    return docs.join(bad, same, "left_anti")


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, ws[k:k + least(len(ws), 10) - 1] AS w FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, l, k, ws[k:k + l - 1] AS w FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM g) WHERE len(ws) >= l)),
h AS (SELECT doc_id, item_id, p.l, k FROM p JOIN g ON p.w = g.w AND p.l = g.l),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS pos FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
