"""Importance resampling towards a target distribution, by hashed runs of one or two words.

Each task builds tries of its words: a node of depth one is a word, a node of depth two a
word and the next one. A node holds how often its path occurs and the CRC-32 state after
the path's bytes, from which its child's state follows, so no feature is ever spelled out.
Bucket totals of all tries are merged by Spark; their logarithmic gains, one for each
bucket, are then attached to the nodes, and a document's weight is the mean along its paths.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, release, settle
from .words import WORD, Block, blocks, utf8

BUCKETS = 10_000
MIN_WORDS = 20
DRAWN_PERCENT = 25
SEED = 7
REMEMBERED_WORDS = 1 << 19
SHIFTED_BYTES = 64


@cache
def shifts() -> np.ndarray:
    """shifts()[n, k, v]: what byte k of a CRC-32 state, being v, adds to the state after n more bytes, before these bytes' own part."""
    table = np.zeros((SHIFTED_BYTES + 1, 4, 256), np.uint32)
    for n in range(SHIFTED_BYTES + 1):
        zeros = bytes(n)
        base = zlib.crc32(zeros)
        bits = [zlib.crc32(zeros, 1 << b) ^ base for b in range(32)]
        for k in range(4):
            for b in range(8):
                table[n, k, 1 << b : 2 << b] = table[n, k, : 1 << b] ^ np.uint32(bits[8 * k + b])
    return table


class Words(dict):
    """Nodes of depth one, by word: numbers from 0 with the CRC-32 state of the word, and of a space and the word (what it adds as a child)."""

    def __init__(self) -> None:
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.crc, self.child_crc, self.child_bytes = array("I"), array("I"), array("q")
        self.long: dict[int, bytes] = {}

    def __missing__(self, word: bytes) -> int:
        node = self[word] = len(self)
        self.crc.append(zlib.crc32(word))
        self.child_crc.append(zlib.crc32(b" " + word))
        self.child_bytes.append(len(word) + 1)
        if len(word) >= SHIFTED_BYTES:
            self.long[node] = word
        return node


class Trie:
    """The trie of a block's words: nodes of depth one and two with counts and CRC-32 states, and each word's place in it."""

    def __init__(self, words: Words, block: Block):
        self.at = np.fromiter(map(words.__getitem__, block.words), np.int64, len(block.words))
        segment = block.segment
        #: A segment's carried word counts with the segment before; here it is only the parent of the next.
        own = np.ones(len(self.at), bool)
        own[block.begin[:-1][block.carried > 0]] = False
        self.own = own
        self.state = np.array(words.crc, np.uint32)
        self.count = np.bincount(self.at[own], minlength=len(self.state))
        self.paired = np.flatnonzero(segment[1:] == segment[:-1]) + 1  # words that follow one of the same text
        pair = self.at[self.paired - 1] << 32 | self.at[self.paired]
        nodes, self.pair_at, self.pair_count = np.unique(pair, return_inverse=True, return_counts=True)
        self.pair_state = self.children(words, nodes >> 32, nodes & 0xFFFFFFFF)

    def children(self, words: Words, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        state, size = self.state[parent], np.array(words.child_bytes, np.int64)[child]
        table, n = shifts(), np.minimum(size, SHIFTED_BYTES)
        out = table[n, 0, state & 255] ^ table[n, 1, state >> 8 & 255] ^ table[n, 2, state >> 16 & 255] ^ table[n, 3, state >> 24]
        out ^= np.array(words.child_crc, np.uint32)[child]
        for k in np.flatnonzero(size > SHIFTED_BYTES).tolist():
            out[k] = zlib.crc32(b" " + words.long[int(child[k])], int(state[k]))
        return out

    def totals(self, buckets: int) -> np.ndarray:
        """Occurrences of features by bucket."""
        found = np.bincount(self.state % np.uint32(buckets), self.count, buckets) + np.bincount(self.pair_state % np.uint32(buckets), self.pair_count, buckets)
        return found.astype(np.int64)

    def walk(self, gains: np.ndarray) -> np.ndarray:
        """Per word: the gains of the features that end there."""
        n = np.uint32(len(gains))
        out = np.where(self.own, gains[self.state % n][self.at], 0)
        out[self.paired] += gains[self.pair_state % n][self.pair_at]
        return out


def tries(texts: pa.Array, words: Words) -> Iterator[tuple[Block, Trie]]:
    for block in blocks(texts, WORD, carry=1):
        if len(words) > REMEMBERED_WORDS:
            words.forget()
        yield block, Trie(words, block)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows. Each task sends its own totals once; Spark adds them up, and one number a bucket comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(buckets, np.int64), Words()
        for batch in batches:
            for _, trie in tries(batch.column(0), words):
                total += trie.totals(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
        del words
        release()

    counted = texts.select(utf8(F.col(text_col)).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        found[bucket] = n
    return found


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) of each bucket, p and q its add-one shares in the target and the source."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight, one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            n_words, total = np.zeros((2, batch.num_rows), np.int64)
            for block, trie in tries(batch.column(1), words):
                upto = np.append(0, np.cumsum(trie.walk(gains)))
                np.add.at(total, block.row, upto[block.begin[1:]] - upto[block.begin[:-1]])
                np.add.at(n_words, block.row, np.diff(block.begin) - block.carried)
            n_features = np.maximum(2 * n_words - 1, 0)
            columns = [pa.array(c) for c in (n_words, n_features, total // np.maximum(n_features, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight"])
        del words
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u in (0, 1) from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the drawn rows by score, then id; null for others.

    A score is a whole number in a range that the formulas bound (some 10^5 values at any size of input), so the
    counts by score give both the least score drawn and how many rows come before each score. Rows
    are only sorted within their score, and only those from the least score on.
    """
    eligible = F.col("n_words") >= min_words
    counts = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    higher = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = settle(counts.withColumn("higher", higher).withColumn("wanted", F.expr(f"{percent} * sum(n) OVER () div 100")))
    reached = before.where("higher < wanted")
    least = reached.agg(F.min("score")).first()[0]
    candidate = eligible & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    at = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    placed = scored.where(candidate).withColumn("at", at).join(reached, "score").withColumn("place", F.col("higher") + F.col("at"))
    ranked = placed.select(*scored.columns, F.when(F.col("place") <= F.col("wanted"), F.col("place")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(candidate, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per row of docs, rank null if it is not drawn.

    A null or empty text has no features and the weight 0. Each repeated row takes part on its own; rows
    that agree in score and id take consecutive ranks in any order, and a null id comes last among equal
    scores, with the hash of an empty id. An empty docs gives no rows; with an empty target all gains come from the
    added ones. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    scored = weights(docs, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return draw(settle(scored), percent, min_words)


def q_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its table, over the bytes of each distinct feature.
SQL = r"""
WITH crc AS (SELECT list(v ORDER BY k) AS tab FROM (SELECT k, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS v FROM range(256) r(k))),
x AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
f AS (SELECT side, id, unnest(ws) AS feature FROM w UNION ALL SELECT side, id, unnest(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) FROM w),
h AS (SELECT feature, hex(feature) AS h FROM (SELECT DISTINCT feature FROM f)),
b AS (SELECT feature, xor(list_reduce(list_transform(range(1, len(h), 2), lambda k: ('0x' || substr(h, k, 2))::BIGINT), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM h, crc),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN b USING (feature) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id),
s AS (SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN m USING (id) WHERE side = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM s LEFT JOIN r USING (doc_id)
"""
