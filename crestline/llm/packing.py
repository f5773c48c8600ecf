"""Packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `capacity` ids. The histogram of piece lengths
(at most `capacity` numbers, whatever the corpus) decides everything: lengths are placed
longest first, each on the emptiest pattern that has room, and only counts of patterns are
kept. A piece then finds its place by its length and its rank among pieces of that length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BPE_JSON, BPE_RANKS, ByteBpe, documents, hash_bucket, id_and_text, partitions, settle, slices, tidy

CAPACITY = 2048
END_ID = 1
ROWS_PER_BUCKET = 50_000
Runs = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[Runs, int]]:
    """Patterns, each as ((length, times), ...), with the number of sequences that have the pattern.

    An item goes to the pattern with the most room. Where no pattern has room, new sequences
    are opened that hold as many items of this length as fit, the last one holding the rest.
    Items of one length go on equal patterns together, so the work depends on the number of
    patterns and not on the number of documents.
    """
    room: dict[int, list[tuple[Runs, int]]] = defaultdict(list)
    heap: list[int] = []

    def put(space: int, pattern: Runs, count: int) -> None:
        if count:
            if not room[space]:
                heapq.heappush(heap, -space)
            room[space].append((pattern, count))

    for length in sorted((n for n, count in histogram.items() if count), reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0] >= length:
                space = -heap[0]
                pattern, count = room[space].pop()
                if not room[space]:
                    heapq.heappop(heap)
                taken = min(left, count)
                left -= taken
                put(space, pattern, count - taken)
                runs = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
                put(space - length, runs, taken)
            else:
                each = capacity // length
                put(capacity - each * length, ((length, each),), left // each)
                if rest := left % each:
                    put(capacity - rest * length, ((length, rest),), 1)
                left = 0
    return [entry for space in sorted(room) for entry in room[space]]


class Places:
    """The place of a piece by its length and rank: arrays over the runs of all patterns."""

    def __init__(self, packed: list[tuple[Runs, int]]):
        rows, first_sequence = [], 0
        for runs, count in packed:
            at = 0
            for length, times in runs:
                rows.append((length, times * count, count, first_sequence, at))
                at += length * times
            first_sequence += count
        rows.sort(key=lambda r: r[0])
        self.sequences = first_sequence
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.length, items, self.count, self.sequence, self.offset = table.T
        self.start = np.cumsum(items) - items
        lengths, first = np.unique(self.length, return_index=True)
        self.base = np.zeros(int(lengths.max(initial=0)) + 1, dtype=np.int64)
        self.base[lengths] = self.start[first]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset); rank counts from 0 among the pieces of that length."""
        at = self.base[length] + rank
        run = np.searchsorted(self.start, at, side="right") - 1
        within = at - self.start[run]
        return self.sequence[run] + within % self.count[run], self.offset[run] + within // self.count[run] * length


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str = BPE_RANKS, json_path: str = BPE_JSON) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and end_id, cut every `capacity` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(ranks_path, json_path)
        for ids, texts in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                tokens = np.append(bpe.encode(text), end_id).astype("<u4")
                for start in range(0, len(tokens), capacity):
                    piece = tokens[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece), len(tokens)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return id_and_text(docs).mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


def rank_by_length(pieces: DataFrame) -> DataFrame:
    """pieces with rank, from 0 within each length.

    A length that many pieces share is dealt over hash buckets; a bucket's first rank is the
    number of pieces in the buckets before it, so no task ranks a whole length.
    """
    n_buckets = max(partitions(pieces.sparkSession), pieces.count() // ROWS_PER_BUCKET)
    dealt = pieces.withColumn("bucket", hash_bucket(F.col("doc_id"), n_buckets))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    return dealt.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + within).drop("bucket", "before")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str = BPE_RANKS, json_path: str = BPE_JSON) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    An empty or null text is one piece that holds end_id alone. Repeated rows are packed once
    each. No documents give no rows. Pieces of equal length are ranked by bucket, id and start.
    """
    pieces = settle(cut_pieces(docs, capacity, end_id, ranks_path, json_path))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = Places(shortest_pack_first(histogram, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(n) for n in names[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ranked = rank_by_length(pieces).select(*names[:5], F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


def q_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
