"""Packed id matrices by best-fit-decreasing.

Documents become ids with an end id, documents longer than a sequence are split without
loss, and the pieces of a block are packed by best fit, longest first: a segment tree over
capacities finds the fullest open sequence that still has room. A block is a bounded run of
documents of one task, so packing needs no shuffle and no memory beyond the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import BPE_JSON, BPE_RANKS, ByteBpe, documents, id_and_text, settle, slices, tidy

CAPACITY = 2048
END_ID = 1
BLOCK_IDS = 4 << 20


class RoomTree:
    """Open sequences by their room left, 0..capacity: the least room that is at least a size, in log(capacity) steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        node = room + self.leaves
        while node:
            self.some[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) of the best fit, taken out; None if nothing has room."""
        node = size + self.leaves
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.some[node] -= 1
            node >>= 1
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length; equal lengths in their order."""
    tree, places, opened = RoomTree(capacity), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room, sequence = tree.take(lengths[k]) or (capacity, opened)
        opened += sequence == opened
        places[k] = (sequence, capacity - room)
        tree.put(room - lengths[k], sequence)
    return places


def packed_matrices(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, block_ids: int = BLOCK_IDS, ranks_path: str = BPE_RANKS, json_path: str = BPE_JSON) -> DataFrame:
    """One row per sequence: a row of its shard's id matrix with what training needs beside it.

    shard and sequence name the row; ids is binary, little-endian unsigned 16-bit if the ids
    allow it (id_bytes 2), else 32-bit (4), padded with end_id to `capacity`; cu_lengths are the
    cumulative lengths of its segments from 0; position_resets are the offsets at which positions
    start from 0 again (a document's later pieces start at their place in the document, in starts);
    doc_ids and starts say whose ids a segment holds. An empty or null text is one segment of end_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, block = ByteBpe.load(ranks_path, json_path), TaskContext.get().partitionId(), 0
        pieces: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            places = best_fit_decreasing([len(p[2]) for p in pieces], capacity)
            by_sequence: dict[int, list] = {}
            for piece, (sequence, offset) in zip(pieces, places, strict=True):
                by_sequence.setdefault(sequence, []).append((offset, *piece))
            rows = []
            for sequence, segments in sorted(by_sequence.items()):
                segments.sort(key=lambda s: s[0])
                ids = np.concatenate([s[3] for s in segments])
                wide = np.full(capacity, end_id, ids.dtype)
                wide[: len(ids)] = ids
                small = int(wide.max()) < 1 << 16
                ends = np.cumsum([len(s[3]) for s in segments])
                rows.append(((task << 32) + block, sequence, wide.astype("<u2" if small else "<u4").tobytes(), 2 if small else 4, [0, *ends.tolist()], [s[0] for s in segments], [s[1] for s in segments], [s[2] for s in segments], [s[4] for s in segments]))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), *[pa.list_(pa.int64())] * 5)
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 512], strict=True), types, strict=True)], names=names)

        for ids, texts in slices(batches):
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                tokens = np.append(bpe.encode(text), end_id).astype("<u4")
                held += len(tokens)
                pieces += [(doc_id, start, tokens[start : start + capacity], len(tokens)) for start in range(0, len(tokens), capacity)]
            if held >= block_ids:
                yield from flush()
                pieces, held, block = [], 0, block + 1
        if pieces:
            yield from flush()

    names = ["shard", "sequence", "ids", "id_bytes", "cu_lengths", "position_resets", "doc_ids", "starts", "doc_tokens"]
    schema = "shard long, sequence long, ids binary, id_bytes int, cu_lengths array<long>, position_resets array<long>, doc_ids array<long>, starts array<long>, doc_tokens array<long>"
    return id_and_text(docs).mapInArrow(tidy(run), schema)


def write_packed(docs: DataFrame, path: str, capacity: int = CAPACITY, **options) -> None:
    """Write packed_matrices as Parquet, a file per task."""
    packed_matrices(docs, capacity, **options).write.option("compression", "zstd").parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, shard, sequence, offset of every segment, from the matrices as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
                for k, (a, b) in enumerate(zip(r["cu_lengths"][:-1], r["cu_lengths"][1:], strict=True)):
                    rows.append((r["doc_ids"][k], r["starts"][k], b - a, zlib.crc32(ids[a:b]), r["doc_tokens"][k], r["shard"], r["sequence"], a))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "sequence", "offset"]
    return packed.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


def q_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(settle(packed_matrices(documents(spark, sf_dir))))
