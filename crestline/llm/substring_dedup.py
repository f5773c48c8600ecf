"""Removal of byte strings that also start in an earlier document, by prefix doubling over sampled positions.

A byte goes if some `match` bytes around it also start in a document with a smaller id.
Positions are ranked by the bytes that follow them, at growing lengths, and a position
leaves as soon as its rank is unique or `match` is reached:

1. rank of the first `seed` bytes. Only synchronising positions take part: in each window
   of `match` bytes the seed with the least hash speaks for the window, so equal windows
   pick equal seeds, and one position stands for a run of some fourteen windows.
   Spark deals seeds by their value; those that occur in one document only are unique and leave.
2. rank of a run's whole text, among the runs that Spark brings together by seed. Of equal
   runs, those outside the least document are decided; a run whose seed has no other text left leaves.
3. rank pairs of the windows of what is left: the rank of the first half at each position,
   where unique ranks leave, then the pair of it and the rank at offset `match` / 2. The least
   document of each pair keeps its bytes.
4. A seed with HOT_RUNS runs or more is not brought together, whatever the size of the input. Its runs are
   dealt by their text, of which the least document's copy goes on. These runs then stay where they are, and
   only ranks travel: the distinct first halves among HOT_HELD runs, of which unique ones leave, then their distinct
   pairs of halves with the least document, for which the least of all documents comes back. So however
   often a window occurs, it is sent once for so many runs.

So a task sees a bounded number of runs of any one seed. Texts travel in compressed blocks of
whole documents; a seed is six bytes on its way, each seed once per block. Ranks are exact texts
in step 2 and 128-bit hashes in steps 3 and 4; what is unique is told by 48 bits of a rank, which may keep too much and never too little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, id_and_text, partitions, scratch_table, settle, tidy

MATCH = 50
SEED = 24
BLOCK_BYTES = 4 << 20
HOT_RUNS = 1 << 13
HELD_RUNS = 1 << 16
HOT_HELD = 20_000
CHUNK = 1 << 20
PARTS_PER_PARTITION = 3

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * B
    h = (h ^ (h >> np.uint64(27))) * C
    return h ^ (h >> np.uint64(31))


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each position, as integers."""
    x = raw.astype(np.uint64)
    for s in (1, 2, 4):
        x = x[:-s] | (x[s:] << np.uint64(8 * s))
    return x


def string_hashes(raw: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A 64-bit hash of the `length` >= 8 bytes that start at each position that has as many."""
    x, n = eights(raw), len(raw) - length + 1
    h = (x[:n] + np.uint64(salt)) * A
    for at in range(8, length, 8):
        at = min(at, length - 8)
        h = ((h ^ (h >> np.uint64(29))) + x[at : at + n]) * B
    return finish(h)


def seed_runs(raw: np.ndarray, match: int = MATCH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, first, last, seed position): windows first..last, by their starts, are those for which that seed speaks.

    Of equal hashes within a window the leftmost speaks. A long text is cut into chunks; a run
    that a cut splits is merely two runs.
    """
    found = [chunk_runs(raw[at : at + CHUNK + match - 1], at, match, seed) for at in range(0, len(raw) - match + 1, CHUNK)]
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def chunk_runs(raw: np.ndarray, base: int, match: int, seed: int) -> tuple[np.ndarray, ...]:
    h = string_hashes(raw, seed, 0)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, span = match - seed + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := width - span:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return finish(h[at[first]] ^ A), first + base, last + base, at[first] + base  # least hashes are small: mixed again, seeds spread evenly


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, payload: rows of docs, all columns, in compressed blocks of about block_bytes of text.

    The table is bucketed by block, so that what is found out about blocks is joined to them
    without moving a text again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            packed = pack_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), pa.array([packed], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                held.append(batch.slice(at, 64))
                size += sum(len(v) for v in held[-1].column("text").cast(pa.large_binary()).to_pylist() if v is not None)
                if size >= block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    name = scratch_table(docs.sparkSession, "text_blocks")
    docs.mapInArrow(tidy(run), "block long, payload binary").write.option("compression", "uncompressed").bucketBy(partitions(docs.sparkSession), "block").format("parquet").saveAsTable(name)
    return docs.sparkSession.table(name)


def open_block(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def texts_of(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """(row, doc_id, bytes) of the rows that have an id; a row without one matches nothing."""
    for row, (doc_id, raw) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist(), strict=True)):
        if doc_id is not None and raw:
            yield row, doc_id, raw


def block_seeds(table: pa.Table, match: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, in_two, runs): the block's distinct 48-bit seeds in order, whether two of its documents hold one, and the power of two below its number of runs."""
    own = [np.unique(seed_runs(np.frombuffer(raw, np.uint8), match, seed)[0] >> np.uint64(16), return_counts=True) for _, _, raw in texts_of(table)]
    every = np.concatenate([np.zeros(0, np.uint64), *(seeds for seeds, _ in own)])
    seeds, which, times = np.unique(every, return_inverse=True, return_counts=True)
    runs = np.bincount(which, np.concatenate([np.zeros(0, np.int64), *(n for _, n in own)]), len(seeds))
    return seeds, times > 1, np.log2(np.maximum(runs, 1)).astype(np.uint8)


def part_edges(seeds: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's seeds begin: part p holds the seeds from p / parts of 2 ** 48 on."""
    starts = np.array([(p << 48) // parts for p in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(seeds, starts), len(seeds))


def six_bytes(seeds: np.ndarray) -> bytes:
    return np.ascontiguousarray(seeds.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def unique_keys_leave(blocks: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """block, ranks: for each part of a block's keys a code each: 0 unique, 1 in several documents, 2 of HOT_RUNS runs or more.

    keys_of a block: its distinct 48-bit keys in order, whether two of its documents hold one, and the power of two below its number of runs.
    """
    n = partitions(blocks.sparkSession)
    parts = PARTS_PER_PARTITION * n
    names, types = ["block", "part", "seeds", "in_two", "runs"], (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                seeds, in_two, runs = keys_of(open_block(payload.as_py()))
                edges = part_edges(seeds, parts)
                rows = [
                    (block, p, six_bytes(seeds[a:b]), np.packbits(in_two[a:b]).tobytes(), packer.compress(runs[a:b].tobytes())) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def rank_part(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        every = [from_six(r[2]) for r in rows]
        sizes = [len(s) for s in every]
        flags = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=k) for r, k in zip(rows, sizes, strict=True)])
        many = np.exp2(np.concatenate([np.frombuffer(unpacker.decompress(r[4]), np.uint8) for r in rows]), dtype=np.float32)
        joined = np.concatenate(every)
        order = np.argsort(joined, kind="stable")
        ordered = joined[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(first) - 1
        times, in_two, runs = np.bincount(group), np.bincount(group, flags[order]), np.bincount(group, many[order])
        code = np.where((times > 1) | (in_two > 0), np.where(runs >= HOT_RUNS, 2, 1), 0).astype(np.uint8)
        back = np.empty(len(joined), np.uint8)
        back[order] = code[group]
        ends = np.cumsum(sizes)
        packed = [packer.compress(back[end - size : end].tobytes()) for size, end in zip(sizes, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array(packed, pa.binary())], names=["block", "part", "codes"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[1] != part and held:
                    yield from rank_part(held)
                    held = []
                part = row[1]
                held.append(row)
        if held:
            yield from rank_part(held)

    sent = blocks.mapInArrow(tidy(send), "block long, part int, seeds binary, in_two binary, runs binary").repartition(n, "part").sortWithinPartitions("part")
    ranked = sent.mapInArrow(tidy(rank), "block long, part int, codes binary")
    return ranked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "codes"))).alias("ranks"))


def pack_spans(spans: list[tuple[int, int, int]]) -> bytes:
    """Spans (row, start, stop) of one block; those that touch become one."""
    spans.sort()
    merged: list[list[int]] = []
    for row, start, stop in spans:
        if merged and merged[-1][0] == row and start <= merged[-1][2]:
            merged[-1][2] = max(stop, merged[-1][2])
        else:
            merged.append([row, start, stop])
    return zstandard.ZstdCompressor(level=3).compress(np.array(merged, "<i8").T.tobytes())


def unpack_spans(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i8").reshape(3, -1).T


def open_runs(blocks: DataFrame, ranks: DataFrame, match: int, seed: int) -> DataFrame:
    """block, part, decided, payload: the runs whose seed is not unique, dealt by seed (by their text, if the seed is hot).

    Of equal runs among HELD_RUNS of one block only the least document's go on; the others are decided here.
    """
    parts = PARTS_PER_PARTITION * partitions(blocks.sparkSession)
    types = (pa.int32(), pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.binary())

    def sent(block: int, held: list[tuple], least: dict[bytes, int]) -> pa.RecordBatch:
        gone = [(r[3], r[4], r[5]) for r in held if r[2] > least[r[7]]]
        left = [r for r in held if r[2] == least[r[7]]]
        rows = [(block, block % parts, True, pack_spans(gone))] if gone else []
        if left:
            columns = list(zip(*left, strict=True))
            order = np.argsort(np.array(columns[0]), kind="stable")
            table = pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "kind", "doc_id", "row", "start", "stop", "rel", "text"]).take(order)
            part = table.column("part").to_numpy()
            edges = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(part)]
            rows += [(block, int(part[i]), False, pack_table(table.slice(i, j - i).drop(["part"]))) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["block", "part", "decided", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, payload, codes in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("ranks"), strict=True):
                per_doc = [(row, doc_id, raw, seed_runs(np.frombuffer(raw, np.uint8), match, seed)) for row, doc_id, raw in texts_of(open_block(payload.as_py()))]
                seeds = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(runs[0] >> np.uint64(16)) for *_, runs in per_doc)]))
                code = np.frombuffer(b"".join(unpacker.decompress(c["codes"]) for c in codes.as_py()), np.uint8)
                least: dict[bytes, int] = {}
                held: list[tuple] = []
                for row, doc_id, raw, (hashes, first, last, at) in per_doc:
                    short = hashes >> np.uint64(16)
                    own = code[np.searchsorted(seeds, short)]
                    every = np.flatnonzero(own)
                    for begin in range(0, len(every), HELD_RUNS):
                        keep = every[begin : begin + HELD_RUNS]
                        if len(held) + len(keep) > HELD_RUNS and held:
                            yield sent(block, held, least)
                            least, held = {}, []
                        dealt = ((short[keep] >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
                        columns = (dealt.astype(np.int64), own[keep], first[keep], last[keep] + match, at[keep] - first[keep])
                        for part, kind, a, z, rel in zip(*(c.tolist() for c in columns), strict=True):
                            text = raw[a:z]
                            if doc_id < least.setdefault(text, doc_id):
                                least[text] = doc_id
                            if kind == 2:
                                part = int.from_bytes(hashlib.blake2b(text, digest_size=6).digest(), "little") % parts
                            held.append((part, kind, doc_id, row, a, z, rel, text))
                if held:
                    yield sent(block, held, least)

    return blocks.join(ranks.hint("merge"), "block").select("block", "payload", "ranks").mapInArrow(tidy(run), "block long, part int, decided boolean, payload binary")


def windows_of(texts: list[bytes], match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start within it, rank of the first half, rank of the second half) of every window; the texts are hashed as one string."""
    half, sizes = match // 2, np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    head, tail = string_hashes(raw, half, 1), string_hashes(raw, match - half, 2)
    many = sizes - match + 1
    which = np.repeat(np.arange(len(texts)), many)
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(np.cumsum(sizes) - sizes, many) + within
    return which, within, head[at], tail[at + half]


def several(ranks: np.ndarray) -> np.ndarray:
    """Where a rank is not unique."""
    _, which, times = np.unique(ranks, return_inverse=True, return_counts=True)
    return times[which] > 1


def decide_part(rows: pa.Table, match: int, seed: int) -> tuple[dict[int, list], list[tuple]]:
    """(spans by block, hot runs left to window ranks) of one part's runs.

    All runs of a seed are here, so its windows are ranked here; the runs of a hot seed meet their equals only.
    """
    block, kind, doc_id, row, start, stop, rel = (rows.column(c).to_numpy() for c in ("block", "kind", "doc_id", "row", "start", "stop", "rel"))
    texts = rows.column("text").to_pylist()
    least: dict[bytes, int] = {}
    for own, text in zip(doc_id.tolist(), texts, strict=True):
        if own < least.setdefault(text, own):
            least[text] = own
    first = doc_id == np.fromiter(map(least.__getitem__, texts), np.int64, len(texts))
    spans: dict[int, list] = {}
    for k in np.flatnonzero(~first).tolist():
        spans.setdefault(int(block[k]), []).append((int(row[k]), int(start[k]), int(stop[k])))
    hot = [(int(block[k]), int(doc_id[k]), int(row[k]), int(start[k]), texts[k]) for k in np.flatnonzero(first & (kind == 2)).tolist()]
    left = np.flatnonzero(first & (kind == 1))
    if len(left):
        seeds = np.array([hash(texts[k][r : r + seed]) for k, r in zip(left.tolist(), rel[left].tolist(), strict=True)])
        left = left[several(seeds)]
    if len(left):
        which, within, head, tail = windows_of([texts[k] for k in left.tolist()], match)
        on = np.flatnonzero(several(head))  # at half the length unique ranks leave
        on = on[np.lexsort((tail[on], head[on]))]
        if len(on):
            edge = np.concatenate([[True], (head[on][1:] != head[on][:-1]) | (tail[on][1:] != tail[on][:-1])])
            owners = doc_id[left[which[on]]]
            late = np.sort(on[owners > np.minimum.reduceat(owners, np.flatnonzero(edge))[np.cumsum(edge) - 1]])
            if len(late):
                begins = np.concatenate([[True], (which[late][1:] != which[late][:-1]) | (within[late][1:] != within[late][:-1] + 1)])
                ends = late[np.append(np.flatnonzero(begins)[1:] - 1, len(late) - 1)]
                k = left[which[ends]]
                columns = (block[k], row[k], start[k] + within[late[begins]], start[k] + within[ends] + match)
                for own, *span in zip(*(c.tolist() for c in columns), strict=True):
                    spans.setdefault(own, []).append(tuple(span))
    return spans, hot


def packed_rows(rows: list[tuple[int, bytes]], column: str = "spans") -> pa.RecordBatch:
    """Rows (block, packed spans), or (holder, its hot runs) with column "hot"."""
    packed = pa.array([r[1] for r in rows], pa.binary())
    none = pa.nulls(len(rows), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *((packed, none) if column == "spans" else (none, packed))], names=["block", "spans", "hot"])


def decide_runs(runs: DataFrame, match: int, seed: int) -> DataFrame:
    """block, spans, hot: a block's packed spans, or (with a number of its own as block) a table of hot runs that are left to ranks of windows."""

    def hot_table(rows: list[tuple]) -> bytes:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pack_table(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "doc_id", "row", "start", "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tables = None, []
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def close() -> Iterator[pa.RecordBatch]:
            if tables:
                spans, hot = decide_part(pa.concat_tables(tables).combine_chunks(), match, seed)
                if spans:
                    yield packed_rows([(block, pack_spans(found)) for block, found in spans.items()])
                held.extend(hot)

        def hot_rows(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            while len(held) >= least:
                yield packed_rows([(number, hot_table(held[:HOT_HELD]))], "hot")
                del held[:HOT_HELD]
                number += 1

        for batch in batches:
            for block, own, decided, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "decided", "payload")), strict=True):
                if decided:
                    yield packed_rows([(block, payload)])
                    continue
                if own != part:
                    yield from close()
                    yield from hot_rows(HOT_HELD)
                    part, tables = own, []
                table = open_block(payload)
                tables.append(table.append_column("block", pa.array(np.full(table.num_rows, block))))
        yield from close()
        yield from hot_rows(1)

    dealt = runs.repartition(partitions(runs.sparkSession), "part").sortWithinPartitions("part")
    return settle(dealt.mapInArrow(tidy(run), "block long, spans binary, hot binary"))


def first_halves(runs: pa.Table, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ranks of first halves of a table of hot runs, as unique_keys_leave takes them."""
    which, _, head, _ = windows_of(runs.column("text").to_pylist(), match)
    owners = runs.column("doc_id").to_numpy()[which]
    short = head >> np.uint64(16)
    order = np.argsort(short, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], short[order][1:] != short[order][:-1]]))
    in_two = np.minimum.reduceat(owners[order], begins) < np.maximum.reduceat(owners[order], begins)
    return short[order][begins], in_two, np.zeros(len(begins), np.uint8)


class HotWindows:
    """The windows of a table of hot runs whose first half is not unique, and their distinct rank pairs in order."""

    def __init__(self, runs: pa.Table, codes: list[bytes], match: int):
        unpacker = zstandard.ZstdDecompressor()
        which, within, head, tail = windows_of(runs.column("text").to_pylist(), match)
        short = head >> np.uint64(16)
        on = np.flatnonzero(np.frombuffer(b"".join(map(unpacker.decompress, codes)), np.uint8)[np.searchsorted(np.unique(short), short)])
        self.which, self.within, self.match = which[on], within[on], match
        self.owners = runs.column("doc_id").to_numpy()[self.which]
        self.order = np.lexsort((tail[on], head[on]))
        ordered = np.stack([head[on], tail[on]])[:, self.order]
        new = np.ones(len(on), bool)
        new[1:] = (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)
        self.pair = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        self.head, self.tail = ordered[:, begins]
        self.least = np.minimum.reduceat(self.owners[self.order], begins) if len(begins) else np.zeros(0, np.int64)

    def late(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, start, stop) of the bytes of windows that a document before theirs holds; windows one after the other make one span."""
        first = np.empty(len(self.order), np.int64)
        first[self.order] = least[self.pair]
        late = np.flatnonzero(self.owners > first)
        which, within = self.which[late], self.within[late]
        new = np.ones(len(late), bool)
        new[1:] = (which[1:] != which[:-1]) | (within[1:] != within[:-1] + 1)
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(late))[: len(begins)] - 1
        return which[begins], within[begins], within[ends] + self.match


def hot_spans(hot: DataFrame, match: int) -> DataFrame:
    """block, spans: what goes of the runs of hot (block: a number of its own, payload: a table of runs)."""
    parts = partitions(hot.sparkSession)
    names, types = ["block", "part", "pairs"], (pa.int64(), pa.int32(), pa.binary())
    ranked = settle(hot.join(unique_keys_leave(hot, lambda runs: first_halves(runs, match)).hint("merge"), "block").select("block", "payload", "ranks.codes"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, payload, codes in zip(*(batch.column(c).to_pylist() for c in ("block", "payload", "codes")), strict=True):
                windows = HotWindows(open_block(payload), codes, match)
                part = ((windows.head >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                every = np.stack([windows.head, windows.tail, windows.least.astype(np.uint64)])
                rows = [(block, p, packer.compress(every[:, a:b].tobytes())) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def least_of_part(rows: list[tuple]) -> pa.RecordBatch:
        unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        held = [np.frombuffer(unpacker.decompress(r[2]), np.uint64).reshape(3, -1) for r in rows]
        head, tail, least = np.concatenate(held, axis=1)
        order = np.lexsort((tail, head))
        new = np.ones(len(order), bool)
        new[1:] = (head[order][1:] != head[order][:-1]) | (tail[order][1:] != tail[order][:-1])
        of_all = np.empty(len(order), np.int64)
        of_all[order] = np.minimum.reduceat(least[order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        ends = np.cumsum([h.shape[1] for h in held])
        packed = [packer.compress(of_all[end - h.shape[1] : end].tobytes()) for h, end in zip(held, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([r[0] for r in rows], [r[1] for r in rows], packed), types, strict=True)], names=names)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[1] != part and held:
                    yield least_of_part(held)
                    held = []
                part = row[1]
                held.append(row)
        if held:
            yield least_of_part(held)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for payload, codes, pairs in zip(*(batch.column(c).to_pylist() for c in ("payload", "codes", "least")), strict=True):
                runs = open_block(payload)
                which, start, stop = HotWindows(runs, codes, match).late(np.frombuffer(b"".join(unpacker.decompress(p["pairs"]) for p in pairs), np.int64))
                block, row, base = (runs.column(c).to_numpy()[which] for c in ("block", "row", "start"))
                found: dict[int, list] = {}
                for own, *span in zip(*(c.tolist() for c in (block, row, base + start, base + stop)), strict=True):
                    found.setdefault(own, []).append(tuple(span))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([pack_spans(f) for f in found.values()], pa.binary())], names=["block", "spans"])

    pairs = "block long, part int, pairs binary"
    decided = ranked.mapInArrow(tidy(send), pairs).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(least), pairs)
    by_holder = decided.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "pairs"))).alias("least"))
    return ranked.join(by_holder.hint("merge"), "block").select("payload", "codes", "least").mapInArrow(tidy(spans), "block long, spans binary")


def removed_spans(decided: DataFrame, match: int) -> DataFrame:
    """block, packed (a list of packed spans): bytes to remove; spans may overlap."""
    spans, hot = decided.where("spans IS NOT NULL").select("block", "spans"), decided.where("hot IS NOT NULL").select("block", F.col("hot").alias("payload"))
    if not hot.isEmpty():
        spans = spans.union(hot_spans(hot, match))
    return spans.groupBy("block").agg(F.collect_list("spans").alias("packed"))


def cut_repeats(docs: DataFrame, match: int = MATCH, seed: int = SEED) -> DataFrame:
    """doc (a struct of all columns of the row, as they were), kept_bytes (binary), n_bytes, n_removed and n_spans, for each row of docs.

    docs has doc_id (long) and text (string) and any other columns. A null text has no bytes. A row
    without an id removes nothing and keeps everything; rows with the same id, repeated rows too,
    do not remove from each other. An empty table gives an empty one. The texts' blocks stay in a
    scratch table until common.drop_scratch.
    """
    blocks = to_blocks(docs)
    ranks = unique_keys_leave(blocks, lambda block: block_seeds(block, match, seed))
    decided = decide_runs(open_runs(blocks, ranks, match, seed), match, seed)
    gone = removed_spans(decided, match)
    added = ["kept_bytes", "n_bytes", "n_removed", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, packed in zip(batch.column("payload"), batch.column("packed"), strict=True):
                table = open_block(payload.as_py())
                cuts = np.concatenate([np.zeros((0, 3), np.int64), *map(unpack_spans, packed.as_py() or [])])
                cuts = cuts[np.argsort(cuts[:, 0], kind="stable")]
                edges = np.searchsorted(cuts[:, 0], np.arange(table.num_rows + 1))
                kept, sizes, removed, counts = [], [], [], []
                for row, raw in enumerate(table.column("text").cast(pa.large_binary()).to_pylist()):
                    raw = raw or b""
                    own = cuts[edges[row] : edges[row + 1]]
                    if len(own):
                        depth = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(depth, own[:, 1], 1)
                        np.add.at(depth, own[:, 2], -1)
                        out = np.cumsum(depth[:-1]) > 0
                        removed.append(int(out.sum()))
                        counts.append(int(np.count_nonzero(out[1:] & ~out[:-1])) + int(out[0]))
                        kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
                    else:
                        removed.append(0)
                        counts.append(0)
                        kept.append(raw)
                    sizes.append(len(raw))
                more = [pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts))]
                step = 256
                for at in range(0, table.num_rows, step):
                    part = table.slice(at, step)
                    doc = pa.StructArray.from_arrays([c.combine_chunks() for c in part.columns], fields=list(part.schema))
                    yield pa.RecordBatch.from_arrays([doc, *(c.slice(at, step) for c in more)], names=["doc", *added])

    schema = T.StructType([T.StructField("doc", docs.schema), T.StructField(added[0], T.BinaryType()), *(T.StructField(n, T.LongType()) for n in added[1:])])
    return blocks.join(gone.hint("merge"), "block", "left").select("payload", "packed").mapInArrow(tidy(run), schema)


def whole_characters(kept: Column) -> Column:
    """UTF-8 bytes as text, without the remains of characters that a cut went through."""

    @F.arrow_udf("string")
    def decoded(raws: pa.Array) -> pa.Array:
        return pa.array([None if raw is None else raw.decode("utf-8", "ignore") for raw in raws.to_pylist()], pa.string())

    return decoded(kept)


def substring_dedup(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    return cut_repeats(id_and_text(docs), match).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def q_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
