"""Near-duplicate groups by a chosen-path set similarity join.

A document's set is its distinct five-word shingles. Documents with the same set form one
class; classes are joined as follows.

* Each class has 128 minwise values. A tree node picks one of them (a second one with the
  probability that makes 1 / threshold picks on average) and branches its documents by the
  value, so a pair of similarity s stays together at a branch with probability s.
* In every node of the first level each document is compared with the node's least one, which
  costs one comparison per document however large the node. A node whose documents are then connected
  is done at any size, since only components are asked for. Where at most SMALL documents
  are outside the node's largest component, they are compared with all others of the node, in
  chunks of it; other nodes branch again.
* TREES independent trees repeat this. The deeper a node, the likelier that a pair has parted:
  a pair at 0.85, whose values agree by chance more or less, is missed by ten trees with
  probability 6e-9 at depth one, 5e-4 at five, 1e-2 at ten and 8e-2 at twenty. Documents of nodes that
  branch where this is over MISS go through as many further trees as the depth reached needs
  (18 in all at depth ten, 53 at twenty), and after MAX_DEPTH levels a node is compared whole.
* A candidate must agree in so many of the 128 values that a pair at the threshold fails with
  probability 1e-5 (90 at 0.85, 82 at 0.80) and is then confirmed on its full shingle sets, made
  from the whole texts. Where a chunk has few candidates, each pair is confirmed once, whatever
  nodes it was met in. Where it has many (documents of one template, say), each of its documents
  brings its text to the chunk once, all candidates are confirmed there, and only links that join
  two components leave it: rows grow with documents and links, not with pairs.

Whole texts move once, to a table bucketed by class; of them only candidates' texts move again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, documents, id_and_text, partitions, per_text, scratch_table, settle, tidy
from .substring_dedup import A, B, finish

WORDS = 5
PERCENT = 85
VALUES = 128
TREES = 10
SMALL = 2048
CHUNK = 1024
HELD = 1 << 22
DENSE = 2
MAX_DEPTH = 20
MISS = 1e-3
MULTIPLIERS = finish(np.arange(1, VALUES + 1, dtype=np.uint64) * A) | np.uint64(1)


@cache
def least_agreement(percent: int) -> int:
    """Of the VALUES, so many agree in a pair at the threshold but for one pair in 100,000."""
    share, below, k = percent / 100, 0.0, 0
    while (below := below + comb(VALUES, k) * share**k * (1 - share) ** (VALUES - k)) <= 1e-5:
        k += 1
    return k


def missed(depth: int, trees: int, percent: int) -> float:
    """The probability that a pair at the threshold, with values enough in agreement, has parted before this depth in every tree."""
    share, more, total = percent / 100, 100 / percent - 1, 0.0
    for k in range(least_agreement(percent), VALUES + 1):
        together = 1.0
        for _ in range(depth):
            once = together * k / VALUES
            together = once * (1 + more) - more * once**2
        total += comb(VALUES, k) * share**k * (1 - share) ** (VALUES - k) * (1 - together) ** trees
    return total


@cache
def trees_for(depth: int, percent: int) -> int:
    """TREES, or as many more as this depth needs."""
    trees = TREES
    while missed(depth, trees, percent) > MISS:
        trees += 1
    return trees


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    LIMIT = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: str, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; bytes.lower() and bytes.split() know ASCII only, as asked."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    take = min(WORDS, len(w))
    if not take:
        return w
    n = len(w) - take + 1
    h = w[:n]
    for k in range(1, take):
        h = (h ^ (h >> np.uint64(29))) * B + w[k : k + n]
    return np.unique(finish(h + np.uint64(take)))


def minwise(shingles: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[None, at : at + 1024] * MULTIPLIERS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(finish(s ^ salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (A, B))


def set_keys(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit hash of the set)."""

    def of_texts(texts: list[str]) -> list[pa.Array]:
        hashes = WordHashes()
        sets = [shingle_set(text, hashes) for text in texts]
        a, b = zip(*map(set_hash, sets), strict=True)
        return [pa.array(c, pa.int64()) for c in ([len(s) for s in sets], a, b)]

    return per_text(docs, "n_shingles long, set_a long, set_b long", of_texts)


def class_table(docs: DataFrame, firsts: DataFrame) -> str:
    """The name of a table of classes, bucketed by rep: rep, n_shingles, sketch (the minwise values), small (their low bytes), text.

    Where rows share an id, each of their texts that is the first of a class stands here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), (None, set())
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = []
            for rep, set_a, set_b, text in zip(*columns, strict=True):
                if seen[0] != rep:
                    seen = (rep, set())
                s = shingle_set(text, hashes)
                if (key := set_hash(s)) == (set_a, set_b) and key not in seen[1]:
                    seen[1].add(key)
                    values = minwise(s)
                    rows.append((rep, len(s), values.tobytes(), values.astype(np.uint8).tobytes(), text))
            if rows:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["rep", "n_shingles", "sketch", "small", "text"])

    spark, name = docs.sparkSession, scratch_table(docs.sparkSession, "near_classes")
    first = firsts.select("rep", "set_a", "set_b").hint("merge")
    met = first.join(id_and_text(docs), F.col("rep") == F.col("doc_id")).select("rep", "set_a", "set_b", "text")
    made = met.mapInArrow(tidy(run), "rep long, n_shingles long, sketch binary, small binary, text string")
    made.write.option("compression", "zstd").bucketBy(partitions(spark), "rep").format("parquet").saveAsTable(name)
    return name


def mixed(node: np.ndarray, salt: int) -> np.ndarray:
    return finish(node * A + np.uint64(salt))


def branch(node: np.ndarray, sketches: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, child node) of each document's children; node and sketches are aligned."""
    every = np.arange(len(node))
    first = (mixed(node, 1) % np.uint64(VALUES)).astype(np.int64)
    other = (first + 1 + (mixed(node, 2) % np.uint64(VALUES - 1)).astype(np.int64)) % VALUES
    both = np.flatnonzero(mixed(node, 3) < np.uint64(int((100 / percent - 1) * 2**64)))
    index = np.concatenate([every, both])
    place = np.concatenate([first, other[both]])
    child = finish((node[index] ^ (place.astype(np.uint64) + np.uint64(1)) * B) + sketches[index, place].astype(np.uint64) * A)
    return index, child


def sketch_rows(column: pa.Array, dtype: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, VALUES)


def first_level(classes: DataFrame, percent: int, trees: range) -> DataFrame:
    """node, rep: the children of the roots of these trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rep, sketches = batch.column("rep").to_numpy(), sketch_rows(batch.column("sketch"))
                for tree in trees:
                    root = finish(np.full(len(rep), tree + 1, np.uint64))
                    index, child = branch(root, sketches, percent)
                    yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), pa.array(rep[index])], names=["node", "rep"])

    return classes.select("rep", "sketch").mapInArrow(tidy(run), "node long, rep long")


def next_level(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, child = branch(batch.column("node").to_numpy().astype(np.uint64), sketch_rows(batch.column("sketch")), percent)
                yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), pa.array(batch.column("rep").to_numpy()[index])], names=["node", "rep"])

    return members.select("node", "rep").join(classes.select("rep", "sketch"), "rep").select("node", "rep", "sketch").mapInArrow(tidy(run), "node long, rep long")


def unsettled(members: DataFrame, components: DataFrame | None) -> DataFrame:
    """node, rep, component, n, pivot, main, main_n of the nodes that hold more than one component; main is the largest, of main_n.

    Nodes are written before they meet their members: both sides then come from files, and a hot node can be split.
    """
    if components is None:
        known = members.withColumn("component", F.col("rep"))
        nodes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1").withColumns({"main": F.col("pivot"), "main_n": F.lit(1).cast("long")})
    else:
        known = settle(members.join(components, F.col("rep") == F.col("id"), "left").select("node", "rep", F.coalesce("component", "rep").alias("component")))
        parts = known.groupBy("node", "component").agg(F.count("*").alias("c"), F.min("rep").alias("least"))
        of_node = parts.groupBy("node").agg(F.sum("c").alias("n"), F.min("least").alias("pivot"), F.max_by("component", "c").alias("main"), F.max("c").alias("main_n"), F.count("*").alias("parts"))
        nodes = of_node.where("parts > 1").drop("parts")
    return settle(known.join(settle(nodes), "node"))


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the threshold."""
    agree = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (sketch_rows(batch.column("sketch_a"), np.uint8) == sketch_rows(batch.column("sketch_b"), np.uint8)).sum(axis=1) >= agree
                yield batch.select(["a", "b"]).filter(pa.array(same))

    heads = settle(classes.join(pairs.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi").select("rep", "n_shingles", "small"))  # from files, not buckets: a hot one can be split
    one = heads.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("small").alias("sketch_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("small").alias("sketch_b"))
    sized = pairs.join(two, "b").join(one, "a").where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    return sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(tidy(run), "a long, b long")


class Roots(dict):
    """A small union-find over component labels."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


class Held:
    """The documents of side 0 of a task, with their shingles numbered, to compare others with."""

    def __init__(self, rows: list[tuple], percent: int):
        self.percent, self.agree = percent, least_agreement(percent)
        self.reps, self.components, sets, sketches = zip(*rows, strict=True)
        self.sketches = np.stack(sketches)
        self.sizes = np.array([len(s) for s in sets])
        self.every, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.numbers = np.split(numbers, np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(len(self.every), bool)

    def links(self, rep: int, component: int, s: np.ndarray, sketch: np.ndarray, roots: Roots, stop: int) -> Iterator[tuple[int, int]]:
        """Links between this document and those before stop, each of which joins two components."""
        at = np.flatnonzero((self.sketches[:stop] == sketch).sum(axis=1) >= self.agree)
        least, most = np.minimum(self.sizes[at], len(s)), np.maximum(self.sizes[at], len(s))
        at = at[100 * least >= self.percent * most]
        if not len(at):
            return
        place = np.minimum(np.searchsorted(self.every, s), len(self.every) - 1)
        place = place[self.every[place] == s]
        self.mark[place] = True
        for k in at.tolist():
            if roots.find(self.components[k]) != roots.find(component):
                common = int(np.count_nonzero(self.mark[self.numbers[k]]))
                if 100 * common >= self.percent * (self.sizes[k] + len(s) - common) and roots.join(self.components[k], component):
                    yield min(rep, self.reps[k]), max(rep, self.reps[k])
        self.mark[place] = False


def confirmed(work: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) with 100 * intersection >= percent * union of their full sets, as many as join all that are linked in a task.

    work has task, side, rep and component: documents of side 1 meet those of side 0, or, where
    a task has no side 1, those of side 0 meet each other. Side 0 is held, side 1 passes by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, roots, rows, held, alone, found = WordHashes(), None, Roots(), [], None, True, []

        def close() -> Iterator[tuple[int, int]]:
            if alone and len(rows) > 1:
                own = Held(rows, percent)
                for k in range(1, len(rows)):
                    yield from own.links(*rows[k], roots, k)

        for batch in batches:
            for own, side, rep, component, small, text in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "rep", "component", "small", "text")), strict=True):
                if own != task:
                    found += close()
                    task, roots, rows, held, alone = own, Roots(), [], None, True
                row = (rep, component, shingle_set(text, hashes), np.frombuffer(small, np.uint8))
                if side == 0:
                    rows.append(row)
                    continue
                alone = False
                if held is None and rows:
                    held = Held(rows, percent)
                if held is not None:
                    found += held.links(*row, roots, len(rows))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found = []
        found = list(close())
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = work.join(classes.select("rep", "small", "text"), "rep").select("task", "side", "rep", "component", "small", "text")
    return met.repartition(partitions(work.sparkSession), "task").sortWithinPartitions("task", "side").mapInArrow(tidy(run), "a long, b long")


def pair_tasks(pairs: DataFrame) -> DataFrame:
    """The work of confirming pairs (a, b): each a with its b, in as many tasks as they need."""
    many = settle(pairs.groupBy("a").agg(F.expr(f"1 + count(*) div {CHUNK}").alias("tasks")))
    task = lambda salt: F.xxhash64("a", salt.cast("long"))
    one = many.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).select(task(F.col("salt")).alias("task"), F.lit(0).alias("side"), F.col("a").alias("rep"))
    two = pairs.join(many, "a").select(task(F.pmod(F.xxhash64("b"), F.col("tasks"))).alias("task"), F.lit(1).alias("side"), F.col("b").alias("rep"))
    return one.union(two).withColumn("component", F.col("rep"))


CANDIDATES = "a long, b long, task long, side int, component long"


def exhaustive(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidates of one node but of two components, whose sizes and sketches agree: rows of pairs (a, b), a < b, and rows of work.

    The documents of a node's largest component are dealt over chunks and so are the others, first in
    number; each chunk of the others meets itself and every chunk behind it. A node of one chunk meets
    itself. Where there are more than DENSE pairs to a document, the documents with candidates become
    work: rows with their id as a, no b, a task and a side, tasks that hold HELD shingles at most on side 0.
    """
    agree = least_agreement(percent)

    def dealt_out(key: tuple, rep: list, component: list, sizes: np.ndarray, near: list[int], others: list[int]) -> Iterator[tuple]:
        """Tasks for near (positions) against others, or for near alone: parts of near that can be held, each with itself or with all that it meets."""
        parts, held = [[]], 0
        for k in near:
            if parts[-1] and held + sizes[k] > HELD:
                parts.append([])
                held = 0
            parts[-1].append(k)
            held += sizes[k]
        for i, part in enumerate(parts):
            meets = [others] if others else [[], [k for p in parts[i + 1 :] for k in p]]
            for j, side in enumerate(meets):
                if side or (not others and j == 0):
                    task = xxhash.xxh64_intdigest(repr((key, i, j))) - (1 << 63)
                    yield from ((rep[k], None, task, number, component[k]) for number, those in ((0, part), (1, side)) for k in those)

    def compare(key: tuple, node: list[tuple]) -> Iterator[tuple]:
        rep, component, chunk, sizes, small = zip(*node, strict=True)
        of, chunk, sizes = np.array(component), np.array(chunk), np.array(sizes)
        sketches = np.frombuffer(b"".join(small), np.uint8).reshape(-1, VALUES)
        first = chunk == chunk.min()
        alone = first.all()
        one, two = [], []
        for k in np.flatnonzero(first).tolist():
            at = np.flatnonzero((of != of[k]) & ((np.arange(len(node)) > k) if alone else ~first))
            at = at[100 * np.minimum(sizes[at], sizes[k]) >= percent * np.maximum(sizes[at], sizes[k])]
            at = at[(sketches[at] == sketches[k]).sum(axis=1) >= agree]
            one += [k] * len(at)
            two += at.tolist()
        near = sorted({*one, *two})
        if len(one) <= DENSE * len(near):
            yield from ((min(rep[k], rep[j]), max(rep[k], rep[j]), None, None, None) for k, j in zip(one, two, strict=True))
        elif alone:
            yield from dealt_out(key, rep, component, sizes, near, [])
        else:
            yield from dealt_out(key, rep, component, sizes, sorted(set(one)), sorted(set(two)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []

        def close() -> list[tuple]:
            return list(compare(key, held)) if len(held) > 1 and (key[1] == key[2] or len({r[2] for r in held}) == 2) else []

        def out() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=[c.split()[0] for c in CANDIDATES.split(", ")])

        for batch in batches:
            for own, one, two, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (own, one, two) != key:
                    found += close()
                    key, held = (own, one, two), []
                held.append(row)
            yield out()
            found = []
        found = close()
        yield out()

    whole = F.col("n") <= CHUNK
    outside = whole | (F.col("component") != F.col("main"))
    others = F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("main_n")) / CHUNK)).cast("long")
    mains = F.when(whole, 0).otherwise(F.ceil(F.col("main_n") / CHUNK)).cast("long")
    hashed = F.xxhash64("rep")
    dealt = members.select("node", "rep", "component", outside.alias("outside"), others.alias("others"), mains.alias("mains"), F.when(outside, F.pmod(hashed, others)).otherwise(others + F.pmod(hashed, mains)).alias("chunk"))
    met = dealt.withColumn("other", F.explode(F.when(F.col("outside"), F.sequence(F.lit(0).cast("long"), F.col("others") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))))
    rows = met.join(classes.select("rep", "n_shingles", "small"), "rep").select("node", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "rep", "component", "chunk", "n_shingles", "small")
    return rows.repartition(partitions(members.sparkSession), "node", "one", "two").sortWithinPartitions("node", "one", "two").mapInArrow(tidy(run), CANDIDATES)


def apart(pairs: DataFrame, components: DataFrame | None) -> DataFrame:
    """The pairs that are not in one component yet."""
    if components is None:
        return pairs
    one, two = components.toDF("a", "in_a"), components.toDF("b", "in_b")
    found = pairs.join(one, "a", "left").join(two, "b", "left")
    return found.where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b")


class Links:
    """Confirmed links so far, and the components that they make, worked out when next asked for."""

    def __init__(self, classes: DataFrame, percent: int):
        self.classes, self.percent = classes, percent
        self.links: DataFrame | None = None
        self.known: DataFrame | None = None
        self.more = False
        self.tried: list[DataFrame] = []
        self.waiting: DataFrame | None = None

    @property
    def components(self) -> DataFrame | None:
        if self.more:
            self.known, self.more = connected_components(self.links), False
        return self.known

    def confirm(self, work: DataFrame) -> None:
        found = settle(confirmed(work, self.classes, self.percent))
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.union(found)
            self.more = True

    def try_stars(self, pairs: DataFrame) -> None:
        """Of the pairs that may be links, confirm one for each document; those still between components wait for the next call of try_nodes."""
        likely = settle(alike(pairs, self.classes, self.percent))
        if likely.isEmpty():
            return
        firsts = settle(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        self.confirm(pair_tasks(firsts))
        self.tried.append(likely)
        self.waiting = apart(likely.join(firsts, ["a", "b"], "left_anti"), self.components)

    def try_nodes(self, members: DataFrame) -> None:
        """Compare the documents of each node that are in two components, and confirm the candidates that were not tried before."""
        found = settle(exhaustive(members, self.classes, self.percent))
        pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
        for before in self.tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = settle(pairs)
        self.tried.append(pairs)
        if self.waiting is not None:
            pairs, self.waiting = settle(pairs.union(self.waiting)), None
        work = found.where("b IS NULL").select("task", "side", F.col("a").alias("rep"), "component")
        self.confirm(pair_tasks(pairs).unionByName(work))


def stars(members: DataFrame) -> DataFrame:
    return members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()


def below(members: DataFrame, classes: DataFrame, found: Links, met: bool = False) -> tuple[int, list[DataFrame]]:
    """Compare in or branch the nodes of the first level and all below. Returns the depth reached, and the documents (rep) of nodes that branched where TREES trees no longer do.

    met: the pairs of first-level nodes of two documents have been compared.
    """
    depth, open_nodes = 1, []
    while not members.isEmpty():
        few = F.col("n") - F.col("main_n") <= SMALL
        compared = F.col("n") > (2 if met and depth == 1 else 1)
        found.try_nodes(members.where(few | F.lit(depth >= MAX_DEPTH)).where(compared))
        large = members.where(~few)
        if depth >= MAX_DEPTH or large.isEmpty():
            break
        if trees_for(depth + 1, found.percent) > TREES:
            open_nodes.append(large.select("rep").distinct())
        members = unsettled(next_level(large, classes, found.percent), found.components)
        depth += 1
    return depth, open_nodes


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of docs. Sets of a similarity of percent / 100 or more are linked.

    A text without words and a row without an id are linked with nothing and kept; the
    latter's component_id is null. Rows that share an id count as one document, which is
    linked by any of their texts. An empty table gives an empty one.
    """
    rows = settle(set_keys(docs))
    some = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    firsts = settle(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    table = class_table(docs, firsts)
    try:
        components = linked_classes(docs.sparkSession.table(table), percent)
        groups = firsts.withColumn("component", F.col("rep"))
        if components is not None:
            groups = firsts.join(components, F.col("rep") == F.col("id"), "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
        groups = settle(groups.select("set_a", "set_b", "component"))
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    linked = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    joined = rows.join(groups, ["set_a", "set_b"], "left")
    labelled = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"))
    return labelled.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def linked_classes(classes: DataFrame, percent: int) -> DataFrame | None:
    """(id, component) of the classes that have links, or None where there are none."""
    found = Links(classes, percent)
    members = unsettled(first_level(classes, percent, range(TREES)), None)
    found.try_stars(stars(members))
    members = unsettled(members.select("node", "rep"), found.components)
    depth, open_nodes = below(members, classes, found, met=True)
    if found.waiting is not None:
        found.confirm(pair_tasks(settle(found.waiting)))
    done, trees = TREES, trees_for(depth, percent)
    if trees > done:
        open_reps = settle(reduce(DataFrame.union, open_nodes).distinct())
        pending = settle(classes.select("rep", "sketch").join(open_reps, "rep", "left_semi"))
        while trees > done:
            members = unsettled(first_level(pending, percent, range(done, trees)), found.components)
            reached, _ = below(members, pending, found)
            depth, done = max(depth, reached), trees
            trees = trees_for(depth, percent)
    return found.components


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns."""
    gone = settle(near_groups(docs, percent).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def q_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), PERCENT)


#: Sets, sizes, all pairs that share a shingle, links, and the least document over links; feasible on small tables only.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS h FROM (SELECT doc_id, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.b AS component_id, d.doc_id = m.b AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
"""
