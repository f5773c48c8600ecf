"""How far the sources of a language differ in their terms.

Terms become integers: the terms that enough of a language's documents hold, in UTF-8 order,
are cut into chunks, a term's id being its place in its chunk. Each chunk is a sorted array
in which `searchsorted` finds ids and `bincount` adds up document and term counts for each
source, so a chunk of one source is a dense vector and ids break ties. The dictionary grows
with the corpus and is never sent whole to a task: terms are range-partitioned, and each chunk is made
where its terms are. Shares are integers, worked out by long division, so all sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, release, settle
from .words import TERM, blocks, utf8

MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE_DIGITS = 9
TOP = 50
CHUNK = 1024
#: Sources of a language that meet in one task at once.
SOURCE_BLOCK = 128
COUNTED_WORDS = 1 << 22
COUNTED_TERMS = 1 << 19


class Counter:
    """Occurrences and documents by (group, term) of a few million words at a time, as integer codes."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.documents = 0
        self.forget()

    def forget(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> Iterator[pa.RecordBatch]:
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        for block in blocks(texts, TERM):
            if block.first[0] == 0 and (self.held > COUNTED_WORDS or len(self.terms) > COUNTED_TERMS):  # never within a text, whose terms count as one document
                yield from self.flush()
            terms = self.terms
            code = np.fromiter((terms.setdefault(w, len(terms)) for w in block.words), np.int64, len(block.words))
            row = block.row[block.segment]
            pair, n = np.unique((row + self.documents) << 32 | code, return_counts=True)
            self.parts.append((pair, group[(pair >> 32) - self.documents], n))
            self.held += len(pair)
        self.documents += len(texts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            pair, group, n = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            _, first, at = np.unique(pair, return_index=True, return_inverse=True)
            n = np.bincount(at, n)
            keys, at = np.unique(group[first] << 32 | pair[first] & 0xFFFFFFFF, return_inverse=True)
            term = pa.array(list(self.terms), pa.binary()).take(pa.array(keys & 0xFFFFFFFF)).cast(pa.string())
            yield self.rows(keys >> 32, term, np.bincount(at, n).astype(np.int64), np.bincount(at))
        self.forget()

    def rows(self, group: np.ndarray, term: pa.Array, n: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        names = list(self.groups)
        lang, source = (pa.array([g[k] for g in names], pa.string()).take(pa.array(group)) for k in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(df)], names=["lang", "source", "term", "n", "df"])

    def presence(self) -> pa.RecordBatch:
        """A row with an empty term for each group, as a group may have no terms at all."""
        every = np.arange(len(self.groups))
        return self.rows(every, pa.array([""] * len(every), pa.string()), every * 0, every * 0)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents of the group that hold it); the empty term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            yield from counter.add(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
        yield from counter.flush()
        yield counter.presence()
        release()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*text, utf8(F.col("text")).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


CHUNK_ROWS = "lang string, chunk long, size int, source string, ids array<int>, n array<long>, lang_n array<long>, terms array<string>"


class Chunks:
    """Sorted rows of a partition, made into chunks of some CHUNK kept terms."""

    def __init__(self, min_documents: int, partition: int):
        self.min_documents, self.next_chunk = min_documents, partition << 32
        self.lang, self.size = None, 0
        self.held: list[pd.DataFrame] = []

    def add(self, lang: str, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """rows: whole terms of one language, in UTF-8 order."""
        if lang != self.lang or self.size >= CHUNK:
            yield from self.flush()
            self.lang = lang
        encoded = rows["term"].combine_chunks().dictionary_encode()
        code, n = encoded.indices.to_numpy(), rows["n"].to_numpy()
        df = np.bincount(code, rows["df"].to_numpy())
        kept = np.flatnonzero(df >= self.min_documents)  # codes follow UTF-8 order, as the rows do
        among = df[code] >= self.min_documents
        lang_n = np.zeros(len(df), np.int64)
        np.add.at(lang_n, code, n)
        if len(kept):
            ids = np.searchsorted(kept, code[among]) + self.size
            part = {"source": rows["source"].to_numpy()[among], "id": ids, "n": n[among], "lang_n": lang_n[code[among]], "term": rows["term"].to_numpy()[among]}
            self.held.append(pd.DataFrame(part))
            self.size += len(kept)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = pd.concat(self.held).sort_values(["source", "id"], kind="stable")
            source = rows["source"].to_numpy()
            begin = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
            offsets = pa.array(np.append(begin, len(rows)).astype(np.int32))
            many = len(begin)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(rows[c].to_numpy(), t)) for c, t in (("id", pa.int32()), ("n", pa.int64()), ("lang_n", pa.int64()), ("term", pa.string()))]
            single = [pa.array([self.lang] * many, pa.string()), pa.array([self.next_chunk] * many, pa.int64()), pa.array([self.size] * many, pa.int32()), pa.array(source[begin], pa.string())]
            yield pa.RecordBatch.from_arrays([*single, *lists], names=[c.split()[0] for c in CHUNK_ROWS.split(", ")])
            self.next_chunk += 1
        self.held, self.size = [], 0


def term_chunks(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """CHUNK_ROWS: for each chunk of kept terms and each source with any of them, the ids it has in ascending order, with its own and the language's counts and the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, rest = Chunks(min_documents, TaskContext.get().partitionId()), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            lang, term = rows["lang"].to_pylist(), rows["term"].to_pylist()
            begin = [k for k in range(len(lang)) if k == 0 or lang[k] != lang[k - 1]]
            last = max((k for k in range(len(lang)) if k == 0 or lang[k] != lang[k - 1] or term[k] != term[k - 1]), default=0)  # this term may go on in the next batch
            for a, b in zip(begin, [*begin[1:], len(lang)], strict=True):
                if a < min(b, last):
                    yield from chunks.add(lang[a], rows.slice(a, min(b, last) - a))
            rest = rows.slice(last)
        if rest is not None:
            yield from chunks.add(rest["lang"][0].as_py(), rest)
        yield from chunks.flush()
        release()

    rows = counts.where("term <> ''").repartitionByRange(partitions(counts.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return rows.mapInArrow(run, CHUNK_ROWS)


def shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (n + SMOOTHING) / (total + SMOOTHING kept)), by long division in three steps, so that no product leaves 64 bits."""
    rest, whole, out = n.astype(np.int64) + SMOOTHING, total + SMOOTHING * kept, np.int64(0)
    for _ in range(SCALE_DIGITS // 3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return out + 1


def group_totals(counts: DataFrame, chunks: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), kept (terms of the language), lang_total, block and blocks (the language's last): every group once."""
    own = chunks.groupBy("lang", "source").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    sizes = chunks.select("lang", "chunk", "size").distinct().groupBy("lang").agg(F.sum("size").alias("kept"))
    every = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(sizes, "lang", "left")
    per_lang = Window.partitionBy("lang")
    numbered = every.select(
        "lang",
        "source",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("kept", F.lit(0)).alias("kept"),
        F.coalesce(F.sum("total").over(per_lang), F.lit(0)).alias("lang_total"),
        F.floor((F.row_number().over(per_lang.orderBy("source")) - 1) / SOURCE_BLOCK).cast("int").alias("block"),
    )
    return numbered.withColumn("blocks", F.max("block").over(per_lang))


def _vector(ids: np.ndarray | None, n: np.ndarray | None, size: int) -> np.ndarray:
    """The counts of all ids of a chunk; each id comes once, so a count is exact whatever its size."""
    out = np.zeros(size, np.int64)
    if ids is not None:
        out[ids] = n
    return out


def pair_divergence(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang) and value: the sum of the shares' differences over all kept terms.

    Each chunk is a dense matrix of sources by ids, of at most SOURCE_BLOCK sources; pairs of blocks
    meet in one task per chunk, and Spark adds up the chunks.
    """

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", kind="stable")  # rows come in any order, and a pair has to be named the same way in every chunk
        size, low, high = int(rows["size"].iloc[0]), rows["low"].iloc[0], rows["high"].iloc[0]
        dense = np.zeros((len(rows), size), np.int64)
        for k, (ids, n, total, kept) in enumerate(zip(rows["ids"], rows["n"], rows["total"], rows["kept"], strict=True)):
            if size:
                dense[k] = shares(_vector(ids, n, size), int(total), int(kept))
        own, name = rows["block"].to_numpy(), rows["source"].to_numpy()
        first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
        out: list[tuple] = []
        for k in first.tolist():
            others = second[second > k] if low == high else second
            values = np.abs(dense[others] - dense[k]).sum(axis=1)
            out += zip([name[k]] * len(others), name[others].tolist(), values.tolist(), strict=True)
        made = pd.DataFrame(out, columns=["a", "b", "value"])
        made.insert(0, "lang", rows["lang"].iloc[0])
        return made

    listed = chunks.select("lang", "chunk", "size").distinct()
    listed = listed.union(groups.select("lang").distinct().select("lang", F.lit(-1).cast("long"), F.lit(0)))  # a language without kept terms has its pairs too
    dense = groups.join(listed, "lang").join(chunks.select("lang", "chunk", "source", "ids", "n"), ["lang", "chunk", "source"], "left")
    dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0), "blocks"))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    met = dense.groupBy("lang", "chunk", "low", "high").applyInPandas(meet, "lang string, a string, b string, value long")
    summed = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(summed.select("lang", "b", "a", "value"))


def leading_terms(groups: DataFrame, chunks: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item (a kept term) and value: how far the term's share is above the language's, the top ones of each group and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                above = shares(np.array(row["n"]), row["total"], row["kept"]) - shares(np.array(row["lang_n"]), row["lang_total"], row["kept"])
                at = np.argsort(-above, kind="stable")[:top]  # ids ascend in UTF-8 order, so a stable sort breaks ties by term
                at = at[above[at] > 0]
                lists = [pa.array([row[c]] * len(at), pa.string()) for c in ("lang", "source")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([row["terms"][k] for k in at.tolist()], pa.string()), pa.array(above[at])], names=["lang", "source", "item", "value"])

    totals = groups.select("lang", "source", "total", "lang_total", "kept")
    return chunks.select("lang", "source", "n", "lang_n", "terms").join(totals, ["lang", "source"]).mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) group its distance to every other source of the lang
    (part `pair`, all ranks) and the kept terms it uses most above the lang's share (part `term`, ranks to top).

    Null lang, source and text count as empty strings. Groups without terms, and languages without kept ones,
    have their pairs. Repeated rows count once each. Equal values rank by UTF-8 order of the item. An empty
    table gives no rows. Other columns are not read.
    """
    counts = settle(term_counts(docs))
    chunks = settle(term_chunks(counts, min_documents))
    groups = settle(group_totals(counts, chunks))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = pair_divergence(groups, chunks).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    terms = leading_terms(groups, chunks, top).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.select(*columns).union(terms.select(*columns))


def q_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
w AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total FROM a),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM w JOIN v USING (lang)),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""
