"""Toxicity grades by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - t_k): the word weights w are shared by all thresholds
t_1 <= t_2 <= ..., so a few severe examples still sharpen the mild threshold. x marks which
words of a chosen vocabulary a text holds. The model is fitted on a bounded sample of
labelled rows (`max_labelled`, `max_features`); every document is scored, in place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, release, settle, slices, tidy

WORD = re.compile(r"\w+")
MAX_LABELLED = 20_000
MAX_FEATURES = 1_024
REJECT_AT = 0.5


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def at_least(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = sum(self.weights[w] for w in self.weights.keys() & words_of(text))
        return sigmoid(score - np.array(self.thresholds))


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = 0.004, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch gradient ascent (Adam) on the penalised mean log likelihood.

    rows holds the present features of each example. Thresholds are a first one plus positive
    gaps, so they stay ordered.
    """
    top = int(grades.max(initial=0))
    feature = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    example = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    shares = np.array([np.clip((grades >= k).mean(), 1e-6, 1 - 1e-6) for k in range(1, top + 1)])
    start = np.log((1 - shares) / shares)
    raw = np.concatenate([np.zeros(n_features), start[:1], np.log(np.expm1(np.maximum(np.diff(start), 0.1)))])
    first, second = np.zeros_like(raw), np.zeros_like(raw)

    def cuts(raw: np.ndarray) -> np.ndarray:
        gaps = np.log1p(np.exp(raw[n_features + 1 :]))
        return raw[n_features] + np.concatenate([[0], np.cumsum(gaps)])

    every = np.arange(len(rows))
    for step in range(1, steps + 1):
        score = np.bincount(example, raw[feature], len(rows))
        reach = np.ones((len(rows), top + 2))
        reach[:, 1 : top + 1] = sigmoid(score[:, None] - cuts(raw))
        reach[:, top + 1] = 0
        p = np.maximum(reach[every, grades] - reach[every, grades + 1], 1e-9)
        slope = reach * (1 - reach)
        by_score = (slope[every, grades] - slope[every, grades + 1]) / p
        by_cut = np.zeros((len(rows), top + 2))
        by_cut[every, grades] -= slope[every, grades] / p
        by_cut[every, grades + 1] += slope[every, grades + 1] / p
        cut = by_cut[:, 1 : top + 1].mean(axis=0)
        tail = np.cumsum(cut[::-1])[::-1]
        gap = tail[1:] * sigmoid(raw[n_features + 1 :])
        gradient = np.concatenate([np.bincount(feature, by_score[example], n_features) / len(rows) - penalty / len(rows) * raw[:n_features], tail[:1], gap])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        raw = raw + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return raw[:n_features], cuts(raw)


def sample_words(docs: DataFrame, labels: DataFrame, grade_col: str, max_labelled: int) -> DataFrame:
    """doc_id, grade, words of at most max_labelled labelled documents: those whose ids hash lowest. Of an id's labels the highest counts, of its texts the one whose list of words is least."""
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(grade_col).cast("int").alias("grade"))
        .where("label_id IS NOT NULL AND grade IS NOT NULL")
        .groupBy("label_id")
        .agg(F.max("grade").alias("grade"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_labelled)
    )
    rows = id_and_text(docs).join(F.broadcast(wanted), F.col("doc_id") == F.col("label_id"))  # at most max_labelled ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [sorted(words_of(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "grade", "words"])

    found = rows.select("doc_id", "text", "grade").mapInArrow(tidy(run), "doc_id long, grade int, words array<string>")
    return found.groupBy("doc_id").agg(F.max("grade").alias("grade"), F.min("words").alias("words"))


def choose_features(sample: DataFrame, max_features: int) -> list[str]:
    """The words whose presence tells grades above 0 from grade 0 beyond chance (G squared over 1.5 ln of the number of words), strongest first."""
    counts = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0)).alias("pos")).first()
    n, pos = counts["n"], counts["pos"]
    if not 0 < pos < n:
        return []
    by_word = sample.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum((F.col("grade") > 0).cast("long")).alias("hit"))
    words = by_word.count()

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    df, hit, share = F.col("df"), F.col("hit"), pos / n
    g2 = 2 * (term(hit, df * share) + term(df - hit, df * (1 - share)) + term(pos - hit, (n - df) * share) + term(n - df - (pos - hit), (n - df) * (1 - share)))
    strong = by_word.select("word", g2.alias("g2")).where(F.col("g2") >= 1.5 * float(np.log(max(words, 2))))
    return [r["word"] for r in strong.orderBy(F.desc("g2"), "word").limit(max_features).collect()]


def fit(docs: DataFrame, labels: DataFrame, grade_col: str = "grade", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, split_flag: bool = False) -> OrdinalModel:
    """Fit on labels (doc_id, grade_col), grades 0, 1, 2, ...

    With split_flag, grade_col is a 0/1 flag: flagged rows that hold more of the telling words
    than the median flagged row become grade 2, the rest grade 1. Without examples on
    both sides of grade 0 the model finds nothing toxic.
    """
    sample = settle(sample_words(docs, labels, grade_col, max_labelled))
    names = choose_features(sample, max_features)
    if not names:
        return OrdinalModel({}, (50.0,))
    index = F.create_map(*(F.lit(x) for k, w in enumerate(names) for x in (w, k)))
    present = F.array_compact(F.transform(F.array_intersect("words", F.array(*map(F.lit, names))), lambda w: index[w]))
    found = sample.select("grade", present.alias("present")).toPandas()  # at most max_labelled rows, of the chosen words only
    rows = [np.asarray(r, dtype=np.int64) for r in found["present"]]
    grades = found["grade"].to_numpy(dtype=np.int64)
    if split_flag:
        hits = np.array([len(r) for r in rows])
        grades = np.where(grades > 0, 1 + (hits > np.median(hits[grades > 0])), 0)
    weights, thresholds = fit_cumulative_link(rows, grades, len(names))
    return OrdinalModel(dict(zip(names, map(float, weights), strict=True)), tuple(map(float, thresholds)))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (P(grade >= 1)), grade (the likeliest), kept (p_toxic under REJECT_AT).

    One row per row of docs, repeated rows and those without an id too; none for an empty table. A text
    without known words, a null one too, gets the model's base rate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            reach = np.array([model.at_least(t) for t in texts]).reshape(len(texts), len(model.thresholds))
            padded = np.hstack([np.ones((len(texts), 1)), reach, np.zeros((len(texts), 1))])
            grade = np.argmax(padded[:, :-1] - padded[:, 1:], axis=1)
            columns = [ids, pa.array(reach.sum(axis=1)), pa.array(reach[:, 0]), pa.array(grade, pa.int32()), pa.array(reach[:, 0] < REJECT_AT)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "p_toxic", "grade", "kept"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, severity double, p_toxic double, grade int, kept boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; no shuffle. Each row, repeated or without an id, is judged by its text alone; an empty table stays one."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        kept: list[bool] = []
        for at in range(0, len(texts), 256):
            kept += [bool(model.at_least(t or "")[0] < REJECT_AT) for t in texts.slice(at, 256).to_pylist()]
        release()
        return pa.array(kept, pa.bool_())

    return docs.where(clean(F.col("text")))


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels, "toxic", split_flag=True))
