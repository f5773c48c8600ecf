"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; a policy is a mask of the rules that it enforces, so new policies and
ablations read the ledger's bits and never the texts.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, per_text

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more; windows are compared exactly, by ranks of 1, 2, 4 and 5 words."""
    if len(words) <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    one = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    _, two = np.unique(one[:-1] * len(seen) + one[1:], return_inverse=True)
    _, four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)
    _, five, times = np.unique(four[:-1] * len(seen) + one[4:], return_inverse=True, return_counts=True)
    again = times[five] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(again)] += again
    edges[WINDOW : WINDOW + len(again)] -= again
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: str) -> tuple[int, ...]:
    """The values of MEASURES. bytes.split() and bytes.strip() part at ASCII white space only."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - (len(raw) - sum(map(len, words))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        raw.count(b"!"),
    )


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES (long), one row per row of docs; a null text is measured as an empty one."""

    def of_texts(texts: list[str]) -> list[pa.Array]:
        return [pa.array(c, pa.int64()) for c in zip(*map(measure, texts), strict=True)] if texts else [pa.array([], pa.int64())] * len(MEASURES)

    return per_text(docs, ", ".join(f"{m} long" for m in MEASURES), of_texts)


#: A rule's position is its bit and never changes; new rules are added at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "shouting": "2 * n_marks > n_words",
}
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines"),
    "v3": tuple(RULES),
}
CURRENT = "v3"


def mask(rules: Iterable[str]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and failed_bits (long)."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total: Column = F.lit(0)
    for bit in bits:
        total = total.bitwiseOR(bit)
    return measurements(docs).withColumn("failed_bits", total.cast("long"))


def passes(policy: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """policy, rule, n_failed, n_only_this: the documents that a rule fails, and those that come back without it.

    Rows are first counted by their bits, of which there are at most 2 to the number of rules.
    """
    counts = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    order = list(RULES)
    wanted = [(name, rule, mask(rules), 1 << order.index(rule)) for name, rules in POLICIES.items() for rule in rules]
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit")) for p, r, m, b in wanted)))
    held = F.col("failed_bits").bitwiseAND(F.col("p.mask"))
    return (
        counts.select("failed_bits", "n", pairs.alias("p"))
        .groupBy("p.policy", "p.rule")
        .agg(F.sum(F.when(held.bitwiseAND(F.col("p.bit")) > 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(held == F.col("p.bit"), F.col("n")).otherwise(0)).alias("n_only_this"))
    )


def quality(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy. Empty and null texts fail few_words; an empty table gives no rows."""
    rows = ledger(docs)
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & passes(policy))


def q_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")
    return quality(documents(spark, sf_dir)).select(*columns)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 2 * n_marks > n_words THEN 64 ELSE 0 END AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits
FROM b
"""
