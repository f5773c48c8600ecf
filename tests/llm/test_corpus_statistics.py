"""Source divergence, importance resampling and decontamination against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from crestline.llm import decontamination, divergence, importance, queries
from crestline.llm.words import TERM, WORD, blocks, pieces

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t", "A b\x0bc", "é ü É naïve 日本 😀 ok 7up x7x", "x" * 5000, "one two " * 3000, "ÀÉ ǅ İ ß", "12 34\x00 5"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def prose(seed, n, vocabulary=40):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(n))


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_blocks_hold_every_word_once_for_all_sizes(size):
    texts = [t or "" for t in ODD] + [prose(1, 300), ""]
    column = pa.array([t.encode() for t in texts], pa.binary())
    for carry in (0, 1, 9):
        for limit in (1, 50, 10**6):
            found = {}
            for block in blocks(column, WORD, carry, limit, size):
                for k, row in enumerate(block.row.tolist()):
                    part = block.words[block.begin[k] : block.begin[k + 1]]
                    so_far = found.setdefault(row, [])
                    assert block.first[k] == len(so_far) - block.carried[k] and so_far[len(so_far) - block.carried[k] :] == part[: block.carried[k]]
                    so_far += part[block.carried[k] :]
            assert {k: [w.decode() for w in v] for k, v in found.items()} == {k: words(t) for k, t in enumerate(texts)}
    assert all(b"".join(pieces(t.encode(), TERM, size)) == t.encode() for t in texts)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_importance", "op13_decontamination"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_divergence_equals_sql_however_rows_are_dealt(spark):
    r, docs = random.Random(11), []
    for k in range(500):
        lang, source = r.choice(["en", "pl", "", None]), r.choice(["b", "a", "Z", "é", "日", "", None])
        docs.append((k, " ".join(r.choice(["tak", "NIE", "é", "É", "日本", "ß", "x7y"]) if r.random() < 0.3 else "w" + "abcdefghij"[int(r.paretovariate(0.7)) % 10] * r.randint(1, 6) for _ in range(60)), lang, source))
    docs += [(600 + k, t, r.choice(["en", "xx"]), "odd") for k, t in enumerate(ODD)] + [(700, "lonely", "de", "only"), docs[0], (None, docs[1][1], "en", "\U0001f600"), (800, None, "en", "\uffff")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", docs)
    want = con.execute(divergence.SQL)
    columns = [c[0] for c in want.description]
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = [tuple(row[c] for c in columns) for row in divergence.audit(frame.repartition(5)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


# --- decontamination


def contaminated(docs, items):
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(10, len(iw))
            windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for k in range(len(ws) - n + 1) if n else ():
                if tuple(ws[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    items = [(k, prose(100 + k, 25, 500)) for k in range(12)] + [(12, prose(100, 25, 500)), (13, "alpha beta"), (14, "Gamma"), (15, "w1 w2 w3 w4 w5 w6 w7"), (16, ""), (17, None), (None, prose(103, 12, 500)), (3, prose(103, 25, 500))]
    r = random.Random(3)
    docs = []
    for k in range(60):
        text = prose(k, r.randrange(0, 60), 500).split()
        if k % 3 == 0:
            item = items[r.randrange(12)][1].upper().split()
            a = r.randrange(0, 14)
            text[10:10] = item[a : a + r.randrange(8, 13)]
        if k % 7 == 0:
            text += ["alpha,", "BETA", "gamma"]
        docs.append((k, " ;".join(text)))
    docs += [(100 + k, t) for k, t in enumerate(ODD)] + [(0, docs[0][1]), (0, "other text alpha beta"), (None, items[2][1]), (None, items[2][1]), (500, (items[0][1] + " ") * 40)]
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, window string, start int, item_id int").repartition(3)
    bench = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, length int")
    want = contaminated(docs, items)
    for bits in (64, 1 << 16):  # a full filter lets everything through to the join
        monkeypatch.setattr(decontamination.bit_filter, "__defaults__", (bits,))
        assert sorted(map(tuple, decontamination.contamination(frame, bench).collect()), key=repr) == want
    kept = [(r.doc_id, r.text) for r in decontamination.clean(frame, bench).collect()]
    bad = {(d, t) for d, t in docs if contaminated([(d, t)], items)[0][5]}
    assert Counter(kept) == Counter((d, t) for d, t in docs if (d, t) not in bad)
    assert decontamination.contamination(frame.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontamination.contamination(frame, bench.limit(0)).collect())


def test_long_texts_are_read_whole(spark, monkeypatch):
    item = prose(7, 30, 10**6)
    text = f"{prose(8, 3000)} {item} {'y' * 10000} {prose(9, 3000)} {item}"
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    column = pa.array([text.encode()], pa.binary())
    found = np.full(1, 2**64 - 1, np.uint64)
    for size in (100, 1 << 20):
        starts = []
        for block in blocks(column, WORD, 9, 50, size):
            starts += [int(block.first[s] + a - block.begin[s]) for a in decontamination.selected(decontamination.WordHashes().of(block.words), 10, found).tolist() for s in [block.segment[a]] if block.segment[a + 9] == s]
        assert sorted(starts) == list(range(len(words(text)) - 9))
    assert decontamination.contamination(docs, bench).first().n_hit == 60


# --- importance resampling


def resampled(docs, target, percent, min_words):
    def features(text):
        ws = words(text)
        return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]

    bucket = lambda f: zlib.crc32(f.encode()) % importance.BUCKETS
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in map(bucket, features(text))]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words(text)), len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, order, percent * len(order) // 100


def test_importance_equals_brute_force(spark):
    docs = [(k, prose(k, random.Random(k).randrange(0, 80))) for k in range(80)] + [(100 + k, t) for k, t in enumerate(ODD)] + [(None, prose(5, 40)), (200, "z" * 70 + " é " + "q" * 64 + " ab " + "q" * 63 + " " + "r" * 300)]
    docs += [(300, prose(300, 30))] * 3
    target = [prose(k, 40, 12) for k in range(500, 510)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, n_words int, score string").repartition(4)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, rank int")
    for percent, least in ((25, 20), (100, 0), (0, 20)):
        rows, order, drawn = resampled(docs, target, percent, least)
        got = importance.resample(frame, bench, percent, least).collect()
        assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
        assert [tuple(r)[:5] for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == order[:drawn]
        assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, drawn + 1))
    assert importance.resample(frame.limit(0), bench).collect() == []
    assert importance.resample(frame, bench.limit(0)).count() == len(docs)


def test_trie_states_are_crc32(monkeypatch):
    texts = ["aa bb aa bb " + "c" * 100 + " dd " + "e" * 63 + " f", "bb é", ""]
    for size in (1, 5, 1000):
        column = pa.array([t.encode() for t in texts], pa.binary())
        total, nodes = np.zeros(97, np.int64), importance.Words()
        for block in blocks(column, WORD, 1, 3, size):
            total += importance.Trie(nodes, block).totals(97)
        want = np.zeros(97, np.int64)
        for t in texts:
            ws = words(t)
            for f in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]:
                want[zlib.crc32(f.encode()) % 97] += 1
        assert total.tolist() == want.tolist()


# --- source divergence


def audited(docs, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    langs = {}
    for lang, source, text in docs:
        langs.setdefault(lang or "", {}).setdefault(source or "", []).append(terms(text))
    out = []
    for lang, groups in langs.items():
        df = Counter(t for texts in groups.values() for ts in texts for t in set(ts))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        n = {s: Counter(t for ts in texts for t in ts) for s, texts in groups.items()}
        share = lambda c: (lambda total: {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))  # noqa: E731, B023
        p, q = {s: share(c) for s, c in n.items()}, share(sum(n.values(), Counter()))
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            lead = [(t, p[s][t] - q[t]) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", lead, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k) for k, x in enumerate(found[:limit], 1)]
    return sorted(out, key=repr)


def test_divergence_equals_brute_force(spark, monkeypatch):
    r = random.Random(1)
    vocabulary = ["the", "Of", "é", "日本", "ab", "á", "zz", "😀", "ñandú", *[f"{a}{b}" for a in "abc" for b in "xyzé"]]
    docs = [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "ß", None]), " ".join(r.choices(vocabulary, k=r.randrange(0, 30)))) for _ in range(300)]
    docs += [("xx", "a", "rare"), ("xx", "b", None), ("xx", "c", "12 34"), ("en", "none", ""), ("one", "only", "alone"), *[("en", "s1", "ties tiez tied")] * 7]
    docs += [("en", "long", "the of " * 2000 + "w" * 5000)]
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "lang string, source string, text string, n int, term string").repartition(3)
    want = audited(docs, 5, 4)
    assert sorted(map(tuple, divergence.audit(frame, 5, 4).collect()), key=repr) == want
    assert divergence.audit(frame.limit(0)).collect() == []


def test_divergence_does_not_depend_on_chunks_blocks_and_flushes():
    counter = divergence.Counter()
    texts = [f"{prose(k, 60)} é".replace("0", "a") for k in range(20)]
    for at in range(0, 20, 7):
        part = texts[at : at + 7]
        divergence.COUNTED_WORDS, before = 5, divergence.COUNTED_WORDS
        try:
            rows = [b for b in counter.add(["x"] * len(part), ["y"] * len(part), pa.array([t.encode() for t in part], pa.binary()))]
        finally:
            divergence.COUNTED_WORDS = before
        assert all(b.num_rows for b in rows)
    big = np.array([0, 1, 10**12, 5 * 10**12], np.int64)
    assert divergence.shares(big, int(big.sum()), 4).tolist() == [1 + 10**9 * (int(n) + 5) // (int(big.sum()) + 20) for n in big]
    chunks = divergence.Chunks(1, 0)
    table = pa.table({"term": ["a", "a", "b", "é"], "source": ["p", "q", "p", "q"], "n": pa.array([1, 2, 3, 4]), "df": pa.array([1, 1, 1, 1])})
    made = [b for part in (table, table) for b in chunks.add("en", part)] + list(chunks.flush())
    assert [(b.num_rows, b["ids"].to_pylist(), b["lang_n"].to_pylist()) for b in made] == [(2, [[0, 1, 3, 4], [0, 2, 3, 5]], [[3, 3, 3, 3], [3, 4, 3, 4]])]


def test_many_sources_meet_in_blocks(spark, monkeypatch):
    docs = [("en", f"s{k % 9}", f"a b{'c' * (k % 5)} d") for k in range(90)]
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    want = audited(docs, 3, 50)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    assert sorted(map(tuple, divergence.audit(frame, 3).collect()), key=repr) == want
