import hashlib
import random
import re
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from tokenizers import Tokenizer

from crestline.llm import exact_dedup, license_scan, packing, quality_rules, spiece, token_counts, token_output, toxicity
from crestline.llm.common import BPE_JSON, ByteBpe

ODD = ["", None, " \n\t", "a", "A b\x0bc", "a  b", "a b", "a\nb", "é ü", "x" * 5000, "word " * 3000, "<|endoftext|> hi", "naïve 日本 😀 ok", "l1\nl1\n \nl2\n"]


def table(spark, texts, extra=True):
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(2, texts[2], None, None), (None, "a b", "s", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, kept int").repartition(3)


def test_exact_dedup_equals_brute_force_and_remembers(spark):
    docs = table(spark, ODD)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == len(groups)
    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    index = exact_dedup.DigestIndex(spark)
    first = index.add(docs).count()
    again = index.add(docs).collect()
    assert first == len(again) and not any(r.kept for r in again) and index.table().count() == len(groups)
    assert exact_dedup.drop_exact_copies(docs).count() == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).collect() == []


def test_digest_index_reopened_elsewhere_knows_its_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "no id")], "doc_id long, text string")
    made = exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/index", buckets=8)
    assert made.add(docs, batch="one").where("kept").count() == 201
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        index = exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/index")
        assert index.buckets == 8
        assert index.add(docs, batch="two").where("kept").count() == 0 and index.table().count() == 201  # the row without an id is known too
        assert index.add(docs, batch="one").where("kept").count() == 201 and index.table().count() == 201  # a batch tried again
        index.compact()
        again = exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/index")
        assert again.table().count() == 201 and again.add(docs).where("kept").count() == 0
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/index", buckets=5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_two_writers_keep_each_text_once(spark, tmp_path):
    """Two batches with the same 50 texts, added at the same time through two openings of one index."""
    path = f"file://{tmp_path}/index"
    exact_dedup.DigestIndex(spark, path=path, buckets=4)
    docs = [spark.createDataFrame([(100 * k + i, f"text {i}") for i in range(50)], "doc_id long, text string") for k in range(2)]
    with ThreadPoolExecutor(2) as pool:
        kept = list(pool.map(lambda k: exact_dedup.DigestIndex(spark, path=path).add(docs[k], batch=f"b{k}").where("kept").count(), range(2)))
    assert sorted(kept) == [0, 50]
    index = exact_dedup.DigestIndex(spark, path=path)
    assert index.table().count() == 50 and index.add(docs[0], batch="later").count() == 50


def test_a_claim_left_by_a_failed_writer(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path=path, buckets=4, wait=0)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    index._claim("lost")
    with pytest.raises(RuntimeError, match="another batch"):
        index.add(docs, batch="other")
    assert index.add(docs, batch="lost").where("kept").count() == 2
    assert index.add(docs, batch="other").where("kept").count() == 0
    opened = exact_dedup.DigestIndex(spark, path=path)
    index.compact()
    assert opened.add(docs, batch="third").where("kept").count() == 0 and opened.table().count() == 2


def test_exact_copies_with_any_column_names(spark):
    docs = spark.createDataFrame([(2, "a", 7, "x", "p"), (1, "a", 8, "y", "q"), (1, "a", 8, "y", "q"), (3, None, None, None, None)], "doc_id long, text string, __id int, __digest string, row_id string")
    got = sorted(tuple(r) for r in exact_dedup.drop_exact_copies(docs).collect())
    assert got == [(1, "a", 8, "y", "q"), (3, None, None, None, None)]


def ids_of(text):
    return Tokenizer.from_file(BPE_JSON).encode(text or "", add_special_tokens=False).ids


def test_bpe_ids_equal_the_tokenizers_library():
    bpe = ByteBpe.load()
    assert all(bpe.encode(t).tolist() == ids_of(t) for t in ODD if t is not None)


def check_packed(rows, texts, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault((getattr(r, "shard", 0), r.sequence_id if hasattr(r, "sequence_id") else r.sequence), []).append(r)
    for d, text in texts.items():
        ids = np.array([*ids_of(text), 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_packing_places_every_id_once(spark):
    texts = dict(enumerate(ODD))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, capacity=64).collect()
    check_packed(rows, texts, 64)
    assert packing.pack(docs.limit(0)).collect() == []


def test_pattern_counts_add_up():
    r = random.Random(2)
    for h in ({1: 1000}, {100: 7, 2048: 3}, Counter(min(2048, int(r.expovariate(1 / 600)) + 1) for _ in range(5000))):
        packed = packing.shortest_pack_first(dict(h), 2048)
        held = Counter()
        for runs, count in packed:
            assert sum(n * k for n, k in runs) <= 2048
            for n, k in runs:
                held[n] += k * count
        assert held == Counter(h)


def test_matrices_round_trip(spark):
    texts = dict(enumerate(ODD))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    packed = token_output.packed_matrices(docs, capacity=64, block_ids=500)
    check_packed(token_output.segments(packed).collect(), texts, 64)
    for r in packed.collect():
        assert len(r.ids) == 64 * r.id_bytes and r.cu_lengths[:-1] == r.position_resets and r.cu_lengths[0] == 0
    assert packed.limit(0).collect() == []


def test_best_fit_takes_the_fullest_that_has_room():
    assert token_output.best_fit_decreasing([6, 5, 4, 3, 2], 10) == [(0, 0), (1, 0), (0, 6), (1, 5), (1, 8)]


def test_best_fit_equals_a_plain_scan():
    """Each length goes to the open sequence with the least room that suffices, found by looking at all of them."""
    r = random.Random(8)
    for _ in range(200):
        lengths = sorted((r.randint(1, 40) for _ in range(r.randint(1, 60))), reverse=True)
        rooms: list[int] = []
        for (place, offset), n in zip(token_output.best_fit_decreasing(lengths, 40), lengths, strict=True):
            fits = [room for room in rooms if room >= n]
            if place == len(rooms):
                assert not fits
                rooms.append(40)
            else:
                assert rooms[place] == min(fits)
            assert offset == 40 - rooms[place]
            rooms[place] -= n


def test_token_counts_equal_brute_force(spark):
    docs = table(spark, ODD)
    lengths = [len(ids_of(r.text)) for r in docs.collect()]
    sums = token_counts.token_counts(docs)
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.length) and r.docs_at_least == sum(n >= r.length for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= r.length) and r.truncated_tokens == sum(min(n, r.length) for n in lengths)
    limits = spark.createDataFrame([(0,), (2,), (777,), (10**6,)], "context_limit long")
    for r in token_counts.at_limits(sums, limits).collect():
        assert r.truncated_tokens == sum(min(n, r.context_limit) for n in lengths)
    assert token_counts.quantile(sums, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def slow_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    return len({p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 5)})


def test_quality_measures_equal_brute_force(spark):
    r = random.Random(4)
    texts = [*ODD, *(" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(30)), "x #$ y | z"]
    got = {x.doc_id: x for x in quality_rules.quality(table(spark, texts)).collect() if x.doc_id is not None}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [line for line in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        want = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), slow_repeats(words))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, t
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not got[i].kept or not got[i].base_failed)
    ledger = quality_rules.ledger(table(spark, texts))
    bits = [x.failed_bits for x in ledger.collect()]
    for a in quality_rules.ablations(ledger).collect():
        held, bit = quality_rules.mask(quality_rules.POLICIES[a.policy]), quality_rules.mask([a.rule])
        assert a.n_failed == sum(b & bit > 0 for b in bits) and a.n_only_this == sum(b & held == bit for b in bits)


def test_pieces_equal_the_sentencepiece_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    got = {r.doc_id: r.ids for r in spiece.encode(table(spark, ODD)).collect() if r.doc_id is not None}
    assert all(got[i] == library.encode(t or "") for i, t in enumerate(ODD))
    back = {r.doc_id: r.text for r in spiece.decode(spiece.encode(table(spark, ODD))).collect() if r.doc_id is not None}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))


def test_pieces_equal_the_library_on_a_whole_table(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spiece.MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in spiece.encode(docs).collect()}
    assert got == {k: library.encode(t) for k, t in texts.items()}


def test_unigram_scores_are_the_best_possible():
    model = spiece.PieceModel(kind="unigram")

    def best(word):
        table = [0.0] + [None] * len(word)
        for end in range(1, len(word) + 1):
            options = [table[s] + model.scores[model.ids[word[s:end]]] for s in range(end) if word[s:end] in model.ids]
            table[end] = max(options)
        return table[-1]

    for word, ids in model.forward(sorted(["▁hello", "▁help", "▁helpful", "ness", "nested"])):
        assert sum(model.scores[i] for i in ids) == pytest.approx(best(word))


def test_license_notices(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = ["some words\n" + notice, "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 4.", "we license nothing here", "", None, "pad " * 3000 + notice + " pad" * 3000, license_scan.TEMPLATES["MIT"].replace("free of charge", "free of any charge")]
    texts.append(license_scan.TEMPLATES["MIT"].replace("free of charge", "at no charge"))
    got = {}
    for r in license_scan.license_scan(table(spark, texts)).collect():
        if r.confirmed and r.doc_id is not None:
            got.setdefault(r.doc_id, []).append((r.template, texts[r.doc_id][r.notice_start : r.notice_end]))
    assert got[0] == [("Apache-2.0-notice", notice[:-1])] and got[1][0][0] == "GPL-3.0-notice" and 2 not in got and 3 not in got
    assert got[6][0][0] == "Apache-2.0-notice" and got[7][0][0] == "MIT" and 8 not in got


def exact_notices(text, templates):
    """(template, start, end) of every exact run of a template's words; those inside a longer one do not count."""
    spans = license_scan.words_at(text)
    words = [w for w, _, _ in spans]
    found = []
    for name, notice in templates.items():
        own = [w for w, _, _ in license_scan.words_at(notice)]
        found += [(name, spans[i][1], spans[i + len(own) - 1][2]) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return {x for x in found if not any(y != x and y[1] <= x[1] and x[2] <= y[2] for y in found)}


def test_license_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {(d, *x) for d, t in texts.items() for x in exact_notices(t, license_scan.TEMPLATES)}
    rows = license_scan.q_license_scan(spark, sf).where("confirmed AND n_missing = 0 AND n_extra = 0").collect()
    assert {(r.doc_id, r.template, r.notice_start, r.notice_end) for r in rows} == want and len(want) > 10


def test_license_templates_of_any_length(spark):
    r = random.Random(6)
    templates = {f"own-{n}": "This licence grants " + " ".join(f"w{r.randrange(500)}" for _ in range(n)) for n in (5, 300, 900)}
    texts = [" ".join(["pad"] * n + [t] + ["end"] * n) for n in (0, 50, 2000) for t in templates.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.template) for x in license_scan.license_scan(docs, templates).where("confirmed").collect()}
    assert got == {(i, list(templates)[i % 3]) for i in range(9)}
    with pytest.raises(ValueError):
        license_scan.license_scan(docs, {"none": "all words are free"})


def test_license_notices_of_long_lists():
    """Every notice of a list longer than a window is reported once and whole, as an exact search finds it."""
    names = ["MIT", "Apache-2.0-notice", "GPL-3.0-notice", "MIT", "MIT-notice", "Apache-2.0", "BSD", "CC-BY-4.0", "GPL-2.0", "MPL-2.0"] * 3
    for pad in (0, 3, 7, 40, 55, 71, 90):
        text, want = "pad " * (pad % 5), []
        for k, name in enumerate(names):
            notice = license_scan.TEMPLATES[name]
            words = license_scan.words_at(notice)
            want.append((name, len(text) + words[0][1], len(text) + words[-1][2]))
            text += notice + " " + " ".join(f"part{k}x{j}" for j in range(pad + k)) + "\n"
        got = license_scan.Scanner(license_scan.TEMPLATES).scan(text)
        assert sorted((r[5], r[6], r[2]) for r in got if r[-1]) == [(a, z, n) for n, a, z in want]
        assert all(r[7] == r[8] == 0 for r in got if r[-1])


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"), "toxic", split_flag=True)
    assert list(model.thresholds) == sorted(model.thresholds)
    held = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("toxic", "kept").count().collect()
    n = {(r["toxic"], r["kept"]): r["count"] for r in held}
    assert n[1, False] / (n[1, False] + n.get((1, True), 0)) > 0.85 and n.get((0, False), 0) / n[0, True] < 0.01
    odd = table(spark, ODD)
    assert toxicity.score(odd, model).count() == odd.count() == toxicity.keep_clean(odd, model).count()
    many = spark.createDataFrame([(1, "foul words here")] * 50 + [(2, "kind words here")] * 50, "doc_id long, text string")
    assert toxicity.sample_words(many, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), "toxic", 2).count() == 2
    nothing = toxicity.fit(docs, labels.where("toxic = 0"), "toxic")
    assert nothing.weights == {} and toxicity.score(odd, nothing).where("NOT kept").count() == 0


def test_scores_equal_the_formula(spark):
    """severity and grades of every text, worked out word by word from the weights."""
    model = toxicity.OrdinalModel({"foul": 2.0, "vile": 1.5, "kind": -1.0}, (1.0, 3.0))
    texts = [*ODD, "Foul, vile FOUL!", "kind and foul", "vile", "foul vile kind words " * 500]
    for x in toxicity.score(table(spark, texts), model).where("doc_id IS NOT NULL").collect():
        words = set(re.findall(r"\w+", (texts[x.doc_id] or "").lower()))
        z = sum(v for k, v in model.weights.items() if k in words)
        p = [1.0, *(1 / (1 + np.exp(t - z)) for t in model.thresholds), 0.0]
        assert x.severity == pytest.approx(p[1] + p[2]) and x.p_toxic == pytest.approx(p[1])
        assert x.grade == int(np.argmax([p[k] - p[k + 1] for k in range(3)])) and x.kept == (p[1] < 0.5)


def test_cumulative_link_equals_a_search_of_the_likelihood():
    """No small step in any weight or threshold makes the fitted penalised likelihood better."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(2) < 0.5) for _ in range(300)]
    grades = np.array([min(2, len(r)) if rng.random() < 0.8 else int(rng.integers(3)) for r in rows])
    weights, thresholds = toxicity.fit_cumulative_link(rows, grades, 2)

    def worth(w, t):
        z = np.array([w[r].sum() for r in rows])
        reach = np.column_stack([np.ones(len(z)), *(1 / (1 + np.exp(c - z)) for c in t), np.zeros(len(z))])
        own = reach[np.arange(len(z)), grades] - reach[np.arange(len(z)), grades + 1]
        return np.log(own).mean() - 0.002 / len(z) * (w**2).sum()

    best = worth(weights, thresholds)
    for k in range(4):
        for step in (0.05, -0.05):
            w, t = weights.copy(), thresholds.copy()
            (w if k < 2 else t)[k % 2] += step
            assert worth(w, t) < best + 1e-6


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(3) < 0.5) for _ in range(800)]
    grades = np.array([min(2, len(r)) for r in rows])
    weights, thresholds = toxicity.fit_cumulative_link(rows, grades, 3)
    assert (weights > 1).all() and thresholds[0] < thresholds[1]
