import hashlib
import random

import pytest

from crestline.llm import substring_dedup as S


def brute(rows: list[tuple], match: int = S.MATCH) -> dict:
    """By definition: the least document of every string, then a mask of covered bytes."""
    least: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        if d is not None:
            for p in range(len(raw) - match + 1):
                s = raw[p : p + match]
                least[s] = min(d, least.get(s, d))
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        if d is not None:
            for p in range(len(raw) - match + 1):
                if least[raw[p : p + match]] < d:
                    gone[p : p + match] = b"\1" * match
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéü") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long_passage, line = text(14), text(60), "x" * 49
    rows = [(i, text(r.randint(1, 60))) for i in range(60)]
    rows += [(100 + i, text(10) + passage + text(r.randint(0, 10))) for i in range(40)]
    rows += [(200 + i, text(3) + long_passage[r.randint(0, 30) :] + text(2)) for i in range(20)]
    rows += [(300 + i, long_passage) for i in range(10)]
    rows += [(400, "ab" * 200), (401, "ab" * 90), (402, "b" + "ab" * 300), (403, ""), (404, None), (405, line), (406, line), (407, line + "y"), (408, line + "y")]
    rows += [(None, long_passage), (100, passage + passage), (100, passage + passage)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [100_000, 8])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_RUNS", hot)
    monkeypatch.setattr(S, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(S, "CHUNK", 256)
    monkeypatch.setattr(S, "HELD_RUNS", 50)
    monkeypatch.setattr(S, "HOT_HELD", 7)
    hot_path, tables = S.hot_spans, []
    monkeypatch.setattr(S, "hot_spans", lambda held, match: tables.append(held.count()) or hot_path(held, match))
    rows = corpus(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(S.to_blocks, "__defaults__", (2_000,))
    got = sorted((tuple(r) for r in S.substring_dedup(docs).collect()), key=str)
    assert got == brute(rows)
    assert [n > 3 for n in tables] == ([True] if hot == 8 else [])


def test_keeps_all_columns_and_takes_an_empty_table(spark):
    rows = [(1, "a" * 60, "x", 3, None), (2, "a" * 60, None, None, b"k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n_removed int, kept_bytes binary")
    got = {r["doc"]["doc_id"]: r for r in S.cut_repeats(docs).collect()}
    assert got[1]["kept_bytes"] == b"a" * 60 and got[2]["kept_bytes"] == b"" and got[2]["n_removed"] == 60
    assert [tuple(got[k]["doc"]) for k in (1, 2)] == rows
    assert S.substring_dedup(docs.limit(0)).collect() == []
