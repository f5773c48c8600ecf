import random
import re
from itertools import combinations

import numpy as np

from crestline.llm import near_dedup as N


def words_of(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def brute(rows: list[tuple]) -> list[tuple]:
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and None not in (rows[i][0], rows[j][0]) and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            at[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else least[root(i)]
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]

    def edited(w, times):
        w = list(w)
        for _ in range(times):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        return w

    rows, line = [], text(40)
    for _ in range(25):
        base = text(r.randint(60, 200))
        for _ in range(r.randint(1, 6)):
            rows.append(edited(base, r.randint(0, 4)))
    base = text(150)
    rows += [edited(base, r.randint(0, 3)) for _ in range(120)]
    rows += [line + text(30) for _ in range(90)]
    chain = text(100)
    for _ in range(30):
        chain = edited(chain, 1)
        rows.append(list(chain))
    texts = [" ".join(w) for w in rows]
    texts += [texts[3].upper(), texts[3].replace(" ", "\n\t"), "", None, " \n", "a b c", "A  b\tc", "a b c d", "a b c d e"]
    r.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1, texts[0])]


def test_equals_brute_force(spark):
    rows = corpus(1)
    got = sorted((tuple(r) for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == brute(rows)


def test_nodes_that_branch(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 15)
    monkeypatch.setattr(N, "CHUNK", 8)
    r = random.Random(5)
    line, kin = [f"l{i}" for i in range(30)], [f"k{i}" for i in range(40)]
    texts = [line + [f"w{r.randrange(10**6)}" for _ in range(25)] for _ in range(60)]
    texts += [kin[: 40 - r.randint(0, 2)] for _ in range(40)] + [t + ["x"] for t in texts[:10]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = sorted((tuple(r) for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "x", 1), (7, "a b c d e f", "y", 2), (8, None, None, None)], "doc_id long, text string, component string, n_shingles int")
    assert N.near_groups(docs.limit(0)).collect() == []
    kept = {r["doc_id"]: (r["component"], r["n_shingles"]) for r in N.drop_near_copies(docs).collect()}
    assert kept == {5: ("x", 1), 8: (None, None)}


def test_deep_nodes_get_further_trees(spark, monkeypatch):
    """Documents of one template at a similarity of 0.8, with pairs at the threshold among them, and a node that needs fifteen levels and more."""
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "partitions", lambda spark: 1)
    template = [f"t{i}" for i in range(404)]
    texts = []
    for k in range(60):
        own = [f"o{k}x{j}" for j in range(50)]
        texts.append(template + own)
        texts.append(template + own[:14] + [f"p{k}x{j}" for j in range(36)])
    for k in (0, 2):
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts[k : k + 2])
        assert 85 <= 100 * len(a & b) / len(a | b) < 85.2
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    depths = []
    monkeypatch.setattr(N, "next_level", lambda *a, f=N.next_level: depths.append(1) or f(*a))
    got = sorted((tuple(r) for r in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)).collect()), key=str)
    assert got == brute(rows) and sum(g[3] for g in got) == 60
    assert len(depths) >= 2 * 14


def test_links_of_held_documents_equal_brute_force():
    """The pairs that join two components are those of full sets at the threshold, for shingles before, between and behind those held."""
    r = random.Random(3)
    sketch = np.zeros(N.VALUES, np.uint8)
    for _ in range(300):
        sets = [np.array(sorted(r.sample(range(60), r.randint(1, 40))), np.uint64) for _ in range(6)]
        held = N.Held([(i, i, s, sketch) for i, s in enumerate(sets[:5])], 50)
        got = {a for a, _ in held.links(9, 9, sets[5], sketch, N.Roots(), 5)}
        assert got == {i for i, s in enumerate(sets[:5]) if 2 * len({*s} & {*sets[5]}) >= len({*s} | {*sets[5]})}


def test_trees_follow_depth():
    """Of 1,000 pairs at the threshold followed to depth fifteen, ten trees lose one in thirty or so; the trees for that depth at most a few."""
    r = np.random.default_rng(1)
    pairs, depth = 1000, 15
    one = r.integers(0, 2**32, (pairs, N.VALUES), dtype=np.uint32)
    two = np.where(r.random(one.shape) < 0.85, one, one + np.uint32(1))

    def lost(trees: int) -> int:
        met = set()
        for tree in range(trees):
            pair, node = np.arange(pairs), N.finish(np.full(pairs, tree + 1, np.uint64) + np.arange(pairs, dtype=np.uint64) * N.A)
            for _ in range(depth):
                index, child = N.branch(node, one[pair], 85)
                _, other = N.branch(node, two[pair], 85)
                both = child == other
                pair, node = pair[index][both], child[both]
            met |= set(pair.tolist())
        return pairs - len(met)

    assert lost(N.TREES) > 10
    assert N.trees_for(3, 85) == N.TREES and lost(N.trees_for(depth, 85)) <= 5
