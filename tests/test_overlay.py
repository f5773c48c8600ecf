"""The overlay against a plain search over the whole network, for cells of any size."""

import random

import pytest
from pyspark.sql import functions as F

from crestline.operators import overlay
from crestline.operators.components import component_labels

EDGES = "metric string, way_id long, pos int, a string, b string, cost double"
NODES = "node string, lat double, lng double"
ENDS = "leg_id string, metric string, node string, cost double"


def grid(n, seed, keep=0.9):
    """A lattice of n by n nodes with some segments missing, priced apart in both directions."""
    r = random.Random(seed)
    spot = {f"{i},{j}": (54.4 + i * 4e-4, 18.4 + j * 4e-4) for i in range(n) for j in range(n)}
    rows, way = [], 0
    for i in range(n):
        for j in range(n):
            for a, b in ((1, 0), (0, 1)):
                if i + a < n and j + b < n and r.random() < keep:
                    way += 1
                    u, v = f"{i},{j}", f"{i + a},{j + b}"
                    rows += [(way, 1, u, v, r.uniform(1, 5)), (way, 1, v, u, r.uniform(1, 5))]
    return spot, rows


def links_of(rows):
    found = {}
    for way, pos, a, b, cost in rows:
        found.setdefault(a, []).append((b, cost, (way, pos, a, b)))
    return found


def tables(spark, spot, metrics):
    edges = spark.createDataFrame([(m, *e) for m, rows in metrics.items() for e in rows], EDGES)
    return edges, spark.createDataFrame([(n, *p) for n, p in spot.items()], NODES)


def check_way(row, seeds, goals, rows, want):
    price = {e[:4]: e[4] for e in rows}
    assert row.cost == pytest.approx(want)
    walked = [tuple(e) for e in row.edges]
    ends = [row.entry, *(e[3] for e in walked)]
    assert [e[2] for e in walked] == ends[:-1] and ends[-1] == row.goal
    assert seeds[row.entry] + sum(price[e] for e in walked) + goals[row.goal] == pytest.approx(row.cost)


@pytest.mark.parametrize("limit", [1, 4, 30, 10_000])
def test_equals_plain_search(spark, limit, monkeypatch):
    monkeypatch.setattr(overlay, "TOGETHER", 3)
    spot, rows = grid(9, 1)
    other = [(*e[:4], e[4] * 2) for e in rows if e[0] % 4]  # a second metric allows less
    metrics = {"x": rows, "y": other}
    r = random.Random(5)
    legs = [(f"leg{k}", r.choice("xy"), {r.choice(list(spot)): r.uniform(0, 3) for _ in range(3)}, {r.choice(list(spot)): r.uniform(0, 3) for _ in range(3)}) for k in range(14)]
    legs.append(("same", "x", {"0,0": 1.0}, {"0,0": 2.0}))
    ends = [spark.createDataFrame([(leg, m, n, c) for leg, m, *sides in legs for n, c in sides[k].items()], ENDS) for k in (0, 1)]
    made = overlay.Overlay(*tables(spark, spot, metrics), limit)
    got = {x.leg_id: x for x in made.cheapest(*ends).collect()}
    for leg, metric, seeds, goals in legs:
        found = overlay.settled(links_of(metrics[metric]), [(c, n) for n, c in seeds.items()])
        want = min((found[n][0] + c for n, c in goals.items() if n in found), default=None)
        assert (leg in got) == (want is not None)
        if want is not None:
            check_way(got[leg], seeds, goals, metrics[metric], want)


def test_unreachable_legs_are_refused_before_any_search(spark):
    """Two lattices apart: entries and goals of a leg between them are dropped by their components."""
    spot, rows = grid(5, 2, keep=1)
    far = {f"far{n}": (lat + 1, lng) for n, (lat, lng) in spot.items()}
    rows += [(e[0] + 1000, e[1], f"far{e[2]}", f"far{e[3]}", e[4]) for e in rows]
    made = overlay.Overlay(*tables(spark, spot | far | {"alone": (50.0, 18.0)}, {"x": rows}), 6)
    entries = spark.createDataFrame([("over", "x", "0,0", 0.0), ("apart", "x", "0,0", 0.0), ("mixed", "x", "0,0", 0.0), ("mixed", "x", "far1,1", 9.0), ("still", "x", "alone", 1.0)], ENDS)
    goals = spark.createDataFrame([("over", "x", "4,4", 0.0), ("apart", "x", "far4,4", 0.0), ("mixed", "x", "far2,2", 0.0), ("still", "x", "0,1", 1.0)], ENDS)
    left = [sorted((r.leg_id, r.node) for r in rows.collect()) for rows in made.servable(entries, goals)]
    assert left == [[("mixed", "far1,1"), ("over", "0,0")], [("mixed", "far2,2"), ("over", "4,4")]]
    assert sorted(r.leg_id for r in made.cheapest(entries, goals).collect()) == ["mixed", "over"]


def test_cells_hold_few_nodes_and_are_as_large_as_they_can_be(spark):
    nodes = spark.createDataFrame([(f"n{i},{j}", 54.4 + i * 1e-5, 18.4 + j * 1e-5) for i in range(60) for j in range(60)] + [("off", 10.0, 10.0)], NODES)
    made = overlay.cells(nodes, 200)
    sizes = {r.cell: r["count"] for r in made.groupBy("cell").count().collect()}
    assert made.count() == 3601 and max(sizes.values()) <= 200 and len(sizes) < 120


def test_components_of_chains_and_rings(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.id: r.component for r in component_labels(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200, 202: 200, 300: 300}


def test_a_hundred_thousand_edges(spark):
    """160 by 160 nodes; the overlay is far smaller than the network, and a way across it costs what a plain search says."""
    spot, rows = grid(160, 3, keep=1)
    assert len(rows) > 100_000
    made = overlay.Overlay(*tables(spark, spot, {"x": rows}))
    assert made.cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= overlay.CELL_NODES
    entries = spark.createDataFrame([("across", "x", "0,0", 0.0), ("near", "x", "80,80", 0.0)], ENDS)
    goals = spark.createDataFrame([("across", "x", "159,159", 0.0), ("near", "x", "83,78", 0.0)], ENDS)
    got = {r.leg_id: r for r in made.cheapest(entries, goals).collect()}
    links = links_of(rows)
    for leg, a, b in (("across", "0,0", "159,159"), ("near", "80,80", "83,78")):
        check_way(got[leg], {a: 0.0}, {b: 0.0}, rows, overlay.settled(links, [(0.0, a)], {b})[b][0])
