"""Whole routes on a small lattice of ways, against rules of their own and a plain search over everything."""

import copy
import heapq
import math

import pytest
from pyspark.sql import functions as F

from crestline.functions import geo
from crestline.operators import itineraries as I

NORTH, WEST, LAT, LNG = 54.47, 18.48, 0.00018, 0.0003  # cells of about 20 m
PLACE = (NORTH, WEST, LAT, LNG)
ROWS = COLUMNS = 41


def at(r: float, c: float) -> dict:
    return {"lat": NORTH - r * LAT, "lng": WEST + c * LNG}


def lattice():
    """Paths along rows 10 and 30 and columns 10, 20 and 30, a street along row 20, and a wall along column 5 with a gate at row 8."""
    lines = [("path", "path", [(10, c) for c in range(10, 31, 5)]), ("path", "path", [(30, c) for c in range(10, 31, 5)]), ("road", "residential", [(20, c) for c in range(0, 41, 5)])]
    lines += [("path", "path", [(r, c) for r in range(10, 31, 5)]) for c in (10, 20, 30)]
    return lines, [((r, 5), (r + 4, 5)) for r in range(0, 20, 4)], [(8, 5)]


@pytest.fixture(scope="module")
def ground(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield small_ground(spark)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def small_ground(spark):
    lines, walls, gates = lattice()
    ways = [(i, cat, hw, "gravel" if i % 2 else None, None, None, None, None, "marked" if hw == "path" and i == 4 else None, None, None, f"Way {i}") for i, (cat, hw, _) in enumerate(lines)]
    points = [(i, k + 1, at(*p)["lat"], at(*p)["lng"]) for i, (_, _, line) in enumerate(lines) for k, p in enumerate(line)]
    hops = [(i, k + 1, *at(*a).values(), *at(*b).values(), len(line)) for i, (_, _, line) in enumerate(lines) for k, (a, b) in enumerate(zip(line[:-1], line[1:], strict=True))]
    table = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(2)
    return I.Ground(
        table([(r, c, float(r + (c % 7) / 10)) for r in range(ROWS) for c in range(COLUMNS)], "r long, c long, z double"), PLACE,
        table(hops, "way_id long, pos int, a_lat double, a_lng double, b_lat double, b_lng double, vertices_in_way int"), table(points, "way_id long, pos int, lat double, lng double"),
        table(ways, "way_id long, category string, highway string, surface string, tracktype string, foot string, access string, sidewalk string, crossing string, bridge string, layer string, name string"),
        table([(i, *at(*a).values(), *at(*b).values()) for i, (a, b) in enumerate(walls)], "barrier_id long, a_lat double, a_lng double, b_lat double, b_lng double"), table([(i, *at(*p).values()) for i, p in enumerate(gates)], "opening_id long, lat double, lng double"),
    )


SCHEMA = "request_id long, mode string, points array<struct<lat: double, lng: double>>, alternatives int, profile string, max_grade_percent double, off_trail_aversion double, max_off_trail_meters double, allow_crossing boolean, allow_street boolean, avoid_water boolean"


def asked(spark, *rows):
    made = [(i, mode, [at(*p) for p in points], 1, "hiker", 45.0, 2.0, 150.0, True, False, False) for i, (mode, points) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture(scope="module")
def planned(spark, ground):
    requests = asked(spark, ("destination", [(11, 12), (29, 28)]), ("nearest", [(13, 13)]), ("design", [(11, 12), (28, 11), (12, 29)]), ("destination", [(11, 12), (0, 40)]), ("nearest", [(8, 4)]), ("destination", [(11, 12), (11, 12.01)]))
    rows = I.plan(requests, ground).collect()
    return requests, {r.request_id: r for r in rows}


def meters(p, q):
    k = math.cos(math.radians((p["lat"] + q["lat"]) / 2))
    return math.hypot((p["lat"] - q["lat"]) * 111_132, (p["lng"] - q["lng"]) * 111_132 * k)


def test_routes_join_their_points(planned):
    _, found = planned
    assert sorted(found) == [0, 1, 2, 4, 5]  # the target of 3 is too far from every path
    for k, points in ((0, [(11, 12), (29, 28)]), (2, [(11, 12), (28, 11), (12, 29)])):
        walked = [p.asDict() for p in found[k].points]
        assert walked[0] == pytest.approx(at(*points[0])) and walked[-1] == pytest.approx(at(*points[-1]))
        assert all(min(meters(at(*p), q) for q in walked) < 1 for p in points)
        assert sum(meters(p, q) for p, q in zip(walked[:-1], walked[1:], strict=True)) == pytest.approx(found[k].distance_m, rel=1e-3)
        assert found[k].mapped_m > 0.5 * found[k].distance_m and found[k].off_trail_m <= 150 * 2 * (len(points) - 1)
        assert found[k].surfaces[0].meters == max(s.meters for s in found[k].surfaces) and sum(s.meters for s in found[k].surfaces) == pytest.approx(found[k].distance_m)
        assert "Way" in found[k].way_names and 0.3 <= found[k].confidence <= 0.96


def test_nearest_path_ends_on_one(planned):
    _, found = planned
    end = found[1].points[-1].asDict()
    lines, _, _ = lattice()
    assert min(meters(end, at(*p)) for cat, _, line in lines if cat == "path" for p in line) < 0.2
    assert found[1].mapped_m == 0 and found[1].longest_off_trail_m == pytest.approx(found[1].off_trail_m)


def test_walls_are_passed_at_gates_only(planned):
    """Request 4 starts behind the wall; where its line meets column 5, the gate is within 12 m."""
    _, found = planned
    walked = [(p.lat, p.lng) for p in found[4].points]
    wall = WEST + 5 * LNG
    met = [a[0] + (b[0] - a[0]) * (wall - a[1]) / (b[1] - a[1]) for a, b in zip(walked[:-1], walked[1:], strict=True) if (a[1] - wall) * (b[1] - wall) <= 1e-15 and abs(a[1] - b[1]) > 1e-9]
    assert met and all(meters({"lat": lat, "lng": wall}, at(8, 5)) <= 12 for lat in met)


def test_views_tell_every_request(planned, spark):
    requests, found = planned
    routes = spark.createDataFrame([(r.request_id, r.flavor_index, r.flavor, r.distance_m, r.mapped_m, r.off_trail_m, r.longest_off_trail_m, r.water_m) for r in found.values()], "request_id long, flavor_index int, flavor string, distance_m double, mapped_m double, off_trail_m double, longest_off_trail_m double, water_m double")
    box = geo.Box(*map(F.lit, (NORTH, NORTH - 40 * LAT, WEST + 39.5 * LNG, WEST)))
    told = {r.request_id: r for r in I.views(requests, routes, box).collect()}
    assert {k: v.status for k, v in told.items()} == {k: "blocked" if k == 3 else "ready" for k in range(6)}
    assert told[3].title == "No feasible route" and told[3].warning.startswith("1 point sits") and told[0].warning is None
    assert told[1].title == "Nearest mapped path" and told[2].title == "Route through waypoints: 1" and len(told[0].notes) == 2


def check_connectors(good, lines):
    """Each connector runs from its real end without a gap, and within the budget."""
    rows = lines.orderBy("end", "node", "k").collect()
    by = {}
    for r in rows:
        by.setdefault((r.end, r.node), []).append(r)
    assert {(r.end, r.node) for r in good.collect()} == set(by) and by
    for (end, _), parts in by.items():
        assert sum(p.distance_m for p in parts) <= 150
        tip = parts[0] if end == "start" else parts[-1]
        own = (tip.a_lat, tip.a_lng) if end == "start" else (tip.b_lat, tip.b_lng)
        assert own == pytest.approx(tuple(at(*((11, 12) if end == "start" else (29, 28))).values()))
        assert all((p.b_lat, p.b_lng) == pytest.approx((q.a_lat, q.a_lng)) for p, q in zip(parts[:-1], parts[1:], strict=True))


def test_ways_over_small_cells_equal_a_search_of_everything(spark, ground):
    """Costs of ways over the overlay equal Dijkstra's over all edges, from the same connectors."""
    requests = asked(spark, ("destination", [(11, 12), (29, 28)]), ("nearest", [(13, 13)]), ("destination", [(28, 11), (12, 29)]))
    legs = I.legs(requests)
    ends = I.ends_of(legs, ground)
    good, lines = I.connected(legs, ends, ground)
    check_connectors(good.where("leg_id = '0|0|0'"), lines.where("leg_id = '0|0|0'"))
    goals = good.where("end = 'finish'").drop("end").unionByName(ends.where("end = 'goal'").select("leg_id", "node", F.lit(0.0).alias("cost")))
    starts = good.where("end = 'start'").drop("end")
    got = {r.leg_id: r for r in I.best_ways(legs, starts, goals, ground, 3).collect()}
    each = ground.edges.withColumn("profile", F.lit("hiker"))
    key = ["way_id", "pos", "a", "b"]
    edges = each.join(ground.measures(each, key, F.col("surface_class")), key).where("NOT is_street OR walkway").select("a", "b", F.greatest(F.lit(0.001), F.col("minutes") * (1 + F.col("water_risk") * 1.2)).alias("cost")).collect()
    assert len(got) == 3
    for leg, row in got.items():
        seeds = {r.node: r.cost for r in starts.where(F.col("leg_id") == leg).collect()}
        ends_at = {r.node: r.cost for r in goals.where(F.col("leg_id") == leg).collect()}
        cost, heap = dict(seeds), [(c, n) for n, c in seeds.items()]
        heapq.heapify(heap)
        while heap:
            c, n = heapq.heappop(heap)
            for e in edges:
                if e.a == n and c + e.cost < cost.get(e.b, 1e9):
                    cost[e.b] = c + e.cost
                    heapq.heappush(heap, (c + e.cost, e.b))
        assert row.cost == pytest.approx(min(cost[n] + ends_at[n] for n in ends_at if n in cost))
        assert [e.a for e in row.edges[1:]] == [e.b for e in row.edges[:-1]]


RULES = {  # profile, max_grade_percent, aversion, budget, allow_crossing, allow_street, avoid_water
    "free": ("hiker", 45.0, 2.0, 150.0, True, True, False),
    "dry": ("hiker", 45.0, 2.0, 150.0, True, True, True),
    "no crossing": ("hiker", 45.0, 2.0, 150.0, False, True, False),
    "no street": ("hiker", 45.0, 2.0, 150.0, True, False, False),
    "level": ("mtb", 4.0, 1.0, 150.0, True, True, False),
    "short": ("runner", 45.0, 3.0, 60.0, True, True, False),
    "nothing": ("hiker", 45.0, 2.0, 1.0, True, True, False),
}


def plain_search(hops, home, profile, grade, aversion, budget, crossing, street, dry, backward):
    """Labels settle in order of cost; a hop is walked if it is allowed and the length of the label so far leaves room for it."""
    by = {}
    for h in hops:
        allowed = h.profile == profile and h.max_grade <= max(0.02, grade / 100) + 0.005 and not (dry and h.water_risk > 0.55) and (crossing or not h.crosses) and (street or not h.carriageway)
        if allowed:
            a, b = (h.from_r, h.from_c), (h.to_r, h.to_c)
            step = h.minutes * aversion * (1 + min(0.6, max(0.0, h.side_slope / 60))) * (1 + h.water_risk * (8.0 if dry else 1.5))
            by.setdefault(b if backward else a, []).append((a if backward else b, step, h.distance_m))
    label, done = {home: (0.0, 0.0)}, {}
    while label:
        cell = min(label, key=lambda k: (label[k][0], k))
        done[cell] = cost, length = label.pop(cell)
        for other, step, meters in by.get(cell, ()):
            if other not in done and length + meters <= budget and (other not in label or cost + step < label[other][0]):
                label[other] = (cost + step, length + meters)
    return done


def test_reach_off_the_network_equals_a_plain_search_under_each_rule(spark, ground, monkeypatch):
    monkeypatch.setattr(I, "HOP_TILE", 5)
    wet = copy.copy(ground)
    wet.risk = spark.createDataFrame([(r, c, 0.8 if 13 <= r <= 14 and 9 <= c <= 21 else 0.2 if c > 16 else 0.0) for r in range(ROWS) for c in range(COLUMNS)], "r long, c long, risk double")
    wet.slopes = spark.createDataFrame([(r, c, float((r * 5 + c * 3) % 70)) for r in range(ROWS) for c in range(COLUMNS)], "r long, c long, slope double")
    rows = [(name, end, *at(17.2, 14.8).values(), *rule) for name, rule in RULES.items() for end in ("start", "finish")] + [("outside", "start", *at(-300, 5).values(), *RULES["free"])]
    sources = spark.createDataFrame(rows, "leg_id string, end string, lat double, lng double, profile string, max_grade_percent double, aversion double, budget double, allow_crossing boolean, allow_street boolean, avoid_water boolean")
    got = {}
    for x in I.off_trail_reach(sources, wet).collect():
        got.setdefault((x.leg_id, x.end), {})[x.r, x.c] = x
    every = spark.range(ROWS // 5 + 1).select(F.col("id").alias("tile_r")).crossJoin(spark.range(COLUMNS // 5 + 1).select(F.col("id").alias("tile_c"))).crossJoin(spark.createDataFrame([("hiker",), ("runner",), ("mtb",)], "profile string"))
    part = lambda k, n: (F.shiftright(k, 32) if n == "r" else F.col(k).bitwiseAND(0xFFFFFFFF)).alias(f"{k}_{n}")
    hops = I.hop_tiles(every, wet).select("profile", F.inline("hops")).select("*", *(part(k, n) for k in ("from", "to") for n in "rc")).collect()
    assert len(hops) == 3 * len({(h.from_r, h.from_c, h.to_r, h.to_c) for h in hops}) and any(h.crosses for h in hops) and any(h.carriageway for h in hops)
    sizes = {}
    for name, rule in RULES.items():
        for end in ("start", "finish"):
            want, found = plain_search(hops, (17, 15), *rule, end == "finish"), got[name, end]
            assert set(found) == set(want)
            for cell, (cost, length) in want.items():
                x = found[cell]
                assert (x.cost, x.meters) == pytest.approx((cost, length))
                if cell == (17, 15):
                    assert x.before_r is None and x.before_c is None
                else:
                    before = found[x.before_r, x.before_c]
                    assert before.cost < x.cost and before.meters < x.meters <= rule[3]
            sizes[name, end] = len(found)
    assert ("outside", "start") not in got or list(got["outside", "start"]) == [(-300, 5)]
    assert all(sizes[name, "start"] < sizes["free", "start"] for name in ("dry", "no crossing", "level", "short")) and sizes["nothing", "start"] == 1


def test_windows_hold_the_budget_at_any_latitude(spark):
    """A degree of longitude is short in the north: the columns of a window are counted there, not at 60 degrees."""
    ground = I.Ground.__new__(I.Ground)
    ground.place = (71.0, 25.0, 2.7e-4, 2.7e-4)
    for lat in (0.1, 54.4, 70.9, -80.0):
        row = I.home_cells(spark.createDataFrame([(lat, 25.1, 500.0)], "lat double, lng double, budget double"), ground).first()
        assert row.spread_r * 2.7e-4 * 111_132 >= 500 and row.spread_c * 2.7e-4 * 111_132 * math.cos(math.radians(lat)) >= 500


def test_requests_drop_what_their_mode_has_not(spark):
    rows = [(i, m, at(1, 1), at(2, 2), [at(3, 3)], i % 2 == 0) for i, m in enumerate(("nearest", "destination", "design"))]
    t = spark.createDataFrame(rows, "request_id long, mode string, start struct<lat: double, lng: double>, target struct<lat: double, lng: double>, waypoints array<struct<lat: double, lng: double>>, show_alternatives boolean")
    made = I.routing_requests(t).orderBy("request_id").collect()
    assert [len(r.points) for r in made] == [1, 2, 3] and [r.alternatives for r in made] == [3, 1, 3]
    back = I.swapped(t).where("request_id = 2").first()
    assert back.start.asDict() == at(2, 2) and back.target.asDict() == at(1, 1)


SOURCE = "leg_id string, end string, lat double, lng double, profile string, max_grade_percent double, aversion double, budget double, allow_crossing boolean, allow_street boolean, avoid_water boolean"


def test_reach_makes_neither_tiles_off_the_raster_nor_the_network(spark, ground, monkeypatch):
    monkeypatch.setattr(I, "HOP_TILE", 5)
    plain = I.Ground(ground.dem, ground.place, ground.segments, ground.vertices, ground.ways, ground.barriers, ground.openings)
    sources = spark.createDataFrame([(name, "start", *at(*spot).values(), *RULES["free"]) for name, spot in (("inside", (17.2, 14.8)), ("corner", (0, 40)), ("outside", (-300, 5)))], SOURCE)
    tiles = I.source_tiles(sources, plain).collect()
    assert {t.leg_id for t in tiles} == {"inside", "corner"} and all(0 <= t.tile_r <= 8 and 0 <= t.tile_c <= 8 for t in tiles)
    reached = {r.leg_id: r.n for r in I.off_trail_reach(sources, plain).groupBy("leg_id").agg(F.count("*").alias("n")).collect()}
    assert reached["inside"] > 1 and reached["corner"] > 1 and "outside" not in reached
    assert not {"nodes", "edges", "roads", "crossings"} & set(vars(plain))


def test_ground_within_a_box_keeps_what_bears_on_it(spark, ground):
    """Hops in a box are held to the same walls, gates, streets and crossings by the part of the ground around it."""
    low, high = at(20, 0), at(8, 8)
    part = ground.within(geo.fixed_point(*low.values()), geo.fixed_point(*high.values()))
    assert 0 < part.segments.count() < ground.segments.count() and part.ways.count() < ground.ways.count()
    hops = [(i, *at(8 + i % 12, c).values(), *at(8 + (i * 5) % 13, c + 1 + i % 2).values()) for i, c in ((k, k % 7) for k in range(84))]
    rows = spark.createDataFrame(hops, "i int, a_lat double, a_lng double, b_lat double, b_lng double")
    whole, got = (sorted(g.open_ground(rows, ["i"]).select("i", "crosses", "carriageway", "distance_m", "max_grade").collect()) for g in (ground, part))
    assert got == whole and 0 < len(got) < len(hops) and any(r.crosses for r in got)


def test_only_the_components_of_its_legs_are_priced(spark, ground, monkeypatch):
    """An island of the network, where a leg has an entry but no goal, is not measured."""
    island = lambda c: F.concat(F.lit("island "), c).alias(c)
    more = copy.copy(ground)
    vars(more).pop("components", None)
    more.edges = ground.edges.unionByName(ground.edges.where("way_id = 0").withColumns({"way_id": F.lit(99).cast("long"), "a": island("a"), "b": island("b")}))
    more.nodes = ground.nodes.unionByName(ground.nodes.withColumn("node", island("node")))
    priced, measured = [], I.Ground.measures
    monkeypatch.setattr(I.Ground, "measures", lambda self, rows, key, surface: (priced.extend(r.way_id for r in rows.select("way_id").distinct().collect()), measured(self, rows, key, surface))[1])
    legs = I.legs(asked(spark, ("destination", [(11, 12), (29, 28)])))
    first, last = (ground.edges.where(f"way_id = {w}").agg(F.min("a")).first()[0] for w in (0, 1))
    ends = lambda *nodes: spark.createDataFrame([("0|0|0", n, 1.0) for n in nodes], "leg_id string, node string, cost double")
    got = I.best_ways(legs, ends(first, f"island {first}"), ends(last), more, 3).collect()
    assert len(got) == 1 and got[0].entry == first and got[0].goal == last
    assert priced and 99 not in priced


def listed(frame, *columns):
    return sorted(str(tuple(r)) for r in frame.select(*(columns or sorted(frame.columns))).collect())


def test_only_the_ways_that_legs_can_use_become_edges(spark, ground):
    """A search does not make the whole network's edges, and those of some ways are the network's."""
    plain = ground.underived()
    legs = I.legs(asked(spark, ("destination", [(11, 12), (29, 28)])))
    first, last = (ground.edges.where(f"way_id = {w}").agg(F.min("a")).first()[0] for w in (0, 1))
    ends = lambda node: spark.createDataFrame([("0|0|0", node, 1.0)], "leg_id string, node string, cost double")
    got = I.best_ways(legs, ends(first), ends(last), plain, 3).collect()
    assert len(got) == 1 and got[0].edges and "edges" not in vars(plain)
    some = listed(plain.edges_among(spark.createDataFrame([(0,), (4,)], "way_id long")))
    assert some == listed(ground.edges.where("way_id IN (0, 4)")) and 0 < len(some) < ground.edges.count()


def test_stored_ways_give_the_same_lines_and_nodes(spark, ground):
    """A way of one vertex has a node and no line; a closed way has neither."""
    plain = ground.underived()
    lone, closed = (ground.ways.where("way_id = 0").withColumns({"way_id": F.lit(w).cast("long"), "access": F.lit(access).cast("string")}) for w, access in ((6, None), (7, "private")))
    plain.ways = ground.ways.unionByName(lone).unionByName(closed)
    plain.vertices = ground.vertices.unionByName(spark.createDataFrame([(6, 1, *at(3, 3).values()), (7, 1, *at(4, 4).values())], "way_id long, pos int, lat double, lng double"))
    stored = plain.stored
    assert listed(stored.lines) == listed(plain.lines) and listed(stored.met) == listed(plain.met)
    nodes = lambda g: listed(g.nodes.withColumn("ways", F.array_sort("ways")))
    assert nodes(stored) == nodes(plain) and len(nodes(stored)) == ground.nodes.count() + 1
    assert listed(stored.segments) == listed(ground.segments) and not {"nodes", "lines"} & set(vars(stored.underived()))
