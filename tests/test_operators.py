import base64
import datetime
import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import geo
from crestline.operators import contours, network, raster, search
from crestline.operators.checkpoints import ensure_checkpoint_dir
from crestline.sources import elevation, ways
from crestline.streaming.requests import debounced, latest_by_session


def grid(spark, z):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(z) for c, v in enumerate(row)], "r long, c long, z double")


def test_ramp_has_its_slope_everywhere_inside(spark):
    z = [[r * 5.0] * 6 for r in range(6)]
    rows = raster.horn_slope(grid(spark, z), 10.0, 10.0).where("r BETWEEN 1 AND 4").collect()
    assert all(math.isclose(x.slope, math.degrees(math.atan(0.5)), rel_tol=1e-12) for x in rows)


def test_bilinear_hits_corners_middles_and_clamps(spark):
    dem = grid(spark, [[0, 10], [20, 30]])
    points = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.5, 0.5), (3, 9.0, -9.0), (4, 0.0, 1.0)], "k int, lat double, lng double")
    got = {r.k: r.z for r in raster.sample(points, dem, ["k"], 1.0, 0.0, 1.0, 1.0).collect()}
    assert got == {1: 0.0, 2: 15.0, 3: 0.0, 4: 30.0}


def test_stencils_equal_numpy(spark):
    z = np.random.default_rng(3).normal(size=(7, 5)).round(3)
    p = np.pad(z, 1, mode="edge")
    around = [p[a : a + 7, b : b + 5] for a in range(3) for b in range(3) if (a, b) != (1, 1)]
    want = sum(abs(n - z) for n in around) / 8
    got = {(r.r, r.c): r.ruggedness for r in raster.ruggedness(grid(spark, z)).collect()}
    assert all(math.isclose(got[r, c], want[r, c], abs_tol=1e-12) for r in range(7) for c in range(5))
    h = (p[1:-1, :-2] + 2 * z + p[1:-1, 2:]) / 4
    q = np.pad(h, 1, mode="edge")
    smooth = (q[:-2, 1:-1] + 2 * h + q[2:, 1:-1]) / 4
    got = {(r.r, r.c): r.z for r in raster.smooth(grid(spark, z)).collect()}
    assert all(math.isclose(got[r, c], smooth[r, c], abs_tol=1e-12) for r in range(7) for c in range(5))


def test_contours_of_a_ramp_are_straight_lines(spark):
    lines = contours.contour_lines(grid(spark, [[r * 10.0 + 5] * 5 for r in range(5)]), 10.0, 1.0, 0.0, 0.1, 0.1, minimum=2).orderBy("elevation").collect()
    assert [x.elevation for x in lines] == [10.0, 20.0, 30.0, 40.0]
    assert all(len(x.points) == 2 for x in lines)
    assert not any(x.is_index for x in lines)
    assert contours.contour_lines(grid(spark, [[1, 2], [3, 4]]), 0.0, 1.0, 0.0, 0.1, 0.1).count() == 0


def test_trails_use_every_link_once():
    ends = [("b", "c"), ("d", "c"), ("x", "y"), ("a", "b"), ("z", "z")]
    assert contours.trails(ends) == [[(3, True), (0, True), (1, False)], [(2, True)], [(4, True)]]
    crossing = [("m", "a"), ("b", "m"), ("m", "c"), ("d", "m")]  # the least free link goes on where four meet
    assert contours.trails(crossing) == [[(1, True), (0, True)], [(3, True), (2, True)]]
    assert contours.trails(crossing, [(0, 0), (9, 9), (1, 1), (2, 2)]) == [[(2, False), (0, True)], [(1, True), (3, False)]]


def test_labels_settle_as_by_brute_force():
    hops = [(0, 1, 1.0, 10.0), (1, 2, 1.0, 10.0), (0, 2, 5.0, 5.0), (2, 3, 1.0, 10.0)]
    cost, length, previous = search.settle_labels(hops, 0, 25.0)
    assert cost == {0: 0.0, 1: 1.0, 2: 2.0} and length[2] == 20.0 and previous[2] == 1


def test_what_is_dealt_to_buckets_is_not_broadcast(spark, tmp_path):
    """An estimate does not count the rows of an explode: 15,000 requests at 361 buckets each were sent whole to every executor."""
    spark.createDataFrame([(k, 54.0 + k / 1e4, 18.0) for k in range(50)], "request_id long, lat double, lng double").write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    spot = geo.Point(F.col("lat"), F.col("lng"))
    dealt = network.in_buckets(points, spot, spot, 0.002)
    joined = dealt.join(points.select(network.bucket_key(network.bucket_row(spot.lat), network.bucket_row(spot.lng)).alias("bucket"), F.col("request_id").alias("other")), "bucket")
    assert joined.count() >= 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_segments_beyond_the_raster_are_dealt_to_copies_of_its_corner(spark):
    """They all take their heights from one square, which one task read for all of them."""
    dem = grid(spark, [[r * 1.0 + c for c in range(9)] for r in range(9)])
    rows = [(k, 1, 54.01 + k * 1e-6, 19.0, 54.01 + k * 1e-6, 19.0003) for k in range(200)] + [(900, 1, 54.0, 18.0, 54.0 - 2.7e-4, 18.0), (901, 1, 54.0, 18.0, 54.0, 18.0)]
    segments = spark.createDataFrame(rows, "way_id long, pos int, a_lat double, a_lng double, b_lat double, b_lng double")
    found = network.segment_profile(segments, ["way_id", "pos"], dem, (54.0, 18.0, 2.7e-4, 4.6e-4))
    got = {r.way_id: r for r in found.collect()}
    assert len(got) == 202 and all(r.change_m == 0 and r.distance_m > 15 and r.max_grade == 0 for k, r in got.items() if k < 900)
    assert math.isclose(got[900].change_m, 1.0, abs_tol=1e-9) and tuple(got[901])[2:] == (0.0,) * 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in line and "_copy" in line for line in plan.splitlines())


def test_barriers_are_not_broadcast_and_openings_count_over_bucket_edges(spark, tmp_path):
    """Barriers dealt to buckets were sent whole to every task; segment k crosses barrier k, whose opening lies k * 2 m beside the crossing."""
    rng = random.Random(5)
    at = [(54.0 + k * 0.01 + rng.choice([0.0, 0.00005, rng.random() / 100]), 18.0 + rng.choice([0.0, 0.00005, rng.random() / 100])) for k in range(12)]
    walked = [(k, 1, lat, lng - 1e-4, lat, lng + 1e-4) for k, (lat, lng) in enumerate(at)]
    closed = [(k, lat - 1e-4, lng, lat + 1e-4, lng) for k, (lat, lng) in enumerate(at)]
    opened = [(lat + rng.choice([-1, 1]) * k * 2.01 / geo.METERS_PER_DEGREE_LATITUDE, lng) for k, (lat, lng) in enumerate(at)]
    ends = "a_lat double, a_lng double, b_lat double, b_lng double"
    frames = []
    for name, rows, schema in (("s", walked, f"way_id long, pos int, {ends}"), ("b", closed, f"barrier_id long, {ends}"), ("o", opened, "lat double, lng double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    found = network.barrier_violations(*frames)
    assert sorted(r.way_id for r in found.collect()) == [k for k in range(12) if k * 2.01 > network.OPENING_METERS]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("many", [0, 1, 60, 400, 3000])
def test_nearest_nodes_equal_sql_at_any_density(spark, many):
    """From networks that the first ring never fills to ones that it always does, also below zero and at edges of buckets."""
    import duckdb

    from crestline.plans.network import nearest

    rng = random.Random(many)
    coordinate = lambda: rng.choice([rng.uniform(-0.012, 0.012), rng.randint(-12, 12) / 1000])
    nodes = [(round(lat * 1e6), round(lng * 1e6), lat, lng) for lat, lng in {(coordinate(), coordinate()) for _ in range(many)}]
    nodes = list({n[:2]: n for n in nodes}.values())
    asked = [(k, coordinate(), coordinate()) for k in range(60)] + [(99, 5.0, 5.0), (100, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE nodes (lat_e6 BIGINT, lng_e6 BIGINT, lat DOUBLE, lng DOUBLE); CREATE TABLE asked (request_id BIGINT, lat DOUBLE, lng DOUBLE)")
    for table, rows in (("nodes", nodes), ("asked", asked)):
        if rows:
            con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    want = con.execute(nearest("asked", 5)).fetchall()
    got = network.nearest_nodes(spark.createDataFrame(asked, "request_id long, lat double, lng double"), spark.createDataFrame(nodes, "lat_e6 long, lng_e6 long, lat double, lng double"), 5)
    assert sorted(map(tuple, got.select("request_id", "rank", "lat_e6", "lng_e6", F.round("meters", 4)).collect())) == sorted(want)


def test_reach_writes_its_rounds_as_tables(spark, monkeypatch):
    """A checkpoint carries over what the optimizer has derived, which grows with the rounds on the driver."""
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *_: pytest.fail("a checkpoint in the loop"))
    links = spark.createDataFrame([(str(k), str(k + 1), 1.0) for k in range(4)], "node string, other string, cost double")
    got = network.reach(spark.createDataFrame([("0", "0")], "source string, node string"), links, 2.5)
    assert sorted(map(tuple, got.collect())) == [("0", "0", 0.0), ("0", "1", 1.0), ("0", "2", 2.0)]


def test_reach_equals_brute_force(spark):
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(5)
    links = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.uniform(0.5, 3, 40).round(2), strict=True) if a != b]
    best = {0: 0.0}
    for _ in range(20):
        for a, b, w in links:
            if a in best and best[a] + w <= 6 and best[a] + w < best.get(b, 1e9):
                best[b] = best[a] + w
    df = spark.createDataFrame([(str(a), str(b), w) for a, b, w in links], "node string, other string, cost double")
    got = {int(r.node): r.cost for r in network.reach(spark.createDataFrame([("0", "0")], "source string, node string"), df, 6.0).collect()}
    assert got.keys() == best.keys() and all(math.isclose(got[k], best[k]) for k in best)


def test_overpass_features_and_openings(spark, tmp_path):
    square = [{"lat": 54.0, "lon": 18.0}, {"lat": 54.1, "lon": 18.1}]
    elements = [
        {"type": "way", "id": 1, "tags": {"highway": "path", "sidewalk:left": "yes"}, "geometry": square},
        {"type": "way", "id": 2, "tags": {"barrier": "fence"}, "geometry": square},
        {"type": "way", "id": 3, "tags": {"barrier": "fence", "foot": "Yes "}, "geometry": square},
        {"type": "way", "id": 4, "tags": {"highway": "path"}, "geometry": square[:1]},
        {"type": "node", "id": 5, "lat": 54.0, "lon": 18.0, "tags": {"barrier": "gate"}},
        {"type": "node", "id": 6, "lat": 54.0, "lon": 18.0, "tags": {"barrier": "gate", "locked": "yes"}},
    ]
    (tmp_path / "r.json").write_text(json.dumps({"elements": elements}))
    raw = ways.read_overpass(spark, str(tmp_path))
    got = {r.id: r for r in ways.features(raw).collect()}
    assert set(got) == {"way/1", "way/2", "way/3"} and got["way/1"].sidewalk_left == "yes"
    assert got["way/2"].blocks_on_foot and not got["way/3"].blocks_on_foot and got["way/1"].blocks_on_foot is None
    assert ways.openings(raw).count() == 1 and ways.in_query(raw, 53.9, 17.9, 54.05, 18.05).count() == 6
    ways.write_snapshot(ways.features(raw), str(tmp_path / "s"))
    assert ways.read_snapshot(spark, str(tmp_path / "s")).count() == 3


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    rows = {(r.r, r.c): r for r in elevation.read_ascii_grid(spark, str(tmp_path / "a.asc")).collect()}
    assert rows[1, 1].z == -9999.0 and rows[0, 2].z == 3.0 and rows[0, 0].west == 11.0 and rows[0, 0].nodata == -9999.0
    (tmp_path / "b.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\n1 2 3\n")
    with pytest.raises(Exception, match="wrong number of values"):
        elevation.read_ascii_grid(spark, str(tmp_path / "b.asc")).collect()


def test_packed_heights_round_trip(spark):
    data = base64.b64encode(np.array([15, -20, 30, 45], "<i2").tobytes()).decode()
    cells = elevation.from_packed(spark.createDataFrame([("k", 2, data)], "key string, columns int, data_base64 string"))
    assert sorted((r.r, r.c, r.z) for r in cells.collect()) == [(0, 0, 1.5), (0, 1, -2.0), (1, 0, 3.0), (1, 1, 4.5)]
    assert elevation.to_packed(cells, 2).first()["data_base64"] == data


def test_png_filters():
    pixels = np.random.default_rng(1).integers(0, 256, (4, 3, 3)).astype(np.uint8)
    flat, raw, above = pixels.reshape(4, 9).astype(int), b"", np.zeros(9, int)
    for row, kind in zip(range(4), (0, 1, 2, 3), strict=True):
        left = np.concatenate([[0, 0, 0], flat[row][:-3]])
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2}[kind]
        raw += bytes([kind]) + ((flat[row] - guess) % 256).astype(np.uint8).tobytes()
        above = flat[row]
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + b"0000"
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw))
    assert (elevation.png_pixels(png) == pixels).all()


@pytest.mark.parametrize("seed", range(4))
def test_filled_gaps_equal_a_search_of_every_ring(spark, seed):
    r = random.Random(seed)
    rows, columns, share = ((12, 17, 0.5), (30, 3, 0.9), (1, 40, 0.8), (25, 25, 0.97))[seed]
    height = {(y, x): None if r.random() < share else float(r.randrange(100)) for y in range(rows) for x in range(columns)}
    known = {k: z for k, z in height.items() if z is not None}
    want = {(y, x): z if z is not None else known[min(known, key=lambda k: (max(abs(k[0] - y), abs(k[1] - x)), *k))] if known else None for (y, x), z in height.items()}
    cells = spark.createDataFrame([(y, x, z) for (y, x), z in height.items()], "r long, c long, z double")
    assert {(x.r, x.c): x.z for x in elevation.fill_gaps(cells).collect()} == want


def test_ring_distances_of_long_rows():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 257):
        upright = np.where(r.random(n) < 0.9, np.inf, r.integers(0, 300, n))
        d = np.maximum(np.abs(np.arange(n)[:, None] - np.arange(n)), upright[None, :]).min(axis=1)
        assert elevation.ring_distances(upright).tolist() == d.tolist()


def test_gaps_take_the_nearest_ring(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (5, 5, None)], "r long, c long, z double")
    got = {(r.r, r.c): r.z for r in elevation.fill_gaps(cells).collect()}
    assert got[0, 1] == 1.0 and got[5, 5] == 1.0  # the first of its ring by row, then by column
    wide = spark.createDataFrame([(0, c, 7.0 if c == 40 else None) for c in range(41)], "r long, c long, z double")
    assert {r.z for r in elevation.fill_gaps(wide).collect()} == {7.0}
    assert elevation.fill_gaps(wide.where("c < 40")).where("z IS NOT NULL").count() == 0
    assert elevation.plan_tiles(spark, 0.0, 0.0, 2300.0, 1000.0).count() == 3


def test_latest_request_of_a_session(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:00", "x"), ("a", 3, "2024-01-01 00:00:02", "z"), ("b", 1, "2024-01-01 00:00:01", "q"), ("a", 2, "2024-01-01 00:00:01", "y")]
    df = spark.createDataFrame(rows, "session string, seq int, ts string, state string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = latest_by_session(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("latest").collect())) == [("a", 3, "z"), ("b", 1, "q")]


def test_debounced_requests_leave_the_state(spark, tmp_path):
    """Four batches an hour apart, append mode: runs come out once the watermark has passed, state falls, and late requests of a lower seq change nothing."""
    schema = "session string, seq int, ts timestamp, state string"

    def send(hour, rows):
        made = [(s, seq, datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(milliseconds=ms), state) for s, seq, ms, state in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = debounced(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("append").format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        many = send(1, [(f"s{k}", 1, 0, "a") for k in range(50)] + [("s0", 2, 100, "b"), ("s0", 3, 400, "c")])
        late = send(1, [("s0", 0, 120, "late")])
        few = send(2, [("s0", 4, 0, "d")])
        last = send(3, [("s1", 9, 0, "e")])
    finally:
        query.stop()
    assert many == 51 and late == 51 and few <= 2 and last <= 2
    got = {(r.session, r.seq, r.state) for r in spark.table("debounced").collect()}
    assert got == {(f"s{k}", 1, "a") for k in range(1, 50)} | {("s0", 2, "b"), ("s0", 3, "c"), ("s0", 4, "d")}
    rows = spark.createDataFrame([("x", k, datetime.datetime(2024, 1, 1, 0, 0, 0, k * 100_000), str(k)) for k in range(3)], schema)
    assert [(r.seq, r.state) for r in debounced(rows).collect()] == [(2, "2")]


@pytest.mark.parametrize(("rows", "columns", "steps", "tile", "stretch"), [(40, 8, None, 16, 12), (24, 14, 4, 5, 50_000), (12, 9, 2, 256, 50_000)])
def test_contours_equal_joining_segments_one_by_one(spark, monkeypatch, rows, columns, steps, tile, stretch):
    """For tiles and stretches of any size, on smooth ground and on heights that are often a level's own, where up to eight ends meet at a spot."""
    rng = np.random.default_rng(rows)
    z = [[10 * np.sin(r / 6) + 3 * np.cos(c / 2) + r / 10 if steps is None else rng.integers(0, steps * 5) * 5.0 / steps for c in range(columns)] for r in range(rows)]
    dem = grid(spark, z)

    def one_by_one():
        by_level = {}
        for s in sorted(raster.marching_squares(dem, 5.0).collect(), key=lambda s: (s.r, s.c, s.part)):
            by_level.setdefault(s.level, []).append(((54.0 - s.a_r * 0.001, 18.0 + s.a_c * 0.001), (54.0 - s.b_r * 0.001, 18.0 + s.b_c * 0.001)))
        for level, ends in by_level.items():
            for trail in contours.trails([tuple(tuple(round(x * 1e6) for x in p) for p in pair) for pair in ends]):
                line = np.array([ends[trail[0][0]][1 - trail[0][1]]] + [ends[k][forward] for k, forward in trail])
                if len(line) >= 5:
                    yield level, [tuple(p) for p in contours.simplify(line, 0.00035).round(9)]

    monkeypatch.setattr(contours, "TILE", tile)
    monkeypatch.setattr(contours, "STRETCH", stretch)
    found = contours.contour_lines(dem, 5.0, 54.0, 18.0, 0.001, 0.001, minimum=5).collect()
    whole = sorted(one_by_one())
    assert whole and sorted((r.elevation, [(round(p.lat, 9), round(p.lng, 9)) for p in r.points]) for r in found) == whole


def test_terrain_in_one_row_a_cell(spark):
    """Where the survey is as fine as the grid its slopes count; on a coarser one, cells that no sample is nearest to take the grid's own slope."""
    from crestline.operators import raster

    cells = [(r, c, float((r * 7 + c * 3) % 11)) for r in range(6) for c in range(6)]
    dem = spark.createDataFrame(cells, "r long, c long, z double")
    lines = spark.createDataFrame([(54.0, 18.0, 54.0, 18.0012)], "a_lat double, a_lng double, b_lat double, b_lng double")
    place = (54.0, 18.0, 0.0003, 0.0004)
    own = {(r.r, r.c): r.slope for r in raster.horn_slope(dem, 33.0, 26.0).collect()}
    same = raster.terrain(dem, place, (33.0, 26.0), place, 6, 6, (33.0, 26.0), lines).collect()
    assert len(same) == 36 and all((r.mean_slope, r.max_slope, r.z) == pytest.approx((own[r.r, r.c], own[r.r, r.c], (r.r * 7 + r.c * 3) % 11), abs=1e-6) for r in same)
    assert all(r.risk > 0.7 for r in same if r.r == 0 and r.c <= 3) and all(r.risk == 0 for r in same if r.r > 1)
    fine = raster.terrain(dem, place, (33.0, 26.0), (54.0, 18.0, 0.0001, 0.0004 / 3), 16, 16, (11.0, 9.0), lines)
    heights = fine.select("r", "c", "z")
    grid = {(r.r, r.c): r.slope for r in raster.horn_slope(heights, 11.0, 9.0).collect()}
    for r in fine.collect():
        want = own[r.r // 3, r.c // 3] if r.r % 3 == 0 and r.c % 3 == 0 else grid[r.r, r.c]
        assert (r.mean_slope, r.max_slope) == pytest.approx((want, want), abs=1e-6)


def test_heights_between_cells_by_brute_force(spark):
    """Squares of the raster join points near and across their borders; a missing cell leaves no height."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 37))
    cells = [(r, c, float(z[r, c])) for r in range(40) for c in range(37) if (r, c) != (5, 5)]
    dem = spark.createDataFrame(cells, "r long, c long, z double")
    asked = [(k, float(y), float(x)) for k, (y, x) in enumerate(zip(rng.uniform(0, 39, 400), rng.uniform(0, 36, 400)))] + [(400, 39.0, 36.0), (401, 16.0, 15.5), (402, 15.5, 16.0), (403, 5.5, 4.5), (404, 6.0, 6.0), (405, 4.0, 5.5)]
    points = spark.createDataFrame(asked, "k int, _y double, _x double").withColumns({"_rows": F.lit(40), "_columns": F.lit(37)})
    got = {r.k: r.z for r in raster.between_cells(points, dem).collect()}
    assert len(got) == len(asked)
    for k, y, x in asked:
        r, c = int(y), int(x)
        corners = [(r, c, (1 - x + c) * (1 - y + r)), (r, min(c + 1, 36), (x - c) * (1 - y + r)), (min(r + 1, 39), c, (1 - x + c) * (y - r)), (min(r + 1, 39), min(c + 1, 36), (x - c) * (y - r))]
        if any((i, j) == (5, 5) and w for i, j, w in corners):
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(sum(z[i, j] * w for i, j, w in corners), abs=1e-9)


def test_tiles_make_one_mosaic(spark):
    """Four tiles of four pixels: heights go on over their borders, are clamped outside, and a tile that is not there leaves none."""
    from crestline.operators import mosaics

    zoom, size = 3, 4
    box = {"north": 30.0, "south": -30.0, "west": -40.0, "east": 40.0}
    x0, x1, y0, y1 = mosaics.tile_range(box, zoom)
    assert (x0, x1, y0, y1) == (3, 4, 3, 4)
    cells = [(x, y, r, c, 128, x * size + c, 0) for x in (3, 4) for y in (3, 4) for r in range(size) for c in range(size)]
    tiles = spark.createDataFrame(cells, "x long, y long, r long, c long, red int, green int, blue int")
    points = spark.createDataFrame([(k, 1.0, lng) for k, lng in enumerate((-40.0, 0.0, 13.0, 80.0, 170.0))], "k int, lat double, lng double")
    got = {r.k: (r.lng, r.z) for r in mosaics.sample_tiles(points, tiles, box, zoom, size).collect()}
    for lng, z in got.values():
        assert z == pytest.approx(min(max((lng + 180) / 360 * 8 * size, 12), 19))
    partly = mosaics.sample_tiles(points, tiles.where("x = 3"), box, zoom, size)
    assert {r.k: r.z for r in partly.collect()}[0] is not None and partly.where("k > 0 AND z IS NOT NULL").count() == 0
    grid_ = mosaics.grid_from_tiles(tiles, box, zoom, 1e6, size)
    assert grid_.count() == 256 and grid_.where("z IS NULL").count() == 0  # no fewer than sixteen rows and columns
    assert [tuple(r) for r in mosaics.flat(spark).orderBy("r", "c").collect()] == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 0.0)]


def test_survey_grids_are_resampled(spark, tmp_path):
    """The first of two grids that overlap counts, outer edges are half a cell out, no-data is no height, gaps are filled."""
    from crestline.operators import mosaics

    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 5 -9999\n")
    (tmp_path / "b.asc").write_text("ncols 2\nnrows 2\nxllcorner 4\nyllcorner 0\ncellsize 2\n10 20\n30 40\n")
    cells = elevation.read_ascii_grid(spark, str(tmp_path))
    grids = mosaics.survey_grids(cells)
    assert sorted((r.west, r.south, r.rows, r.columns) for r in grids.collect()) == [(0.0, 0.0, 2, 3), (4.0, 0.0, 2, 2)]
    asked = [(1, 1.0, 3.0), (2, 2.0, 2.0), (3, 5.0, 3.0), (4, 7.0, 1.0), (5, 9.0, 1.0), (6, 0.0, 0.0), (7, 5.0, 1.0), (8, 6.0, 4.0)]
    got = {r.k: r.z for r in mosaics.sample_surveys(spark.createDataFrame(asked, "k int, px double, py double"), ["k"], grids, cells).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 3.0, 4: 40.0, 5: None, 6: 4.0, 7: None, 8: 3.0}

    center = spark.range(1).select(F.lit(54.45).alias("lat"), F.lit(18.5).alias("lng")).withColumn("p", geo.to_poland_1992(geo.Point(F.col("lat"), F.col("lng")))).select("p.*").first()
    east, north = center["x"] - 50, center["y"] - 50
    plane = spark.createDataFrame([("g", r, c, float(10 * r + c)) for r in range(20) for c in range(10)], "file string, r long, c long, z double")
    one = spark.createDataFrame([("g", 20, 10, 5.0, 5.0, east, north)], "file string, rows int, columns int, dx double, dy double, west double, south double")
    box = {"north": 54.4504, "south": 54.4496, "west": 18.4993, "east": 18.5013}
    rows = mosaics.resampled(one, plane, box, 10.0).collect()
    size = mosaics.grid_size(box, 10.0, 111_320.0)
    assert len(rows) == size[0] * size[1] and all(r.decimetres == round(r.z * 10) for r in rows) and min(r.z for r in rows) >= 0 and max(r.z for r in rows) <= 199


def test_documents_round_trip(spark, tmp_path):
    feature = {"id": "way/1", "category": "barrier", "barrier": "wall", "blocksOnFoot": True, "sidewalkLeft": "yes", "coordinates": [[54.0, 18.0], [54.1, 18.1]]}
    others = [{"id": "way/2", "category": "road", "highway": "track", "coordinates": [[54.0, 18.0], [54.2, 18.0]]}, {"id": "way/3", "category": "water", "waterway": "stream", "coordinates": [[54.0, 18.0], [54.2, 18.0]]}]
    (tmp_path / "w.json").write_text(json.dumps({"schemaVersion": 3, "source": "x", "features": [feature, *others], "barrierOpenings": [[54.5, 18.5]]}, indent=1))
    found, gates = ways.read_document(spark, str(tmp_path / "w.json"))
    rows = {r.id: r for r in found.collect()}
    assert rows["way/1"].sidewalk_left == "yes" and rows["way/1"].blocks_on_foot and [(p.lat, p.lng) for p in rows["way/1"].coordinates] == [(54.0, 18.0), (54.1, 18.1)]
    assert [tuple(r) for r in gates.collect()] == [(54.5, 18.5)]
    assert {k: [r.id for r in v.collect()] for k, v in ways.views(found).items()} == {"ways": ["way/2"], "barriers": ["way/1"], "paths": ["way/2"], "waterways": ["way/3"]}
    (tmp_path / "old.json").write_text(json.dumps({"schemaVersion": 2, "features": [feature], "barrierOpenings": []}))
    with pytest.raises(Exception, match="unknown schema version"):
        ways.read_document(spark, str(tmp_path / "old.json"))[0].collect()

    box = {"north": 2.0, "south": 1.0, "west": 3.0, "east": 4.0}
    elevation.write_height_document(grid(spark, [[1.23, 2], [-3, 4.56]]), str(tmp_path / "h"), box, 2, 2, 5.0, "survey")
    documents, cells = elevation.read_height_document(spark, str(tmp_path / "h"))
    one = documents.first()
    assert (one.north, one.south, one.west, one.east, one.rows, one.columns, one.source, one.spacing_meters) == (2.0, 1.0, 3.0, 4.0, 2, 2, "survey", 5.0)
    assert sorted((r.r, r.c, r.z) for r in cells.collect()) == [(0, 0, 1.2), (0, 1, 2.0), (1, 0, -3.0), (1, 1, 4.6)]
    raw = json.loads(next((tmp_path / "h").glob("*.json")).read_text())
    assert raw["schemaVersion"] == 1 and raw["minElevationMeters"] == -3.0 and raw["maxElevationMeters"] == 4.6


def test_simplified_lines_keep_their_ends_and_stay_close():
    r = np.random.default_rng(3)
    for n in (2, 3, 50, 400):
        line = np.cumsum(r.normal(size=(n, 2)), axis=0)
        for tolerance in (0.0, 0.5, 5.0, 1e9):
            kept = contours.simplify(line, tolerance)
            at = [int(np.flatnonzero((line == p).all(axis=1))[0]) for p in kept]
            assert at == sorted(at) and at[0] == 0 and at[-1] == n - 1 and (tolerance < 1e9 or len(kept) == 2)
            for a, b in zip(at[:-1], at[1:], strict=True):  # no point left out is farther from its stretch than the tolerance
                along = line[b] - line[a]
                t = np.clip((line[a:b] - line[a]) @ along / max(along @ along, 1e-300), 0, 1)
                assert (np.hypot(*(line[a:b] - line[a] - t[:, None] * along).T) <= tolerance + 1e-9).all()


def test_boxes_are_cut_into_whole_nodes(spark):
    rng = np.random.default_rng(5)
    ends = np.sort(rng.integers(0, 150, (60, 2, 2)), axis=2)
    rows = [(k, *map(int, (*e[0], *e[1])), 3) for k, e in enumerate(ends)] + [(60, 4, 3, 0, 9, 3), (61, None, None, 0, 9, 3), (62, 0, 149, 7, 9, 3)]
    found = raster.whole_nodes(spark.createDataFrame(rows, "box long, r0 long, r1 long, c0 long, c1 long, top int")).toPandas().astype({"level": float})
    for k, r0, r1, c0, c1, _ in rows:
        own = found[found["box"] == k]
        if k in (60, 61):
            assert len(own) == 1 and own[["r", "c"]].isna().all(axis=None)
            continue
        covered = np.zeros((256, 256), int)
        for level, r, c in own[["level", "r", "c"]].astype(int).itertuples(index=False):
            side = raster.FAN**level
            covered[r * side : (r + 1) * side, c * side : (c + 1) * side] += 1
        inside = np.zeros((256, 256), int)
        inside[r0 : r1 + 1, c0 : c1 + 1] = 1
        assert (covered == inside).all()
        assert len(own) <= 8 * (r1 - r0 + c1 - c0 + 2) + 16


def test_local_ranges_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    z = np.round(rng.normal(300, 80, (90, 70)), 1)
    z[rng.random(z.shape) < 0.3] = np.nan
    z[20:50, 20:50] = np.nan
    z[60:80, 5:30] = 250.2
    dem = spark.createDataFrame([(r, c, float(z[r, c])) for r, c in np.argwhere(~np.isnan(z)).tolist()], "r long, c long, z double")
    north, west, step, buffer = 50.0, 10.0, 0.001, 150.0
    boxes = []
    for k in range(40):
        (a, b), (x, y) = np.sort(rng.uniform(-5, 95, 2)).tolist(), np.sort(rng.uniform(-5, 75, 2)).tolist()
        boxes.append((k, north - a * step, north - b * step, west + y * step, west + x * step))
    boxes += [(40, north - 0.033, north - 0.035, west + 0.036, west + 0.034), (41, north - 0.066, north - 0.072, west + 0.020, west + 0.015), (42, None, 50.0, 10.0, 10.0)]
    got = {r["box"]: (r["low"], r["high"]) for r in raster.local_range(dem, spark.createDataFrame(boxes, "box long, n double, s double, e double, w double"), north, west, step, step, buffer).collect()}
    whole = float(np.nanmin(z)), float(np.nanmax(z))
    place = lambda x, most: min(max(math.floor(x + 0.5), 0), most - 1)
    for k, n, s, e, w in boxes[:-1]:
        pad_lat, pad_lng = buffer / 111_320.0, buffer / (111_320.0 * math.cos(math.radians((n + s) / 2)))
        rows, columns = 1 + int(max(np.argwhere(~np.isnan(z))[:, 0])), 1 + int(max(np.argwhere(~np.isnan(z))[:, 1]))
        part = z[place((north - n - pad_lat) / step, rows) : place((north - s + pad_lat) / step, rows) + 1, place((w - pad_lng - west) / step, columns) : place((e + pad_lng - west) / step, columns) + 1]
        known = part[~np.isnan(part)]
        assert got[k] == ((float(known.min()), float(known.max())) if len(known) and known.max() - known.min() >= 1 else whole), k
    assert got[40] == got[41] == got[42] == whole
