"""The way network: nodes, edges, spatial joins and searches over tables of segments.

Spatial joins meet in buckets of 0.001 degrees: the smaller shape is dealt to every bucket
that it may touch, an equi-join on the bucket finds candidates, an exact predicate decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions import costs, geo, tags
from crestline.functions.numeric import clamp, js_round, micro_degrees

from .checkpoints import written

BUCKET = 0.001
OFFSET, STRIDE = 2_000_000, 4_000_000
SAMPLE_METERS = 4.0
CROSSING_METERS, OPENING_METERS = 24.0, 12.0
OPENING_WINDOW = 0.0006  # degrees that are at least OPENING_METERS up to 79 degrees of latitude
RINGS, BLOCK = 8, 8
CORNER_COPIES, RIM_COPIES = 512, 8
#: What the tags of an open way say of it, beside its name.
SAID = ["is_path", "is_street", "walkway", "surface_class", "bridge_or_tunnel", "layer_number", "tagged_crossing", "name", "highway"]


def bucket_row(x: Column) -> Column:
    return F.floor(x / BUCKET)


def bucket_key(row: Column, column: Column) -> Column:
    return (row + OFFSET) * STRIDE + (column + OFFSET)


def block_key(row: Column, column: Column) -> Column:
    return bucket_key(F.floor(row / BLOCK), F.floor(column / BLOCK))


def in_buckets(rows: DataFrame, low: geo.Point, high: geo.Point, pad: float = 0.0) -> DataFrame:
    """rows once per bucket that the box low..high, padded by degrees, touches; adds bucket.

    Spark's estimate of a size does not count how often rows are dealt out, so these are never broadcast on its word.
    """
    dealt = rows.withColumn("_r", F.explode(F.sequence(bucket_row(low.lat - pad), bucket_row(high.lat + pad))))
    dealt = dealt.withColumn("_c", F.explode(F.sequence(bucket_row(low.lng - pad), bucket_row(high.lng + pad))))
    return dealt.withColumn("bucket", bucket_key(F.col("_r"), F.col("_c"))).drop("_r", "_c").hint("merge")


def segment_buckets(rows: DataFrame, a: str, b: str, pad: float = 0.0) -> DataFrame:
    p, q = geo.at(a), geo.at(b)
    return in_buckets(rows, geo.Point(F.least(p.lat, q.lat), F.least(p.lng, q.lng)), geo.Point(F.greatest(p.lat, q.lat), F.greatest(p.lng, q.lng)), pad)


def described(ways: DataFrame) -> DataFrame:
    """ways with is_path, is_street, walkway, restricted, surface_class, bridge_or_tunnel, layer_number and tagged_crossing."""
    c = F.col
    return ways.select(
        "*",
        tags.is_path(c("category"), c("highway")).alias("is_path"),
        tags.is_street(c("category"), c("highway")).alias("is_street"),
        tags.has_walkway(c("category"), c("highway"), c("sidewalk")).alias("walkway"),
        tags.is_restricted(c("foot"), c("access")).alias("restricted"),
        tags.surface_class(c("category"), c("highway"), c("surface"), c("tracktype")).alias("surface_class"),
        tags.is_tagged(c("bridge")).alias("bridge_or_tunnel"),
        tags.layer_number(c("layer")).alias("layer_number"),
        tags.is_tagged(c("crossing")).alias("tagged_crossing"),
    )


def open_ways(ways: DataFrame) -> DataFrame:
    return described(ways).where("NOT restricted").select("way_id", *SAID)


def nodes(vertices: DataFrame, ways: DataFrame) -> DataFrame:
    """lat_e6, lng_e6, lat, lng, path_evidence: vertices of open ways by coordinate; the first way's coordinate is kept."""
    return nodes_of(vertices.join(open_ways(ways), "way_id")).drop("on_street", "ways")


def nodes_of(met: DataFrame) -> DataFrame:
    """nodes with on_street and ways, the ids of those that meet there. met: vertices with what their ways' tags say."""
    placed = met.withColumns({"lat_e6": micro_degrees(F.col("lat")), "lng_e6": micro_degrees(F.col("lng"))})
    found = placed.groupBy("lat_e6", "lng_e6").agg(F.min(F.struct("way_id", "pos", "lat", "lng")).alias("first"), F.bool_or("is_path").alias("path_evidence"), F.bool_or("is_street").alias("on_street"), F.collect_set("way_id").alias("ways"))
    return found.select("lat_e6", "lng_e6", "first.lat", "first.lng", "path_evidence", "on_street", "ways")


def edges(segments: DataFrame, vertices: DataFrame, ways: DataFrame) -> DataFrame:
    """Directed edges both ways of each segment of at least half a metre of an open way.

    crosses_street: one of its ends is an inner vertex of a path and lies on an open street's vertex.
    """
    streets = vertices.join(open_ways(ways).where("is_street").select("way_id"), "way_id", "left_semi")
    return edges_of(segments.join(open_ways(ways), "way_id"), streets.select(micro_degrees(F.col("lat")).alias("lat_e6"), micro_degrees(F.col("lng")).alias("lng_e6")).distinct())


def edges_of(lines: DataFrame, street_keys: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """edges with the columns in more. lines: segments with what their ways' tags say; street_keys: lat_e6, lng_e6 of the vertices of open streets."""
    keys = lambda p: (micro_degrees(F.col(f"{p}_lat")), micro_degrees(F.col(f"{p}_lng")))
    own = lines.withColumn("meters", geo.distance(geo.at("a"), geo.at("b"))).where("meters >= 0.5")
    own = own.withColumns({"from_lat": keys("a")[0], "from_lng": keys("a")[1], "to_lat": keys("b")[0], "to_lng": keys("b")[1]}).where("from_lat <> to_lat OR from_lng <> to_lng")
    for end in ("from", "to"):
        marked = street_keys.select(F.col("lat_e6").alias(f"{end}_lat"), F.col("lng_e6").alias(f"{end}_lng"), F.lit(True).alias(f"{end}_street"))
        own = own.join(marked, [f"{end}_lat", f"{end}_lng"], "left")
    inner_from, inner_to = F.col("pos") > 1, F.col("pos") + 1 < F.col("vertices_in_way")
    touches = F.col("is_path") & ((inner_from & F.col("from_street").isNotNull()) | (inner_to & F.col("to_street").isNotNull()))
    kept = own.withColumn("crosses_street", touches)
    attributes = ["way_id", "pos", "meters", "is_path", "is_street", "walkway", "surface_class", "bridge_or_tunnel", "crosses_street", *more]
    there = kept.select("from_lat", "from_lng", "to_lat", "to_lng", *attributes)
    back = kept.select(F.col("to_lat").alias("from_lat"), F.col("to_lng").alias("from_lng"), F.col("from_lat").alias("to_lat"), F.col("from_lng").alias("to_lng"), *attributes)
    return there.unionByName(back)


def crossing_points(segments: DataFrame, ways: DataFrame) -> DataFrame:
    """lat_e6, lng_e6 where a path meets a street of which one is tagged a crossing; bridges only on the same layer."""
    return crossings_of(segments.join(open_ways(ways), "way_id"))


def crossings_of(lines: DataFrame) -> DataFrame:
    """crossing_points of lines, segments with what their ways' tags say."""
    columns = ["way_id", "pos", "tagged_crossing", "bridge_or_tunnel", "layer_number"]
    side = lambda kind, a, b, tag: lines.where(kind).select(*(F.col(c).alias(f"{tag}_{c}") for c in columns), *(F.col(f"{s}_{k}").alias(f"{d}_{k}") for s, d in (("a", a), ("b", b)) for k in ("lat", "lng")))
    paths = segment_buckets(side("is_path", "a", "b", "p"), "a", "b", 0.00005)
    streets = segment_buckets(side("is_street", "c", "d", "s"), "c", "d")
    met = paths.join(streets, "bucket").where("(p_tagged_crossing OR s_tagged_crossing) AND NOT (p_bridge_or_tunnel <> s_bridge_or_tunnel AND p_layer_number <> s_layer_number)")
    found = met.withColumn("p", geo.intersection(*map(geo.at, "abcd"))).where("p IS NOT NULL")
    return found.select(micro_degrees(F.col("p.lat")).alias("lat_e6"), micro_degrees(F.col("p.lng")).alias("lng_e6")).distinct()


def near(points: DataFrame, others: DataFrame, meters: float) -> DataFrame:
    """The points (lat, lng) that have one of others (lat, lng) within so many metres: a semi-join in buckets."""
    window = 0.0004
    dealt = in_buckets(points, geo.Point(F.col("lat") - window, F.col("lng") - window), geo.Point(F.col("lat") + window, F.col("lng") + window))
    there = others.select(F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), bucket_key(bucket_row(F.col("lat")), bucket_row(F.col("lng"))).alias("o_bucket"))
    close = (F.col("bucket") == F.col("o_bucket")) & (geo.distance(geo.Point(F.col("lat"), F.col("lng")), geo.at("o")) <= meters)
    return dealt.join(there, close, "left_semi").drop("bucket").distinct()


def barrier_violations(segments: DataFrame, barriers: DataFrame, openings: DataFrame) -> DataFrame:
    """way_id, pos of segments that meet a barrier away from every opening.

    Only what meets moves on from the buckets, and openings are dealt to the buckets around them, so that a point needs its own only.
    """
    walked = segment_buckets(segments.select("way_id", "pos", "a_lat", "a_lng", "b_lat", "b_lng"), "a", "b", 0.00015)
    closed = segment_buckets(barriers.select("barrier_id", *(F.col(f"{s}_{k}").alias(f"{d}_{k}") for s, d in (("a", "c"), ("b", "d")) for k in ("lat", "lng"))), "c", "d")
    points = walked.join(closed, "bucket").select("way_id", "pos", geo.intersection(*map(geo.at, "abcd")).alias("p")).where("p IS NOT NULL")
    points = points.select("way_id", "pos", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"), bucket_key(bucket_row(F.col("p.lat")), bucket_row(F.col("p.lng"))).alias("bucket"))
    spot = geo.Point(F.col("lat"), F.col("lng"))
    passed = in_buckets(openings.select("lat", "lng"), spot, spot, OPENING_WINDOW).select(F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), F.col("bucket").alias("o_bucket"))
    close = (F.col("bucket") == F.col("o_bucket")) & (geo.distance(spot, geo.at("o")) <= OPENING_METERS)
    return points.join(passed, close, "left_anti").select("way_id", "pos").distinct()


def road_conflicts(segments: DataFrame, roads: DataFrame, crossings: DataFrame) -> DataFrame:
    """way_id, pos, crosses, carriageway of segments that meet a street (roads: way_id, pos, walkway, a, b).

    crosses: away from every mapped crossing. carriageway: a segment of over 18 m whose ends and middle keep within 14 m of a parallel street without a walkway.
    """
    walked = segment_buckets(segments.select("way_id", "pos", "a_lat", "a_lng", "b_lat", "b_lng"), "a", "b", 0.00015)
    streets = segment_buckets(roads.select(F.struct("way_id", "pos").alias("road"), "walkway", *(F.col(f"{s}_{k}").alias(f"{d}_{k}") for s, d in (("a", "c"), ("b", "d")) for k in ("lat", "lng"))), "c", "d")
    a, b, c, d = map(geo.at, "abcd")
    met = walked.join(streets, "bucket").withColumn("p", geo.intersection(a, b, c, d)).where("p IS NOT NULL").dropDuplicates(["way_id", "pos", "road"])
    close = [geo.distance_to_segment(p, c, d) <= 14 for p in (a, b, geo.interpolate(a, b, F.lit(0.5)))]
    along = ~F.col("walkway") & (geo.distance(a, b) > 18) & close[0] & close[1] & close[2] & geo.parallel(a, b, c, d)
    points = met.select("way_id", "pos", "road", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"), along.alias("along"))
    safe = near(points.drop("along"), crossings, CROSSING_METERS).select("way_id", "pos", "road", F.lit(True).alias("safe"))
    return points.join(safe, ["way_id", "pos", "road"], "left").groupBy("way_id", "pos").agg(F.bool_or(F.col("safe").isNull()).alias("crosses"), F.bool_or("along").alias("carriageway"))


def allowed_segments(segments: DataFrame, barriers: DataFrame, openings: DataFrame) -> DataFrame:
    return segments.join(barrier_violations(segments, barriers, openings), ["way_id", "pos"], "left_anti")


def nearest_nodes(requests: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """request_id, rank, lat_e6, lng_e6, meters: each request's `limit` nearest nodes."""
    return nearest(requests, found.select("lat_e6", "lng_e6", "lat", "lng"), limit).drop("lat", "lng")


def nearest(requests: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """request_id, rank, the columns of found (lat_e6, lng_e6, lat, lng and others), meters: each request's `limit` nearest nodes.

    Rings of buckets widen until they hold 2 * limit nodes, at most RINGS; the counts by bucket
    choose the ring, and only then do nodes join. Most requests need the first ring, of some nine buckets; the others
    meet the counts in blocks of BLOCK by BLOCK buckets, one array each.
    """
    placed = found.withColumns({"row": bucket_row(F.col("lat")), "column": bucket_row(F.col("lng"))}).withColumns({"bucket": bucket_key(F.col("row"), F.col("column")), "block": block_key(F.col("row"), F.col("column"))})
    counts = placed.groupBy("row", "column", "bucket", "block").agg(F.count("*").alias("n"))
    asked = requests.select("request_id", "lat", "lng")
    edge = lambda at, k: bucket_row(F.col(at) + k * BUCKET)

    beside = in_buckets(asked, *(geo.Point(F.col("lat") + k * BUCKET, F.col("lng") + k * BUCKET) for k in (-1, 1))).join(counts, "bucket")
    first = beside.groupBy("request_id", "lat", "lng").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bucket", "block")).alias("at")).where(F.col("n") >= 2 * limit)

    def ring(held: Column) -> Column:
        """The first ring whose window holds the bucket: about its distance in buckets, but for rounding at an edge."""
        about = F.greatest(F.abs(held["row"] - edge("lat", 0)), F.abs(held["column"] - edge("lng", 0)))
        within = lambda k: held["row"].between(edge("lat", -k), edge("lat", k)) & held["column"].between(edge("lng", -k), edge("lng", k))
        return F.coalesce(*(F.when((k >= 1) & (k <= RINGS) & within(k), k) for k in (about - 1, about, about + 1)))

    blocks = counts.groupBy("block").agg(F.collect_list(F.struct("row", "column", "bucket", "n")).alias("held"))  # at most BLOCK squared
    rest = asked.join(first.select("request_id"), "request_id", "left_anti")
    for at in ("lat", "lng"):
        rest = rest.withColumn(f"_{at}", F.explode(F.sequence(*(F.floor(edge(at, k) / BLOCK) for k in (-RINGS, RINGS)))))
    rings = F.filter(F.transform("held", lambda h: F.struct(h["bucket"].alias("bucket"), F.col("block").alias("block"), h["n"].alias("n"), ring(h).alias("ring"))), lambda h: h["ring"].isNotNull())
    met = rest.select("request_id", "lat", "lng", bucket_key(F.col("_lat"), F.col("_lng")).alias("block")).hint("merge").join(blocks, "block").select("request_id", "lat", "lng", rings.alias("seen"))
    wide = met.groupBy("request_id", "lat", "lng").agg(F.flatten(F.collect_list("seen")).alias("seen"))
    holds = lambda k: F.aggregate("seen", F.lit(0).cast("long"), lambda n, h: n + F.when(h["ring"] <= k, h["n"]).otherwise(0)) >= 2 * limit
    last = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(RINGS)), holds)), F.lit(RINGS))
    kept = geo.let({"last": last}, lambda v: F.filter("seen", lambda h: h["ring"] <= v["last"]))  # a column of its own would be put into the filter and made again for each bucket seen
    wide = wide.select("request_id", "lat", "lng", F.transform(kept, lambda h: F.struct(h["bucket"].alias("bucket"), h["block"].alias("block"))).alias("at"))

    near_buckets = first.drop("n").unionByName(wide).select("request_id", F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), F.inline("at"))
    # Dealt by block, so that most of a request's candidates are in one task, which keeps `limit` of them.
    close = near_buckets.repartition("block").hint("merge").join(placed.drop("row", "column").repartition("block"), ["block", "bucket"]).withColumn("meters", geo.distance(geo.at("q"), geo.Point(F.col("lat"), F.col("lng"))))
    order = Window.partitionBy("request_id").orderBy(F.round("meters", 6), "lat_e6", "lng_e6")
    return close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("request_id", "rank", *found.columns, "meters")


def segment_profile(segments: DataFrame, key: list[str], dem: DataFrame, place: tuple, profile: str | Column | list[str] = "hiker", surface: str | Column = "natural-trail", risk: DataFrame | None = None, slopes: DataFrame | None = None) -> DataFrame:
    """Distance, climb, steepest grade, minutes, water risk and side slope of each segment, from samples every four metres.

    A segment meets each square of the raster that its samples lie in, as one row, and takes from it height, risk and slope;
    the row makes its own samples, so none of them is moved alone. Risk and slope are those of the samples' nearest cells, the first sample left
    out. Segments shorter than a centimetre measure zero. For a list of profiles minutes is a struct of theirs.
    """
    from . import raster

    north, west, lat_step, lng_step = place
    more = [(cells, name, value) for cells, name, value in ((risk, "water_risk", "risk"), (slopes, "side_slope", "slope")) if cells is not None]
    ground = dem.select("r", "c", "z")
    for cells, _, value in more:
        ground = ground.join(cells.select("r", "c", value), ["r", "c"], "full")
    several = profile if isinstance(profile, list) else None
    own = [x if isinstance(x, Column) else F.lit(x) for x in (None if several else profile, surface)]
    size = F.broadcast(raster.extent(dem).select(F.col("rows").alias("_rows"), F.col("columns").alias("_columns")))  # one row
    ends = [f"{e}_{k}" for e in "ab" for k in ("lat", "lng")]
    counted = segments.select(*key, *ends, own[0].alias("_profile"), own[1].alias("_surface"), geo.distance(geo.at("a"), geo.at("b")).alias("_meters")).withColumn("_count", F.greatest(F.lit(1), F.ceil(F.col("_meters") / SAMPLE_METERS)).cast("int"))
    lines = counted.crossJoin(size).withColumn("_step", F.col("_meters") / F.col("_count"))
    every = F.when(F.col("_step") >= 0.01, F.sequence(F.lit(0), F.col("_count")))

    def grid(k: Column) -> tuple[Column, Column]:
        p = geo.interpolate(geo.at("a"), geo.at("b"), k / F.col("_count"))
        return clamp((F.lit(north) - p.lat) / lat_step, F.lit(0.0), F.col("_rows") - 1.0), clamp((p.lng - F.lit(west)) / lng_step, F.lit(0.0), F.col("_columns") - 1.0)

    square = lambda k: F.struct(*(F.floor(F.floor(x) / raster.TILE).alias(n) for x, n in zip(grid(k), ("tile_r", "tile_c"), strict=True)))
    dealt = lines.withColumn("_square", F.explode_outer(F.array_distinct(F.transform(every, square)))).withColumns({n: F.col(f"_square.{n}") for n in ("tile_r", "tile_c")})
    # Samples beyond the raster gather in its outermost squares, above all in the corners: these come in several copies.
    rim = [F.when(F.col(n).isin(0) | (F.col(n) == F.floor((F.col(size) - 1) / raster.TILE)), 1).otherwise(0) for n, size in (("tile_r", "_rows"), ("tile_c", "_columns"))]
    copies = F.when(rim[0] + rim[1] == 2, CORNER_COPIES).when(rim[0] + rim[1] == 1, RIM_COPIES).otherwise(1)
    stored = raster.squares(ground, ["z", *(value for *_, value in more)]).crossJoin(size).withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_rows", "_columns")
    dealt = dealt.withColumn("_copy", F.pmod(F.hash(*key), copies))
    met = dealt.join(stored.hint("merge"), ["tile_r", "tile_c", "_copy"], "left")

    def sample(at: Column) -> Column:
        y, x = at["y"], at["x"]
        r, c = F.floor(y), F.floor(x)
        cell = lambda r, c: F.get("cells", ((r - F.col("tile_r") * raster.TILE) * (raster.TILE + 1) + c - F.col("tile_c") * raster.TILE).cast("int"))
        down, right = F.least(r + 1, F.col("_rows") - 1), F.least(c + 1, F.col("_columns") - 1)
        part = lambda r, c, weight: F.when(weight == 0, F.lit(0.0)).otherwise(cell(r, c)["z"] * weight)
        fr, fc = y - r, x - c
        z = part(r, c, (1 - fc) * (1 - fr)) + part(r, right, fc * (1 - fr)) + part(down, c, (1 - fc) * fr) + part(down, right, fc * fr)
        nearest = cell(js_round(y), js_round(x))
        return F.struct(at["k"].alias("k"), z.alias("z"), *(nearest[value].alias(value) for *_, value in more))

    inside = F.filter(every, lambda k: square(k) == F.col("_square"))
    placed = F.transform(inside, lambda k: F.struct(k.alias("k"), *(x.alias(n) for x, n in zip(grid(k), "yx", strict=True))))
    found = met.select(*key, "_step", "_profile", "_surface", "_rows", "_columns", "tile_r", "tile_c", "cells", placed.alias("_placed")).select(*key, "_step", "_profile", "_surface", F.transform("_placed", sample).alias("_found"))
    whole = found.groupBy(*key).agg(F.first("_step").alias("_step"), F.first("_profile").alias("_profile"), F.first("_surface").alias("_surface"), F.array_sort(F.flatten(F.collect_list("_found"))).alias("_s"))
    rises = F.filter(F.transform(F.arrays_zip(F.col("_s.z").alias("a"), F.slice("_s.z", 2, 1_000_000_000).alias("b")), lambda p: p["b"] - p["a"]), lambda dz: dz.isNotNull())
    whole = whole.withColumn("_dz", rises)
    step = F.col("_step")
    total = lambda of: F.aggregate("_dz", F.lit(0.0), lambda so_far, dz: so_far + of(dz))
    spent = lambda p: total(lambda dz: step / costs.meters_per_minute(p, dz / step, F.col("_surface")))
    minutes = F.struct(*(spent(F.lit(p)).alias(p) for p in several)) if several else spent(F.col("_profile"))
    walked = F.filter("_s", lambda x: x["k"] > 0)
    greatest = lambda value: F.array_max(F.transform(walked, lambda x: x[value]))
    beside = [F.when(F.size("_dz") > 0, greatest(value)) for *_, value in more]
    return whole.select(
        *key, total(lambda dz: step).alias("distance_m"), total(lambda dz: dz).alias("change_m"), total(lambda dz: F.greatest(dz, F.lit(0.0))).alias("ascent_m"), total(lambda dz: F.greatest(-dz, F.lit(0.0))).alias("descent_m"),
        F.coalesce(F.array_max(F.transform("_dz", lambda dz: F.abs(dz / step))), F.lit(0.0)).alias("max_grade"), minutes.alias("minutes"), *(F.coalesce(b, F.lit(0.0)).alias(name) for b, (_, name, _) in zip(beside, more, strict=True)),
    )


def reach(sources: DataFrame, links: DataFrame, budget: float) -> DataFrame:
    """source, node, cost: the cheapest cost from each source to every node within a budget.

    sources (source, node), links (node, other, cost > 0). Each round relaxes the frontier with
    one join and keeps the least cost per pair; what improved is the next frontier. Rounds are
    tables in the checkpoint folder, so plans stay short and sizes are those of the rows written.
    """
    best = written(sources.select("source", "node", F.lit(0.0).alias("cost")))
    frontier = best
    links = written(links.groupBy("node", "other").agg(F.min("cost").alias("step")))
    while True:
        tried = frontier.join(links, "node").select("source", F.col("other").alias("node"), (F.col("cost") + F.col("step")).alias("cost")).where(F.col("cost") <= budget)
        least = tried.groupBy("source", "node").agg(F.min("cost").alias("new"))
        frontier = written(least.join(best, ["source", "node"], "left").where("cost IS NULL OR new < cost - 1e-9").select("source", "node", F.col("new").alias("cost")))
        if frontier.isEmpty():
            return best
        best = written(best.unionByName(frontier).groupBy("source", "node").agg(F.min("cost").alias("cost")))
