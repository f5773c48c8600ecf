"""Whole routes for batches of requests: legs, connectors at both ends, the way between, and what they add up to.

Every measure is taken by joins over all legs at once. A grouped function only settles labels,
over the hops within one leg's off-trail budget, the edges of one cell of the network, or the
overlay of its cells.
"""

from __future__ import annotations

import copy
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions import costs, geo
from crestline.functions.numeric import micro_degrees

from . import network, overlay, raster, routes, search
from .checkpoints import ensure_checkpoint_dir, written
from .components import component_labels

CONNECTOR_NODES, PATH_NODES = 24, 64
HOP_TILE = 16
SETTINGS = ["profile", "max_grade_percent", "aversion", "budget", "allow_crossing", "allow_street", "avoid_water"]
SHORTEST = 0.5
#: Degrees around a box within which ways, crossings and openings bear on what lies in it: more than any bucket join looks.
MARGIN = 0.002


def routing_requests(asked: DataFrame) -> DataFrame:
    """request_id, mode, points, alternatives and settings: a nearest request drops its target, only a design keeps its waypoints.

    asked: request_id, mode, start and target (struct lat, lng), waypoints (array), show_alternatives and settings.
    """
    target = F.when(F.col("mode") == "nearest", None).otherwise(F.col("target"))
    between = F.when(F.col("mode") == "design", F.coalesce("waypoints", F.array())).otherwise(F.array())
    points = F.filter(F.concat(F.array("start"), between, F.array(target)), lambda p: p.isNotNull())
    kept = [c for c in asked.columns if c not in ("start", "target", "waypoints", "show_alternatives")]
    return asked.select(*kept, points.alias("points"), F.when(F.col("show_alternatives"), 3).otherwise(1).alias("alternatives"))


def swapped(asked: DataFrame) -> DataFrame:
    """The way back: start and target change places and the waypoints turn round; without a target nothing changes."""
    both = F.col("target").isNotNull()
    return asked.withColumns({"start": F.when(both, F.col("target")).otherwise(F.col("start")), "target": F.when(both, F.col("start")).otherwise(F.col("target")), "waypoints": F.when(both, F.reverse("waypoints")).otherwise(F.col("waypoints"))})


def legs(requests: DataFrame) -> DataFrame:
    """leg_id, request_id, flavor_index, flavor, leg, a_lat, a_lng, b_lat, b_lng and the flavour's settings; b is null for the nearest path.

    requests: request_id, mode, points, alternatives, profile, max_grade_percent, off_trail_aversion, max_off_trail_meters,
    allow_crossing, allow_street, avoid_water. Legs between fixed points do not wait for each other.
    """
    flavors = F.when((F.col("mode") == "nearest") | (F.col("alternatives") <= 1), F.array(F.lit("balanced"))).otherwise(F.array(*map(F.lit, costs.FLAVORS)))
    each = requests.select("*", F.posexplode(flavors).alias("flavor_index", "flavor"))
    nearest = F.col("mode") == "nearest"
    ends = F.when(nearest, F.array(F.struct(F.element_at("points", 1).alias("a"), F.lit(None).cast("struct<lat: double, lng: double>").alias("b")))).otherwise(
        F.transform(F.filter(F.arrays_zip(F.col("points").alias("a"), F.slice("points", 2, 1_000_000).alias("b")), lambda x: x["b"].isNotNull()), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    )
    made = each.select("*", F.posexplode(ends).alias("leg", "e"))
    return made.select(
        F.concat_ws("|", F.col("request_id").cast("string"), "flavor_index", "leg").alias("leg_id"), "request_id", "flavor_index", "flavor", "leg",
        *(F.col(f"e.{p}.{k}").alias(f"{p}_{k}") for p in "ab" for k in ("lat", "lng")),
        "profile", "max_grade_percent", costs.aversion(F.col("flavor"), F.col("off_trail_aversion")).alias("aversion"),
        costs.off_trail_budget(F.col("flavor"), F.col("max_off_trail_meters")).alias("budget"), "allow_crossing", "allow_street", "avoid_water",
    )


def node_name() -> Column:
    return F.concat_ws(",", F.col("lat_e6").cast("string"), F.col("lng_e6").cast("string"))


class Ground:
    """What a request moves over: the raster and its place, ways and barriers as tables; measures are made from them by joins.

    What is derived from the ways (crossings, roads, nodes, edges) is made when it is first asked for.
    """

    def __init__(self, dem: DataFrame, place: tuple, segments: DataFrame, vertices: DataFrame, ways: DataFrame, barriers: DataFrame, openings: DataFrame, risk: DataFrame | None = None, slopes: DataFrame | None = None):
        ensure_checkpoint_dir(dem.sparkSession)
        self.dem, self.place, self.barriers, self.openings, self.risk, self.slopes = dem, place, barriers, openings, risk, slopes
        self.segments, self.vertices, self.ways = segments, vertices, ways

    @cached_property
    def stored(self) -> Ground:
        """The same ground with its open ways in a table, a row a way with its points in order, from which lines and nodes are made without moving a segment."""
        points = self.vertices.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lng"))).alias("points"))
        rows = written(points.join(network.open_ways(self.ways), "way_id"))
        pairs = F.filter(F.arrays_zip(F.col("points").alias("a"), F.slice("points", 2, 1_000_000_000).alias("b")), lambda p: p["b"].isNotNull())
        cut = rows.select("way_id", *network.SAID, F.size("points").alias("vertices_in_way"), F.explode(pairs).alias("p"))
        lines = cut.select("way_id", F.col("p.a.pos").alias("pos"), *(F.col(f"p.{e}.{k}").alias(f"{e}_{k}") for e in "ab" for k in ("lat", "lng")), "vertices_in_way", *network.SAID)
        own = self.underived()
        own.segments, own.lines, own.met = lines.drop(*network.SAID), lines, rows.select("way_id", *network.SAID, F.inline("points"))
        own.vertices = own.met.drop(*network.SAID)
        return own

    @cached_property
    def lines(self) -> DataFrame:
        """The segments of open ways with what their ways' tags say."""
        return self.segments.join(network.open_ways(self.ways), "way_id")

    @cached_property
    def met(self) -> DataFrame:
        """The vertices of open ways with what their ways' tags say."""
        return self.vertices.join(network.open_ways(self.ways), "way_id")

    @cached_property
    def crossings(self) -> DataFrame:
        return network.crossings_of(self.lines).select((F.col("lat_e6") / 1e6).alias("lat"), (F.col("lng_e6") / 1e6).alias("lng")).checkpoint()

    @cached_property
    def roads(self) -> DataFrame:
        return self.lines.where("is_street").select("way_id", "pos", "walkway", *(f"{e}_{k}" for e in "ab" for k in ("lat", "lng")))

    @cached_property
    def nodes(self) -> DataFrame:
        return written(network.nodes_of(self.met)).withColumn("node", node_name())

    @cached_property
    def edges(self) -> DataFrame:
        return self.edges_among()

    def edges_among(self, ways: DataFrame | None = None) -> DataFrame:
        """The edges of the network, or those of some ways (way_id): nodes and crossings are looked up for these only."""
        if ways is not None and "edges" in vars(self):
            return self.edges.join(ways, "way_id", "left_semi")
        lines, local = self.lines, self.nodes
        if ways is not None:
            lines = written(lines.join(ways, "way_id", "left_semi"))
            ends = reduce(DataFrame.union, (lines.select(micro_degrees(F.col(f"{e}_lat")).alias("lat_e6"), micro_degrees(F.col(f"{e}_lng")).alias("lng_e6")) for e in "ab"))
            local = written(local.join(written(ends.distinct()), ["lat_e6", "lng_e6"], "left_semi").drop("ways"))
        at = lambda end: local.select(F.col("lat_e6").alias(f"{end}_lat"), F.col("lng_e6").alias(f"{end}_lng"), F.col("node").alias(end), F.col("lat").alias(f"{'a' if end == 'from' else 'b'}_lat0"), F.col("lng").alias(f"{'a' if end == 'from' else 'b'}_lng0"))
        made = network.edges_of(lines, local.where("on_street").select("lat_e6", "lng_e6"), ("name", "highway")).join(at("from"), ["from_lat", "from_lng"]).join(at("to"), ["to_lat", "to_lng"])
        near = network.near(local.select("node", "lat", "lng"), self.crossings, network.CROSSING_METERS).select("node").distinct().checkpoint()
        for end in ("from", "to"):
            made = made.join(near.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_near")), end, "left")
        return written(made.select(
            "way_id", "pos", F.col("from").alias("a"), F.col("to").alias("b"), *(F.col(f"{e}_{k}0").alias(f"{e}_{k}") for e in "ab" for k in ("lat", "lng")), "is_path", "is_street", "walkway", "surface_class", "bridge_or_tunnel",
            "crosses_street", F.coalesce(F.col("from_near") | F.col("to_near"), F.col("from_near"), F.col("to_near"), F.lit(False)).alias("near_crossing"), "name", "highway",
        ))

    @cached_property
    def components(self) -> DataFrame:
        """way_id, component of ways that share a node with others, whatever the rules: they hang together, and the component is the least of their ids. A way that is not there is alone."""
        meets = self.nodes.where(F.size("ways") > 1).select(F.array_min("ways").alias("b"), F.explode("ways").alias("a")).where("a <> b")
        return component_labels(meets.distinct()).withColumnRenamed("id", "way_id")

    def underived(self) -> Ground:
        """A copy without what is derived from the ways."""
        part = copy.copy(self)
        for derived in ("stored", "lines", "met", "crossings", "roads", "nodes", "edges", "components"):
            part.__dict__.pop(derived, None)
        return part

    def within(self, low: geo.Point, high: geo.Point) -> Ground:
        """The same ground for rows a-b inside a box: ways, barriers and openings that touch none of it, with a margin, are left out. The raster stays whole."""
        edge = {"lat": (low.lat - MARGIN, high.lat + MARGIN), "lng": (low.lng - MARGIN, high.lng + MARGIN)}
        touches = lambda a, b: reduce(Column.__and__, ((F.greatest(F.col(f"{a}{k}"), F.col(f"{b}{k}")) >= lo) & (F.least(F.col(f"{a}{k}"), F.col(f"{b}{k}")) <= hi) for k, (lo, hi) in edge.items()))
        part = self.underived()
        part.segments = self.segments.where(touches("a_", "b_")).checkpoint()
        part.ways = self.ways.join(part.segments.select("way_id").distinct(), "way_id", "left_semi").checkpoint()
        part.vertices = self.vertices.join(part.ways.select("way_id"), "way_id", "left_semi")
        part.barriers, part.openings = self.barriers.where(touches("a_", "b_")), self.openings.where(touches("", ""))
        return part

    def measures(self, rows: DataFrame, key: list[str], surface: str | Column) -> DataFrame:
        """The profile of each segment a-b for the rows' own profile column, or with minutes for every profile where there is none; water risk and side slope are 0 where no raster says more."""
        found = network.segment_profile(rows, key, self.dem, self.place, F.col("profile") if "profile" in rows.columns else list(costs.FLAT_SPEED_KMH), surface, self.risk, self.slopes)
        return found.withColumns({n: F.lit(0.0) for n in ("water_risk", "side_slope") if n not in found.columns})

    def open_ground(self, rows: DataFrame, key: list[str]) -> DataFrame:
        """Segments a-b over open ground, without those through a barrier: adds crosses (a street away from a mapped crossing), carriageway (along a street without a walkway) and the profile."""
        keyed = rows.withColumns({"way_id": F.struct(*key), "pos": F.lit(0)})
        free = network.allowed_segments(keyed, self.barriers, self.openings)
        flags = network.road_conflicts(free, self.roads, self.crossings)
        flagged = free.join(flags, ["way_id", "pos"], "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in ("crosses", "carriageway")}).drop("way_id", "pos")
        return flagged.join(self.measures(flagged, key, "open-terrain"), key)


def passable(of=F.col) -> Column:
    """Whether a stretch of open ground is allowed by the settings beside it; `of` finds what is named."""
    roads = (of("allow_crossing") | ~of("crosses")) & (of("allow_street") | ~of("carriageway"))
    return roads & costs.profile_allowed(of("max_grade"), of("max_grade_percent"), of("water_risk"), of("avoid_water"), F.lit(False))


def step_cost(of=F.col) -> Column:
    return costs.connector_step_cost(of("minutes"), of("aversion"), of("side_slope"), of("water_risk"), of("avoid_water"))


def ends_of(asked: DataFrame, ground: Ground) -> DataFrame:
    """leg_id, end, budget, lat, lng, node, t_lat, t_lng: the nodes to be connected: the nearest reachable ones, and for a nearest path its candidates as goals at no cost."""

    def close(rows: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
        """rows (leg_id, end, budget, lat, lng) with their nearest nodes; what starts or ends at one spot is looked up once."""
        named = rows.withColumn("request_id", F.concat_ws("|", F.col("lat").cast("string"), F.col("lng").cast("string")))
        found = network.nearest(named.select("request_id", "lat", "lng").dropDuplicates(["request_id"]), nodes.select("lat_e6", "lng_e6", "lat", "lng"), limit)
        return named.join(found.select("request_id", node_name().alias("node"), F.col("lat").alias("t_lat"), F.col("lng").alias("t_lng")), "request_id").drop("request_id")

    paths = ground.nodes.where("path_evidence")
    rows = reduce(DataFrame.unionByName, (asked.where(F.col(f"{p}_lat").isNotNull()).select("leg_id", F.lit(end).alias("end"), "budget", "allow_street", F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_lng").alias("lng")) for end, p in (("start", "a"), ("finish", "b"))))
    parts = [close(rows.where(chosen).drop("allow_street"), nodes, CONNECTOR_NODES) for chosen, nodes in (("allow_street", ground.nodes), ("NOT allow_street", paths))]
    parts.append(close(asked.where("b_lat IS NULL").select("leg_id", F.lit("goal").alias("end"), "budget", F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng")), paths, PATH_NODES))
    return written(reduce(DataFrame.unionByName, parts))


HOP = ("distance_m", "minutes", "max_grade", "side_slope", "water_risk", "crosses", "carriageway")


def spot(ground: Ground, r: Column, c: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell."""
    north, west, lat_step, lng_step = ground.place
    return F.lit(north) - r * lat_step, F.lit(west) + c * lng_step


def home_cells(rows: DataFrame, ground: Ground) -> DataFrame:
    """rows (lat, lng, budget and others) with r, c, their cell, and spread_r, spread_c, how many cells away the budget can lead, by the length of a degree there."""
    _, _, lat_step, lng_step = ground.place
    farthest = F.least(F.abs("lat") + F.col("budget") / geo.METERS_PER_DEGREE_LATITUDE + lat_step, F.lit(89.0))
    height, width = lat_step * geo.METERS_PER_DEGREE_LATITUDE, F.cos(F.radians(farthest)) * (lng_step * geo.METERS_PER_DEGREE_LATITUDE)
    r, c = home_cell(ground, F.col("lat"), F.col("lng"))
    return rows.withColumns({"r": r, "c": c, "spread_r": (F.ceil(F.col("budget") / height) + 1).cast("long"), "spread_c": (F.ceil(F.col("budget") / width) + 1).cast("long")})


def home_cell(ground: Ground, lat: Column, lng: Column) -> tuple[Column, Column]:
    north, west, lat_step, lng_step = ground.place
    return F.round((F.lit(north) - lat) / lat_step).cast("long"), F.round((lng - F.lit(west)) / lng_step).cast("long")


def cell_code(r: Column, c: Column) -> Column:
    return F.shiftleft(r, 32) + c


def hop_tiles(wanted: DataFrame, ground: Ground) -> DataFrame:
    """profile, tile_r, tile_c, hops: the hops over open ground from each cell of the wanted tiles in all headings, with the measures in HOP.

    wanted: profile, tile_r, tile_c. Hops are measured once for all requests and kept in files, one array a tile.
    """
    tile = ["tile_r", "tile_c"]
    cells = ground.dem.select("r", "c", *(F.floor(F.col(k) / HOP_TILE).alias(f"tile_{k}") for k in "rc")).join(wanted.select(*tile).distinct(), tile)
    headings = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in search.HEADINGS)))
    tried = cells.withColumn("h", headings).select(F.col("r").alias("from_r"), F.col("c").alias("from_c"), (F.col("r") + F.col("h.dr")).alias("to_r"), (F.col("c") + F.col("h.dc")).alias("to_c"))
    tried = tried.join(ground.dem.select(F.col("r").alias("to_r"), F.col("c").alias("to_c")), ["to_r", "to_c"], "left_semi")
    ends = {f"{p}_{k}": spot(ground, F.col(f"{n}_r"), F.col(f"{n}_c"))[i] for p, n in (("a", "from"), ("b", "to")) for i, k in enumerate(("lat", "lng"))}
    tried = tried.withColumns(ends).checkpoint()
    box = tried.agg(*(fn(F.least(f"a_{k}", f"b_{k}") if fn is F.min else F.greatest(f"a_{k}", f"b_{k}")).alias(f"{n}_{k}") for n, fn in (("low", F.min), ("high", F.max)) for k in ("lat", "lng"))).first()
    around = ground.within(*(geo.fixed_point(box[f"{n}_lat"], box[f"{n}_lng"]) for n in ("low", "high"))) if box["low_lat"] is not None else ground
    hops = around.open_ground(tried, ["from_r", "from_c", "to_r", "to_c"])
    code = lambda n: (F.shiftleft(F.col(f"{n}_r").cast("long"), 32) + F.col(f"{n}_c")).alias(n)
    listed = F.collect_list(F.struct(code("from"), code("to"), *HOP)).alias("every")
    tiles = hops.groupBy(*(F.floor(F.col(f"from_{k}") / HOP_TILE).alias(f"tile_{k}") for k in "rc")).agg(listed).checkpoint()
    own = lambda h: costs.lookup(F.col("profile"), {p: h["minutes"][p] for p in costs.FLAT_SPEED_KMH})
    return tiles.join(wanted, tile).select("profile", *tile, F.transform("every", lambda h: F.struct(h["from"].alias("from"), h["to"].alias("to"), *(own(h).alias(n) if n == "minutes" else h[n].alias(n) for n in HOP))).alias("hops"))


def source_tiles(sources: DataFrame, ground: Ground) -> DataFrame:
    """sources (leg_id, end, lat, lng and SETTINGS) with home, their cell, once for each tile of the raster (tile_r, tile_c) within their budget; none for a source without any."""
    placed = tiles_near(sources, ground)
    for k in "rc":
        placed = placed.withColumn(f"tile_{k}", F.explode(F.when(F.col(f"low_{k}") <= F.col(f"high_{k}"), F.sequence(f"low_{k}", f"high_{k}"))))
    return placed.withColumn("home", cell_code(F.col("r"), F.col("c"))).drop("r", "c", "low_r", "high_r", "low_c", "high_c").checkpoint()


def tiles_near(rows: DataFrame, ground: Ground) -> DataFrame:
    """rows (lat, lng, budget and others) with r, c, their cell, and the first and last tiles of the raster within their budget (low_r, high_r, low_c, high_c); where last is before first there are none."""
    size = raster.extent(ground.dem).select("rows", "columns")
    placed = home_cells(rows, ground).crossJoin(F.broadcast(size))  # one row
    for k, last in (("r", "rows"), ("c", "columns")):
        reach = [F.floor((F.col(k) + sign * F.col(f"spread_{k}")) / HOP_TILE) for sign in (-1, 1)]
        placed = placed.withColumns({f"low_{k}": F.greatest(reach[0], F.lit(0)), f"high_{k}": F.least(reach[1], F.floor((F.col(last) - 1) / HOP_TILE))})
    return placed.drop("spread_r", "spread_c", "rows", "columns")


def walkable(placed: DataFrame, ground: Ground) -> DataFrame:
    """leg_id, end, budget, home, steps: for each source and tile within its budget the allowed hops (from, to, cost, meters), priced by its own settings.

    placed: source_tiles. A source meets whole tiles, so it moves some rows of arrays, not one a hop.
    """
    tile = ["profile", "tile_r", "tile_c"]
    priced = lambda h: F.struct(h["from"].alias("from"), h["to"].alias("to"), step_cost(lambda n: h[n] if n in HOP else F.col(n)).alias("cost"), h["distance_m"].alias("meters"))
    allowed = F.filter("hops", lambda h: passable(lambda n: h[n] if n in HOP else F.col(n)))
    return placed.join(hop_tiles(placed.select(*tile).distinct(), ground), tile).select("leg_id", "end", "budget", "home", F.transform(allowed, priced).alias("steps"))


def settle_cells(tiles: pa.Table) -> tuple[int, dict[int, float], dict[int, float], dict[int, int]]:
    """(home, cost, length, previous) of one source's search; from a finish, hops are walked backwards."""
    steps = pa.concat_arrays([c.flatten() for c in tiles["steps"].chunks])
    a, b, cost, meters = (steps.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    if tiles["end"][0].as_py() == "finish":
        a, b = b, a
    order, home = np.lexsort((b, a)), tiles["home"][0].as_py()
    walked = list(zip(*(x[order].tolist() for x in (a, b, cost, meters)), strict=True))
    return (home, *search.settle_labels(walked, home, tiles["budget"][0].as_py()))


def off_trail_reach(sources: DataFrame, ground: Ground) -> DataFrame:
    """leg_id, end, r, c, cost, meters, before_r, before_c: every cell that a source reaches within its budget, and the cell before it on the cheapest way (null at home).

    A cell's length is that of its cheapest label; labels over the budget end there.
    """
    schema = "leg_id string, end string, r long, c long, cost double, meters double, before_r long, before_c long"

    def search_all(tiles: pa.Table) -> pa.Table:
        _, cost, length, previous = settle_cells(tiles)
        cells = sorted(cost)
        n, place = len(cells), lambda keys: [[k if k is None else part(k) for k in keys] for part in (lambda k: k >> 32, lambda k: k & 0xFFFFFFFF)]
        before = place([previous.get(k) for k in cells])
        columns = [[tiles["leg_id"][0].as_py()] * n, [tiles["end"][0].as_py()] * n, *place(cells), [cost[k] for k in cells], [length[k] for k in cells], *before]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return walkable(source_tiles(sources, ground), ground).groupBy("leg_id", "end").applyInArrow(search_all, schema)


def connected(asked: DataFrame, ends: DataFrame, ground: Ground) -> tuple[DataFrame, DataFrame]:
    """((leg_id, end, node, cost), (leg_id, end, node, k, a, b and measures)) of the connectors that hold every rule on their real points.

    A search over cells proposes the cells between; then each proposed line is measured from its real ends, priced as it is walked.
    """
    settings = asked.select("leg_id", *SETTINGS)
    wanted = ends.where("end <> 'goal'").where(geo.distance(geo.Point(F.col("lat"), F.col("lng")), geo.at("t")) <= F.col("budget"))
    there = tiles_near(wanted, ground).withColumns({"own": cell_code(F.col("r"), F.col("c")), "cell": cell_code(*home_cell(ground, F.col("t_lat"), F.col("t_lng")))})
    # Where no tile of the raster is near, only the source's own cell is reached.
    there = there.withColumn("searched", F.expr("low_r <= high_r AND low_c <= high_c")).where("searched OR cell = own")
    targets = written(there.select("leg_id", "end", "node", "lat", "lng", "t_lat", "t_lng", "own", "cell", "searched"))
    sources = targets.where("searched").select("leg_id", "end", "lat", "lng").distinct().join(settings, "leg_id")

    def propose(tiles: pa.Table, asked: pa.Table) -> pa.Table:
        home = asked["own"][0].as_py() if asked.num_rows else 0
        cost, previous = {home: 0.0}, {}  # off the raster a source has no hops, but a target in its own cell
        if asked.num_rows and tiles.num_rows:
            _, cost, _, previous = settle_cells(tiles)
        found: list[tuple] = []
        for leg, end, node, cell in zip(*(asked[c].to_pylist() for c in ("leg_id", "end", "node", "cell")), strict=True):
            if cell not in cost:
                continue
            via = []
            while cell in previous:
                cell = previous[cell]
                if cell != home:
                    via.append({"r": cell >> 32, "c": cell & 0xFFFFFFFF})
            found.append((leg, end, node, via[::-1] if end == "start" else via))
        columns = zip(*found, strict=True) if found else [[]] * 4
        types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("r", pa.int64()), ("c", pa.int64())])))
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["leg_id", "end", "node", "via"])

    tiles = walkable(source_tiles(sources, ground), ground)
    tiles = tiles.toDF(*tiles.columns)  # so that its keys are not taken for those of the targets
    proposed = "leg_id string, end string, node string, via array<struct<r: long, c: long>>"
    lines = tiles.groupBy("leg_id", "end").cogroup(targets.where("searched").select("leg_id", "end", "node", "cell", "own").groupBy("leg_id", "end")).applyInArrow(propose, proposed)
    spots = ["leg_id", "end", "node", "lat", "lng", "t_lat", "t_lng"]
    beside = targets.where("NOT searched").select(*spots, F.array().cast("array<struct<r: long, c: long>>").alias("via"))
    lines = lines.join(targets.where("searched").select(*spots), ["leg_id", "end", "node"]).select(*spots, "via").unionByName(beside)
    own, other = F.struct("lat", "lng"), F.struct(F.col("t_lat").alias("lat"), F.col("t_lng").alias("lng"))
    between = F.transform("via", lambda v: F.struct(*(x.alias(k) for x, k in zip(spot(ground, v["r"], v["c"]), ("lat", "lng"), strict=True))))
    points = F.when(F.col("end") == "start", F.concat(F.array(own), between, F.array(other))).otherwise(F.concat(F.array(other), between, F.array(own)))
    key = ["leg_id", "end", "node", "k"]
    stretches = lines.withColumn("points", points).select("leg_id", "end", "node", F.size("points").alias("n"), "points", F.explode(F.sequence(F.lit(1), F.size("points") - 1)).alias("k"))
    stretches = stretches.select(*key, "n", *(F.col("points")[F.col("k") - i][x].alias(f"{p}_{x}") for p, i in (("a", 1), ("b", 0)) for x in ("lat", "lng"))).join(settings, "leg_id").checkpoint()
    measured = ground.open_ground(stretches, key).where(passable()).checkpoint()
    held = measured.groupBy("leg_id", "end", "node").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.sum("distance_m").alias("meters"), F.first("budget").alias("budget"), F.sum(step_cost()).alias("cost"))
    good = held.where("m = n - 1 AND meters <= budget").select("leg_id", "end", "node", "cost").checkpoint()
    return good, measured.join(good.drop("cost"), ["leg_id", "end", "node"], "left_semi")


METRIC = ["profile", "max_grade_percent", "allow_crossing", "allow_street", "avoid_water"]


def best_ways(asked: DataFrame, entries: DataFrame, goals: DataFrame, ground: Ground, cell_nodes: int | None = None) -> DataFrame:
    """leg_id, entry, goal, cost, edges (array of way_id, pos, a, b in order): each leg's cheapest way from an entry over the network to a goal.

    entries and goals: leg_id, node, cost. Legs that cannot be served have no row, and are refused before any search.
    Legs with the same settings share one overlay, so a task holds a cell, or an overlay, and a bounded number of legs. For a set of rules
    only those components of the whole network are made and priced in which one of its legs has an entry and a goal: no way leaves its component.
    """
    return ways_and_edges(asked, entries, goals, ground, cell_nodes)[0]


def ways_and_edges(asked: DataFrame, entries: DataFrame, goals: DataFrame, ground: Ground, cell_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(best_ways, the edges of the ground among which they were searched)."""
    key = ["way_id", "pos", "a", "b", "profile"]
    named = asked.withColumn("metric", F.concat_ws("|", *(F.col(c).cast("string") for c in METRIC)))
    own = named.select("leg_id", "metric", *METRIC)
    both = reduce(DataFrame.unionByName, (r.select("leg_id", "node", "cost", F.lit(side).alias("side")) for r, side in ((entries, "entry"), (goals, "goal"))))
    first = ground.nodes.select("node", "lat", "lng", F.array_min("ways").alias("way_id"))
    ends = written(both.join(first, "node").join(ground.components, "way_id", "left").select("leg_id", "node", "cost", "side", "lat", "lng", F.coalesce("component", "way_id").alias("component")))
    entries, goals = (ends.where(F.col("side") == side) for side in ("entry", "goal"))
    entries, goals = (written(r.join(other, ["leg_id", "component"], "left_semi")) for r, other in ((entries, goals), (goals, entries)))
    rules = entries.select("leg_id", "component").distinct().join(own, "leg_id").select("metric", *METRIC, "component").distinct().checkpoint()
    needed = rules.select("profile", "component").distinct().where(F.col("profile").isin(list(costs.FLAT_SPEED_KMH)))
    ways = written(needed.withColumn("way_id", F.col("component")).unionByName(needed.join(ground.components, "component")).distinct())
    among = ground.edges_among(ways.select("way_id").distinct())
    each = written(among.join(ways, "way_id"))
    priced = each.join(ground.measures(each, key, F.col("surface_class")), key)
    allowed = costs.edge_allowed(F.col("profile"), F.col("surface_class"), F.col("is_street"), F.col("walkway"), F.col("allow_street"), F.col("crosses_street"), F.col("allow_crossing"), F.col("near_crossing")) & costs.profile_allowed(F.col("max_grade"), F.col("max_grade_percent"), F.col("water_risk"), F.col("avoid_water"), F.col("bridge_or_tunnel"))
    cost = costs.edge_cost(allowed, F.col("minutes"), F.col("water_risk"), F.col("avoid_water"))
    edges = priced.join(rules, ["profile", "component"]).select("metric", "way_id", "pos", "a", "b", cost.alias("cost")).where("cost IS NOT NULL")
    spots = reduce(DataFrame.union, [*(r.select("node", "lat", "lng") for r in (entries, goals)), *(among.select(e, f"{e}_lat", f"{e}_lng") for e in "ab")]).dropDuplicates(["node"])
    return overlay.Overlay(edges, spots, cell_nodes).cheapest(*(r.select("leg_id", "node", "cost").join(own.select("leg_id", "metric"), "leg_id") for r in (entries, goals))), among


def route_hops(asked: DataFrame, ground: Ground) -> DataFrame:
    """request_id, flavor_index, flavor, profile, seq, a, b, surface, mapped, way_name, highway and measures, for the routes all of whose legs were found."""
    ends = ends_of(asked, ground)
    good, lines = connected(asked, ends, ground)
    goals = good.where("end = 'finish'").drop("end").unionByName(ends.where("end = 'goal'").select("leg_id", "node", F.lit(0.0).alias("cost")))
    chosen, edges = ways_and_edges(asked, good.where("end = 'start'").drop("end"), goals, ground)
    chosen = chosen.checkpoint()
    about = asked.select("leg_id", "request_id", "flavor_index", "flavor", "leg", "profile")
    whole = about.join(chosen.select("leg_id", F.lit(1).alias("found")), "leg_id", "left").groupBy("request_id", "flavor_index").agg(F.count("*").alias("n"), F.count("found").alias("m")).where("n = m").select("request_id", "flavor_index")
    line = lambda end, node, part: lines.where(F.col("end") == end).join(chosen.select("leg_id", F.col(node).alias("node")), ["leg_id", "node"]).select("leg_id", F.lit(part).alias("part"), "k", *(f"{p}_{x}" for p in "ab" for x in ("lat", "lng")), F.lit("open-terrain").alias("surface"), F.lit(False).alias("mapped"), F.lit(None).cast("string").alias("way_name"), F.lit(None).cast("string").alias("highway"))
    walked = chosen.select("leg_id", F.posexplode("edges").alias("k", "e")).select("leg_id", F.lit(1).alias("part"), "k", F.col("e.way_id").alias("way_id"), F.col("e.pos").alias("pos"), F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    walked = walked.join(edges, ["way_id", "pos", "a", "b"]).select("leg_id", "part", "k", *(f"{p}_{x}" for p in "ab" for x in ("lat", "lng")), F.col("surface_class").alias("surface"), F.col("is_path").alias("mapped"), F.col("name").alias("way_name"), "highway")
    every = line("start", "entry", 0).unionByName(walked).unionByName(line("finish", "goal", 2)).where(geo.distance(geo.at("a"), geo.at("b")) >= SHORTEST)
    placed = every.join(about, "leg_id").join(whole, ["request_id", "flavor_index"], "left_semi").checkpoint()
    key = ["request_id", "flavor_index", "leg", "part", "k"]
    measured = placed.join(ground.measures(placed, key, F.col("surface")), key)
    return measured.withColumns({"seq": F.col("leg") * 1_000_000_000 + F.col("part") * 100_000_000 + F.col("k"), "meters": F.col("distance_m"), "grade": F.col("change_m") / F.greatest("distance_m", F.lit(1.0))}).drop("leg_id", "leg", "part", "k")


def plan(requests: DataFrame, ground: Ground, has_elevation: bool = True) -> DataFrame:
    """One row per distinct route: request_id, flavor_index, flavor and its totals, surfaces (longest first), way_names, points and signature.

    Of routes of one request with the same signature the first flavour's stays; a request without any route has no row.
    """
    key = F.concat_ws("|", F.col("request_id").cast("string"), "flavor_index")
    rows = route_hops(legs(requests).checkpoint(), ground.stored).withColumn("route", key).checkpoint()
    part = lambda condition: F.sum(F.when(condition, F.col("meters")).otherwise(0.0))
    listed = F.array_sort(F.collect_list(F.struct("seq", "a_lat", "a_lng", "b_lat", "b_lng")))
    rolled = rows.groupBy("route", "request_id", "flavor_index", "flavor").agg(
        F.sum("meters").alias("distance_m"), F.sum(F.greatest("change_m", F.lit(0.0))).alias("ascent_m"), F.sum(F.greatest(-F.col("change_m"), F.lit(0.0))).alias("descent_m"), F.max(F.abs("grade")).alias("max_grade"),
        F.sum("minutes").alias("minutes"), part(F.col("mapped")).alias("mapped_m"), part(F.col("water_risk") > 0.4).alias("water_m"), listed.alias("hops"),
    )
    ends = F.concat(F.transform(F.slice("hops", 1, 1), lambda h: F.struct(h["a_lat"].alias("lat"), h["a_lng"].alias("lng"))), F.transform("hops", lambda h: F.struct(h["b_lat"].alias("lat"), h["b_lng"].alias("lng"))))
    by_surface = routes.surfaces(rows, "route").groupBy("route").agg(F.array_sort(F.collect_list(F.struct((-F.col("meters")).alias("less"), "surface"))).alias("s"))
    by_surface = by_surface.select("route", F.transform("s", lambda s: F.struct(s["surface"].alias("surface"), (-s["less"]).alias("meters"))).alias("surfaces"))
    whole = rolled.withColumns({"points": ends, "off_trail_m": F.greatest(F.col("distance_m") - F.col("mapped_m"), F.lit(0.0)), "confidence": costs.confidence(F.col("mapped_m"), F.col("water_m"), F.col("distance_m"), F.lit(has_elevation))})
    whole = whole.join(routes.longest_off_trail(rows, "route"), "route").join(routes.way_names(rows, "route"), "route", "left").join(by_surface, "route")
    return routes.distinct_alternatives(whole.withColumn("signature", routes.signature(F.col("distance_m"), F.col("points"))).drop("hops", "route"))


def share(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1.0)) * 100).cast("int")


def views(requests: DataFrame, found: DataFrame, box: geo.Box, preferred: str | None = None) -> DataFrame:
    """request_id, status, title, objective, alternatives, notes, warning: what each request is told.

    The route of the preferred objective is shown where there is one, else the first; the others are its alternatives.
    """
    order = F.when(F.col("flavor") == F.lit(preferred), -1).otherwise(F.col("flavor_index"))
    told = F.array_compact(
        F.array(
            F.when(share(F.col("mapped_m"), F.col("distance_m")) > 0, F.concat(share(F.col("mapped_m"), F.col("distance_m")).cast("string"), F.lit("% on mapped ways"))).otherwise("all over open ground"),
            F.when(F.col("off_trail_m") > 0, F.concat(F.round("off_trail_m").cast("int").cast("string"), F.lit(" m off-trail, at most "), F.round("longest_off_trail_m").cast("int").cast("string"), F.lit(" m at a stretch"))).otherwise("never off mapped ways"),
            F.when(F.col("water_m") > 0, F.concat(F.round("water_m").cast("int").cast("string"), F.lit(" m near water"))),
        )
    )
    shown = found.groupBy("request_id").agg(F.min_by("flavor", order).alias("objective"), F.min_by(told, order).alias("notes"), F.array_sort(F.collect_set("flavor")).alias("flavors"))
    points = requests.select("request_id", F.inline("points"))
    title = F.when(F.col("objective").isNull(), "No feasible route").when(F.col("mode") == "nearest", "Nearest mapped path").when((F.col("mode") == "design") & (F.size("points") > 2), F.concat(F.lit("Route through waypoints: "), (F.size("points") - 2).cast("string"))).otherwise("Route to target")
    return requests.join(shown, "request_id", "left").join(search.warnings(points, box).select("request_id", "warning"), "request_id", "left").select(
        "request_id", F.when(F.col("objective").isNull(), "blocked").otherwise("ready").alias("status"), title.alias("title"), "objective", F.filter("flavors", lambda f: f != F.col("objective")).alias("alternatives"), "notes", "warning"
    )
