"""Contour lines: segments of marching squares joined, put in order and simplified.

Segments are joined in square tiles of the raster first; what is left, chains that end at a tile's border or where more
than two segments meet, is ranked by pointer doubling. So no task holds a level or a whole line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.numeric import js_round

from . import raster
from .checkpoints import written
from .components import component_labels

#: Cells to a tile's side, and the most points of a line that are simplified in one task.
TILE = 256
STRETCH = 50_000
#: Ends are the same where they round to the same millionth of a degree.
SPOT = 1e-6


def trails(ends: list[tuple[Hashable, Hashable]], keys: list[tuple] | None = None) -> list[list[tuple[int, bool]]]:
    """Join links at shared ends, in their order: each trail grows at its tail, then at its head.

    A trail lists its links as (index, whether it runs from its first end to its second). Where several links are
    free the one with the least key at that end goes on; without keys, the first.
    """
    at: dict[Hashable, list[tuple]] = {}
    for k, pair in enumerate(ends):
        for e, spot in enumerate(pair):
            at.setdefault(spot, []).append((keys[k][e] if keys else k, k))
    for links in at.values():
        links.sort()
    used = [False] * len(ends)

    def grow(tip: Hashable) -> list[tuple[int, bool]]:
        grown = []
        while (k := next((k for _, k in at[tip] if not used[k]), None)) is not None:
            used[k] = True
            forward = ends[k][0] == tip
            grown.append((k, forward))
            tip = ends[k][forward]
        return grown

    found = []
    for k, (a, b) in enumerate(ends):
        if not used[k]:
            used[k] = True
            tail = grow(b)
            found.append([(j, not forward) for j, forward in reversed(grow(a))] + [(k, True)] + tail)
    return found


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker; the ends stay."""
    return points[kept(points, tolerance)]


def kept(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        first, last = todo.pop()
        if last - first < 2:
            continue
        base, along, inner = points[first], points[last] - points[first], points[first + 1 : last]
        squared = along @ along
        t = np.clip((inner - base) @ along / squared, 0, 1) if squared else np.zeros(len(inner))
        gap = np.hypot(*(inner - (base + t[:, None] * along)).T)
        worst = int(gap.argmax())
        if gap[worst] > tolerance:
            keep[first + 1 + worst] = True
            todo += [(first, first + 1 + worst), (first + 1 + worst, last)]
    return keep


def tile_chains(segments: DataFrame, lat_step: float, lng_step: float) -> DataFrame:
    """level, chain, m, k0, lat, lng, start_at, start_key, end_at, end_key, closed: what one tile joins of one level.

    segments: level, tile_r, tile_c, key, and of either end its spot, place in the grid (_r, _c), lat and lng. A chain ends at
    the tile's border, where more or less than two segments meet, or is closed. It is named by its least segment, which
    is its k0-th of m and gives it its direction.
    """
    size = TILE

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key").reset_index(drop=True)
        keys = group["key"].to_numpy()
        spots = list(zip(group["a_at"], group["b_at"], strict=True))
        met = Counter(spot for pair in spots for spot in pair)
        loose = {spot for spot, n in met.items() if n > 2}
        for end in ("a", "b"):
            near = np.zeros(len(group), bool)
            for axis, step in (("r", lat_step), ("c", lng_step)):
                at = group[f"{end}_{axis}"].to_numpy() - group[f"tile_{axis}"].to_numpy() * size
                near |= np.minimum(np.abs(at), np.abs(at - size)) * step <= 2 * SPOT
            loose.update(group.loc[near, f"{end}_at"])
        ends = [tuple((spot, k, e) if spot in loose else spot for e, spot in enumerate(pair)) for k, pair in enumerate(spots)]
        place = {x: group[[f"a_{x}", f"b_{x}"]].to_numpy() for x in ("lat", "lng")}
        rows = []
        for trail in trails(ends):
            k, forward = np.array([k for k, _ in trail]), np.array([int(f) for _, f in trail])
            start, end = (trail[0][0], 1 - forward[0]), (trail[-1][0], forward[-1])
            closed = ends[start[0]][start[1]] == ends[end[0]][end[1]]
            line = [np.append(place[x][start], place[x][k, forward]) for x in ("lat", "lng")]
            least = int(k.argmin())
            rows.append((group["level"].iloc[0], keys[k[least]], len(k), least, *line, spots[start[0]][start[1]], keys[k[0]], spots[end[0]][end[1]], keys[k[-1]], bool(closed)))
        return pd.DataFrame(rows, columns=["level", "chain", "m", "k0", "lat", "lng", "start_at", "start_key", "end_at", "end_key", "closed"])

    schema = "level double, chain long, m long, k0 long, lat array<double>, lng array<double>, start_at string, start_key long, end_at string, end_key long, closed boolean"
    return segments.groupBy("level", "tile_r", "tile_c").applyInPandas(joined, schema)


def ends_of(rows: DataFrame, name: str) -> DataFrame:
    """level, name, end (0 or 1), spot and key of both ends."""
    each = F.array(*(F.struct(F.lit(e).alias("end"), F.col(f"{x}_at").alias("spot"), F.col(f"{x}_key").alias("key")) for e, x in enumerate(("start", "end"))))
    return rows.where("NOT closed").select("level", name, F.inline(each))


def joined_by(links: DataFrame, one: Column, two: Column, name: str, label: str) -> DataFrame:
    """level, name, label: the least of those that links lead to."""
    named = lambda x: F.struct("level", x.alias("of"))
    found = component_labels(links.select(named(one).alias("a"), named(two).alias("b")))
    return found.select(F.col("id.level").alias("level"), F.col("id.of").alias(name), F.col("component.of").alias(label))


def ranked(chains: DataFrame) -> DataFrame:
    """chains with way (the least chain of all that follow one another at spots where just two meet), pos, forward and ring.

    pos is the place of a chain's segments along the way, counted from the way's least chain: each chain learns in doubling
    steps how many segments lie between it and that one, and at which of its ends. A ring is cut at its least chain.
    """
    met = ends_of(chains, "chain").groupBy("level", "spot").agg(F.count("*").alias("n"), F.min(F.struct("chain", "end")).alias("one"), F.max(F.struct("chain", "end")).alias("two"))
    pairs = written(met.where("n = 2").select("level", "one", "two"))
    own = pairs.where("one.chain = two.chain").select("level", F.col("one.chain").alias("chain"), F.lit(True).alias("own"))
    links = pairs.where("one.chain <> two.chain")
    labels = joined_by(links, F.col("one.chain"), F.col("two.chain"), "chain", "way")

    turned = links.select("level", F.col("two").alias("one"), F.col("one").alias("two"))
    hops = links.union(turned).select("level", F.col("one.chain").alias("chain"), F.col("one.end").alias("out"), F.col("two.chain").alias("to"), (1 - F.col("two.end")).alias("to_out"))
    first = hops.join(labels.where("chain <> way"), ["level", "chain"]).join(chains.select("level", F.col("chain").alias("to"), F.col("m").alias("between")), ["level", "to"])
    there = F.col("to") == F.col("way")
    state = written(first.select("level", "chain", "out", "to", "to_out", F.when(there, 0).otherwise(F.col("between")).alias("between"), F.when(there, 1 - F.col("to_out")).alias("side")))
    while not state.where("side IS NULL").isEmpty():
        on = state.select("level", F.col("chain").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("next"), F.col("to_out").alias("next_out"), F.col("between").alias("more"), F.col("side").alias("next_side"))
        open_ = F.col("side").isNull()
        step = lambda old, new: F.when(open_, F.col(new)).otherwise(F.col(old)).alias(old)
        # One join a round and no union, so that the number of partitions stays as it is.
        doubled = state.join(on, ["level", "to", "to_out"], "left").where(~open_ | F.col("next").isNotNull())
        state = written(doubled.select("level", "chain", "out", step("to", "next"), step("to_out", "next_out"), F.when(open_, F.col("between") + F.col("more")).otherwise(F.col("between")).alias("between"), step("side", "next_side")))

    reached = state.groupBy("level", "chain").agg(F.max(F.struct("side", "out", "between")).alias("s"), (F.count("*") > 1).alias("both"))
    heads = chains.select("level", F.col("chain").alias("way"), F.col("m").alias("head_m"))
    put = chains.join(labels, ["level", "chain"], "left").withColumn("way", F.coalesce("way", "chain")).join(reached, ["level", "chain"], "left").join(heads, ["level", "way"]).join(own, ["level", "chain"], "left")
    after = F.col("s.side") == 1
    pos = F.when(F.col("s").isNull(), 0).when(after, F.col("head_m") + F.col("s.between")).otherwise(-F.col("s.between") - F.col("m"))
    forward = F.col("s").isNull() | (after == (F.col("s.out") == 0))
    ring = F.col("closed") | F.coalesce("own", "both", F.lit(False))
    return put.select("level", "way", "chain", pos.alias("pos"), forward.alias("forward"), ring.alias("ring"), *(c for c in chains.columns if c not in ("level", "chain")))


def ways(chains: DataFrame) -> DataFrame:
    """level, way, low (its least pos), m, k0, closed, and of either end its spot and key."""
    side = lambda x, y: F.when(F.col("forward"), F.struct(f"{x}_at", f"{x}_key")).otherwise(F.struct(F.col(f"{y}_at").alias(f"{x}_at"), F.col(f"{y}_key").alias(f"{x}_key")))
    found = chains.groupBy("level", "way").agg(
        F.min("pos").alias("low"), F.sum("m").alias("m"), F.max(F.when(F.col("chain") == F.col("way"), F.col("k0"))).alias("k0"), F.max("ring").alias("closed"), F.min_by(side("start", "end"), "pos").alias("s"), F.max_by(side("end", "start"), "pos").alias("e")
    )
    return found.select("level", "way", "low", "m", (F.col("k0") - F.col("low")).alias("k0"), "closed", "s.*", "e.*")


def parts(found: DataFrame) -> DataFrame:
    """level, way, low, first, last, line, at, forward: segments first to last - 1 of a way come at `at` in a line.

    A ring starts at its least segment. Ways that meet at spots of more than two ends are joined in one task for all that
    hang together, a row a way: at each spot the least free segment goes on, first behind and then before the line's
    least segment, so a way is cut there.
    """
    spots = ends_of(found, "way").groupBy("level", "spot").agg(F.count("*").alias("n"), F.min("way").alias("least"))
    links = written(ends_of(found, "way").join(spots.where("n > 1"), ["level", "spot"]).select("level", "way", "least").distinct())
    knots = joined_by(links, F.col("way"), F.col("least"), "way", "knot")

    def wound(group: pd.DataFrame) -> pd.DataFrame:
        cut = []
        for w in group.sort_values("way").itertuples(index=False):
            names = [(w.way, 0), (w.way, 1)]
            inner = [(w.k0, w.k0 + 1, w.start_at if w.k0 == 0 else names[0], w.end_at if w.k0 + 1 == w.m else names[1], w.way, w.way)]
            inner += [(0, w.k0, w.start_at, names[0], w.start_key, w.way)] if w.k0 else []
            inner += [(w.k0 + 1, w.m, names[1], w.end_at, w.way, w.end_key)] if w.k0 + 1 < w.m else []
            cut += [(w.way, w.low, *piece) for piece in inner]
        rows = []
        for trail in trails([(c[4], c[5]) for c in cut], [(c[6], c[7]) for c in cut]):
            at, line = 0, min(cut[k][0] for k, _ in trail)
            for k, forward in trail:
                way, low, first, last = cut[k][:4]
                rows.append((group["level"].iloc[0], way, low, first, last, line, at, forward))
                at += last - first
        return pd.DataFrame(rows, columns=["level", "way", "low", "first", "last", "line", "at", "forward"])

    schema = "level double, way long, low long, first long, last long, line long, at long, forward boolean"
    knotted = found.join(knots, ["level", "way"]).groupBy("level", "knot").applyInPandas(wound, schema)
    piece = lambda first, last, at: F.struct(first.alias("first"), last.alias("last"), at.alias("at"))
    zero, k0, m = F.lit(0).cast("long"), F.col("k0"), F.col("m")
    turned = F.when(F.col("closed"), F.array(piece(k0, m, zero), piece(zero, k0, m - k0))).otherwise(F.array(piece(zero, m, zero)))
    plain = found.join(knots, ["level", "way"], "left_anti").select("level", "way", "low", F.col("way").alias("line"), F.inline(turned)).where("first < last")
    return plain.withColumn("forward", F.lit(True)).unionByName(knotted)


def points_of(chains: DataFrame, pieces: DataFrame) -> DataFrame:
    """level, line, pos, lat, lng: the points of every line, numbered from 0."""
    held = chains.withColumn("way_forward", F.col("forward")).drop("forward", "m").join(pieces, ["level", "way"])
    j = F.col("j")
    size = F.size("lat") - 1
    s = F.col("pos") - F.col("low") + F.when(F.col("way_forward"), j).otherwise(size - 1 - j)
    each = held.withColumn("j", F.explode(F.sequence(F.lit(0), size - 1))).withColumn("s", s).where("s >= first AND s < last")
    along = F.when(F.col("forward"), F.col("s") - F.col("first")).otherwise(F.col("last") - 1 - F.col("s"))
    each = each.withColumn("k", F.col("at") + along).withColumn("end", j + F.when(F.col("way_forward") == F.col("forward"), 1).otherwise(0))
    place = lambda pos, at: F.struct(pos.alias("pos"), F.get("lat", at).alias("lat"), F.get("lng", at).alias("lng"))
    far, near = place(F.col("k") + 1, F.col("end")), place(F.col("k"), 2 * j + 1 - F.col("end"))
    return each.select("level", "line", F.inline(F.when(F.col("k") == 0, F.array(near, far)).otherwise(F.array(far))))


def simplified(points: DataFrame, tolerance: float, minimum: int) -> DataFrame:
    """level, line, points (array of pos, lat, lng): the points that Douglas-Peucker keeps of lines with at least minimum points.

    Stretches of more than STRETCH points are split by Spark at their farthest point, one aggregation a round, until
    they fit a task; the result is the same.
    """
    spot = F.struct("pos", "lat", "lng")
    size = written(points.groupBy("level", "line").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where(F.col("hi.pos") + 1 >= minimum))
    stay = size.select("level", "line", F.explode(F.array("lo", "hi")).alias("p")).select("level", "line", "p.*")
    todo = written(points.join(size, ["level", "line"]).where("pos > lo.pos AND pos < hi.pos"))
    is_long = F.col("hi.pos") - F.col("lo.pos") >= STRETCH
    ready = todo.where(~is_long)
    todo = todo.where(is_long)
    dy, dx = F.col("hi.lat") - F.col("lo.lat"), F.col("hi.lng") - F.col("lo.lng")
    y, x = F.col("lat") - F.col("lo.lat"), F.col("lng") - F.col("lo.lng")
    squared = dy * dy + dx * dx
    t = F.when(squared > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y * dy + x * dx) / squared))).otherwise(0.0)
    gap = F.hypot(y - t * dy, x - t * dx)
    while not todo.isEmpty():
        worst = written(todo.groupBy("level", "line", F.col("lo.pos").alias("from")).agg(F.max(F.struct(gap.alias("gap"), (-F.col("pos")).alias("first"), spot.alias("p"))).alias("w")).where(F.col("w.gap") > tolerance).select("level", "line", "from", F.col("w.p").alias("mid")))
        stay = stay.unionByName(worst.select("level", "line", "mid.*"))
        before = F.col("pos") < F.col("mid.pos")
        split = todo.withColumn("from", F.col("lo.pos")).join(worst, ["level", "line", "from"]).where("pos <> mid.pos")
        todo = written(split.select("level", "line", "pos", "lat", "lng", F.when(before, F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(before, F.col("mid")).otherwise(F.col("hi")).alias("hi")))
        ready = ready.unionByName(todo.where(~is_long))
        todo = todo.where(is_long)

    def short(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        ends = group[["lo_lat", "lo_lng", "hi_lat", "hi_lng"]].iloc[0].to_numpy(float)
        whole = np.vstack([ends[:2], group[["lat", "lng"]].to_numpy(float), ends[2:]])
        return group.loc[kept(whole, tolerance)[1:-1], ["level", "line", "pos", "lat", "lng"]]

    flat = ready.select("level", "line", "pos", "lat", "lng", F.col("lo.pos").alias("from"), *(F.col(f"{e}.{v}").alias(f"{e}_{v}") for e in ("lo", "hi") for v in ("lat", "lng")))
    inner = flat.groupBy("level", "line", "from").applyInPandas(short, "level double, line long, pos long, lat double, lng double")
    return stay.unionByName(inner).groupBy("level", "line").agg(F.array_sort(F.collect_list(spot)).alias("points"))


def contour_lines(dem: DataFrame, interval: float, north: float, west: float, lat_step: float, lng_step: float, minimum: int = 4, passes: int = 0) -> DataFrame:
    """elevation, is_index, points (array of (lat, lng)).

    The lines are those of joining all segments of a level one by one in raster order, whatever TILE and STRETCH are.
    A bad interval gives no lines.
    """
    if not (interval > 0 and np.isfinite(interval)):
        return dem.sparkSession.createDataFrame([], "elevation double, is_index boolean, points array<struct<lat: double, lng: double>>")
    smoothed = raster.smooth(dem, passes) if passes else dem
    place = {f"{e}_{x}": origin + F.col(f"{e}_{axis}") * step for e in "ab" for x, axis, origin, step in (("lat", "r", F.lit(north), -lat_step), ("lng", "c", F.lit(west), lng_step))}
    spots = {f"{e}_at": F.concat_ws(",", *(F.round(F.col(f"{e}_{x}") * 1e6).cast("long") for x in ("lat", "lng"))) for e in "ab"}
    key = (F.shiftleft(F.col("r").cast("long"), 31) + F.col("c")) * 2 + F.col("part")
    tile = {f"tile_{x}": F.floor(F.col(x) / TILE) for x in ("r", "c")}
    segments = raster.marching_squares(smoothed, interval).withColumns(place | {"key": key} | tile).withColumns(spots)
    chains = written(ranked(written(tile_chains(segments, lat_step, lng_step))))
    points = points_of(chains, parts(written(ways(chains))))
    found = simplified(points, min(lat_step, lng_step) * 0.35, minimum)
    bare = F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng")))
    return found.select(F.round("level", 2).alias("elevation"), (js_round(F.col("level") / interval) % 5 == 0).alias("is_index"), bare.alias("points"))
