"""Cheapest ways over a network of any size: cells, an overlay of the nodes at their borders, and component labels.

The network is cut into squares that hold a bounded number of nodes each. For each set of
travel rules (a metric), every cell is searched once on its own: what it costs to cross
it between any two of its border nodes becomes a shortcut, and its connected parts are
labelled. Shortcuts and the edges between cells are the overlay; contracted to the
cells' parts it also gives the components of the whole network, by which requests that cannot be
served are refused before any search. A request then searches its end cells and the overlay, and the
shortcuts on its way are unfolded in their cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import component_labels
from .network import BUCKET

CELL_NODES = 2_000
LEVELS = 16
FINEST = BUCKET / 16
#: Requests that share a cell's or an overlay's task.
TOGETHER = 256

EDGE = "struct<way_id: long, pos: int, a: string, b: string>"
Leaving = dict[str, list[tuple[str, float, tuple]]]


def cells(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """node, cell of nodes (node, lat, lng): the largest square of a hierarchical grid around it with at most limit nodes, or the smallest square if that holds more."""
    row, column = (F.floor(F.col(k) / FINEST) for k in ("lat", "lng"))
    squares = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(row, k).alias("r"), F.shiftright(column, k).alias("c")) for k in range(LEVELS))))
    placed = nodes.select("node", squares.alias("square"))
    fit = placed.groupBy("square").agg(F.count("*").alias("n")).where((F.col("n") <= (limit or CELL_NODES)) | (F.col("square.level") == 0))
    name = F.concat_ws("/", F.col("largest.level"), F.col("largest.r"), F.col("largest.c"))
    return placed.join(fit, "square").groupBy("node").agg(F.max("square").alias("largest")).select("node", name.alias("cell"))


def leaving(edges: pd.DataFrame, backward: bool = False) -> Leaving:
    """For each node its edges as (other node, cost, (way_id, pos, a, b)), cheapest first."""
    found: Leaving = {}
    for way, pos, a, b, cost in edges[["way_id", "pos", "a", "b", "cost"]].sort_values(["cost", "a", "b", "way_id", "pos"]).itertuples(index=False):
        near, far = (b, a) if backward else (a, b)
        found.setdefault(near, []).append((far, cost, (int(way), int(pos), a, b)))
    return found


def settled(links: Leaving, seeds: Iterable[tuple[float, str]], enough: set[str] | None = None) -> dict[str, tuple[float, str, tuple | None, str | None]]:
    """node: (cost, the seed that it is reached from, its last edge, the node before), by Dijkstra; it ends early once all of enough are settled."""
    label: dict[str, tuple] = {}
    for cost, node in sorted(seeds):
        label.setdefault(node, (cost, node, None, None))
    heap, done = sorted((v[0], n) for n, v in label.items()), set()
    left = set(enough) if enough is not None else None
    while heap:
        cost, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if left is not None:
            left.discard(node)
            if not left:
                break
        for other, step, edge in links.get(node, ()):
            if other not in done and (other not in label or cost + step < label[other][0]):
                label[other] = (cost + step, label[node][1], edge, node)
                heapq.heappush(heap, (cost + step, other))
    return {n: v for n, v in label.items() if n in done}


def _dealt(order: str, *of: str) -> Column:
    return F.floor((F.dense_rank().over(Window.partitionBy(*of).orderBy(order)) - 1) / TOGETHER)


class Overlay:
    """The overlay of a network for all metrics that are asked for.

    edges: metric, way_id, pos, a, b, cost, both ways of each segment that the metric allows. nodes: node, lat, lng.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, limit: int | None = None):
        self.cells = cells(nodes, limit).checkpoint()
        for end in "ab":
            edges = edges.join(self.cells.select(F.col("node").alias(end), F.col("cell").alias(f"cell_{end}")), end)
        placed = edges.checkpoint()
        columns = ["metric", "way_id", "pos", "a", "b", "cost"]
        self.inner = placed.where("cell_a = cell_b").select(F.col("cell_a").alias("cell"), *columns)
        self.between = placed.where("cell_a <> cell_b")
        border = [self.between.select("metric", F.col(f"cell_{e}").alias("cell"), F.col(e).alias("node")) for e in "ab"]
        self.border = border[0].union(border[1]).distinct().checkpoint()
        self.parts = self._crossed().checkpoint()

    def _crossed(self) -> DataFrame:
        """metric, cell, u, v, cost: shortcuts between a cell's border nodes; and rows without cost: u lies in the part of the cell that is named v."""

        def cross(edges: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
            key = (edges if len(edges) else border).iloc[0][["metric", "cell"]].tolist()
            links, ends, out = leaving(edges), sorted(set(border["node"])), []
            for u in ends:
                found = settled(links, [(0.0, u)])
                out += [(*key, u, v, found[v][0]) for v in ends if v != u and v in found]
            part: dict[str, str] = {}
            for start in sorted({*links, *edges["b"], *ends}):  # a segment is allowed both ways or not at all
                if start not in part:
                    for node in settled(links, [(0.0, start)]):
                        part[node] = start
            return pd.DataFrame(out + [(*key, u, v, None) for u, v in part.items()], columns=["metric", "cell", "u", "v", "cost"])

        own = ["metric", "cell"]
        return self.inner.groupBy(*own).cogroup(self.border.groupBy(*own)).applyInPandas(cross, "metric string, cell string, u string, v string, cost double")

    def components(self) -> DataFrame:
        """metric, node, component, for nodes with any edge: from the cells' parts and the edges between cells."""
        part = self.parts.where("cost IS NULL").select("metric", F.col("u").alias("node"), F.col("v").alias("part"))
        links = self.between.select("metric", "a", "b")
        for end in "ab":
            links = links.join(part.select("metric", F.col("node").alias(end), F.struct("metric", "part").alias(f"part_{end}")), ["metric", end])
        joined = component_labels(links.select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))).select(F.col("id.metric").alias("metric"), F.col("id.part").alias("part"), F.col("component.part").alias("component"))
        return part.join(joined, ["metric", "part"], "left").select("metric", "node", F.coalesce("component", "part").alias("component"))

    def servable(self, entries: DataFrame, goals: DataFrame) -> tuple[DataFrame, DataFrame]:
        """entries and goals (leg_id, metric, node, cost) without those that no goal, or no entry, of their leg shares a component with. A node without any allowed edge is a component of its own."""
        labels = self.components()
        entries, goals = (r.join(labels, ["metric", "node"], "left").withColumn("component", F.coalesce("component", "node")).checkpoint() for r in (entries, goals))
        return entries.join(goals, ["leg_id", "component"], "left_semi").drop("component"), goals.join(entries, ["leg_id", "component"], "left_semi").drop("component")

    def _beside(self, rows: DataFrame, order: str, more: DataFrame | None = None):
        """rows (metric, cell, ...) with the edges of their cells, in groups of at most TOGETHER values of order; rows of more go to every group of their cell."""
        own = ["metric", "cell", "salt"]
        dealt = rows.withColumn("salt", _dealt(order, "metric", "cell")).checkpoint()
        groups = dealt.select(*own).distinct().toDF(*own)
        asked = dealt if more is None else dealt.unionByName(groups.join(more, ["metric", "cell"]), allowMissingColumns=True)
        beside = self.inner.join(groups, ["metric", "cell"])
        return beside.toDF(*beside.columns).groupBy(*own).cogroup(asked.groupBy(*own))  # renamed, so that its keys are not taken for those of the rows

    def _ends(self, entries: DataFrame, goals: DataFrame) -> DataFrame:
        """leg_id, metric, kind, cell, u, v, cost: from an entry to a border node, from one to a goal, or within one cell from entry to goal (kind direct)."""
        columns = ["leg_id", "metric", "cell", "kind", "node", "cost"]
        rows = entries.withColumn("kind", F.lit("entry")).unionByName(goals.withColumn("kind", F.lit("goal"))).join(self.cells, "node").select(*columns)
        border = self.border.withColumn("kind", F.lit("border"))

        def search(edges: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            metric, cell = asked.iloc[0][["metric", "cell"]]
            ahead, back = leaving(edges), leaving(edges, backward=True)
            border, out = asked.loc[asked["kind"] == "border", "node"].tolist(), []
            for leg, rows in asked[asked["kind"] != "border"].groupby("leg_id", sort=True):
                seeds = {k: [(float(c), n) for n, c in r[["node", "cost"]].itertuples(index=False)] for k, r in rows.groupby("kind")}
                if "entry" in seeds:
                    found = settled(ahead, seeds["entry"])
                    out += [(leg, metric, "entry", cell, found[v][1], v, found[v][0]) for v in border if v in found]
                    direct = [(found[v][0] + c, found[v][1], v) for c, v in seeds.get("goal", ()) if v in found]
                    if direct:
                        cost, u, v = min(direct)
                        out.append((leg, metric, "direct", cell, u, v, cost))
                if "goal" in seeds:
                    found = settled(back, seeds["goal"])
                    out += [(leg, metric, "goal", cell, u, found[u][1], found[u][0]) for u in border if u in found]
            return pd.DataFrame(out, columns=["leg_id", "metric", "kind", "cell", "u", "v", "cost"])

        return self._beside(rows, "leg_id", border).applyInPandas(search, "leg_id string, metric string, kind string, cell string, u string, v string, cost double")

    def _chosen(self, ends: DataFrame) -> DataFrame:
        """leg_id, metric, entry, goal, cost, pieces (in order: an edge between cells, or a way within a cell from u to v)."""
        arcs = self.parts.where("cost IS NOT NULL").select("metric", "cell", "u", "v", "cost", F.lit(0).cast("long").alias("way_id"), F.lit(0).alias("pos"))
        arcs = arcs.unionByName(self.between.select("metric", F.lit(None).cast("string").alias("cell"), F.col("a").alias("u"), F.col("b").alias("v"), "cost", "way_id", "pos"))
        dealt = ends.withColumn("salt", _dealt("leg_id", "metric")).checkpoint()
        own = ["metric", "salt"]
        piece = "struct<cell: string, u: string, v: string, way_id: long, pos: int>"

        def choose(arcs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            links: Leaving = {}
            for cell, u, v, cost, way, pos in arcs[["cell", "u", "v", "cost", "way_id", "pos"]].sort_values(["cost", "u", "v", "way_id", "pos"]).itertuples(index=False):
                links.setdefault(u, []).append((v, cost, (None, u, v, int(way), int(pos)) if cell is None else (cell, u, v, None, None)))
            out = []
            for leg, rows in asked.groupby("leg_id", sort=True):
                best, pieces, ends_at = None, [], None
                for cell, u, v, cost in rows.loc[rows["kind"] == "direct", ["cell", "u", "v", "cost"]].itertuples(index=False):
                    if best is None or (cost, u, v) < best[:3]:
                        best, pieces, ends_at = (cost, u, v), [(cell, u, v, None, None)], (u, v)
                first, last = ({}, {})
                for kept, side, node in ((first, "entry", "v"), (last, "goal", "u")):
                    for cell, u, v, cost in rows.loc[rows["kind"] == side, ["cell", "u", "v", "cost"]].itertuples(index=False):
                        at = v if node == "v" else u
                        if at not in kept or (cost, u, v) < kept[at][:3]:
                            kept[at] = (cost, u, v, cell)
                if first and last:
                    found = settled(links, [(c[0], n) for n, c in first.items()], set(last))
                    over = min(((found[n][0] + c[0], n) for n, c in last.items() if n in found), default=None)
                    if over is not None and (best is None or over[0] < best[0]):
                        at, walked = over[1], []
                        while found[at][2] is not None:
                            walked.append(found[at][2])
                            at = found[at][3]
                        (_, u, v, cell), (_, u2, v2, cell2) = first[at], last[over[1]]
                        best, pieces, ends_at = (over[0], u, v2), [(cell, u, v, None, None), *walked[::-1], (cell2, u2, v2, None, None)], (u, v2)
                if best is not None:
                    out.append((leg, rows["metric"].iloc[0], *ends_at, best[0], [dict(zip(("cell", "u", "v", "way_id", "pos"), p, strict=True)) for p in pieces if p[1] != p[2]]))
            return pd.DataFrame(out, columns=["leg_id", "metric", "entry", "goal", "cost", "pieces"])

        sent = arcs.join(dealt.select(*own).distinct().toDF(*own), "metric")
        return sent.toDF(*sent.columns).groupBy(*own).cogroup(dealt.groupBy(*own)).applyInPandas(choose, f"leg_id string, metric string, entry string, goal string, cost double, pieces array<{piece}>")

    def _unfolded(self, wanted: DataFrame) -> DataFrame:
        """wanted (metric, cell, u, v) with edges, the cheapest way from u to v within the cell."""

        def unfold(edges: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            links, out = leaving(edges), []
            for u, rows in asked.groupby("u", sort=True):
                found = settled(links, [(0.0, u)], set(rows["v"]))
                for v in rows["v"]:
                    at, walked = v, []
                    while found[at][2] is not None:
                        walked.append(dict(zip(("way_id", "pos", "a", "b"), found[at][2], strict=True)))
                        at = found[at][3]
                    out.append((*rows.iloc[0][["metric", "cell"]], u, v, walked[::-1]))
            return pd.DataFrame(out, columns=["metric", "cell", "u", "v", "edges"])

        return self._beside(wanted, "u").applyInPandas(unfold, f"metric string, cell string, u string, v string, edges array<{EDGE}>")

    def cheapest(self, entries: DataFrame, goals: DataFrame) -> DataFrame:
        """leg_id, entry, goal, cost, edges (array of way_id, pos, a, b in order). entries and goals: leg_id, metric, node, cost; legs that cannot be served have no row."""
        chosen = self._chosen(self._ends(*self.servable(entries, goals))).checkpoint()
        pieces = chosen.select("leg_id", "metric", F.posexplode("pieces").alias("k", "p")).select("leg_id", "metric", "k", "p.*")
        within = pieces.where("cell IS NOT NULL")
        unfolded = within.join(self._unfolded(within.select("metric", "cell", "u", "v").distinct()), ["metric", "cell", "u", "v"]).select("leg_id", "k", "edges")
        across = pieces.where("cell IS NULL").select("leg_id", "k", F.array(F.struct("way_id", "pos", F.col("u").alias("a"), F.col("v").alias("b"))).cast(f"array<{EDGE}>").alias("edges"))
        walked = unfolded.unionByName(across).groupBy("leg_id").agg(F.array_sort(F.collect_list(F.struct("k", "edges"))).alias("parts")).select("leg_id", F.flatten("parts.edges").alias("edges"))
        return chosen.join(walked, "leg_id", "left").select("leg_id", "entry", "goal", "cost", F.coalesce("edges", F.array().cast(f"array<{EDGE}>")).alias("edges"))
