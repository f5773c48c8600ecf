"""What a search off the network needs: headings, the order in which labels settle, and warnings of points outside the survey."""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions import geo

REACH = 2
HEADINGS = [(r, c) for r in range(-REACH, REACH + 1) for c in range(-REACH, REACH + 1) if gcd(abs(r), abs(c)) == 1]


def settle_labels(hops: list[tuple[int, int, float, float]], start: int, budget: float) -> tuple[dict[int, float], dict[int, float], dict[int, int]]:
    """(cost, length, previous) of what can be reached: a node's length is that of its cheapest label, and labels over the budget end there."""
    by: dict[int, list[tuple[int, float, float]]] = {}
    for a, b, cost, meters in hops:
        by.setdefault(a, []).append((b, cost, meters))
    cost, length, previous, done = {start: 0.0}, {start: 0.0}, {}, set()
    heap = [(0.0, start)]
    while heap:
        c, a = heapq.heappop(heap)
        if a in done:
            continue
        done.add(a)
        for b, step, meters in by.get(a, ()):
            if length[a] + meters <= budget and c + step < cost.get(b, float("inf")):
                cost[b], length[b], previous[b] = c + step, length[a] + meters, a
                heapq.heappush(heap, (c + step, b))
    return cost, length, previous


def warnings(points: DataFrame, box: geo.Box) -> DataFrame:
    """request_id, outside, warning of requests with points outside the surveyed box; heights there are the nearest edge's, not measured."""
    outside = F.count_if(~geo.contains(box, geo.Point(F.col("lat"), F.col("lng"))))
    counted = points.groupBy("request_id").agg(outside.alias("outside")).where("outside > 0")
    sits = F.when(F.col("outside") == 1, "1 point sits").otherwise(F.concat(F.col("outside").cast("string"), F.lit(" points sit")))
    return counted.withColumn("warning", F.concat(sits, F.lit(" outside the surveyed area; heights there are not measured.")))
