import json
import math
import re

import pytest
from pyspark.sql import functions as F

from crestline.functions import costs, geo, numeric, tags, text
from crestline.plans import exchange


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_rounding_is_half_up_and_exact(spark):
    values = [2.5, -2.5, 0.49999999999999994, -0.5, 1.2, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(numeric.js_round(F.col("x"))).collect()
    assert [r[0] for r in rows] == [3, -2, 0, 0, 1, None]


def test_absent_numbers_are_zero_and_words_fall_back(spark):
    rows = spark.createDataFrame([(None,), ("",), ("7.5",), ("steep",)], "x string").select(numeric.number_or(F.col("x"), F.lit(35.0))).collect()
    assert [r[0] for r in rows] == [0.0, 0.0, 7.5, 35.0]


def test_climbing_is_fastest_at_the_critical_grade(spark):
    rows = spark.range(0, 900).select((F.col("id") / 1000).alias("g")).select("g", (F.col("g") * costs.grade_speed_factor(F.col("g"))).alias("gain"))
    best = rows.agg(F.max_by("g", "gain")).first()[0]
    assert best == pytest.approx(costs.CRITICAL_GRADE, abs=1e-3)
    assert one(spark, costs.grade_speed_factor(F.lit(0.0))) == pytest.approx(1.0)


def test_speed_never_drops_below_six_metres_a_minute(spark):
    assert one(spark, costs.meters_per_minute(F.lit("mtb"), F.lit(1.0), F.lit("steps"))) == 6.0


def test_surface_rules_keep_their_order(spark):
    rows = [("unpaved", None, "paved"), ("woodchips", None, "paved"), ("fine_gravel", None, "gravel"), ("mud", None, "natural-trail"), (None, "grade1", "paved"), (None, "grade3", "gravel"), (None, "grade5", "natural-trail"), (None, None, "natural-trail")]
    df = spark.createDataFrame(rows, "s string, t string, want string")
    got = df.select(tags.surface_class(F.lit("path"), F.lit("path"), F.col("s"), F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_foot_wins_over_access(spark):
    df = spark.createDataFrame([("yes", "private", False), ("no", None, True), (None, "private", True), (None, None, False), (" Designated", "no", False)], "f string, a string, want boolean")
    assert all(r.got == r.want for r in df.select(tags.is_restricted(F.col("f"), F.col("a")).alias("got"), "want").collect())


def test_category_precedence(spark):
    c = lambda h, w, n, b: one(spark, tags.category(*(F.lit(v).cast("string") for v in (h, w, n, b))))
    assert [c("path", "stream", None, "wall"), c("track", None, None, None), c(None, "stream", None, "wall"), c(None, None, "water", None), c(None, None, None, "wall"), c("motorway", None, None, None)] == ["path", "road", "water", "water", "barrier", None]


def test_parallel_segments_meet_at_a_shared_end(spark):
    p = [geo.fixed_point(*x) for x in ((54.46, 18.51), (54.46, 18.52), (54.46, 18.52), (54.46, 18.53))]
    assert tuple(one(spark, geo.intersection(*p))) == (54.46, 18.52)
    far = [geo.fixed_point(*x) for x in ((54.46, 18.51), (54.46, 18.52), (54.47, 18.51), (54.47, 18.52))]
    assert one(spark, geo.intersection(*far)) is None
    assert one(spark, geo.parallel(*far)) is True


def test_projection_matches_a_published_point(spark):
    x, y = one(spark, geo.to_poland_1992(geo.fixed_point(52.0, 19.0)))
    assert x == pytest.approx(500_000, abs=0.01)
    meridian = 0.9993 * 5763343.55  # length of the GRS80 meridian to 52 degrees north
    assert y == pytest.approx(meridian - 5_300_000, abs=2.0)


def test_terrarium_and_tiles(spark):
    assert one(spark, geo.terrarium_height(F.lit(128), F.lit(100), F.lit(128))) == 100.5
    assert one(spark, geo.tile_x(F.lit(0.0), 1), geo.tile_y(F.lit(0.0), 1)) == pytest.approx((1.0, 1.0))
    assert one(spark, geo.tile_url("http://t/{z}/{x}/{y}.png", 13, F.lit(4), F.lit(5))) == "http://t/13/4/5.png"


def test_xml_names_are_escaped(spark):
    assert one(spark, text.escape_xml(F.lit('a & <b> "c" \'d\''))) == "a &amp; &lt;b&gt; &quot;c&quot; 'd'"
    assert one(spark, text.decode_point(F.lit("54.1,x"))) is None
    assert math.isclose(one(spark, text.nice_scale(F.lit(260.0))), 200.0)


def test_exports_carry_the_heights_that_were_sampled(spark):
    points = spark.createDataFrame([(u, k, 54.5 + k / 1000, 18.4) for u in (1, 2, 3) for k in range(3)], "user_id long, seq int, lat double, lng double")
    heights = spark.createDataFrame([(u, k, 10.0 * u + k) for u in (1, 2) for k in range(2)], "user_id long, seq int, z double")
    made = exchange.exported(points, heights, F.lit('a "b" & c'), F.when(F.col("user_id") == 2, "geojson").otherwise("gpx"))
    got = {r.user_id: r for r in made.collect()}
    assert [got[u].media_type for u in (1, 2, 3)] == ["application/gpx+xml", "application/geo+json", "application/gpx+xml"]
    assert re.findall("<ele>(.*?)</ele>", got[1].text) == ["10.0", "11.0"] and got[1].text.count("<trkpt") == 3 and "<name>a &quot;b&quot; &amp; c</name>" in got[1].text
    feature = json.loads(got[2].text)
    assert feature["geometry"]["coordinates"] == [[18.4, 54.5, 20.0], [18.4, 54.501, 21.0], [18.4, 54.502]] and feature["properties"]["elevationSource"] == "elevation-tiles"
    assert "<ele>" not in got[3].text
