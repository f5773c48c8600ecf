"""Way data from Overpass responses and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import tags

OVERPASS = "elements array<struct<type string, id bigint, lat double, lon double, tags map<string,string>, geometry array<struct<lat double, lon double>>>>"
SNAPSHOT_VERSION = 3
# The tags that are kept, as tag -> column.
KEPT = {t: t for t in ("highway", "name", "surface", "access", "foot", "sidewalk", "crossing", "bridge", "tunnel", "barrier", "incline", "width", "oneway", "bicycle", "layer", "tracktype", "waterway")}
KEPT |= {"sidewalk:left": "sidewalk_left", "sidewalk:right": "sidewalk_right", "motor_vehicle": "motor_vehicle", "trail_visibility": "trail_visibility"}


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """The elements of response files, one row each."""
    return spark.read.schema(OVERPASS).option("multiLine", True).json(path).select(F.inline("elements"))


def in_query(elements: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """What the remote query would return: ways and gates of interest with a point in the box."""
    tagged = F.exists(F.array(*(F.element_at("tags", t) for t in ("highway", "waterway", "barrier"))), lambda v: v.isNotNull()) | (F.element_at("tags", "natural") == "water")
    points = F.coalesce("geometry", F.array(F.struct("lat", "lon")))
    return elements.where(F.coalesce(tagged, F.lit(False)) & F.exists(points, lambda p: p["lat"].between(south, north) & p["lon"].between(west, east)))


def features(elements: DataFrame) -> DataFrame:
    """way id, category, the kept tags, blocks_on_foot and coordinates of ways with two points or more that have a category."""
    tag = lambda t: F.element_at("tags", t)
    category = tags.category(tag("highway"), tag("waterway"), tag("natural"), tag("barrier"))
    blocks = F.when(F.col("category") == "barrier", tags.blocks_on_foot(tag("barrier"), tag("foot"), tag("access")))
    coordinates = F.transform("geometry", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lng")))
    ways = elements.where((F.col("type") == "way") & (F.size("geometry") >= 2)).withColumn("category", category).where("category IS NOT NULL")
    return ways.select(F.concat(F.lit("way/"), F.col("id").cast("string")).alias("id"), "category", *(tag(t).alias(c) for t, c in KEPT.items()), blocks.alias("blocks_on_foot"), coordinates.alias("coordinates"))


def openings(elements: DataFrame) -> DataFrame:
    tag = lambda t: F.element_at("tags", t)
    return elements.where((F.col("type") == "node") & tags.is_opening(tag("barrier"), tag("access"), tag("locked"))).select("lat", F.col("lon").alias("lng"))


def vertices(ways: DataFrame) -> DataFrame:
    """way_id, pos (from 1), lat, lng of features."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("coordinates").alias("k", "p")).select("way_id", (F.col("k") + 1).alias("pos"), "p.lat", "p.lng")


def write_snapshot(ways: DataFrame, path: str) -> None:
    """One folder per category."""
    ways.withColumn("schema_version", F.lit(SNAPSHOT_VERSION)).write.partitionBy("category").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The written ways; another schema version is an error."""
    rows = spark.read.parquet(path)
    checked = F.assert_true(F.col("schema_version") == SNAPSHOT_VERSION, F.lit("unknown schema version"))
    return rows.where(checked.isNull()).drop("schema_version")


def _document(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot documents at path; another schema version is an error."""
    names = ["id string", "category string", *(f"{_camel(c)} string" for c in KEPT.values()), "blocksOnFoot boolean", "coordinates array<array<double>>"]
    schema = f"schemaVersion int, features array<struct<{', '.join(n.replace(' ', ': ', 1) for n in names)}>>, barrierOpenings array<array<double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.where(F.assert_true(F.col("schemaVersion").eqNullSafe(SNAPSHOT_VERSION), F.lit("unknown schema version")).isNull())


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ways as features() gives them, openings) of whole JSON documents with features and barrierOpenings, coordinates as [lat, lng]."""
    document = _document(spark, path)
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("lat"), F.get(p, F.lit(1)).alias("lng"))
    ways = document.select(F.inline("features"))
    found = ways.select("id", "category", *(F.col(_camel(c)).alias(c) for c in KEPT.values()), F.col("blocksOnFoot").alias("blocks_on_foot"), F.transform("coordinates", pair).alias("coordinates"))
    return found, document.select(F.explode("barrierOpenings").alias("p")).select(pair(F.col("p")).alias("p")).select("p.*")


def views(ways: DataFrame) -> dict[str, DataFrame]:
    """What can be travelled, what closes the way on foot, paths (tracks too) and watercourses."""
    return {
        "ways": ways.where("category NOT IN ('water', 'barrier')"),
        "barriers": ways.where("category = 'barrier' AND blocks_on_foot"),
        "paths": ways.where("category = 'path' OR highway = 'track'"),
        "waterways": ways.where("category = 'water'"),
    }
