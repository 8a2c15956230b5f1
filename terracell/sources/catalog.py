"""Raster catalog: which layers exist, which role they play, where to fall back; small public text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def missing(catalog: DataFrame, required: DataFrame) -> DataFrame:
    """Required roles without a layer."""
    return required.join(catalog.select("role").distinct(), "role", "left_anti")


def require(catalog: DataFrame, roles: list[str]) -> None:
    """Raise when a role has no layer."""
    gone = [r["role"] for r in missing(catalog, catalog.sparkSession.createDataFrame([(r,) for r in roles], "role string")).collect()]
    if gone:
        raise FileNotFoundError(f"no layer for {', '.join(sorted(gone))}")


def resolved(catalog: DataFrame) -> DataFrame:
    """The first layer of each role by priority: catalog (role, priority, path, ...).  Partial minima, so that a role with
    very many layers is no hot key."""
    first = F.min_by(F.struct(*[F.col(c) for c in catalog.columns]), F.struct("priority", "path"))
    return catalog.groupBy("role").agg(first.alias("_f")).select(*[F.col(f"_f.{c}").alias(c) for c in catalog.columns])


def world_file(spark: SparkSession, path: str) -> tuple[float, ...]:
    """The affine transform (a, b, c, d, e, f) of a cell's corner from a world file, whose lines are a, d, b, e and the
    centre of the first cell."""
    a, d, b, e, x, y = (float(r["value"]) for r in spark.read.text(path, wholetext=False).filter("trim(value) <> ''").collect())  # six lines
    return a, b, x - (a + b) / 2, d, e, y - (d + e) / 2


#: The parts of a GeoJSON collection that are read.
COLLECTION = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"


def rings_of(features: DataFrame, *kept: Column) -> DataFrame:
    """feature, the kept columns, ring, point, lon, lat of polygons: features (feature, f), f as in COLLECTION."""
    rings = features.filter("f.geometry.type = 'Polygon'").select("feature", *kept, F.posexplode("f.geometry.coordinates").alias("ring", "points"))
    points = rings.select("*", F.posexplode("points").alias("point", "p")).drop("points")
    return points.select("*", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")).drop("p")


def _features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLLECTION).json(path, multiLine=True).select(F.posexplode("features").alias("feature", "f"))


def polygon_rings(spark: SparkSession, path: str) -> DataFrame:
    """feature, ring, point, lon, lat of the polygons of a GeoJSON file."""
    return rings_of(_features(spark, path))


def named(features: DataFrame, name: str, key: str = "name") -> DataFrame:
    """The rings of the features whose property `key` is `name`."""
    return rings_of(features.filter(F.col("f.properties")[key] == name), F.col("f.properties")[key].alias("name"))


def polygon_by_name(spark: SparkSession, path: str, name: str, key: str = "name") -> DataFrame:
    """feature, name, ring, point, lon, lat of a place of a GeoJSON file."""
    return named(_features(spark, path), name, key)


def scan(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """path, name, bytes of the files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def check(cells: DataFrame, metadata: DataFrame, master: str) -> DataFrame:
    """One row for each layer of metadata (layer, crs, dtype): its shape and crs against the master layer's, and its values.

    cells (layer, r, c, value) may hold NaN; NULL is nodata.  A layer is binary when 0 and 1 are its only values and both
    occur; only then has it a share of ones.  A layer without cells has no shape, and matches no master that has one."""
    v = F.col("value")
    valid = F.when(~F.isnan(v), v)
    seen = cells.groupBy("layer").agg(
        (F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), F.count("value").alias("n_valid"), F.count_if(F.isnan(v)).alias("n_nan"), F.min(valid).alias("mn"), F.max(valid).alias("mx"),
        F.count_if(v == 1).alias("_ones"), F.count_if(v == 0).alias("_zeros"),
    )
    own = metadata.join(seen, "layer", "left")
    first = F.broadcast(own.filter(F.col("layer") == master).agg(F.max("height").alias("_h"), F.max("width").alias("_w"), F.max("crs").alias("_crs")))  # one row
    binary = F.coalesce((F.col("_ones") > 0) & (F.col("_zeros") > 0) & (F.col("_ones") + F.col("_zeros") == F.col("n_valid")), F.lit(False))
    count = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return own.crossJoin(first).select(
        "layer", "crs", "dtype", "height", "width", (F.col("height").eqNullSafe(F.col("_h")) & F.col("width").eqNullSafe(F.col("_w"))).alias("same_shape"), F.col("crs").eqNullSafe(F.col("_crs")).alias("same_crs"),
        count("n_valid"), count("n_nan"), "mn", "mx", binary.alias("is_binary"), F.when(binary, F.col("_ones") / F.col("n_valid")).alias("share_of_ones"),
    )


def metric_table(spark: SparkSession, path: str) -> DataFrame:
    """model, metric, value of a JSON document {"model_metrics": {model: {metric: number}}}."""
    models = spark.read.schema("model_metrics map<string, map<string, double>>").json(path, multiLine=True)
    return models.select(F.explode("model_metrics").alias("model", "m")).select("model", F.explode("m").alias("metric", "value"))
