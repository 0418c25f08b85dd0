"""GeoJSON feature collections as DataFrames of lines or polygons, with a stable row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidetrace.functions import geo as G
from sidetrace.operators.ordering import numbered

POINT_PAIR = T.ArrayType(T.DoubleType())


def _schema(properties: tuple[str, ...]) -> T.StructType:
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("geometry", geometry), T.StructField("properties", T.StructType([T.StructField(p, T.StringType()) for p in properties]))])
    return T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(feature))])


def _features(spark: SparkSession, path: str, properties: tuple[str, ...], row: str) -> DataFrame:
    docs = spark.read.schema(_schema(properties)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.select(F.posexplode("features").alias(row, "f")).select(F.col(row).cast("long").alias(row), "f.properties.*", F.col("f.geometry.type").alias("_kind"), F.col("f.geometry.coordinates").alias("_json"))


def _line(points):
    return F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_lines(spark: SparkSession, path: str, properties: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """Lines with the named properties as text, source_row from 0 and lines; other geometries have none. An empty file raises."""
    return guarded(geometry(_features(spark, path, properties, "source_row"), "lines"), "source_row", limit)


def read_polygons(spark: SparkSession, path: str, properties: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """Polygons with the named properties as text, frequency_row from 0 and polys, without the closing point of a ring."""
    return guarded(geometry(_features(spark, path, properties, "frequency_row"), "polys"), "frequency_row", limit)


def read_line_features(spark: SparkSession, path: str, properties: tuple[str, ...], kind: str = "lines") -> DataFrame:
    """Features one a line (newline-delimited GeoJSON), which splits among tasks; kind is lines or polys. Rows are numbered in file order.

    A feature collection in one piece is read by one task as one row (read_lines, read_polygons); turn a large one into this
    form, or into Parquet, first.
    """
    schema = T.StructType([f for f in _schema(properties)["features"].dataType.elementType])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("_at", F.monotonically_increasing_id())
    row = "source_row" if kind == "lines" else "frequency_row"
    flat = rows.select("_at", "properties.*", F.col("geometry.type").alias("_kind"), F.col("geometry.coordinates").alias("_json"))
    return guarded(numbered(geometry(flat, kind), "_at", name=row).drop("_at"), row, None)


def geometry(df: DataFrame, kind: str) -> DataFrame:
    """Turns _kind and _json into lines or polys."""
    if kind == "lines":
        one, many = F.from_json("_json", "array<array<double>>"), F.from_json("_json", "array<array<array<double>>>")
        shape = F.when(F.col("_kind") == "LineString", F.array(_line(one))).when(F.col("_kind") == "MultiLineString", F.transform(many, _line))
    else:
        one, many = F.from_json("_json", "array<array<array<double>>>"), F.from_json("_json", "array<array<array<array<double>>>>")
        ring = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), _line(F.slice(r, F.lit(1), F.size(r) - 1))).otherwise(_line(r))
        shape = F.when(F.col("_kind") == "Polygon", F.array(F.transform(one, ring))).when(F.col("_kind") == "MultiPolygon", F.transform(many, lambda p: F.transform(p, ring)))
    return df.withColumn(kind, shape).drop("_kind", "_json")


def to_plane(df: DataFrame, kind: str) -> DataFrame:
    """Shapes in longitude and latitude turned into state plane feet; those in feet stay. One input must be all of one sort."""
    points = F.flatten(kind) if kind == "lines" else F.flatten(F.flatten(kind))
    r = df.where(F.col(kind).isNotNull()).agg(F.bool_and(G.is_lonlat(points)).alias("all"), F.bool_or(G.is_lonlat(points)).alias("some")).first()
    if r["all"] is None or not r["some"]:
        return df
    if not r["all"]:
        raise ValueError("some shapes are in degrees and some aren't")
    return df.withColumn(kind, (G.project if kind == "lines" else G.project_polygons)(F.col(kind), G.lonlat_to_plane))


def schema_of(spark: SparkSession, path: str, n: int = 3) -> dict[str, str]:
    """Property names and types, as the first n features show them."""
    head = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f")).limit(n)
    return {f.name: f.dataType.simpleString() for f in head.select("f.properties.*").schema}


def guarded(df: DataFrame, row: str, limit: int | None) -> DataFrame:
    """The first rows by position if a positive limit is given; an empty input raises."""
    if limit is not None:
        if limit <= 0:
            raise ValueError("a row limit must be positive")
        df = df.where(F.col(row) < limit)
    if df.isEmpty():
        raise ValueError("the input has no rows")
    return df


def snapshot_proof(expected: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """Rows (id, verdict) of ids that are missing, unexpected or repeated in what was received; a whole snapshot has none."""
    got = received.groupBy(F.col(key).cast("string").alias("id")).agg(F.count("*").alias("n"))
    want = expected.select(F.col(key).cast("string").alias("id")).distinct().withColumn("wanted", F.lit(True))
    both = want.join(got, "id", "full_outer")
    return both.select("id", F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated").alias("verdict")).where("verdict is not null")


def read_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A Parquet table cast to a declared schema {name: type}; a missing column raises, others are pruned from the scan."""
    df = spark.read.parquet(path)
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))
