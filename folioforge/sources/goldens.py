"""Expected results of documents, as tables: a folder for each document with truth.json and, where limits differ, thresholds.json."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = 0.01
#: Limits of a comparison of renderings, in percent of bytes over 24 and over 8, and the mean distance.
LIMITS = {"maxOver24Pct": 2.0, "maxOver8Pct": 10.0, "maxMeanDelta": 2.0}
TRUTH = """file string, sha256 string, pageCount int, requiresAuth boolean, authPassword string, auth array<struct<password:string,status:int>>, dpis array<int>, needles array<string>,
 pages array<struct<page:int,bounds:array<float>,linksRaw:array<struct<uri:string,external:boolean,rect:array<float>,page:int,destX:float,destY:float>>,searchRaw:map<string,array<array<float>>>,
 renders:map<string,struct<width:int,height:int,stride:int,links:array<struct<uri:string,page:int,bounds:array<int>,destX:int,destY:int>>,search:map<string,array<array<int>>>>>>>"""


def truths(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each truth.json below a folder, with the name of its own folder."""
    found = spark.read.schema(TRUTH).json(folder, multiLine=True, pathGlobFilter="truth.json", recursiveFileLookup=True)
    return found.withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -2))


def thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """name and the three limits of every document that has a thresholds.json; a missing one is that of LIMITS, an unknown one an error."""
    found = spark.read.json(folder, multiLine=True, pathGlobFilter="thresholds.json", recursiveFileLookup=True)
    unknown = set(found.columns) - {*LIMITS, "justification"}
    if unknown:
        raise ValueError(f"unknown limits: {sorted(unknown)}")
    limit = lambda k, v: (F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in found.columns else F.lit(v)).alias(k)
    return found.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("name"), *[limit(k, v) for k, v in LIMITS.items()])


def expected_quads(truth: DataFrame) -> DataFrame:
    """name, page, needle, ord, quad of every hit."""
    pages = truth.select("name", F.explode("pages").alias("p"))
    needles = pages.select("name", F.col("p.page").alias("page"), F.explode("p.searchRaw").alias("needle", "quads"))
    return needles.select("name", "page", "needle", F.posexplode("quads").alias("ord", "quad"))


def quad_errors(found: DataFrame, expected: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """name, page, needle, hits found and expected, largest and mean distance of a coordinate, and whether all keep within the tolerance.
    Both tables have name, page, needle, ord, quad."""
    key = ["name", "page", "needle", "ord"]
    both = found.select(*key, F.col("quad").cast("array<double>").alias("a")).join(expected.select(*key, F.col("quad").cast("array<double>").alias("b")), key, "full")
    d = F.zip_with("a", "b", lambda a, b: F.abs(a - b))
    mean = F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)
    made = both.withColumns({"most": F.array_max(d), "mean": mean}).groupBy("name", "page", "needle")
    made = made.agg(F.count("a").alias("found"), F.count("b").alias("expected"), F.max("most").alias("most"), F.avg("mean").alias("mean"))
    return made.withColumn("passes", (F.col("found") == F.col("expected")) & (F.coalesce("most", F.lit(0.0)) <= tolerance))


def judged_renderings(differences: DataFrame, limits: DataFrame) -> DataFrame:
    """differences (name, page, over8, over24, mean) with `passes` under the limits of each document, or the usual ones."""
    both = differences.join(limits, "name", "left")
    limit = lambda k: F.coalesce(F.col(k), F.lit(LIMITS[k]))
    passes = (100 * F.col("over24") <= limit("maxOver24Pct")) & (100 * F.col("over8") <= limit("maxOver8Pct")) & (F.col("mean") <= limit("maxMeanDelta"))
    return both.withColumn("passes", F.coalesce(passes, F.lit(False))).drop(*LIMITS)
