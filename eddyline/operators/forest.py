"""Groups of labels that grow batch by batch: a stored forest of representatives.

A representative that joins another group gets a parent, once, in the batch (version) that joined them; the parent is the smaller
label. A batch looks up the representatives of its own labels, finds the components among those, and appends a row for
each representative that lost its place: work is in proportion to the batch's pairs, whatever the forest holds. A label without
a row is its own representative. As rows carry their version, groups can be told as they were after any batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.sources.scratch import whole, written

from .graph import connected_components

_ROWS = "node long, parent long, version int"


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(node, parent, version) of all batches stored whole."""
    versions = stored(spark, path)
    return spark.read.schema(_ROWS).parquet(*(f"{path}/batch={v}" for v in versions)) if versions else spark.createDataFrame([], _ROWS)


def stored(spark: SparkSession, path: str) -> list[int]:
    """The versions that are stored whole."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch=") and whole(spark, f"{path}/{n}"))


def representatives(labels: DataFrame, forest: DataFrame, label: str = "label", version: str | None = None) -> DataFrame:
    """Rows with column ``root``: the representative of their label, as of the version in a column where one is named. One join for each link of the longest chain."""
    one = ["label", "at"]
    at = F.col(version) if version else F.lit(2**31 - 1)
    asked = labels.select(F.col(label).cast("long").alias("label"), at.cast("int").alias("at")).distinct()
    known = written(asked.withColumn("root", F.col("label")).withColumn("open", F.lit(True)), "asked")
    links = forest.select(F.col("node").alias("__node"), "parent", F.col("version").alias("__version"))
    done = known.where("false")
    while not known.isEmpty():
        step = known.join(links, (F.col("root") == F.col("__node")) & (F.col("__version") <= F.col("at")), "left")
        step = written(step.select(*one, F.coalesce("parent", "root").alias("root"), F.col("parent").isNotNull().alias("open")), "links")
        done, known = done.unionAll(step.where("not open")), step.where("open")
    told = done.select(F.col("label").alias("__label"), F.col("at").alias("__at"), "root")
    return labels.join(told, (F.col(label) == F.col("__label")) & (at.cast("int") == F.col("__at"))).drop("__label", "__at")


def add(pairs: DataFrame, path: str, version: int) -> dict[str, int]:
    """Join the groups of pairs (a, b) as a batch; returns how many rows were looked at and written. A batch that is stored already is left as it is."""
    spark = pairs.sparkSession
    if version in stored(spark, path):
        return {"pairs": 0, "labels": 0, "written": 0}
    pairs, forest = written(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "pairs"), rows(spark, path)
    labels = pairs.select(F.col("a").alias("label")).unionAll(pairs.select("b")).distinct()
    known = written(representatives(labels, forest), "roots")
    own = pairs.join(known.select(F.col("label").alias("a"), F.col("root").alias("ra")), "a").join(known.select(F.col("label").alias("b"), F.col("root").alias("rb")), "b")
    joined = connected_components(own.select("ra", "rb"), "ra", "rb").where("node <> root")
    joined.select("node", F.col("root").alias("parent"), F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{path}/batch={version}")
    return {"pairs": pairs.count(), "labels": known.count(), "written": spark.read.parquet(f"{path}/batch={version}").count()}


def mapping(labels: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """(child, mother) of some labels (``label``), as of a version, the last by default."""
    forest = rows(labels.sparkSession, path)
    forest = forest if version is None else forest.where(F.col("version") <= version)
    return representatives(labels.select("label").distinct(), forest).select(F.col("label").alias("child"), F.col("root").alias("mother"))
