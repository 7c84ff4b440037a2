"""Reading tables, staging between steps, places in an order, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake.session import shared_dir

#: Rows and bytes of an Arrow batch: texts may be long, so batches are kept short.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """A written copy in the shared folder: later steps neither repeat the work nor depend on its machines."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null keys count as the text ``null``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % n


def positions(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place in the group ``grp`` by ``order``, and ``total``, the group's size.

    A range sort deals out the rows, so that a large group and many equal rows are spread
    over tasks; the places before a task's rows come from the counts of (group, task).
    """
    keys = ["grp", *order, "tie"]
    rows = nodes.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    rows = stage(rows.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "sorted")
    counts = rows.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part")) - F.col("n")
    counts = counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    placed = rows.join(counts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return placed.withColumn("pos", F.col("seq") + F.col("shift")).drop("part", "seq", "shift", "g", "p")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(node, component)``, the component its smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest neighbour, until nothing changes: rounds grow with the
    logarithm of the nodes. Rounds hand on through written tables. Nodes may be of
    any type with an order; repeated links, both directions and loops are
    harmless, and no links give no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    links, before = stage(links, "links"), None
    for _ in range(max_rounds):
        count, checksum = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, checksum) == before or not count:
            break
        before = (count, checksum)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(smallest, "u")
        small = hung.select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")
        ).select("l.u", "l.v")
        links = stage(small.filter("u != v").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
