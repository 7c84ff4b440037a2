"""Cross-site boilerplate lines: HyperLogLog spread first, exact counts where it is close.

Native functions throughout. Every line's hash gets a sketch of the sites it stands
on; partial sketches merge on the map side, so a line that is everywhere costs no
more than others. Lines well beyond the threshold go, lines well below stay, and only
lines within the sketch's error of it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sites that make a line boilerplate, and the sketch: 2^8 registers, an error of about 6.5 %.
MIN_SITES = 10
SKETCH = 8
#: Errors on either side of the threshold within which a line is counted exactly.
ERRORS = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes ``line`` of the non-blank lines that stand on at least ``min_sites`` distinct sites (column source)."""
    lines = docs.select(F.col("source").cast("string").alias("site"), F.explode(_lines(F.col("text").cast("string"))).alias("words"))
    lines = lines.filter("site is not null and trim(words) != ''").select(_key(F.col("words")).alias("line"), "site")
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH)).alias("sites"))
    margin = ERRORS * 1.04 / 2 ** (SKETCH / 2)
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    sure = spread.filter(F.col("sites") > high).select("line")
    near = spread.filter(F.col("sites").between(low, high)).select("line")
    exact = lines.join(near, "line").distinct().groupBy("line").count().filter(F.col("count") >= min_sites).select("line")
    return sure.unionByName(exact)


def _marked(docs: DataFrame, min_sites: int) -> DataFrame:
    """``docs`` with ``__bad``, the hashes of the boilerplate lines of its text; texts with none have null."""
    text = F.col("text").cast("string")
    # Keyed by text, so rows without an id and repeated ids need no care; two texts
    # of one hash would only share lists of lines that are boilerplate anyway.
    hashes = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key))
    found = docs.select(F.xxhash64(text).alias("__text"), F.explode(hashes).alias("line"))
    found = found.join(boilerplate(docs, min_sites), "line").groupBy("__text").agg(F.collect_set("line").alias("__bad"))
    return docs.withColumn("__text", F.xxhash64(text)).join(found, "__text", "left").drop("__text")


def _kept(text: Column, bad: Column) -> Column:
    return F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(bad, _key(x)))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs``, all columns and rows, its texts without boilerplate lines.

    Lines are compared without the blanks around them; blank lines stay. Rows
    without a source add no site, but their lines go too. A null text stays null,
    a text of nothing but boilerplate becomes empty.
    """
    text, bad = F.col("text").cast("string"), F.col("__bad")
    cleaned = F.when(bad.isNull(), text).otherwise(F.array_join(_kept(text, bad), "\n"))
    return _marked(docs, min_sites).withColumn("text", cleaned).select(*docs.columns)


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, its non-blank lines, how many of them are boilerplate, and the SHA-256 of what is left.

    Null texts count as empty. One row out per row in; other columns are ignored.
    """
    docs = docs.select("doc_id", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, none = F.col("text"), F.lit([]).cast("array<bigint>")
    full = F.size(F.filter(_lines(text), lambda x: F.trim(x) != ""))
    marked = _marked(docs, min_sites).withColumn("__bad", F.coalesce("__bad", none))
    kept = _kept(text, F.col("__bad"))
    left = F.size(F.filter(kept, lambda x: F.trim(x) != ""))
    return marked.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        full.cast("long").alias("n_lines"),
        (full - left).cast("long").alias("n_removed"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"),
    )
