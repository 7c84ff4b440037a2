"""The derived trip tables hold what they are said to hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridelake.operators.merge import unscored
from ridelake.operators.slices import day_slice, valid_predictions
from ridelake.sources import trips as src

# Rows per scale of each derived table and planted defect.
COUNTS = {
    "0.001": (1_000, 976, 836, 10, 10, 10, 551, 140, 26),
    "0.01": (10_000, 9_780, 8_383, 97, 95, 92, 5_531, 1_397, 311),
    "0.1": (100_000, 97_831, 83_855, 970, 941, 914, 55_262, 13_976, 3_221),
}


@pytest.mark.parametrize("scale", COUNTS)
def test_counts(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    rich, scored = src.enriched(spark, sf), src.predictions(spark, sf)
    sums = rich.agg(
        F.count(F.lit(1)),
        F.count_if(F.col("actual_fare").isNull()),
        F.count_if(F.col("actual_fare") == 0),
        F.count_if(F.col("weather").isNull()),
    ).first()
    got = (
        src.trips(spark, sf).count(), sums[0], scored.count(), sums[1], sums[2], sums[3],
        valid_predictions(scored).count(), unscored(rich, scored).count(),
        day_slice(rich, "created_at", dt.date(2024, 1, 15)).count(),
    )
    assert got == COUNTS[scale]


def test_zones_that_occur(spark, sf):
    zones = {r[0] for r in src.enriched(spark, sf).select("origin_zone").distinct().collect()}
    assert zones == {"Jakarta Pusat", "Jakarta Utara", "Jakarta Selatan", "Jakarta Barat", "Jakarta Timur", "Lainnya"}
