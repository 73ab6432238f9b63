import random

import pytest
from pyspark.sql import functions as F

from civicledger.plans import paging as P


@pytest.mark.parametrize("order", [[("amount", False), ("id", True)], [("name", True), ("id", False)], [("x", True), ("name", False), ("id", True)], [("flag", False), ("x", False), ("id", True)]])
def test_deep_pages_against_sorting(spark, order):
    rng = random.Random(5)
    names = ["", "a", "ab", "abcdefgh", "abcdefghi", "abcdefgh\0", "é", None, "z" * 30, "z" * 29 + "y"]
    data = [(i, rng.choice([None, -5, 0, 7, rng.randint(-10**9, 10**9)]), rng.choice(names), rng.choice([None, 0.0, -1.5, 1e300, rng.random()]), rng.random() < 0.5) for i in range(800)]
    rows = spark.createDataFrame(data, "id long, cents long, name string, x double, flag boolean").withColumn("amount", (F.col("cents") / 100).cast("decimal(18,2)")).withColumn("flag", F.col("flag").cast("int"))
    rows = rows.repartition(3).cache()
    whole = rows.orderBy(*P.sort_columns(order)).collect()
    for offset, limit in ((0, 5), (333, 40), (790, 50), (799, 1), (800, 5), (5, 0)):
        assert P.deep_page(rows, order, offset, limit, most=37).collect() == whole[offset : offset + limit]
    rows.unpersist()


def test_a_deep_page_gathers_few_rows(spark):
    """Ranges before the page are counted only: what is sorted in the end is at most `most` rows."""
    rows = spark.range(200_000).withColumn("k", F.col("id") * 7919 % 200_003)
    pieces = P._pieces(rows, 200_000, list(P._levels(rows, [("k", True)])), 123_456, 50, 500)
    assert sum(part.count() for part, _, _ in pieces) <= 1000 and sum(take for *_, take in pieces) == 50
    got = [r.k for r in P.deep_page(rows, [("k", True)], 123_456, 50, 500).collect()]
    assert got == sorted(i * 7919 % 200_003 for i in range(200_000))[123_456:123_506]
    with pytest.raises(ValueError):
        list(P._levels(rows.withColumn("d", F.col("id").cast("decimal(30,2)")), [("d", True)]))
