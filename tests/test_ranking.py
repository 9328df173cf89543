import hashlib
import math

import pytest
from pyspark.sql import functions as F

from clinote.functions import ranking


@pytest.fixture(scope="module")
def digests(spark):
    return spark.range(500).select("id", F.sha1(F.col("id").cast("string")).alias("digest"))


@pytest.mark.parametrize("digits", [1, 4])
def test_positions_are_the_digest_order(digests, digits):
    found = ranking.with_position(digests, "digest", "position", digits=digits).collect()
    wanted = sorted(hashlib.sha1(str(i).encode()).hexdigest() for i in range(500))
    assert [r["digest"] for r in sorted(found, key=lambda r: r["position"])] == wanted
    assert sorted(r["position"] for r in found) == list(range(500))


@pytest.mark.parametrize("fraction", [0.0, 0.001, 0.3, 0.5, 0.999, 1.0])
def test_lowest_fraction_is_exact(digests, fraction):
    chosen = digests.filter(ranking.lowest_fraction(digests, "digest", fraction, digits=2))
    wanted = sorted(hashlib.sha1(str(i).encode()).hexdigest() for i in range(500))[: math.floor(500 * fraction)]
    assert sorted(r["digest"] for r in chosen.collect()) == wanted


def test_one_bucket_holding_all_rows_is_still_exact(spark):
    df = spark.range(50).select(F.concat(F.lit("ffff"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("digest"))
    found = ranking.with_position(df, "digest", "position").orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(50))
    assert [r["digest"] for r in found] == sorted(r["digest"] for r in found)
