"""Exact global ranks without a single-task sort.

A hex digest is uniform, so its leading digits split the rows into even buckets.
Give more digits where 10^11 rows or more make buckets large. Only the bucket sizes (at most 16 ** digits rows, whatever the data size) pass through
one task to become bucket offsets; the ordering itself runs per bucket in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_DIGITS = 4


def _bucket_offsets(df: DataFrame, digest: str, digits: int) -> DataFrame:
    """Rows per digest prefix with the number of rows in all smaller prefixes."""
    sizes = df.groupBy(F.left(digest, F.lit(digits)).alias("_bucket")).agg(F.count("*").alias("_size"))
    smaller = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(smaller), F.lit(0)))


def with_position(
    df: DataFrame, digest: str, name: str, tie_break: list[str] | None = None, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Add the 0-based global rank of each row in digest order, exact and gap-free.

    ``df`` is read twice; pass a written table where it is costly to compute. Digests are
    to be of a key: rows that share one are ordered within one task.
    """
    offsets = _bucket_offsets(df, digest, digits).select("_bucket", "_offset")
    inside = Window.partitionBy("_bucket").orderBy(digest, *(tie_break or []))
    ranked = df.withColumn("_bucket", F.left(digest, F.lit(digits))).withColumn(
        "_row", F.row_number().over(inside)
    )
    # At most 16 ** digits offset rows of two fields: a fixed bound, so broadcast is safe.
    return (
        ranked.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_offset")
    )


def with_key_position(df: DataFrame, key: list[str], digest: Column, name: str) -> DataFrame:
    """Add the 0-based rank of each row's key in digest order; only keys are ranked, the rows join them.

    Rows that share a key share its number.
    """
    keys = df.select(*key).distinct().withColumn("_digest", digest)
    ranked = with_position(keys, "_digest", name, tie_break=key).select(*[F.col(k).alias(f"_key_{k}") for k in key], name)
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key]
    return df.join(ranked, same).drop(*[f"_key_{k}" for k in key])


def lowest_fraction(df: DataFrame, digest: str, fraction: float, digits: int = BUCKET_DIGITS) -> Column:
    """Condition selecting exactly the floor(n * fraction) rows with the smallest digests.

    The digest at that rank is found by ranking the one bucket that holds it. The rows
    themselves are not moved: the condition is a comparison with a scalar subquery. Digests must be
    unique, and the digest column of ``df`` should come from a written table, as it is
    read three times.
    """
    offsets = _bucket_offsets(df, digest, digits)
    wanted = F.floor(F.sum("_size").over(Window.partitionBy()) * F.lit(float(fraction)))
    target = (
        offsets.withColumn("_wanted", wanted)
        .filter((F.col("_offset") <= F.col("_wanted")) & (F.col("_wanted") < F.col("_offset") + F.col("_size")))
        .select("_bucket", (F.col("_wanted") - F.col("_offset")).alias("_skip"))
    )
    in_bucket = (
        df.select(F.col(digest).alias("_digest"), F.left(digest, F.lit(digits)).alias("_bucket"))
        .join(F.broadcast(target), "_bucket")
        .withColumn("_row", F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest")) - 1)
    )
    cutoff = in_bucket.filter(F.col("_row") == F.col("_skip")).select("_digest").scalar()
    # No digest at that rank means every row is wanted (fraction 1).
    return cutoff.isNull() | (F.col(digest) < cutoff)
