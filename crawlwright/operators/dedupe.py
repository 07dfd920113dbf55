"""Keep-first de-duplication as aggregation.

``min_by`` aggregates partially on the map side, so a key that holds a third
of all rows costs one row per task in the shuffle; a ranking window would
send all of them to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import urls as U


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in the given order. Columns keep their order."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the last in the given order."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def dedupe_images(df: DataFrame, order: list[str], keys: list[str] = ()) -> DataFrame:
    """First per lower-case file name, else per url; rows with neither all stay."""
    name, url = F.nullif(F.lower("filename"), F.lit("")), F.nullif(F.col("url"), F.lit(""))
    keyed = (df.withColumn("_kind", F.when(name.isNotNull(), 0).when(url.isNotNull(), 1))
             .withColumn("_key", F.coalesce(name, url)))
    cols = [*keys, "_kind", "_key"]
    first = keep_first(keyed.filter("_key is not null"), cols, order)
    return first.unionByName(keyed.filter("_key is null")).drop("_kind", "_key")


def dedupe_by_priority(links: DataFrame, page: str = "page_id") -> DataFrame:
    """Best priority per key-parameter url, and only then the inclusion test.

    A rejected best row removes its later duplicates too. ``seq`` columns give
    the order of equal priorities.
    """
    order = [-F.col("priority"), F.col("branch"), F.col("selector"), F.col("element"), F.col("pos")]
    best = keep_first(links.withColumn("norm_url", U.keep_key_params("url")), [page, "norm_url"], order)
    return best.filter(L.is_includable("url", "link_text"))
