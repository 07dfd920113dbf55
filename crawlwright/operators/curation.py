"""Image curation: the rule set with reasons, and the filter before a download."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import urls as U
from .columns import computed

# What the images can be sorted by.
SORT_COLUMNS = {"size": "file_size", "name": "filename", "url": "url", "format": "format"}


def apply_rules(images: DataFrame, options: dict | None = None, config: dict | None = None,
                extra_rules: dict[str, Column] | None = None) -> DataFrame:
    """``passed``, ``reasons`` in rule order and ``score``; no rule hides another.

    ``extra_rules`` are further Columns that give a reason or null.
    """
    rules = I.merge_rules(options, config)
    rows = computed(images, _size=I.known_size("url", "width", "height"))
    w, h = F.col("_size.width"), F.col("_size.height")
    score = I.quality_score("url", "filename", "alt_text", w, h) if rules["min_quality_score"] > 0 else F.lit(1.0)
    text = F.col("_text")
    rows = computed(rows, score=score, _text=I.image_text(
        "url", "filename", "alt_text", "title", "css_class", "element_id"))
    found = [I.size_reason(w, h, rules), I.file_size_reason("file_size", rules),
             I.format_reason("url", "content_type", rules), I.keyword_reason(text, rules),
             I.domain_reason("url", rules), I.quality_reason(F.col("score"), rules), I.url_reason("url"),
             *(extra_rules or {}).values()]
    rows = computed(rows, reasons=F.array_compact(F.array(*found))).drop("_size", "_text")
    return rows.withColumn("passed", F.size("reasons") == 0)


def sort_images(images: DataFrame, sort_by: str = "size", descending: bool = True) -> DataFrame:
    """A range-partitioned sort of the rule output."""
    rows = images.withColumn("format", U.file_extension("url"))
    key = F.col(SORT_COLUMNS[sort_by])
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "url")


def prefiltered(images: DataFrame, options: dict | None = None) -> DataFrame:
    """what is left to download."""
    reason = I.prefilter_reason("file_size", "width", "height", options)
    return images.filter(reason.isNull())


def prefilter_counts(images: DataFrame, options: dict | None = None) -> DataFrame:
    """how many images each reason drops; 'kept' for the rest."""
    reason = I.prefilter_reason("file_size", "width", "height", options)
    return images.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
