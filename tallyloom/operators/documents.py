"""Headings, sections, text blocks and batches of document rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col, null_safe_join
from tallyloom.operators.ordered import with_last_known, with_row_number

# A heading or paragraph up to its closing tag, or to the next one's opening tag where none closes it.
_ELEMENT = r"(?is)<(h[1-6]|p)(?:\s[^>]*)?>.*?(?=</\1\s*>|<(?:h[1-6]|p)[\s>]|\z)"
_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def html_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, level, text) of the headings (level 1-6) and paragraphs (level NULL), without inner tags, comments and scripts."""
    elements = F.regexp_extract_all(F.regexp_replace(col(html), _UNSEEN, ""), F.lit(_ELEMENT), F.lit(0))
    return (
        pages.select(key, F.posexplode(elements).alias("position", "element"))
        .select(
            key, "position",
            F.regexp_extract("element", r"^<[hH]([1-6])", 1).try_cast("int").alias("level"),
            F.trim(F.regexp_replace("element", r"<[^>]*>", "")).alias("text"))
        .where("text <> ''")
    )


def heading_counts(elements: DataFrame, level: str = "level") -> DataFrame:
    """Headings counted by level."""
    return elements.where(col(level).isNotNull()).groupBy(col(level).alias("level")).agg(F.count("*").alias("headings"))


def heading_sections(elements: DataFrame, key: str, position: str = "position", level: str = "level",
                     text: str = "text", **options) -> DataFrame:
    """Every paragraph with the last heading above it; headings without paragraphs fall out."""
    is_heading = col(level).isNotNull()
    assigned = with_last_known(elements, [key], [position], {
        "_section": F.when(is_heading, F.struct(col(position).alias("p"), col(text).alias("t"), col(level).alias("l")))
    }, **options)
    return assigned.where(~is_heading).select(
        key, position,
        F.coalesce(F.col("_section")["t"], F.lit("")).alias("heading"),
        F.coalesce(F.col("_section")["l"], F.lit(0)).alias("heading_level"),
        F.coalesce(F.col("_section")["p"], F.lit(-1)).alias("heading_position"),
        col(text).alias("text"))


def text_blocks(tokens: DataFrame, block: list[str], order: list[str], *, text: str = "text", confidence: str = "conf",
                per_part: int = 100_000, **options) -> DataFrame:
    """Tokens joined to blocks with mean confidence and bounding box.

    The text of a block with more than ``per_part`` tokens comes in several
    ordered parts; the figures are those of the whole block.
    """
    figures = tokens.groupBy(*block).agg(
        F.round(F.avg(confidence), 6).alias("confidence"),
        F.min("left").alias("x"), F.min("top").alias("y"),
        F.sum("width").alias("width"), F.max("height").alias("height"))
    numbered = with_row_number(tokens.where(col(text).isNotNull()).select(*block, *order, text), block, order, **options)
    texts = (
        numbered.withColumn("part", F.floor((F.col("row_no") - 1) / per_part) + 1)
        .groupBy(*block, "part")
        .agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("row_no", col(text).alias("t")))), lambda e: e["t"]), " ").alias("text"))
    )
    return null_safe_join(figures, texts, block).withColumns({
        "part": F.coalesce("part", F.lit(1)), "text": F.coalesce("text", F.lit(""))})


def batch_numbers(df: DataFrame, order: list[str], size: int, **options) -> DataFrame:
    """Number fixed-size batches over the rows in the given (total) order."""
    return with_row_number(df, [], order, **options).withColumn(
        "batch", F.floor((F.col("row_no") - 1) / size) + 1)
