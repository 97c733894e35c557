"""Result browsing: chart frame, filter/search, sort, pages, display projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpool.functions.labels import CLASS_NAMES, class_id_of
from textpool.functions.text import strip_ws

PAGE_SIZE = 25
PREVIEW_CHARS = 100


def chart_frame(df: DataFrame) -> DataFrame:
    """``sentiment`` is required; keep ``confidence >= 0`` when the column exists."""
    if "sentiment" not in df.columns:
        raise ValueError(f"a chart needs a sentiment column, got {df.columns}")
    return df.filter(F.col("confidence") >= 0.0) if "confidence" in df.columns else df


def labels_present(df: DataFrame) -> DataFrame:
    """Distinct labels present, with their canonical class index."""
    return df.select("sentiment").distinct().select("sentiment", class_id_of("sentiment").alias("class_index"))


def search(df: DataFrame, sentiment: str = "All", query: str = "") -> DataFrame:
    """Sentiment equality (or "All") and case-insensitive substring match on text."""
    cond: Column = F.lit(True) if sentiment == "All" else (F.col("sentiment") == F.lit(sentiment))
    if query:
        cond = cond & F.contains(F.lower(F.col("text")), F.lower(F.lit(query)))
    return df.filter(cond)


def sort_order(key: str, direction: str = "asc", tie: str = "id") -> list[Column]:
    """T2's order: nulls behave as the empty (smallest) value; ``tie`` makes it total."""
    c = F.col(key)
    return [c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last(), F.col(tie).asc()]


def sort_rows(df: DataFrame, key: str, direction: str = "asc", tie: str = "id") -> DataFrame:
    """User sort; nulls behave as the empty (smallest) value; ``tie`` gives a total order."""
    return df.orderBy(*sort_order(key, direction, tie))


def page(df: DataFrame, page_no: int, key: str, direction: str = "asc", tie: str = "id",
         page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of the sorted rows, without a full sort.

    Shallow pages are a top-k of ``page_no · page_size`` rows
    (TakeOrderedAndProject).  Deeper pages would send partitions × that many
    rows to one task, so they use the range-partitioned global rank instead
    and keep the rows whose rank falls in the page.  The page number is
    clamped to ``[1, total_pages]`` by :func:`clamped_page`.
    """
    from textpool.operators import ranking as R
    p = max(1, int(page_no))
    start = (p - 1) * page_size
    order = sort_order(key, direction, tie)
    if start + page_size <= R.TOPK_SINGLE_TASK_LIMIT:
        return df.orderBy(*order).offset(start).limit(page_size)
    ranked = R.with_order_rank(df, order, "_pos")
    return ranked.filter((F.col("_pos") >= start) & (F.col("_pos") < start + page_size)) \
        .orderBy("_pos").drop("_pos")


def total_pages(df: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(page_size))).cast("long").alias("total_pages"))


def clamped_page(df: DataFrame, page_no: int, key: str, direction: str = "asc", tie: str = "id",
                 page_size: int = PAGE_SIZE) -> DataFrame:
    """T3 with the page clamped to ``[1, total_pages]`` (one count job, then a top-k).

    The columns ``page_no`` and ``total_pages`` say which page it is.
    """
    last = total_pages(df, page_size).first()["total_pages"]
    p = min(max(1, int(page_no)), last)
    return page(df, p, key, direction, tie, page_size) \
        .withColumn("page_no", F.lit(p).cast("long")).withColumn("total_pages", F.lit(last).cast("long"))


def with_page_position(rows: DataFrame, page_no: int, key: str, direction: str = "asc", tie: str = "id",
                       page_size: int = PAGE_SIZE, out: str = "position") -> DataFrame:
    """The 1-based place of each row of one page (≤ ``page_size`` rows) in the whole sorted table."""
    w = Window.partitionBy(F.lit(1)).orderBy(*sort_order(key, direction, tie))
    return rows.withColumn(out, F.row_number().over(w) + F.lit((max(1, int(page_no)) - 1) * page_size))


def preview(df: DataFrame) -> DataFrame:
    """Text cut at 100 chars + '…', confidence with 4 decimals, probabilities as 'x.x%'."""
    t = F.col("text")
    cut = F.when(F.length(t) > PREVIEW_CHARS, F.concat(F.substring(t, 1, PREVIEW_CHARS), F.lit("…"))).otherwise(t)
    out = df.withColumn("text_preview", cut).withColumn("confidence_4dp", F.round("confidence", 4))
    for i, name in enumerate(CLASS_NAMES):
        col = f"p{i}"
        if col in df.columns:
            out = out.withColumn(f"{name.lower()}_pct", F.format_string("%.1f%%", F.round(F.col(col) * 100, 1)))
    return out


def topic_columns(df: DataFrame, title: str | None, keywords: str | None) -> DataFrame:
    """Trimmed topic title / keywords as literal columns (default empty)."""
    return df.withColumn("topic_title", strip_ws(F.lit(title or ""))).withColumn(
        "keywords_subtitle", strip_ws(F.lit(keywords or "")))
