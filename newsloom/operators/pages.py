"""Pages of a stored table at any depth, by tokens instead of offsets.

The table is kept in the order of its pages, cut into ranges: a folder per range, and one row
per range that says how it begins, how it ends and how many rows it has.  A page names the last row it
showed; the next one begins in the range of that row and reads as many ranges as it takes to
fill it, usually one, whatever the number of the page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import tables

# how each order sorts: its column, and whether large values come first; nulls always come last
ORDERS = {"published": ("published", True), "created": ("created_at", True), "title": ("title", False)}

# what one task puts in order: of the files that articles come from, and rows; it writes as many ranges as that makes
TASK_BYTES, TASK_ROWS = 32 << 20, 100_000


@dataclass(frozen=True)
class PageToken:
    """The last row that was shown."""
    value: object
    article_id: str


def _sort(order: str) -> list[Column]:
    column, down = ORDERS[order]
    return [F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_last(), F.col("article_id").asc()]


def write_ordered(articles: DataFrame, path: str, order: str, rows_per_range: int = 100_000) -> None:
    """Write ``articles`` in the order of its pages, about ``rows_per_range`` to a range.

    Tasks are as many as the bytes and rows ask for, however small the ranges are: Spark samples a hundred or more keys
    for each of them into the driver, and a title may be long.  A task cuts its own rows into ranges.
    """
    spark = articles.sparkSession
    n = articles.count()
    ranges = max(1, -(-n // rows_per_range))
    by_bytes = tables.tasks_for(spark, tables.input_bytes(articles), TASK_BYTES, TASK_BYTES >> 5)
    tasks = min(ranges, max(by_bytes, -(-n // TASK_ROWS)))
    # the number of a task stands above its 33rd bit, that of a row of the task below
    numbered = (articles.repartitionByRange(tasks, *_sort(order)).sortWithinPartitions(*_sort(order))
                .withColumn("_n", F.monotonically_increasing_id()))
    task, row = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    placed = numbered.withColumn("page_range", (task * F.lit(ranges) + F.floor(row / F.lit(rows_per_range))).cast("long")).drop("_n")
    placed.write.mode("overwrite").partitionBy("page_range").parquet(f"{path}/{order}/rows")
    column, _ = ORDERS[order]
    rows = _rows(spark, path, order, articles.schema).select("page_range", F.struct(
        F.col(column).isNull().alias("none"), F.col(column).alias("value"), "article_id").alias("key"), _rank(order).alias("place"))
    bounds = rows.groupBy("page_range").agg(F.count("*").alias("n"), F.max_by("key", "place").alias("last"))
    bounds.select("page_range", "n", "last.*").coalesce(1).write.mode("overwrite").parquet(f"{path}/{order}/ranges")


def _rank(order: str) -> Column:
    """Place of a row inside its range."""
    return F.row_number().over(Window.partitionBy("page_range").orderBy(*_sort(order)))


def _rows(spark: SparkSession, path: str, order: str, schema: StructType, ranges: list[int] | None = None) -> DataFrame:
    """All rows, or those of some ranges: then the folders of no others are listed."""
    home = f"{path}/{order}/rows"
    reader = spark.read.schema(StructType(list(schema.fields)).add("page_range", "long")).option("basePath", home)
    rows = reader.parquet(*[f"{home}/page_range={r}" for r in ranges] if ranges else [home])
    return rows if ranges is None else rows.filter(F.col("page_range").isin(ranges))


def _after(order: str, token: PageToken, value: Column, article_id: Column) -> Column:
    """Rows behind a token."""
    _, down = ORDERS[order]
    if token.value is None:
        return value.isNull() & (article_id > token.article_id)
    last = F.lit(token.value)
    further = value < last if down else value > last
    return further | ((value == last) & (article_id > token.article_id)) | value.isNull()


def page_after(spark: SparkSession, path: str, schema: StructType, order: str = "published", token: PageToken | None = None,
               per_page: int = 20, condition: Column | None = None) -> DataFrame:
    """The page behind ``token`` (the first one without), of the rows that meet ``condition``.

    Ranges that end before the token are not opened.  Without a condition the counts say how many
    ranges a page needs; with one, the number of ranges read is doubled until the page is full.
    """
    if not 1 <= per_page <= 100:
        raise ValueError("per_page must be between 1 and 100")
    column, _ = ORDERS[order]
    kind = schema[column].dataType.simpleString()
    ranges = spark.read.schema(f"page_range long, n long, none boolean, value {kind}, article_id string").parquet(f"{path}/{order}/ranges")
    if token is not None:
        last = F.col("value").cast(kind)
        reaches = _after(order, token, F.when(~F.col("none"), last), F.col("article_id"))
        ranges = ranges.filter(reaches)
    # the range of the token has an unknown part behind it, so its rows are not counted on
    wanted, opened = 2 if token is not None else 1, 0
    while True:
        chosen = ranges.orderBy("page_range").limit(wanted).select("page_range", "n").collect()
        if condition is None:
            sure = [r.n for r in chosen[1:]] if token is not None else [r.n for r in chosen]
            full = sum(sure) >= per_page
        else:
            full = None
        found = _rows(spark, path, order, schema, [r.page_range for r in chosen])
        if token is not None:
            found = found.filter(_after(order, token, F.col(column), F.col("article_id")))
        if condition is not None:
            found = found.filter(condition)
        page = found.orderBy(*_sort(order)).limit(per_page)
        if len(chosen) < wanted or len(chosen) == opened or full or (full is None and page.count() >= per_page):
            return page.select(*[f.name for f in schema.fields])
        opened, wanted = len(chosen), 2 * wanted
