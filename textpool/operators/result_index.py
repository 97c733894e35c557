"""T2, T3, P14 over a written copy: pages by key ranges and substring search by trigrams, reading only the files that matter.

The rows are range-partitioned by (sort key, tie) and written one file per
range. Beside them lie one row per file (its rows, first and last key) and
the distinct (trigram, file) pairs of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from textpool.functions.arrays import explode_values
from textpool.operators.explore import PAGE_SIZE, search, sort_order

GRAM = 3


def _with_grams(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_g``, the distinct runs of three characters of the lower-cased text.

    The characters are a column of their own: inside the lambda they would be
    split again for every run, and a text's cost would be its length squared.
    """
    split = df.withColumn("_chars", F.split(F.lower(F.col(text)), ""))
    n = F.size("_chars") - (GRAM - 1)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(*[F.get("_chars", i + k) for k in range(GRAM)]))
    return split.withColumn("_g", F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))).drop("_chars")


class ResultIndex:
    """A copy of a result table, clustered by ``key`` (nulls first) and ``tie``, which must be unique."""

    def __init__(self, spark: SparkSession, path: str, key: str, tie: str = "id", text: str = "text"):
        self.spark, self.path, self.key, self.tie, self.text = spark, path, key, tie, text
        self.files = spark.read.parquet(f"{path}/files")

    @classmethod
    def write(cls, df: DataFrame, path: str, key: str, tie: str = "id", text: str = "text", n_files: int | None = None) -> ResultIndex:
        spark = df.sparkSession
        order = sort_order(key, "asc", tie)
        n = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
        rows = spark.read.schema(df.schema).parquet(f"{path}/rows").withColumn("_file", F.col("_metadata.file_name"))
        place = F.struct(F.col(key).alias("key"), F.col(tie).alias("tie"))
        rows.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low"), F.max(place).alias("high")) \
            .write.parquet(f"{path}/files")
        grams = explode_values(_with_grams(rows.select("_file", F.col(text).alias("_t")), "_t"), ["_file"], F.col("_g"), "gram")
        # postings lie sorted by trigram, so a search reads few of their row groups
        grams.select("gram", F.col("_file").alias("file")).distinct().repartitionByRange("gram").sortWithinPartitions("gram") \
            .write.parquet(f"{path}/grams")
        return cls(spark, path, key, tie, text)

    def _read(self, files: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/rows/{f}" for f in files]) if files else rows.limit(0)

    def total_pages(self, page_size: int = PAGE_SIZE) -> int:
        return max(1, -(-(self.files.agg(F.sum("n")).first()[0] or 0) // page_size))

    def page(self, page_no: int, page_size: int = PAGE_SIZE) -> DataFrame:
        """A page by its number, with ``position`` from 1: the files' row counts say which of them hold it."""
        start = (max(1, int(page_no)) - 1) * page_size
        upto = F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, 0))  # one row per file
        held = self.files.select("file", "n", upto.alias("upto")).filter(
            (F.col("upto") > start) & (F.col("upto") - F.col("n") < start + page_size)).orderBy("upto").collect()  # ≤ page_size files
        before = held[0]["upto"] - held[0]["n"] if held else 0
        return self._placed(self._read([r["file"] for r in held]).orderBy(*sort_order(self.key, "asc", self.tie))
                            .offset(start - before).limit(page_size), start)

    def page_after(self, last: Row, page_size: int = PAGE_SIZE, position: int = 0) -> DataFrame:
        """The page that follows the row ``last`` (keyset): only the file that holds it and as many more as the page needs."""
        place = F.struct(F.lit(last[self.key]).cast(self.files.schema["low"].dataType["key"].dataType).alias("key"),
                         F.lit(last[self.tie]).cast(self.files.schema["low"].dataType["tie"].dataType).alias("tie"))
        # every file after the first gives a row at least
        following = self.files.filter(F.col("high") > place).orderBy("low").limit(page_size + 1).select("file", "n").collect()
        needed, rows = [], -following[0]["n"] if following else 0
        for r in following:
            if rows >= page_size:
                break
            needed.append(r["file"])
            rows += r["n"]
        own = F.struct(F.col(self.key).alias("key"), F.col(self.tie).alias("tie"))
        return self._placed(self._read(needed).filter(own > place).orderBy(*sort_order(self.key, "asc", self.tie)).limit(page_size), position)

    def _placed(self, page: DataFrame, before: int) -> DataFrame:
        order = Window.partitionBy(F.lit(1)).orderBy(*sort_order(self.key, "asc", self.tie))  # one page of rows
        return page.withColumn("position", (F.row_number().over(order) + before).cast("long"))

    def candidate_files(self, query: str) -> list[str] | None:
        """Names of the files that hold every trigram of ``query``; None if it is shorter than one."""
        low = self.spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()["q"]  # as texts are lower-cased
        grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not grams:
            return None
        held = self.spark.read.parquet(f"{self.path}/grams").filter(F.col("gram").isin(grams))
        return [r["file"] for r in held.groupBy("file").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(grams)).collect()]

    def search(self, query: str) -> DataFrame:
        """Rows whose text contains ``query`` in any case, verified in the candidate files; short queries read all files."""
        files = self.candidate_files(query)
        rows = self.spark.read.parquet(f"{self.path}/rows") if files is None else self._read(files)
        return search(rows.withColumnRenamed(self.text, "text") if self.text != "text" else rows, query=query)
