"""Column profiles: counts, distinct values, first samples and inferred type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.contract import Contract
from tributary.functions import text
from tributary.session import materialize
from tributary.sources.readers import ROW_NUM, SOURCE, data_columns

SAMPLES = 5

# Fixed value: what a date looks like to the profiler.
DATE_LIKE = r"^\d{1,4}[-/\.]\w{1,3}[-/\.]\d{2,4}$|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"


def cells(df: DataFrame) -> DataFrame:
    """Every cell of a source as (source, column, value, row_num)."""
    cols = data_columns(df)
    return (df.unpivot([SOURCE, ROW_NUM], cols, "column", "value")
            .select(F.col(SOURCE).alias("source"), "column", "value", F.col(ROW_NUM).alias("row_num")))


def all_cells(sources: list[DataFrame]) -> DataFrame:
    out = cells(sources[0])
    for df in sources[1:]:
        out = out.unionByName(cells(df))
    return out


def value_counts(cells_df: DataFrame) -> DataFrame:
    """One row per distinct value of each column; repeated values are combined before the shuffle."""
    return cells_df.groupBy("source", "column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_num").alias("first_row"))


def column_stats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("source", "column").agg(*_counted()).transform(with_ratios)


def _counted() -> list[Column]:
    known = F.col("value").isNotNull()
    return [F.sum("n").alias("total_count"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null_count"),
            F.count_if(known).alias("distinct_count")]


def with_ratios(stats: DataFrame) -> DataFrame:
    known = F.col("non_null_count")
    return stats.withColumns({
        "null_rate": F.round(1.0 - known / F.col("total_count"), 3),
        "uniqueness_ratio": F.when(known > 0, F.round(F.col("distinct_count") / known, 3)).otherwise(0.0),
    })


def column_stats_quick(cells_df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """The same statistics in one pass with an estimated distinct count; no value is shuffled."""
    out = cells_df.groupBy("source", "column").agg(
        F.count(F.lit(1)).alias("total_count"), F.count("value").alias("non_null_count"),
        F.approx_count_distinct("value", rsd).alias("distinct_count"))
    return with_ratios(out)


def column_samples(counts: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first ``n`` distinct values of each column in row order.

    The rank filter is pushed below the shuffle, so each task sends at most
    ``n`` values per column.
    """
    first = Window.partitionBy("source", "column").orderBy("first_row")
    top = (counts.filter(F.col("value").isNotNull())
           .withColumn("position", F.row_number().over(first)).filter(F.col("position") <= n))
    return top.select("source", "column", "position", "value")


def gather_samples(samples: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("position", "value")))
    return samples.groupBy("source", "column").agg(F.transform(pairs, lambda p: p["value"]).alias("sample_values"))


def _looks() -> list[Column]:
    """How many distinct values of a column look like an address, a number or a date."""
    value = F.col("value")
    at = F.contains(value, F.lit("@"))
    return [F.count_if(at).alias("with_at"), F.count_if(at & F.contains(value, F.lit("."))).alias("emails"),
            F.count_if(text.to_number(value).isNotNull()).alias("numbers"), F.count_if(value.rlike(DATE_LIKE)).alias("dates")]


def _hits(contract: Contract | None) -> Column:
    """How many distinct values are words of each enum field, and how many fit the pattern of each field that has one."""
    value, found = F.col("value"), []
    for f in contract.fields if contract else ():
        if f.type == "enum":
            found += [F.lit(f"words:{f.name}"), F.count_if(F.lower(F.trim(value)).isin(*f.vocabulary()))]
        if f.pattern:
            found += [F.lit(f"pattern:{f.name}"), F.count_if(F.trim(value).rlike(f.anchored_pattern))]
    return (F.create_map(*found) if found else F.create_map()).cast("map<string,bigint>").alias("hits")


def infer_type() -> Column:
    """email, decimal, date or string, judged on all distinct values."""
    n = F.col("distinct_count")
    return (
        F.when(n == 0, "string")
        .when(F.col("emails") == n, "email")
        .when(F.col("numbers") / n >= 0.8, "decimal")
        .when(F.col("dates") / n >= 0.7, "date")
        .otherwise("string"))


def profile(sources: list[DataFrame], contract: Contract | None = None) -> DataFrame:
    """One row per (source, column) with counts, ratios, first samples and type.

    The samples are for display; the type, and with a ``contract`` the hits
    that mapping scores, come from every distinct value of the column.
    """
    counts = materialize(value_counts(all_cells(sources)), "value_counts")
    samples = gather_samples(column_samples(counts))
    stats = counts.groupBy("source", "column").agg(*_counted(), *_looks(), _hits(contract)).transform(with_ratios)
    out = stats.withColumn("inferred_type", infer_type()).join(samples, ["source", "column"], "left")
    return out.withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
