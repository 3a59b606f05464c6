"""Column profiles that add up: one row of sketches per file and column, kept as a table.

A file is read once. What is kept of each of its columns has a fixed size:
counts, HyperLogLog sketches of all values and of those that look like
something, the values that come first, and the most frequent ones. A profile
merges the rows of the files there are; a later load reads only files it has
not seen. Distinct values are estimates (``profile.profile`` counts them);
row counts, and whether every value is an address, are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tributary.contract import Contract
from tributary.functions import text
from tributary.operators.profile import DATE_LIKE, SAMPLES, infer_type, with_ratios
from tributary.sources.readers import CSV, _quoted

#: HyperLogLog sketches of 2 ** LG_K registers; their relative standard error is about 0.83 / sqrt(2 ** LG_K), 1.3 %.
LG_K = 12
#: The first values are looked for among so many rows of each file.
FIRST_ROWS = 1000
FREQUENT = 64
_LOOKS = ("all", "with_at", "emails", "numbers", "dates")


def _shapes(contract: Contract | None) -> dict[str, Column]:
    """What a value may look like, by name."""
    value = F.col("value")
    at = F.contains(value, F.lit("@"))
    found = {"all": value.isNotNull(), "with_at": at, "emails": at & F.contains(value, F.lit(".")), "numbers": text.to_number(value).isNotNull(), "dates": value.rlike(DATE_LIKE)}
    for f in contract.fields if contract else ():
        if f.type == "enum":
            found[f"words:{f.name}"] = F.lower(F.trim(value)).isin(*f.vocabulary())
        if f.pattern:
            found[f"pattern:{f.name}"] = F.trim(value).rlike(f.anchored_pattern)
    return found


def file_cells(raw: DataFrame) -> DataFrame:
    """(file, mark, column, value): every cell of files as clean text; ``mark`` rises from row to row of a file."""
    cleaned = [f"{text.clean_sql(c)} AS {_quoted(c)}" for c in raw.columns]
    strings = raw.select(*[F.col(_quoted(c)).cast("string").alias(c) for c in raw.columns], F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_mark"))
    clean = strings.selectExpr("_file", "_mark", *cleaned)
    return clean.unpivot(["_file", "_mark"], raw.columns, "column", "value").withColumnsRenamed({"_file": "file", "_mark": "mark"})


def sketch(cells: DataFrame, contract: Contract | None = None) -> DataFrame:
    """One row per (file, column). Each task adds up its own rows; what is shuffled does not grow with the values."""
    shapes = _shapes(contract)
    held = [F.hll_sketch_agg(F.when(fits, F.col("value")), F.lit(LG_K)).alias(f"hll_{i}") for i, fits in enumerate(shapes.values())]
    counted = cells.groupBy("file", "column").agg(
        F.count(F.lit(1)).alias("total_count"), F.count("value").alias("non_null_count"), F.count_if(shapes["emails"]).alias("email_rows"),
        F.expr(f"approx_top_k_accumulate(value, {8 * FREQUENT})").alias("frequent"), *held)
    sketches = F.map_from_arrays(F.array(*map(F.lit, shapes)), F.array(*[F.col(f"hll_{i}") for i in range(len(shapes))]))
    first = cells.withColumn("n", F.row_number().over(Window.partitionBy("file", "column").orderBy("mark"))).filter(F.col("n") <= FIRST_ROWS).filter("value IS NOT NULL")
    first = first.groupBy("file", "column", "value").agg(F.min("n").alias("n"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("file", "column").orderBy("n"))).filter(F.col("k") <= SAMPLES)
    first = first.groupBy("file", "column").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("first"))
    kept = counted.select("file", "column", "total_count", "non_null_count", "email_rows", "frequent", sketches.alias("sketches"))
    return kept.join(first, ["file", "column"], "left")


def _reader(spark: SparkSession, fmt: str, options: dict):
    settings = {**CSV, **options} if fmt == "csv" else options
    return spark.read.options(**settings).format(fmt)


def load(spark: SparkSession, path: str, source: str, fmt: str, store: str, contract: Contract | None = None, **options) -> list[str]:
    """Sketch the files of ``path`` that the store does not have as they are now; which files were read.

    A file that changed since is read again, and its new rows count. The
    store is a table by source; every load adds one folder.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    try:
        known = _stored(spark, store).filter(F.col("source") == source).select("file", "modified", "bytes").distinct()
        listed = listed.join(known, ["file", "modified", "bytes"], "left_anti")
    except FileNotFoundError:
        pass
    new = listed.collect()  # names of files, which the scan's own listing holds as well
    if not new:
        return []
    files = spark.createDataFrame(new, listed.schema).withColumn("file", _plain_path(F.col("file")))
    made = sketch(file_cells(_reader(spark, fmt, options).load([r["file"] for r in new])), contract).withColumn("file_key", _plain_path(F.col("file"))).drop("file")
    rows = files.join(made, files["file"] == made["file_key"]).drop("file_key")
    rows.withColumn("loaded_at", F.current_timestamp()).withColumn("source", F.lit(source)).write.mode("append").partitionBy("source").parquet(store)
    return [r["file"] for r in new]


def _plain_path(file: Column) -> Column:
    """One spelling of a local path; scans write file:///a, listings file:/a."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(file, "\\+", "%2B")), "^file:/*", "file:/")


def _stored(spark: SparkSession, store: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(store)
    return spark.read.parquet(store)


def profiles(spark: SparkSession, store: str, contract: Contract | None = None) -> DataFrame:
    """The merged profile of every source and column, with the columns of ``profile.profile``, those that come first and those that are frequent.

    Of a file that was read more than once its last sketch counts.
    """
    rows = _stored(spark, store)
    latest = Window.partitionBy("source", "file", "column").orderBy(F.desc("loaded_at"))
    last_load = rows.groupBy("source", "file").agg(F.max("loaded_at").alias("last"))
    rows = rows.join(last_load, ["source", "file"]).filter("loaded_at = last").withColumn("again", F.row_number().over(latest)).filter("again = 1")
    names = list(_shapes(contract))
    union = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.element_at("sketches", F.lit(n)))), F.lit(0)).alias(f"n_{i}") for i, n in enumerate(names)]
    per_file = F.transform("first", lambda e: F.struct(F.col("file").alias("file"), e["n"].alias("n"), e["value"].alias("value")))
    merged = rows.groupBy("source", "column").agg(
        F.sum("total_count").alias("total_count"), F.sum("non_null_count").alias("non_null_count"), F.sum("email_rows").alias("email_rows"), *union,
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {8 * FREQUENT}), {FREQUENT})").alias("frequent"))
    in_order = rows.select("source", "column", F.explode(per_file).alias("e")).select("source", "column", "e.*")
    in_order = in_order.groupBy("source", "column", "value").agg(F.min(F.struct("file", "n")).alias("at"))
    in_order = in_order.withColumn("k", F.row_number().over(Window.partitionBy("source", "column").orderBy("at"))).filter(F.col("k") <= SAMPLES)
    samples = in_order.groupBy("source", "column").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("f"))
    counted = {n: F.col(f"n_{i}") for i, n in enumerate(names)}
    hits = [x for n in names if n not in _LOOKS for x in (F.lit(n), counted[n])]
    out = merged.select(
        "source", "column", "total_count", "non_null_count", "email_rows", F.least(counted["all"], F.col("non_null_count")).alias("distinct_count"), counted["with_at"].alias("with_at"),
        # every row an address, or not: that is known exactly
        F.when((F.col("email_rows") == F.col("non_null_count")) | (F.col("email_rows") == 0), F.when(F.col("email_rows") > 0, F.least(counted["all"], F.col("non_null_count"))).otherwise(0))
        .otherwise(F.least(counted["emails"], counted["all"] - 1)).cast("long").alias("emails"), counted["numbers"].alias("numbers"), counted["dates"].alias("dates"),
        (F.create_map(*hits) if hits else F.create_map()).cast("map<string,bigint>").alias("hits"), "frequent")
    out = with_ratios(out).withColumn("inferred_type", infer_type()).drop("email_rows").join(samples, ["source", "column"], "left")
    first = F.coalesce(F.transform("f", lambda e: e["value"]), F.array().cast("array<string>"))
    return out.withColumn("sample_values", first).drop("f")
