"""Sources as all-string tables with row lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tributary.functions import text
from tributary.sources.records import Dialect, split_records

SOURCE, ROW_NUM = "_source", "_row_num"
FORMATS = ("csv", "json", "parquet", "orc")
# Without column pruning the parser counts the cells of every row, whichever of them a plan needs.
CSV = {"header": "true", "multiLine": "false", "ignoreLeadingWhiteSpace": "false", "columnPruning": "false"}
_TORN, _FILE = "_torn_row", "_record_file"


def read_source(spark: SparkSession, path: str, source: str, fmt: str | None = None, **options) -> DataFrame:
    """Read one export; every column becomes a trimmed string, null tokens become NULL.

    ``source`` is the logical name that rules and precedence refer to. Rows
    are numbered from 1 in file order.
    """
    return read_raw(spark, path, source, fmt, **options).transform(all_strings)


def read_raw(spark: SparkSession, path: str, source: str, fmt: str | None = None, **options) -> DataFrame:
    """The cells as text, exactly as the file holds them, with row lineage.

    A CSV row with more or fewer cells than the header is an error, never cut
    or filled; ``rejects`` lists such rows, and ``mode="DROPMALFORMED"`` reads
    the others. Quoted line breaks need ``multiLine="true"``: records are then
    put together from their lines (``records.split_records``), in as many tasks
    as the file has blocks; without it the torn row is such an error.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in FORMATS:
        raise ValueError(f"source {source}: unsupported format '{fmt}' (use one of {', '.join(FORMATS)})")
    if fmt == "csv" and _over_lines(options):
        cells, torn = _parsed_records(spark, path, options)
        if options.get("mode", "FAILFAST").upper() == "DROPMALFORMED":
            cells = cells.filter(torn.isNull())
        elif options.get("mode", "FAILFAST").upper() == "FAILFAST":
            refused = F.raise_error(F.concat(F.lit("malformed CSV record: "), torn)).cast("long")
            cells = cells.withColumn(ROW_NUM, F.when(torn.isNull(), F.col(ROW_NUM)).otherwise(refused))
        return cells.drop(_TORN, _FILE).withColumn(SOURCE, F.lit(source))
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(**CSV, mode="FAILFAST")
    raw = reader.options(**options).format(fmt).load(path)  # a missing path fails here
    cells = [c if dict(raw.dtypes)[c] == "string" else f"CAST({_quoted(c)} AS STRING) AS {_quoted(c)}" for c in raw.columns]
    cells = [_quoted(c) if c in raw.columns else c for c in cells]
    return with_file_order(raw).selectExpr(*cells, ROW_NUM).withColumn(SOURCE, F.lit(source))


def rejects(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, line): the CSV rows that do not fit the header, as they stand in the file."""
    if _over_lines(options):
        cells, torn = _parsed_records(spark, path, options)
        return cells.filter(torn.isNotNull()).select(F.col(_FILE).alias("file"), torn.alias("line"))
    names = spark.read.options(**CSV).options(**options).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in [*names, _TORN]])
    rows = spark.read.options(**CSV).options(**options).options(mode="PERMISSIVE", columnNameOfCorruptRecord=_TORN).schema(schema).csv(path)
    first = F.col(_quoted(names[0]))  # Spark refuses a scan that asks for the torn rows alone
    torn = F.col(_TORN).isNotNull() & (first.isNull() | (F.length(first) >= 0))
    return rows.filter(torn).select(F.col("_metadata.file_path").alias("file"), F.col(_TORN).alias("line"))


def _over_lines(options: dict) -> bool:
    return str(options.get("multiLine", "false")).lower() == "true"


def _parsed_records(spark: SparkSession, path: str, options: dict) -> tuple[DataFrame, Column]:
    """The cells of all records with ``_row_num``, the file and, of records that do not fit the header, their text."""
    settings = {**CSV, **options}
    settings.pop("mode", None)
    header = str(settings.pop("header")).lower() == "true"
    dialect = Dialect(**{k: settings.pop(k) for k in ("sep", "quote", "escape") if k in settings})
    names = spark.read.options(**settings, **dialect.options, header=header).csv(path).columns  # reads the first record only
    schema = StructType([StructField(c, StringType()) for c in [*names, _TORN]])
    parsing = {**settings, **dialect.options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _TORN}
    cells = F.from_csv("record", ", ".join(f"{_quoted(f.name)} STRING" for f in schema), parsing)
    rows = split_records(spark, path, dialect, header).select(cells.alias("c"), F.col("row_num"), F.col("file"))
    return rows.select(*[F.col("c." + _quoted(c)).alias(c) for c in [*names, _TORN]], F.col("row_num").alias(ROW_NUM), F.col("file").alias(_FILE)), F.col(_TORN)


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def all_strings(df: DataFrame) -> DataFrame:
    """Every data column as clean text; lineage columns pass through."""
    cells = [c if c in (SOURCE, ROW_NUM) else f"{text.clean_sql(c)} AS `{c.replace('`', '``')}`" for c in df.columns]
    return df.selectExpr(*cells)


def with_file_order(df: DataFrame) -> DataFrame:
    """Number the rows of a file scan from 1, file by file and block by block.

    Only one row per file block is ordered; the rows themselves are looked up
    by their block, whose size the scan already bounds.
    """
    marked = df.withColumns({
        "_file": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_mark": F.monotonically_increasing_id(),
    })
    blocks = marked.groupBy("_file", "_block").agg(F.min("_mark").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (marked.join(offsets, ["_file", "_block"])
            .withColumn(ROW_NUM, F.col("_offset") + F.col("_mark") - F.col("_first") + 1)
            .drop("_file", "_block", "_mark", "_first", "_offset"))


def from_frame(df: DataFrame, source: str, row_num: str | Column) -> DataFrame:
    """A source that is already a DataFrame with its own row number column."""
    number = F.col(row_num) if isinstance(row_num, str) else row_num
    drop = [row_num] if isinstance(row_num, str) else []
    return (df.withColumns({ROW_NUM: number.cast("long"), SOURCE: F.lit(source)}).drop(*drop)
            .transform(all_strings))


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (SOURCE, ROW_NUM)]


def landing(df: DataFrame) -> DataFrame:
    """Source rows as (source, row_num, raw_json); rows of ``read_raw`` land as the file holds them."""
    cells = F.struct(*[F.col(f"`{c}`") for c in data_columns(df)])
    return df.select(F.col(SOURCE).alias("source"), F.col(ROW_NUM).alias("row_num"), F.to_json(cells).alias("raw_json"))


def ingest_summary(sources: list[DataFrame]) -> DataFrame:
    """Row count and column list per source."""
    out = None
    for df in sources:
        cols = data_columns(df)
        part = df.groupBy(F.col(SOURCE).alias("source")).agg(F.count(F.lit(1)).alias("row_count")).withColumns({
            "column_count": F.lit(len(cols)), "columns": F.lit(",".join(cols))})
        out = part if out is None else out.unionByName(part)
    return out
