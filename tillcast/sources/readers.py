"""Sources: sales, returns and master tables from CSV or Parquet."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions.calendar import month_key, week_key
from tillcast.sources import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """CSV (with header) or Parquet, by ``fmt`` or by the path's ending.

    CSV columns are found by their trimmed header name, whatever their order.
    With a schema the result has its columns and types: absent columns and
    values that do not parse are null, further columns are left out, and an
    absent required column is an error. Files of one folder must share a header.
    """
    kind = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if kind != "csv":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.format(kind).load(path)
    text = (spark.read.option("header", True).option("enforceSchema", False)
            .option("mode", "PERMISSIVE").csv(path))
    text = text.toDF(*[name.strip() for name in text.columns])
    missing = [name for name in required if name not in text.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    if schema is None:
        return text
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return text.select(*[
        (F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType) if f.name in text.columns
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])


def csv_headers(spark: SparkSession, path: str, most: int = 1 << 16) -> dict[str, tuple[str, ...]]:
    """The trimmed header of every CSV file below a folder, from the first line alone.

    ``most`` bounds the bytes read of a file; a longer header is an error."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found, files = {}, fs.listFiles(root, True)
    names = []
    while files.hasNext():
        name = files.next().getPath()
        if not name.getName().startswith(("_", ".")):
            names.append(name.toString())

    def first_line(name: str) -> str:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(name))
        try:
            reader = spark._jvm.org.apache.hadoop.util.LineReader(stream)
            line = spark._jvm.org.apache.hadoop.io.Text()
            if reader.readLine(line, most) >= most:
                raise ValueError(f"the header of {name} is longer than {most} bytes")
            return line.toString()
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        for name, line in zip(names, pool.map(first_line, names), strict=True):
            if line.strip():  # an empty file has no rows
                cells = next(csv.reader([line.lstrip("\ufeff")]))
                found[name] = tuple(cell.strip() for cell in cells)
    return found


def read_mixed(spark: SparkSession, path: str, schema: T.StructType | str,
               required: Sequence[str] = (), names: dict[str, str] | None = None) -> DataFrame:
    """CSV files of one folder whose headers differ in order, spelling or number of columns.

    Files are grouped by header, each group is read by name, and the groups are united. ``names``
    maps other spellings of a column, in any case, to its name. A column that a group lacks is
    null there; a required one is an error that names the files. Of two columns with one name the
    first in the schema's spelling counts, else the first.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    spelled = {k.strip().lower(): v for k, v in (names or {}).items()}
    spelled |= {f.name.lower(): f.name for f in wanted.fields}
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in csv_headers(spark, path).items():
        groups.setdefault(header, []).append(file)
    out = None
    for header, files in sorted(groups.items()):
        place: dict[str, int] = {}
        for i, cell in enumerate(header):
            name = spelled.get(cell.lower())
            if name and (name not in place or (cell == name != header[place[name]])):
                place[name] = i
        missing = [name for name in required if name not in place]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in {', '.join(sorted(files)[:3])}"
                             + (f" and {len(files) - 3} more" if len(files) > 3 else ""))
        text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        part = (spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE")
                .option("enforceSchema", True).csv(files))
        part = part.select(*[
            (F.trim(F.col(f"c{place[f.name]}")).try_cast(f.dataType) if f.name in place
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], wanted) if out is None else out


def read_sales(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Sales in the standard schema with ``Month`` and ``Week`` labels."""
    return with_period_labels(
        read_table(spark, path, schemas.SALES, fmt, schemas.REQUIRED_SALES))


def with_period_labels(sales: DataFrame) -> DataFrame:
    return sales.withColumns({"Month": month_key("Date"), "Week": week_key("Date")})


def first_available(spark: SparkSession, paths: Sequence[str],
                    fmt: str | None = None) -> tuple[str, DataFrame]:
    """First path of a priority list that exists, with its data."""
    for path in paths:
        try:
            return path, read_table(spark, path, fmt=fmt)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of the sources exists: {list(paths)}")


def clean_sales(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    """Trimmed column names, ``SKU`` spelled one way, rows without a valid date dropped."""
    trimmed = raw.toDF(*[name.strip() for name in raw.columns])
    if "sku" in trimmed.columns:
        trimmed = trimmed.withColumnRenamed("sku", "SKU")
    text = F.trim(F.col("Date").cast("string"))
    parsed = (F.try_to_timestamp(text, F.lit(date_format)) if date_format
              else F.try_to_timestamp(text))
    return (trimmed.withColumn("Date", parsed.cast("date"))
            .dropna(subset=["Date"]))


def rename_columns(raw: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Raw column names mapped to the standard ones; unknown names stay."""
    return raw.withColumnsRenamed(names or schemas.RAW_NAMES)


def sku_master(entries: DataFrame, order_col: str | None = None) -> DataFrame:
    """One category per SKU. A repeated SKU takes its last entry.

    Entries are ranked by ``order_col``; without one they must come straight
    from files and rank by file path, then by their place in the file.
    """
    if order_col:
        rank = F.col(order_col)
    else:
        rank = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                        F.monotonically_increasing_id().alias("row"))
    return (entries.where(F.col("sku").isNotNull())
            .select("sku", "category", rank.alias("_entry"))
            .groupBy("sku").agg(F.max_by("category", "_entry").alias("category")))


def moq_or_estimate(moq: DataFrame | None, estimate: DataFrame) -> DataFrame:
    """Supplier terms as read, or the estimate when the table has no ``moq`` column."""
    if moq is None or "moq" not in moq.columns:
        return estimate
    return moq.select("sku", "moq", "lead_time_days", "supplier", "unit_cost")


def tag_and_union(sales: DataFrame, returns: DataFrame | None) -> DataFrame:
    """Sales and returns in one table, told apart by ``Type``."""
    tagged = sales.withColumn("Type", F.lit("Sales"))
    if returns is None:
        return tagged
    renamed = (returns.withColumnRenamed("sku", "SKU") if "sku" in returns.columns
               else returns)
    return tagged.unionByName(renamed.withColumn("Type", F.lit("Returns")),
                              allowMissingColumns=True)


def history_split(sales: DataFrame, first_day: str = "2018-01-01",
                  last_day: str = "2024-11-30") -> DataFrame:
    """Rows of the pattern period, with calendar columns to partition by."""
    period = F.col("Date").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    return sales.where(period).withColumns({
        "Year": F.year("Date"), "Month": F.month("Date"), "Quarter": F.quarter("Date")})


def data_freshness(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Per source whether it exists and when it last changed, and the latest change overall.

    Only file listings are read, never file contents.
    """
    listed = None
    for name, path in sources.items():
        try:
            files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                     .load(path).select(F.col("modificationTime").alias("t")))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            files = spark.range(0).select(F.lit(None).cast("timestamp").alias("t"))
        one = (files.agg(F.max("t").alias("last_modified"))
               .select(F.lit(name).alias("source"), "last_modified",
                       F.col("last_modified").isNotNull().alias("file_exists")))
        listed = one if listed is None else listed.unionByName(one)
    latest = listed.agg(F.max("last_modified").alias("m"))
    return listed.withColumn("last_updated", latest.scalar())
