"""Review sources: CSV, JDBC and Parquet, all ending in one schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.schema import CLEANED_CSV_SCHEMA, DERIVED_COLUMNS, RAW_SCHEMA, REVIEW_SCHEMA, SOURCE_HEADER

CSV_OPTIONS = {
    "header": "true", "encoding": "UTF-8", "mode": "FAILFAST", "nullValue": "",
    "dateFormat": "yyyy-MM-dd", "multiLine": "true", "quote": '"', "escape": '"',
    "enforceSchema": "true",
}


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header), the first line of every file that has one, without its byte-order mark.

    Files are read in blocks and line by line, as text always is; only the lines of each file's first
    block are looked at, and the first of them is a minimum that every task takes for itself.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    first = lines.withColumn("line", F.monotonically_increasing_id()).filter("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("h"))
    return first.select("file", F.regexp_replace(F.regexp_replace("h", "^\ufeff", ""), "\r$", "").alias("header"))


def header_deviations(headers: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(file, columns, position, found, wanted) of every header that is not exactly the expected names in order.

    ``position`` is that of the first difference, from 0; a name too few or too many is null on its side.
    Names are read as a CSV line, so a quoted name may hold a comma.
    """
    room = 2 * len(expected) + 2
    schema = ", ".join(f"c{i} string" for i in range(room))
    # A comma and a mark behind the line tell a missing column from an empty name.
    parsed = F.from_csv(F.concat("header", F.lit(",\u0001")), F.lit(schema), {"quote": '"', "escape": '"'})
    names = headers.select("file", parsed.alias("p")).select("file", F.array(*[F.trim(f"p.c{i}") for i in range(room)]).alias("all"))
    names = names.withColumn("columns", F.coalesce(F.nullif(F.array_position("all", "\u0001"), F.lit(0)) - 1, F.lit(room)).cast("int"))
    wanted = F.array(*[F.lit(n) for n in expected])
    pairs = F.transform(F.sequence(F.lit(0), F.lit(room - 1)), lambda i: F.struct(
        i.alias("position"), F.when(i < F.col("columns"), F.coalesce(F.get("all", i), F.lit(""))).alias("found"), F.get(wanted, i).alias("wanted")))
    wrong = F.filter(pairs, lambda p: ~p["found"].eqNullSafe(p["wanted"]))
    return names.withColumn("d", F.get(wrong, F.lit(0))).filter("d IS NOT NULL").select("file", "columns", "d.position", "d.found", "d.wanted")


def check_header(spark: SparkSession, path: str, expected: list[str]) -> None:
    """The first line of every file must carry exactly the expected names in order (BOM ignored).

    One deviating file at most reaches the driver.
    """
    headers = file_headers(spark, path).filter(F.trim("header") != "")
    if headers.isEmpty():
        raise ValueError(f"source file is empty: {path}")
    wrong = header_deviations(headers, expected).orderBy("file").limit(1).collect()
    for r in wrong:
        if r.columns != len(expected):
            raise ValueError(f"{r.file}: expected {len(expected)} columns, found {r.columns}")
        raise ValueError(f"{r.file}: column {r.position} is {r.found!r}, expected {r.wanted!r}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Declared schema, no inference, quoted line breaks and doubled quotes allowed."""
    check_header(spark, path, schema.fieldNames())
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 15-column source file with operator column names, every field still text."""
    df = read_csv(spark, path, RAW_SCHEMA)
    return df.select([F.coalesce(F.col(h), F.lit("")).alias(n) for h, n in SOURCE_HEADER])


def read_cleaned_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 23-column cleaned file, typed and renamed."""
    df = read_csv(spark, path, CLEANED_CSV_SCHEMA)
    return df.select(
        *[F.col(h).alias(n) for h, n in SOURCE_HEADER], *[n for n, _ in DERIVED_COLUMNS]
    )


def jdbc_options(
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[int, int] = (1, 1000),
    partitions: int = 4,
    fetch_size: int = 1000,
    **extra: str,
) -> dict[str, str]:
    """Reader options; ``table`` may be a name or ``(SELECT ...) t``."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **extra}
    if partition_column:
        options.update(
            partitionColumn=partition_column, lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]), numPartitions=str(partitions),
        )
    return options


def read_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def canonical_reviews(df: DataFrame) -> DataFrame:
    """One column set and one type per column, counts and flags never NULL.

    Databases hand back wide or boolean types for unsigned and tiny integers, hence the casts.
    """
    zero_filled = {"like_count", "image_count", "content_length", "ip_is_unknown", "is_low_info", "is_dup_content"}
    columns = []
    for field in REVIEW_SCHEMA.fields:
        c = F.col(field.name) if field.name in df.columns else F.lit(None)
        c = c.cast(field.dataType)
        if field.name in zero_filled:
            c = F.coalesce(c, F.lit(0).cast(field.dataType))
        columns.append(c.alias(field.name))
    return df.select(columns)


def load_reviews(spark: SparkSession, source: str, **options) -> DataFrame:
    """``csv`` (path), ``parquet`` (path) or ``jdbc`` (options, optional spots join)."""
    if source == "csv":
        return canonical_reviews(read_cleaned_csv(spark, options["path"]))
    if source == "parquet":
        return canonical_reviews(spark.read.parquet(options["path"]))
    if source in ("jdbc", "db"):
        reviews = read_jdbc(spark, options["reviews"])
        if "spots" in options:
            spots = read_jdbc(spark, options["spots"]).select("spot_id", "spot_name")
            reviews = with_spot_name(reviews, spots)
        return canonical_reviews(reviews)
    raise ValueError("source must be csv, parquet, jdbc or db")


def with_spot_name(reviews: DataFrame, spots: DataFrame) -> DataFrame:
    """Fact to dimension.  No hint: Spark broadcasts only below its checked size limit."""
    return reviews.join(spots, "spot_id", "left")
