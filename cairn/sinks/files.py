"""File sinks: cleaned CSV, statistics JSON, sharded recovery files, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.schema import CLEANED_CSV_SCHEMA, DERIVED_COLUMNS, SOURCE_HEADER
from cairn.sinks.tables import KeyedTable, still_missing

SHARDS = 100


def cleaned_layout(reviews: DataFrame) -> DataFrame:
    """The 23 columns of the cleaned file under their source names."""
    return reviews.select(
        *[F.col(name).cast(CLEANED_CSV_SCHEMA[header].dataType).alias(header) for header, name in SOURCE_HEADER],
        *[F.col(name).cast(kind).alias(name) for name, kind in DERIVED_COLUMNS],
    )


def write_cleaned_csv(reviews: DataFrame, path: str, force: bool = False) -> None:
    """K6: never overwrites unless forced; missing values are empty fields.

    Files carry no byte-order mark: Spark writes one file per task and readers here accept both.
    """
    (
        cleaned_layout(reviews).write.mode("overwrite" if force else "errorifexists")
        .options(header="true", encoding="UTF-8", lineSep="\n", quote='"', escape='"', nullValue="",
                 emptyValue="", dateFormat="yyyy-MM-dd")
        .csv(path)
    )


def cleaned_lines(reviews: DataFrame) -> DataFrame:
    """(line): the 23 columns of each review as one CSV record, quoted only where it has to be."""
    rows = cleaned_layout(reviews)
    record = F.to_csv(F.struct(*rows.columns), {
        "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "dateFormat": "yyyy-MM-dd",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return rows.select(record.alias("line"))


def write_exact_csv(reviews: DataFrame, path: str, force: bool = False) -> None:
    """K6 byte for byte: a byte-order mark and the header at the start of each file, records that end in CR LF.

    Every task writes one file; the first record of a task carries mark and header before it, so rows and
    header are written in one pass.  An empty table gives one file with the header alone.  Line breaks inside
    a field stay as they are; Spark's CSV reader gives a quoted CR LF back as LF.
    """
    header = "\ufeff" + ",".join(CLEANED_CSV_SCHEMA.fieldNames())
    lines = cleaned_lines(reviews)
    if reviews.isEmpty():
        lines = reviews.sparkSession.createDataFrame([(header,)], "line string").coalesce(1)
    else:
        # Rows of a task are numbered from 0 in the low bits; rows pass on to the files as they are numbered.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        lines = lines.select(F.when(first, F.concat(F.lit(header + "\r\n"), "line")).otherwise(F.col("line")).alias("line"))
    lines.write.mode("overwrite" if force else "errorifexists").option("lineSep", "\r\n").text(path)


def write_statistics(row: DataFrame, path: str) -> None:
    """K7: counters as JSON."""
    row.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_recovery(rows: DataFrame, path: str, key: str = "comment_id") -> None:
    """K8: rows that could not be stored, appended with the time of writing and sharded by key."""
    shard = F.lpad(F.pmod(F.col(key), F.lit(SHARDS)).cast("string"), 2, "0")
    rows.withColumns({"shard": shard, "written_at": F.current_timestamp()}).write.mode("append").partitionBy("shard").json(path)


def read_recovery(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """K9: the rows of every shard, and the malformed lines to count; blank lines are neither."""
    full = T.StructType([*schema.fields, T.StructField("written_at", T.TimestampType()), T.StructField("malformed", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})
    lines = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    broken = F.col("malformed").isNotNull()
    return lines.filter(~broken).drop("malformed"), lines.filter(broken).select("malformed")


def replay(table: KeyedTable, recovered: DataFrame) -> DataFrame:
    """Store the recovered rows, the last written of each key, and return what is still missing."""
    table.merge(recovered)
    return still_missing(recovered, table.read(), table.keys)


def save_model(model, path: str) -> None:
    """K11."""
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    """A model saved by ``save_model``; ``kind`` is its class, e.g. ``LDAModel``."""
    return kind.load(path)
