"""File scans and sinks: raw log text, the typed request table (Parquet
native; CSV for exchange with pandas-written files) and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botlog.functions import logformat as lf
from botlog.session import spread

REQUEST_SCHEMA = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("status", T.LongType()),
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("referrer", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("tz_offset", T.StringType()),
])


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """Raw log lines (``value string``); lines split on \\n, \\r\\n or \\r and
    invalid UTF-8 bytes dropped."""
    return spread(spark.read.text(path)).select(lf.drop_invalid_utf8(F.col("value")).alias("value"))


def write_parsed_log(requests: DataFrame, path: str, partition_by_date: bool = True,
                     mode: str = "overwrite") -> None:
    """Request table -> Parquet, optionally partitioned by UTC date so time
    filters prune whole directories."""
    out = requests
    writer_cols = []
    if partition_by_date:
        out = out.withColumn("date", F.to_date(F.col("timestamp")))
        writer_cols = ["date"]
    w = out.write.mode(mode)
    if writer_cols:
        w = w.partitionBy(*writer_cols)
    w.parquet(path)


def write_clustered_log(requests: DataFrame, path: str, files: int | None = None, row_group_bytes: int = 16 << 20,
                        mode: str = "overwrite") -> None:
    """Request table -> Parquet ordered by address and time, for questions
    about one address: files are ranges of (ip, timestamp), rows are sorted
    in them, and row groups are small, so their statistics let a filter on
    ``ip`` read a few row groups of the table. An address of any size is split
    over files by time. ``files`` is the number of ranges (default:
    ``spark.sql.shuffle.partitions``)."""
    n = files or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (requests.repartitionByRange(n, "ip", "timestamp").sortWithinPartitions("ip", "timestamp")
     .write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path))


def read_parsed_log(spark: SparkSession, path: str, start_date=None, end_date=None) -> DataFrame:
    """Typed scan of a request table written by :func:`write_parsed_log`.

    ``start_date`` / ``end_date`` (inclusive, UTC) filter the ``date``
    partition column, so only the matching directories are listed and read."""
    df = spark.read.schema(REQUEST_SCHEMA).parquet(path)
    if start_date is not None:
        df = df.filter(F.col("date") >= F.lit(start_date).cast("date"))
    if end_date is not None:
        df = df.filter(F.col("date") <= F.lit(end_date).cast("date"))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REQUEST_SCHEMA.fields])


def write_parsed_log_csv(requests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Request table as a CSV with a header in the layout the reference's
    scripts exchange: time stamps as local wall clock with the original
    offset (``2025-11-25 06:31:10+11:00``), quotes doubled, nulls empty."""
    off = F.col("tz_offset")
    colon = F.concat(F.substring(off, 1, 3), F.lit(":"), F.substring(off, 4, 2))
    local = F.date_format(F.from_utc_timestamp(F.col("timestamp"), colon), "yyyy-MM-dd HH:mm:ss")
    ts_text = F.when(off.isNotNull(), F.concat(local, colon)).otherwise(
        F.date_format(F.col("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    out = requests.select("ip", ts_text.alias("timestamp"), "method", "path", "protocol", "status",
                          "bytes_sent", "referrer", "user_agent")
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_parsed_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """A parsed log written as CSV with a header by pandas: explicit schema,
    doubled-quote escaping, ISO time stamps with offset, and the CSV
    missing-value tokens applied to string columns."""
    raw = (spark.read.option("header", True).option("escape", '"')
           .option("mode", "PERMISSIVE")
           .schema(T.StructType([T.StructField(c, T.StringType()) for c in
                                 ("ip", "timestamp", "method", "path", "protocol", "status",
                                  "bytes_sent", "referrer", "user_agent")]))
           .csv(path))
    ts = F.col("timestamp")
    typed = raw.select(
        "ip",
        F.coalesce(F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ssXXX")),
                   F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ss"))).alias("timestamp"),
        "method", "path", "protocol",
        F.col("status").try_cast("double").try_cast("bigint").alias("status"),
        F.coalesce(F.col("bytes_sent").try_cast("bigint"), F.lit(0).cast("bigint")).alias("bytes_sent"),
        "referrer", "user_agent",
        F.regexp_extract(ts, r"([+-]\d\d):?(\d\d)$", 0).alias("tz_offset"),
    )
    typed = typed.withColumn("tz_offset", F.when(F.col("tz_offset") != "", F.regexp_replace("tz_offset", ":", "")))
    return typed.withColumns({c: lf.null_token(F.col(c)) for c in lf.STRING_COLUMNS})


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Score / prediction table sink; ``ip`` is written as the first column."""
    cols = ["ip"] + [c for c in scores.columns if c != "ip"]
    w = scores.select(*cols).write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


#: Types of the columns that score and prediction tables are written with.
_LONG_SCORES = ("total_requests", "unique_paths", "max_requests_per_minute")
_INT_SCORES = ("ua_bot_flag", "is_anomaly", "predicted_bot", "is_test")
_DOUBLE_SCORES = ("error_rate_4xx", "rate_5xx", "rate_3xx", "login_api_ratio", "avg_requests_per_minute",
                  "mean_interval_sec", "std_interval_sec", "path_entropy", "repeated_path_ratio", "burstiness",
                  "score_samples", "anomaly_score", "bot_probability")


def score_schema(columns) -> T.StructType:
    """Schema of a score table with these columns, in this order; a column
    that no score table is written with is read as text."""
    known = ({c: T.LongType() for c in _LONG_SCORES} | {c: T.IntegerType() for c in _INT_SCORES}
             | {c: T.DoubleType() for c in _DOUBLE_SCORES})
    return T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in columns])


def read_scores(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Score table written by :func:`write_scores`. A CSV carries no types:
    without ``schema`` the header's columns get the types of
    :func:`score_schema`; no values are read to guess them."""
    if fmt == "csv":
        reader = spark.read.option("header", True).option("escape", '"')
        return reader.schema(schema or score_schema(reader.csv(path).columns)).csv(path)
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
