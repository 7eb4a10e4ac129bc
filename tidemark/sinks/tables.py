"""Table sinks: layers, partitioned marts, day overwrite, append-only logs, erasure, retention, export."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.rows import keep_first
from tidemark.session import checkpoint_folder


def stage(df: DataFrame) -> DataFrame:
    """Compute an intermediate once when several consumers follow.

    With a shared checkpoint folder it becomes a table there, so a lost executor costs
    nothing; without one (local sessions) it is persisted and keeps its lineage.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder}/stage/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_layer(df: DataFrame, folder: str, layer: str, name: str) -> str:
    """Full refresh of one table of a layer."""
    path = f"{folder}/{layer}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def write_mart(df: DataFrame, path: str, ts: str, cluster: Sequence[str], day: str = "day", files_per_day: int = 1) -> None:
    """Full refresh of a day-partitioned, clustered table (days that are no longer there go); a day is spread over ``files_per_day`` tasks by the cluster columns."""
    out = df.withColumn(day, F.to_date(F.col(ts)))
    salt = F.pmod(F.hash(*cluster), F.lit(files_per_day))
    out.repartition(F.col(day), salt).sortWithinPartitions(day, *cluster).write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy(day).parquet(path)


def overwrite_days(df: DataFrame, path: str, day: str) -> None:
    """Replace only the days present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


KEY_BUCKET = "key_bucket"


def with_bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """The bucket of every row's key: what a keyed log is partitioned by."""
    return df.withColumn(KEY_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a partitioned table holds any partition (an empty write leaves none)."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return found is not None and len(found) > 0


def logged(spark: SparkSession, path: str, rows: DataFrame, schema: str, **partitions: str) -> DataFrame | None:
    """The rows of a bucketed log that can hold the keys of ``rows``: only their buckets are listed and read (None: no log yet).

    ``rows`` carries the bucket column; ``partitions`` are further partition columns and their types.
    """
    if not has_rows(spark, path):
        return None
    met = [r[0] for r in rows.select(KEY_BUCKET).distinct().collect()]  # at most one a bucket
    columns = ", ".join([schema, f"{KEY_BUCKET} int", *[f"{n} {t}" for n, t in partitions.items()]])
    return spark.read.schema(columns).parquet(path).where(F.col(KEY_BUCKET).isin(met))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A bucketed log without its bucket column."""
    return spark.read.parquet(path).drop(KEY_BUCKET)


def append_new(log_path: str, df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 64) -> int:
    """Append rows whose keys are not logged yet; running it again adds nothing.

    Of several rows with one key the first by ``order`` (by default: all columns) is taken. The log is partitioned by a
    hash of the key, so a load reads the keys of its own buckets only; ``buckets`` is fixed with the first load: choose it so
    that a small load meets a small part of the log.
    """
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    firsts = stage(with_bucket(keep_first(df, list(keys), [F.col(c) for c in (order or df.columns)]), keys, buckets))
    log = logged(spark, log_path, firsts, ", ".join(f"`{c}` {kinds[c]}" for c in keys))
    # the rows read depend on the table being written: fix them before appending
    fixed = firsts if log is None else stage(firsts.join(log.select(*keys), list(keys), "left_anti").select(*firsts.columns))
    count = fixed.count()
    if count:
        fixed.repartition(KEY_BUCKET).write.mode("append").partitionBy(KEY_BUCKET).parquet(log_path)
    return count


def append_param_set(path: str, current: DataFrame, ref: str) -> int:
    """Append a whole parameter set only when its content reference is new."""
    spark = current.sparkSession
    try:
        known = spark.read.parquet(path).select(ref).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new = current
    else:
        new = current.join(known, ref, "left_anti")
    fixed = stage(new)
    count = fixed.count()
    if count:
        fixed.write.mode("append").parquet(path)
    return count


def contract_rows(df: DataFrame, columns: Sequence[str], json_columns: Sequence[str]) -> DataFrame:
    """Contract-shaped JSON text: fixed column order, RFC 3339 times, JSON columns nested, NULLs kept."""
    kinds = dict(df.dtypes)
    fields: list[Column] = []
    for c in columns:
        x = F.col(c)
        if kinds[c].startswith("timestamp"):
            x = C.iso_millis(x.cast("timestamp"))
        elif c in json_columns:
            x = F.try_parse_json(x)
        fields.append(x.alias(c))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def export_jsonl(df: DataFrame, path: str, columns: Sequence[str], json_columns: Sequence[str], order_by: Sequence[str]) -> None:
    """Globally ordered JSON lines (range-partitioned sort, many files)."""
    ordered = df.orderBy(*order_by)
    contract_rows(ordered, columns, json_columns).write.mode("overwrite").text(path)


def create_views(marts: dict[str, DataFrame], hidden: Sequence[str]) -> list[str]:
    """Reporting views without identifier columns."""
    for name, df in marts.items():
        df.drop(*hidden).createOrReplaceTempView(name)
    return list(marts)


def erase(df: DataFrame, requests: DataFrame, now: datetime, older_than_hours: int) -> DataFrame:
    """Rows left after the settled erasure requests (user_id, requested_at)."""
    due = requests.where(F.unix_micros("requested_at") <= F.unix_micros(F.lit(now)) - older_than_hours * 3_600_000_000)
    return df.join(due.select("user_id").distinct(), "user_id", "left_anti")


def expire(df: DataFrame, day: str, today: datetime, days: int) -> DataFrame:
    """Rows of the days kept by the retention rule (a filter on the partition column)."""
    return df.where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), days))


#: Folder value of a partition whose column is NULL.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def drop_days(spark: SparkSession, path: str, day: str, values: Sequence[date | None]) -> None:
    """Delete whole partitions of a day-partitioned table (None: the rows without a day)."""
    for value in values:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={NO_VALUE if value is None else value.isoformat()}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def erase_table(spark: SparkSession, path: str, day: str, requests: DataFrame, now: datetime, older_than_hours: int) -> list[date | None]:
    """Erase the settled requests from a day-partitioned table in place; returns the days that were touched (None: undated rows).

    Only days that hold rows to erase are rewritten: what stays is written aside first, then replaces the days, and days
    that end up empty are deleted. Running it again, also after a failure half-way, ends in the same table.
    """
    table = spark.read.parquet(path)
    keep = erase(table, requests, now, older_than_hours)
    due = requests.where(F.unix_micros("requested_at") <= F.unix_micros(F.lit(now)) - older_than_hours * 3_600_000_000)
    touched = [r[0] for r in table.join(due.select("user_id").distinct(), "user_id", "left_semi").select(day).distinct().collect()]  # one row per day
    if touched:
        dated = F.col(day).isin([x for x in touched if x is not None]) if any(x is not None for x in touched) else F.lit(False)
        affected = F.coalesce(dated, F.lit(False)) | (F.col(day).isNull() & F.lit(None in touched))
        aside = f"{checkpoint_folder(spark)}/aside/{uuid.uuid4().hex}"
        keep.where(affected).write.parquet(aside)
        rest = spark.read.parquet(aside)
        left = {r[0] for r in rest.select(day).distinct().collect()}
        overwrite_days(rest, path, day)
        drop_days(spark, path, day, [x for x in touched if x not in left])
        folder = spark._jvm.org.apache.hadoop.fs.Path(aside)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def expire_table(spark: SparkSession, path: str, day: str, today: datetime, days: int) -> list[date]:
    """Delete the partitions the retention rule no longer keeps, rows without a day among them (nothing shows that they may stay); returns their days."""
    first = today.date() - timedelta(days=days)
    gone = [r[0] for r in spark.read.parquet(path).select(day).distinct().collect() if r[0] is None or r[0] < first]  # one row per day
    drop_days(spark, path, day, gone)
    return gone
