"""Registry of queries over the given tables and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from tidemark.session import prepare

_SHARED: dict = {}


def shared(fn):
    """Layers are built once per session and folder, as tables of a pipeline run are."""

    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir, fn.__module__, fn.__name__)
        if key not in _SHARED:
            _SHARED[key] = fn(spark, sf_dir)
        return _SHARED[key]

    return get


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; timestamps leave it without a zone, as the source tables store them."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            out = fn(spark, sf_dir)
            return out.select(*[
                F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f"`{f.name}`")
                for f in out.schema.fields
            ])

        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle.strip()
        return fn

    return wrap
