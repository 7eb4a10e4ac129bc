"""One run of the revenue warehouse: deliveries and seeds -> staging -> marts -> views.

Every table is written as a whole and read again by the next layer, so a run that fails is simply started again, and a
second run over the same inputs leaves the same rows. The run is pinned to ``Params.as_of``: what arrives later does not
change it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import Params
from tidemark.plans import billing as B
from tidemark.plans import money as M
from tidemark.sinks import tables as K
from tidemark.sources import readers as R

#: A mart is partitioned by the month of its time column, rows of a month next to others of their user.
MARTS = {"purchases": "occurred_at", "adjustments": "occurred_at", "net_cash": "occurred_at"}


@dataclass(frozen=True)
class Warehouse:
    """The folder of a run; a layer's table is a folder below it."""

    spark: SparkSession
    folder: str

    def keep(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        return self.spark.read.parquet(K.write_layer(df, self.folder, layer, name))

    def mart(self, name: str, df: DataFrame) -> DataFrame:
        # a mart without rows has no files, so its columns are kept beside it
        K.write_layer(df.drop("month").limit(0), self.folder, "columns", name)
        K.write_mart(df.withColumn("month", F.trunc(MARTS[name], "month")), f"{self.folder}/marts/{name}", "month", ["user_id"], day="month")
        return read_mart(self.spark, self.folder, name)


def read_mart(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A mart of a run, also one without rows; ``month`` is its partition column."""
    if name not in MARTS:
        return spark.read.parquet(f"{folder}/marts/{name}")
    columns = spark.read.parquet(f"{folder}/columns/{name}").schema
    return spark.read.schema(columns.add("month", "date")).parquet(f"{folder}/marts/{name}")


def staging(w: Warehouse, deliveries: DataFrame, p: Params) -> dict[str, DataFrame]:
    """Typed billing tables; the events are parsed once and read by all."""
    events = w.keep("staging", "billing_events", B.billing_events(deliveries, p))
    out = {"billing_events": events}
    for name, make in (("invoices", B.invoices), ("invoice_payments", B.invoice_payments), ("checkout_sessions", B.checkout_sessions),
                       ("subscription_changes", B.subscription_events), ("refunds", B.refunds), ("disputes", B.disputes)):
        out[name] = w.keep("staging", name, make(events))
    out["invoice_lines"] = w.keep("staging", "invoice_lines", B.invoice_lines(out["invoices"]))
    out["subscription_items"] = w.keep("staging", "subscription_items", B.subscription_items(out["subscription_changes"]))
    return out


def marts(w: Warehouse, s: dict[str, DataFrame], seeds: dict[str, DataFrame], p: Params) -> dict[str, DataFrame]:
    """Purchases, adjustments, net cash and the status of subscriptions."""
    fx = w.keep("staging", "fx_ranges", M.fx_ranges(seeds["fx_rates"], seeds["currency_minor_units"], p.reporting_currency))
    catalog = seeds["plan_catalog"]
    states = M.subscription_states(s["subscription_changes"], s["subscription_items"], catalog)
    out = {"purchases": w.mart("purchases", M.purchases(s["invoices"], s["invoice_lines"], s["checkout_sessions"], s["invoice_payments"], states, catalog, fx))}
    out["adjustments"] = w.mart("adjustments", M.adjustments(s["refunds"], s["disputes"], s["invoice_payments"], out["purchases"], fx))
    out["net_cash"] = w.mart("net_cash", M.net_cash(out["purchases"].where("event_name is not null"), out["adjustments"], fx))
    out["subscriptions"] = w.keep("marts", "subscriptions", M.subscription_status(s["invoices"], s["invoice_lines"], s["subscription_changes"], out["purchases"], p))
    return out


def read_marts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The marts a run left in its folder."""
    return {name: read_mart(spark, folder, name) for name in (*MARTS, "subscriptions")}


def views(m: dict[str, DataFrame]) -> list[str]:
    """Reporting views without identifiers: revenue by day and kind, money out by day and disposition, subscriptions by status."""
    day = F.to_date("occurred_at").alias("day")
    revenue = m["net_cash"].groupBy(day, "event_name", "currency").agg(
        F.count(F.lit(1)).alias("purchases"), F.sum("cash_value_minor").alias("gross_minor"), F.sum("taken_minor").alias("taken_minor"), F.sum("restated_minor").alias("restated_minor"))
    out = m["adjustments"].groupBy(day, "disposition", "currency").agg(F.count(F.lit(1)).alias("adjustments"), F.sum("ledger_cash_value_minor").alias("ledger_cash_minor"))
    status = m["subscriptions"].groupBy("status_as_of", "plan_tier", "billing_interval").agg(F.count(F.lit(1)).alias("subscriptions"))
    return K.create_views({"rpt_revenue_daily": revenue, "rpt_money_out_daily": out, "rpt_subscriptions": status}, ["user_id"])


def run(spark: SparkSession, inbox: str, seed_folder: str, folder: str, p: Params, manifest: dict[str, int] | None = None) -> list[str]:
    """Read deliveries and seeds, rebuild every table below ``folder`` and the views; returns the views' names.

    ``manifest`` holds expected row counts of ``deliveries`` and of the seeds: a load that differs stops the run before
    anything is written. Equal inputs give equal tables, whatever was there before.
    """
    if p.as_of is None:
        raise ValueError("a run is pinned to an instant: set Params.as_of")
    deliveries = R.read_billing_events(spark, inbox)
    seeds = {name: R.read_seed(spark, seed_folder, name) for name in ("plan_catalog", "fx_rates", "currency_minor_units")}
    if manifest is not None:
        frames = {"deliveries": deliveries, **seeds}
        R.require_counts({name: df for name, df in frames.items() if name in manifest}, manifest)
    w = Warehouse(spark, folder)
    return views(marts(w, staging(w, deliveries, p), seeds, p))
