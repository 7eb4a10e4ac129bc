"""Analytics over decoded tracking hits: click-id presence and coverage, page views per route, run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C

COUNTED_KINDS = ("page_view", "event", "conversion")
STATUSES = ("PASS", "FAIL", "ERROR", "SKIP")


def presence(journeys: DataFrame, hits: DataFrame) -> DataFrame:
    """Per journey and platform: was its click id sent on the final page, anywhere, only in the URL, or stored.

    ``journeys``: journey_id, platform, click_id (NULL when the platform is not concerned), final_step, stored;
    ``hits``: journey_id, platform, kind, step, click_id, url_click_id.
    """
    h = hits.where(F.col("kind").isin(*COUNTED_KINDS)).select("journey_id", "platform", "step", F.col("click_id").alias("hit_click_id"), "url_click_id")
    x = journeys.join(h, ["journey_id", "platform"], "left")
    own = F.coalesce(F.col("hit_click_id") == F.col("click_id"), F.lit(False))
    final = F.coalesce(F.col("step") == F.col("final_step"), F.lit(False))
    url = F.coalesce(F.col("url_click_id") == F.col("click_id"), F.lit(False))
    g = x.groupBy("journey_id", "platform").agg(
        F.first("click_id").isNotNull().alias("relevant"), C.tally(final).alias("hits_on_final"), F.bool_or(own & final).alias("sent_on_final_page"), F.bool_or(own).alias("sent_anywhere"), F.bool_or(url & final & ~own).alias("_url"),
        F.bool_or(F.coalesce("stored", F.lit(False))).alias("_stored"))
    return g.withColumn("url_only", F.col("_url") & ~F.col("sent_on_final_page")).withColumn("stored", F.col("_stored") & F.col("relevant")).drop("_url", "_stored")


def coverage(present: DataFrame, journeys: DataFrame) -> DataFrame:
    """Covered and total journeys per platform and cohort (standard, blocker, all); invalid journeys are counted apart.

    ``journeys``: journey_id, blocker, valid.
    """
    x = present.where("relevant").join(journeys, "journey_id")
    x = x.withColumn("cohort", F.explode(F.array(F.lit("all"), F.when(F.col("blocker"), "blocker").otherwise("standard"))))
    ok = F.col("valid")
    g = x.groupBy("platform", "cohort").agg(C.tally(ok & F.col("sent_on_final_page")).alias("covered"), C.tally(ok).alias("total"), C.tally(ok & F.col("stored")).alias("stored"), C.tally(~ok).alias("excluded"))
    return g.withColumn("pct", F.floor(C.safe_divide(F.col("covered") * 1000, F.nullif("total", F.lit(0))) + 0.5) / 10)


def page_views(hits: DataFrame) -> DataFrame:
    """Distinct page views per journey step, platform and stream (transport copies collapse on their dedupe key)."""
    x = hits.where("kind = 'page_view'").groupBy("journey_id", "step", "platform", "dedupe_key").agg(F.min("stream").alias("stream"))
    stream = F.when(F.col("platform") == "google_ads", F.coalesce("stream", F.lit("google-tag"))).otherwise("default")
    return x.groupBy("journey_id", "step", "platform", stream.alias("stream")).agg(F.count(F.lit(1)).alias("views"))


def exactly_one(counts: DataFrame, routes: DataFrame, platforms: Sequence[str], exactly: int = 1) -> DataFrame:
    """Verdict per journey and platform: one page view per clean route change, failing closed.

    ``routes``: journey_id, step, is_hard_load, clean. FAIL when a clean route has a wrong count, ERROR without a
    reference, without a clean route, or when some route was not clean; PASS otherwise.
    """
    total = counts.groupBy("journey_id", "step", "platform").agg(F.sum("views").alias("views"))
    grid = routes.select("*", F.explode(F.array(*[F.lit(p) for p in platforms])).alias("platform"))
    x = grid.join(total, ["journey_id", "step", "platform"], "left").na.fill(0, ["views"])
    soft = ~F.col("is_hard_load")
    g = x.groupBy("journey_id", "platform").agg(
        F.coalesce(F.sum(F.when(F.col("is_hard_load"), F.col("views"))), F.lit(0)).alias("reference"), C.tally(soft & F.col("clean")).alias("clean_routes"), C.tally(soft & ~F.col("clean")).alias("unclean_routes"),
        C.tally(soft & F.col("clean") & (F.col("views") != exactly)).alias("wrong"))
    verdict = F.when((F.col("reference") == 0) | (F.col("clean_routes") == 0), "ERROR").when(F.col("wrong") > 0, "FAIL").when(F.col("unclean_routes") > 0, "ERROR").otherwise("PASS")
    return g.withColumn("status", verdict)


def run_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").pivot("status", list(STATUSES)).agg(F.count(F.lit(1))).na.fill(0)
