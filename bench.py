"""Headline benchmark: wall seconds per query, one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "ded_1_first_delivery", "jn_3_asof_latest", "jn_5_asof_per_key", "jn_8_validity_range", "jn_10b_overlapping_horizons", "win_3_percent_rank", "win_9_running_sum", "top_3_top_fraction",
    "job_1_refund_steps", "job_2_disputes", "job_5_purchases", "job_6_adjustments", "job_0_net_cash_ledger", "job_13_acquisition", "job_17_conversion_ledger", "job_19_generation_cost", "job_20_quarantine",
    "ml_1_features_24h", "ml_4_fit_sets", "ml_9_score_24h", "ml_12_purchase_outcomes", "ml_15_score_purchase", "ml_20_deciles", "ml_23_bootstrap", "expt_3_user_readout", "expt_5_arm_readout", "expt_8_ppi_bootstrap",
    "expt_11_daily_readout", "expt_20_contrast", "rec_1_facts", "rec_4_waterfall", "aud_1_candidates", "aud_5_members", "dsp_3_dispatch_plan", "trk_2_presence", "siz_1_journeys", "str_1_inbox_dedup",
)


def main() -> None:
    from tidemark import catalog
    from tidemark.session import local_session

    spark = local_session(CPUS, 2 * int(CPUS) if CPUS.isdigit() else 16, "16g")
    queries, _ = catalog.load()
    spark.read.parquet(f"{SF_DIR}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
