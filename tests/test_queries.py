"""Registered queries against their SQL on the smallest tables (TIDEMARK_ALL=1 runs every one)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = """prj_1_whitelist prj_8_business_type prj_12_segment prj_18_parse_ids exp_1_explode_json ded_1_first_delivery ded_5_best_attempt jn_3_asof_latest jn_5_asof_per_key jn_6_asof_first_touch
jn_7_previous_record jn_8_validity_range jn_10b_overlapping_horizons jn_12_linkage jn_14_wildcard jn_18_predecessors jn_23_refunds_before jn_24_snapshot_diff jn_25_entity_diff agg_5_first_by agg_7_json_object win_3_percent_rank
win_4_cumulative_steps win_5_change_points win_9_running_sum top_3_top_fraction fn_time fn_json job_0_net_cash_ledger job_6_adjustments job_13_acquisition job_17_conversion_ledger job_19_generation_cost ml_4_fit_sets ml_9_score_24h
ml_12_purchase_outcomes expt_5_arm_readout expt_8_ppi_bootstrap expt_20_contrast expt_23_srm rec_1_facts rec_4_waterfall aud_5_members aud_6_diff dsp_3_dispatch_plan dsp_6_value_decision trk_4_exactly_one siz_1_journeys ml_20_deciles
dq_3_fit_hygiene dq_7_waterfall snk_3_overwrite_days snk_4_append_log str_2_park_and_join str_7_value_sla""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def text(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def test_every_query_is_a_callable_and_oracles_belong_to_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 200 and set(o) <= set(q) and all(callable(f) for f in q.values())


ALL = os.environ.get("TIDEMARK_ALL")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if ALL else QUICK)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(text(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    assert ours == sorted(tuple(text(r[i]) for i in order) for r in cur.fetchall())
