"""The adapters of ``sources.driver_tables`` as SQL text for the independent check."""

from __future__ import annotations

import re

from tidemark.sources import driver_tables as D


def _values(rows) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else ("NULL" if v is None else repr(v))

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _pick(index: str, values) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[({index}) + 1]"


CTES: dict[str, str] = {
    "ev": """SELECT event_id, ts, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props FROM events""",
    "signup": "SELECT user_id, min(ts) AS signup_at FROM ev WHERE event_type = 'signup' GROUP BY user_id",
    "usage": """SELECT event_id AS usage_id, user_id, ts AS created_at, k, cents AS cost_cents, CAST(k + 1 AS BIGINT) AS credits,
        'm' || (k % 7) AS model_id, CASE WHEN k % 3 = 0 THEN 'video' ELSE 'image' END AS media_type,
        CASE k % 4 WHEN 0 THEN 'trial_credit_balance' WHEN 1 THEN 'one_time_pack_credit' ELSE 'subscription_monthly_credit' END AS credit_field,
        event_type = 'error' AS is_failed FROM ev WHERE event_type IN ('view', 'click', 'error')""",
    "purchase": f"""SELECT 'purchase_' || event_id AS event_id,
        CASE WHEN k % 10 < 3 THEN 'purchase_first' WHEN k % 10 < 6 THEN 'purchase_renewal' WHEN k % 10 < 8 THEN 'purchase_one_time_pack'
             WHEN k % 10 = 8 THEN 'purchase_upgrade' ELSE 'purchase_add_on' END AS event_name,
        user_id, ts AS occurred_at, cents AS cash_minor, cents - cents // 10 AS revenue_minor,
        {_pick("user_id % 4", D.CURRENCIES[:4])} AS currency,
        CASE WHEN k % 10 NOT IN (6, 7) THEN {_pick("k % 4", D.TIERS)} END AS plan_tier,
        CASE WHEN k % 10 NOT IN (6, 7) THEN CASE WHEN k % 2 = 0 THEN 'month' ELSE 'year' END END AS billing_interval,
        'sub_' || user_id || '_' || (k % 3) AS subscription_id, k FROM ev WHERE event_type = 'purchase'""",
    "adjustment": """SELECT 'refund_' || event_id AS event_id, 'refund' AS event_name, event_id AS adjusts_event_id, user_id,
        occurred_at + to_hours(k) AS occurred_at, -(cash_minor // 2) AS cash_minor FROM purchase WHERE k % 6 = 0
        UNION ALL SELECT 'chargeback_' || event_id, 'chargeback', event_id, user_id, occurred_at + to_hours(2 * k), -cash_minor
        FROM purchase WHERE k % 11 = 0""",
    "click": f"""SELECT event_id, user_id, {_pick("k % 4", D.CLICK_KEYS)} AS click_id_key, 'v' || k AS click_id_value,
        ts AS click_id_created_at, ts + to_hours(k % 3) AS known_at, k % 2 + 1 AS source_priority FROM ev WHERE event_type = 'click'""",
    "utm": f"""SELECT event_id, user_id, {_pick("k % 3", D.UTM_KEYS)} AS utm_key, {_pick("k % 5", D.UTM_VALUES)} AS utm_value,
        ts AS captured_at, ts + to_minutes(30 * (k % 4)) AS known_at, k % 2 + 1 AS source_priority FROM ev WHERE event_type = 'view' AND k < 40""",
    "exposure_rows": f"""SELECT event_id, user_id, {_pick("k % 2", D.FLAGS)} AS flag_key, 'arm_' || (k % 3) AS arm, ts AS event_time,
        CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS source_priority FROM ev WHERE event_type = 'view' AND k >= 30""",
    "device_events": "SELECT event_id, user_id, ts AS event_time, 'dev' || (k % 3) AS device_id, k FROM ev",
    "deliveries": """SELECT *, ts AS received_at FROM ev UNION ALL
        SELECT *, ts + INTERVAL 1 HOUR FROM ev WHERE event_id % 3 = 0""",
    "invoice": f"""SELECT 'in_' || o_orderkey AS invoice_id, 'evt_' || o_orderkey AS paid_event_id, 'cus_' || o_custkey AS user_id,
        'sub_' || o_custkey AS subscription_id, o_orderdate + to_seconds(o_orderkey % 86400) AS paid_at, 'paid' AS invoice_status,
        CASE WHEN o_orderkey % 10 < 3 THEN 'subscription_create' WHEN o_orderkey % 10 < 7 THEN 'subscription_cycle'
             WHEN o_orderkey % 10 < 9 THEN 'subscription_update' ELSE 'manual' END AS billing_reason,
        c AS amount_paid_minor, c AS total_minor, CASE WHEN o_orderkey % 10 <> 5 THEN c - c // 11 END AS total_excluding_tax_minor,
        {_pick("o_custkey % 6", D.CURRENCIES)} AS currency, o_orderkey AS orderkey
        FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)""",
    "invoice_line": """SELECT 'in_' || l_orderkey AS invoice_id, concat_ws('_', 'il', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id,
        CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor,
        'price_' || l_partkey AS price_id, CAST(l_quantity AS BIGINT) AS quantity, l_linestatus = 'F' AS is_proration,
        l_shipdate AS line_period_end FROM lineitem""",
    "plan_catalog": f"""SELECT 'price_' || p_partkey AS price_id,
        CASE p_type WHEN 'PROMO' THEN 'credit_pack' WHEN 'ECONOMY' THEN 'one_time_pack' ELSE 'plan' END AS item_type,
        {_pick("p_size % 4", D.TIERS)} AS plan_tier, p_size % 4 + 1 AS plan_tier_code,
        CASE WHEN p_size % 2 = 0 THEN 'month' ELSE 'year' END AS billing_interval,
        CAST(round(p_retailprice * 100) AS BIGINT) AS unit_amount_minor, p_size * 100 AS monthly_credits FROM part WHERE p_type <> 'SMALL'""",
    "fx_seed": f"SELECT a AS currency, CAST(b AS DATE) AS rate_date, CAST(c AS DOUBLE) AS usd_per_unit FROM (VALUES {_values(D.FX)}) t(a, b, c)",
    "minor_units": f"SELECT a AS currency, b AS minor_unit_digits FROM (VALUES {_values(D.MINOR_UNITS)}) t(a, b)",
    "click_platforms": f"SELECT a AS click_id_key, b AS platform, c AS acquisition_channel, d AS precedence FROM (VALUES {_values(D.CLICK_PLATFORMS)}) t(a, b, c, d)",
    "fx": """SELECT r.currency, greatest(r.f, p.f) AS valid_from, nullif(least(coalesce(r.t, DATE '9999-12-31'), coalesce(p.t, DATE '9999-12-31')), DATE '9999-12-31') AS valid_to,
        r.usd_per_unit / p.usd_per_unit AS per_unit, coalesce(m.minor_unit_digits, 2) AS digits
        FROM (SELECT *, rate_date AS f, lead(rate_date) OVER (PARTITION BY currency ORDER BY rate_date) AS t FROM fx_seed) r
        JOIN (SELECT *, rate_date AS f, lead(rate_date) OVER (PARTITION BY currency ORDER BY rate_date) AS t FROM fx_seed WHERE currency = 'USD') p
          ON p.f < coalesce(r.t, DATE '9999-12-31') AND r.f < coalesce(p.t, DATE '9999-12-31')
        LEFT JOIN minor_units m ON m.currency = r.currency""",
    "invoice_full": """SELECT *, CASE WHEN orderkey % 2 = 1 THEN 'ch_' || orderkey END AS legacy_charge_id, CAST(NULL AS VARCHAR) AS legacy_payment_intent_id,
        paid_at + INTERVAL 30 DAY AS period_end FROM invoice""",
    "payment": """SELECT 'inpay_' || orderkey AS invoice_payment_id, invoice_id, 'pi_' || orderkey AS payment_intent_id, 'ch_' || orderkey AS charge_id,
        paid_at AS payment_created_at FROM invoice WHERE orderkey % 2 = 0""",
    "session": """SELECT 'cs_live_' || orderkey AS checkout_session_id, paid_event_id AS completed_event_id, paid_at AS completed_at,
        CASE WHEN orderkey % 10 = 9 THEN 'payment' ELSE 'subscription' END AS checkout_mode, 'complete' AS session_status, 'paid' AS payment_status, user_id,
        CASE WHEN orderkey % 10 <> 9 OR orderkey % 20 = 9 THEN invoice_id END AS invoice_id, CASE WHEN orderkey % 10 = 9 THEN 'pi_' || orderkey END AS payment_intent_id,
        amount_paid_minor AS amount_total_minor, amount_paid_minor // 11 AS amount_tax_minor, currency FROM invoice WHERE orderkey % 10 IN (0, 9)""",
    "sub_change": """SELECT 'sev_' || o_orderkey AS stripe_event_id, 'sub_' || o_custkey AS subscription_id, o_orderdate AS changed_at,
        CASE WHEN o_orderkey % 50 = 2 THEN 'customer.subscription.deleted' ELSE 'customer.subscription.updated' END AS event_type FROM orders WHERE o_orderkey % 5 = 2""",
    "sub_item": """SELECT 'sev_' || o_orderkey AS stripe_event_id, 'price_' || (o_orderkey % 200) AS price_id, o_orderkey % 7 AS quantity FROM orders WHERE o_orderkey % 5 = 2""",
    "money_out": f"""SELECT l.*, {_pick("o_custkey % 6", D.CURRENCIES)} AS currency, CAST(round(l_extendedprice * 100) AS BIGINT) AS c,
        concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS line_ref FROM lineitem l JOIN orders ON o_orderkey = l_orderkey""",
    "refund_event": """SELECT 'evt_r_' || line_ref AS stripe_event_id, l_shipdate AS refunded_at, 'ch_' || l_orderkey AS charge_id,
        CASE WHEN l_orderkey % 2 = 0 THEN 'pi_' || l_orderkey END AS payment_intent_id, CASE WHEN l_orderkey % 3 = 0 THEN 'in_' || l_orderkey END AS legacy_invoice_id,
        c AS cum, currency FROM money_out WHERE l_returnflag = 'R'""",
    "refund_step": """SELECT *, cum - coalesce(lag(cum) OVER (PARTITION BY charge_id ORDER BY cum), 0) AS step FROM
        (SELECT *, row_number() OVER (PARTITION BY charge_id, cum ORDER BY refunded_at, stripe_event_id) AS n FROM refund_event WHERE cum > 0) WHERE n = 1""",
    "dispute": """SELECT DISTINCT ON (line_ref) 'dp_' || line_ref AS dispute_id, 'evt_d_' || line_ref || '_0' AS stripe_event_id, l_shipdate AS disputed_at, 'ch_' || l_orderkey AS charge_id,
        CASE WHEN l_orderkey % 2 = 0 THEN 'pi_' || l_orderkey END AS payment_intent_id, c AS amount_minor, currency,
        CASE WHEN l_partkey % 3 = 0 THEN 'fraudulent' ELSE 'general' END AS dispute_reason,
        CASE l_partkey % 16 WHEN 0 THEN 'won' WHEN 4 THEN 'lost' WHEN 8 THEN 'warning_needs_response' ELSE 'under_review' END AS dispute_status,
        CASE WHEN l_partkey % 16 IN (0, 4) THEN l_shipdate + INTERVAL 1 DAY END AS closed_at, l_partkey % 16 = 8 AS is_inquiry,
        l_partkey % 16 IN (0, 12) AS is_funds_reinstated, l_partkey % 16 = 4 AS is_money_lost FROM money_out WHERE l_returnflag = 'A' AND l_partkey % 4 = 0""",
    "pur": """SELECT 'purchase_' || i.invoice_id AS event_id, i.invoice_id, i.user_id, i.paid_at AS occurred_at, i.amount_paid_minor AS cash, i.currency, i.subscription_id, i.billing_reason,
        coalesce(y.charge_id, i.legacy_charge_id) AS charge_id, y.payment_intent_id, i.orderkey, false AS is_pack,
        CASE WHEN total_excluding_tax_minor IS NOT NULL THEN total_excluding_tax_minor ELSE amount_paid_minor END AS revenue,
        CASE WHEN i.billing_reason = 'subscription_create' THEN 'purchase_first' WHEN i.billing_reason = 'subscription_cycle' THEN 'purchase_renewal'
             WHEN i.billing_reason = 'subscription_update' AND EXISTS (SELECT 1 FROM invoice_line l JOIN plan_catalog c USING (price_id) WHERE l.invoice_id = i.invoice_id AND c.item_type = 'plan' AND l.amount_minor < 0) THEN 'purchase_upgrade'
             WHEN i.billing_reason = 'subscription_update' AND EXISTS (SELECT 1 FROM invoice_line l JOIN plan_catalog c USING (price_id) WHERE l.invoice_id = i.invoice_id AND c.item_type = 'credit_pack' AND l.amount_minor > 0) THEN 'purchase_add_on'
             WHEN i.billing_reason = 'subscription_update' THEN 'purchase_upgrade' END AS event_name
        FROM invoice_full i LEFT JOIN payment y ON y.invoice_id = i.invoice_id
        WHERE i.amount_paid_minor > 0 AND NOT EXISTS (SELECT 1 FROM session s WHERE s.checkout_mode = 'payment' AND s.invoice_id = i.invoice_id)
        UNION ALL SELECT 'purchase_' || coalesce(invoice_id, checkout_session_id), invoice_id, user_id, completed_at, amount_total_minor, currency, NULL, NULL, NULL, payment_intent_id,
        CAST(substr(checkout_session_id, 9) AS BIGINT), true, amount_total_minor - amount_tax_minor, 'purchase_one_time_pack' FROM session WHERE checkout_mode = 'payment'""",
    "tied": """SELECT a.*, p.event_id AS adjusts_event_id, p.cash AS p_cash, p.revenue AS p_revenue FROM
        (SELECT 'refund_' || charge_id || '_' || cum AS event_id, 'refund' AS event_name, refunded_at AS occurred_at, charge_id, payment_intent_id, legacy_invoice_id, -step AS cash, currency, true AS lost FROM refund_step
         UNION ALL SELECT 'chargeback_' || dispute_id, 'chargeback', disputed_at, charge_id, payment_intent_id, NULL, -amount_minor, currency, is_money_lost FROM dispute) a
        LEFT JOIN pur p ON p.event_name IS NOT NULL AND (p.payment_intent_id = a.payment_intent_id OR p.charge_id = a.charge_id OR p.invoice_id = a.legacy_invoice_id)""",
    "netted": """SELECT *, CASE WHEN NOT lost THEN 0 WHEN event_name = 'refund' OR adjusts_event_id IS NULL THEN cash
        ELSE -least(-cash, greatest(p_cash - before, 0)) END AS ledger_cash FROM
        (SELECT *, coalesce(sum(CASE WHEN lost THEN -cash ELSE 0 END) OVER (PARTITION BY adjusts_event_id ORDER BY occurred_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tied)""",
}


def add(name: str, sql: str) -> str:
    """Add a shared CTE; returns its name."""
    assert name not in CTES, name
    CTES[name] = sql
    return name


def sql(body: str, **extra: str) -> str:
    """Prefix a query with the CTEs it names, dependencies first."""
    pool = {**CTES, **extra}
    found: list[str] = []

    def visit(text: str):
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if word in pool and word not in found and re.search(rf"(?i)(from|join|,)\s+{word}\b", text):
                visit(pool[word])
                if word not in found:
                    found.append(word)

    visit(body)
    if not found:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({pool[n]})" for n in found) + "\n" + body
