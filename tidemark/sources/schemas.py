"""Explicit schemas of every source; nothing is inferred."""

BILLING_EVENTS = """id string, object string, api_version string, created long, livemode boolean,
pending_webhooks long, request string, type string, data string, received_at timestamp"""

PRODUCT_EVENTS = """uuid string, insert_id string, event_type string, user_id string, device_id string,
platform string, os_name string, os_version string, device_type string, device_family string, country string,
region string, city string, language string, library string, ip_address string, event_id long, amplitude_id long,
app long, session_id long, event_time timestamp, client_event_time timestamp, server_upload_time timestamp,
event_properties string, user_properties string, groups string, group_properties string, data string"""

USAGE_LEDGER = """id string, sequenceId long, type string, amount long, creditField string, balanceBefore long,
balanceAfter long, previousSequenceId long, reference struct<businessType: string, businessId: string>,
idempotencyKey string, createdAt string, userId string, reason string, teamMemberUserId string,
businessDetails array<struct<quantity: long, unitCredits: long, subBusinessType: string,
metadata: struct<projectId: string, mediaType: string, source: string, discountPct: double, originalUnitCredits: long>>>"""

CLICK_POSTS = "user_id string, received_at timestamp, payload string"
ACCOUNTS = "id string, email string, account_created_at timestamp, provider string"
LOOKUP_ATTEMPTS = """user_id string, checkout_session_id string, requested_at timestamp, http_status long,
response struct<invoiceId: string, isFirstPurchase: boolean, isValidInvoice: boolean, isBusiness: boolean,
amountMinor: long, currency: string, ltvValueMajor: double, ltvCurrency: string>"""
FORM_SUBMISSIONS = """portal_id long, form_guid string, conversionId string, submittedAt long, pageUrl string,
values array<struct<name: string, value: string>>"""
PROPERTY_CHANGES = """eventId long, subscriptionId long, portalId long, appId long, occurredAt long,
attemptNumber long, objectId long, subscriptionType string, propertyName string, propertyValue string,
changeSource string, sourceId string"""
PLATFORM_REPORTS = """platform string, account_id string, report_layer string, date_basis string,
account_timezone string, report_date date, attribution_setting string, conversions double,
conversion_value double, currency string, data_origin string"""
EXTERNAL_SCORES = """user_id string, predicted_revenue double, predicted_generation_cost double,
predicted_fees double, predicted_refund_risk double, predicted_profit double, model_version string"""

# Reference tables with pinned column types.
SEEDS = {
    "plan_catalog": """price_id string, product_id string, item_type string, plan_tier string, billing_interval string,
        unit_amount_minor long, plan_tier_code long, monthly_credits long, credits_per_unit long,
        amount_evidence string, source string""",
    "fx_rates": "currency string, rate_date date, usd_per_unit double, source string",
    "currency_minor_units": "currency string, minor_unit_digits long, source string",
    "platform_reporting_rules": """platform string, account_ids string, scope string, value_rule string,
        events_per_purchase long, accepts_fallback_value boolean, click_id_keys string, click_window_days long,
        date_basis string, account_timezone string, evidence string, assumptions string""",
    "click_id_platforms": "click_id_key string, platform string, acquisition_channel string, precedence long",
    "model_costs": """model_id string, business_type string, setting string, credits long, list_cost_usd double,
        cost_per_credit_usd double, source_url string, notes string""",
    "generation_cost_overrides": """override_id string, business_type string, setting string, route string,
        vendor string, unit_cost_usd double, cost_per_credit_usd double, discount_pct double, valid_from date,
        valid_to date, source string, notes string""",
    "default_model_arms": """flag_key string, arm string, business_type string, default_setting string,
        credits_per_generation long, media_type string, evidence string""",
    "allocation_log": """flag_key string, arm string, allocation_slice string, valid_from date, valid_to date,
        assignment_probability double, data_origin string""",
    "fallback_price_table": "plan_tier string, billing_interval string, fallback_value_usd double, evidence string",
    "segment_country_buckets": "country_key string, iso2 string, country_bucket string",
    "country_codes": "country_name string, iso2 string, is_eea_uk_ch boolean",
    "consent_required_regions": "iso2 string, region_group string",
    "qa_accounts": "user_id string, reason string",
    "platform_event_mapping": """canonical_event string, platform string, send boolean, event_name string,
        dedup_template string, requires_web_fix boolean""",
}

# The billing-object fields the jobs read. Everything else in a payload (names,
# addresses, e-mails, evidence) is dropped while parsing.
_LINE = """struct<id: string, amount: long, currency: string, quantity: long, proration: boolean,
subscription_item: string, description: string,
pricing: struct<price_details: struct<price: string, product: string>>,
price: struct<id: string, product: string>,
parent: struct<subscription_item_details: struct<proration: boolean, subscription_item: string>>,
period: struct<start: long, end: long>>"""
_ITEM = "struct<id: string, quantity: long, price: struct<id: string>>"
BILLING_OBJECT = f"""id string, object string, customer string, status string, mode string, payment_status string,
billing_reason string, currency string, amount long, amount_paid long, amount_total long, amount_subtotal long,
amount_refunded long, total long, subtotal long, total_excluding_tax long,
total_details struct<amount_tax: long>, created long, period_start long, period_end long,
status_transitions struct<paid_at: long>,
parent struct<subscription_details: struct<subscription: string>>,
subscription string, invoice string, charge string, payment_intent string,
payment struct<type: string, payment_intent: string, charge: string>,
lines struct<has_more: boolean, data: array<{_LINE}>>,
items struct<data: array<{_ITEM}>>,
client_reference_id string, success_url string,
metadata struct<ga_client_id: string, ga_session_id: string, tolt_referral: string>,
reason string, cancel_at_period_end boolean, cancel_at long, canceled_at long, ended_at long, latest_invoice string"""
BILLING_PREVIOUS = "amount_refunded long, status string, cancel_at_period_end boolean"
