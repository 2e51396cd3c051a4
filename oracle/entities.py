"""SQL of the seven entities with their feature columns, over the test tables."""

# The oracle's own lists of values, so that a wrong label in the engine shows. Fixed values.
INDUSTRIES = [
    "Technology", "Healthcare", "Finance", "Manufacturing", "Retail", "Education",
    "Real Estate", "Media", "Energy", "Transportation", "Telecommunications", "Hospitality",
    "Agriculture", "Automotive", "Pharmaceuticals", "Aerospace", "Consulting", "Insurance",
    "Legal Services", "Non-Profit",
]
LEAD_SOURCES = [
    "Organic Search", "Paid Search", "Social Media", "Email Marketing", "Direct Traffic",
    "Referral", "Content Marketing", "Events", "Partner", "Cold Outreach",
]
LIFECYCLE_STAGES = [
    "Subscriber", "Lead", "MQL", "SQL", "Opportunity", "Customer", "Evangelist",
]
DEAL_STAGES = [
    "Prospecting", "Qualification", "Proposal", "Negotiation", "Closed Won", "Closed Lost",
]
PIPELINES = [
    "Enterprise", "Mid-Market", "SMB", "Partner",
]
CHANNELS = [
    "Organic", "Paid", "Social", "Email", "Direct", "Referral",
]
DEVICES = [
    "Desktop", "Mobile", "Tablet",
]
CAMPAIGN_TYPES = [
    "Newsletter", "Product Launch", "Drip Campaign", "Re-engagement", "Seasonal Promotion",
    "Webinar Invite", "Case Study", "Feature Announcement", "Survey", "Onboarding",
]
EMAIL_ACTIONS = [
    "Sent", "Delivered", "Opened", "Clicked", "Bounced", "Unsubscribed", "Spam",
]
TICKET_CATEGORIES = [
    "Bug Report", "Feature Request", "Billing", "Integration", "Performance", "Security",
    "Onboarding", "Data Migration", "API Issue", "General Inquiry",
]
PAGES = [
    "/", "/pricing", "/features", "/blog", "/contact", "/about", "/demo", "/docs", "/api",
    "/integrations", "/case-studies", "/careers", "/partners", "/resources", "/webinars",
    "/product/crm", "/product/marketing", "/product/sales", "/product/service", "/product/cms",
]


def _list(values) -> str:
    return "[" + ", ".join("'" + value.replace("'", "''") + "'" for value in values) + "]"


def _pick(values, index: str) -> str:
    return f"list_extract({_list(values)}, CAST({index} AS BIGINT) + 1)"


RAW = {
    "companies": f"""
        SELECT s_suppkey AS company_id, s_name AS company_name,
               {_pick(INDUSTRIES, 's_suppkey % 20')} AS industry, r_name AS region,
               list_extract([0, 7, 30, 120, 600, 3000, 20000], s_suppkey % 7 + 1) + s_suppkey % 3
                   AS employee_count,
               round_even(s_acctbal * 1000 * 100, 0) / 100 AS annual_revenue,
               1950 + s_suppkey % 74 AS founded_year,
               100 + (s_suppkey * 104729) % 4999900 AS website_traffic_monthly,
               TIMESTAMP '2023-01-01' + to_days(CAST(s_suppkey % 1095 AS INTEGER)) AS created_at
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
                      LEFT JOIN region ON n_regionkey = r_regionkey""",
    "contacts": f"""
        SELECT c_custkey AS contact_id,
               c_custkey || '@example.com' AS email,
               c_custkey % 100 AS company_id,
               c_mktsegment AS job_title,
               {_pick(LEAD_SOURCES, '(c_custkey * 3) % 10')} AS lead_source,
               (c_custkey * 37) % 101 AS lead_score,
               {_pick(LIFECYCLE_STAGES, 'c_custkey % 7')} AS lifecycle_stage,
               r_name AS region,
               TIMESTAMP '2023-01-01' + to_days(CAST(c_custkey % 1095 AS INTEGER))
                   AS first_touch_date,
               (c_custkey * 31) % 1500 AS num_page_views,
               (c_custkey * 17) % 20 AS num_form_submissions
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
                      LEFT JOIN region ON n_regionkey = r_regionkey""",
    "deals": f"""
        SELECT o_orderkey AS deal_id, o_custkey AS contact_id, o_custkey % 100 AS company_id,
               o_orderpriority AS deal_name,
               CASE o_orderkey % 5
                   WHEN 0 THEN CAST(floor(o_totalprice / 1000) AS DOUBLE)
                   WHEN 1 THEN CAST(floor(o_totalprice / 100) AS DOUBLE)
                   WHEN 2 THEN CAST(floor(o_totalprice / 10) AS DOUBLE)
                   WHEN 3 THEN o_totalprice
                   ELSE round_even(o_totalprice * 5 * 100, 0) / 100 END AS amount,
               {_pick(DEAL_STAGES, 'o_orderkey % 6')} AS stage,
               {_pick(PIPELINES, 'o_custkey % 4')} AS pipeline,
               CAST((o_orderkey * 37) % 1001 AS DOUBLE) / 10 AS probability,
               1 + (o_orderkey * 13) % 364 AS days_in_pipeline,
               o_orderdate AS created_at,
               {_pick(INDUSTRIES, 'c_nationkey % 20')} AS industry, r_name AS region
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey
                    LEFT JOIN nation ON c_nationkey = n_nationkey
                    LEFT JOIN region ON n_regionkey = r_regionkey""",
    "marketing_events": f"""
        SELECT event_id, user_id AS contact_id, event_type,
               {_pick(CHANNELS, 'user_id % 6')} AS channel,
               event_id % 5000 + 1 AS campaign_id,
               event_type AS utm_source,
               {_pick(DEVICES, 'event_id % 3')} AS device_type,
               1 + CAST(floor(value * 3) AS BIGINT) AS session_duration_sec,
               1 + event_id % 19 AS page_depth,
               ts + to_months(CAST(user_id % 24 AS INTEGER)) AS "timestamp"
        FROM events""",
    "email_campaigns": f"""
        SELECT l_orderkey * 10 + l_linenumber AS email_event_id, l_orderkey % 1000 AS contact_id,
               l_partkey % 5000 + 1 AS campaign_id,
               {_pick(CAMPAIGN_TYPES, 'l_partkey % 10')} AS campaign_type,
               {_pick(EMAIL_ACTIONS, '(l_orderkey + l_linenumber * 3) % 7')} AS "action",
               l_suppkey % 100 + 20 AS subject_line_length,
               (l_orderkey * 5 + l_linenumber) % 24 AS send_hour,
               l_orderkey % 7 AS send_day_of_week,
               l_shipdate AS "timestamp"
        FROM lineitem""",
    "support_tickets": f"""
        SELECT o_orderkey AS ticket_id, o_custkey AS contact_id, o_custkey % 100 AS company_id,
               {_pick(TICKET_CATEGORIES, 'o_orderkey % 10')} AS category,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
                   WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low'
                   ELSE 'Unspecified' END AS priority,
               o_orderstatus AS status,
               CAST((o_orderkey * 29) % (CASE WHEN o_orderpriority = '1-URGENT' THEN 100
                   ELSE 4000 END) AS DOUBLE) / 10 AS resolution_hours,
               1 + (o_orderkey * 3 + o_custkey) % 5 AS satisfaction_score,
               o_orderkey % 29 + 1 AS num_interactions,
               o_orderdate AS created_at
        FROM orders""",
    "web_analytics": f"""
        SELECT l_orderkey * 10 + l_linenumber AS session_id,
               {_pick(PAGES, 'l_partkey % 20')} AS page_url,
               l_linestatus AS referrer_domain,
               l_returnflag AS browser,
               {_pick(DEVICES, 'l_suppkey % 3')} AS device_type,
               n_name AS country,
               1 + (l_partkey * l_linenumber) % 600 AS session_duration_sec,
               1 + CAST(floor(l_quantity) AS BIGINT) % 24 AS page_views,
               CASE WHEN l_returnflag = 'R' THEN 1::BIGINT ELSE 0::BIGINT END AS bounce,
               CASE WHEN l_discount >= 0.095::DOUBLE THEN 1::BIGINT ELSE 0::BIGINT END AS conversion,
               l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS "timestamp"
        FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
                      LEFT JOIN nation ON s_nationkey = n_nationkey""",
}


def _yes(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1::BIGINT ELSE 0::BIGINT END"


_MONTH = "strftime({0}, '%Y-%m')"
_QUARTER = "CAST(year({0}) AS VARCHAR) || 'Q' || CAST(quarter({0}) AS VARCHAR)"
_VISIT = f"""CAST(hour("timestamp") AS INTEGER) AS hour, dayname("timestamp") AS day_of_week,
             {_MONTH.format('"timestamp"')} AS month"""

FEATURES = {
    "companies": """
        CASE WHEN employee_count <= 0 THEN NULL WHEN employee_count <= 10 THEN 'Micro'
             WHEN employee_count <= 50 THEN 'Small' WHEN employee_count <= 200 THEN 'Medium'
             WHEN employee_count <= 1000 THEN 'Large' WHEN employee_count <= 5000 THEN 'Enterprise'
             WHEN employee_count > 5000 THEN 'Mega' END AS employee_tier,
        round_even(annual_revenue / (CASE WHEN employee_count < 1 THEN 1 ELSE employee_count END)
                   * 100, 0) / 100 AS revenue_per_employee,
        2025 - founded_year AS company_age""",
    "contacts": """
        CASE WHEN lead_score <= -1 OR lead_score > 100 THEN NULL WHEN lead_score <= 20 THEN 'F'
             WHEN lead_score <= 40 THEN 'D' WHEN lead_score <= 60 THEN 'C'
             WHEN lead_score <= 80 THEN 'B' WHEN lead_score <= 100 THEN 'A' END AS lead_grade,
        CASE WHEN num_page_views + num_form_submissions * 10 > 1000 THEN 1000
             ELSE num_page_views + num_form_submissions * 10 END AS engagement_index""",
    "deals": f"""
        CASE WHEN amount <= 0 THEN NULL WHEN amount <= 1000 THEN '< $1K'
             WHEN amount <= 10000 THEN '$1K–10K' WHEN amount <= 50000 THEN '$10K–50K'
             WHEN amount <= 200000 THEN '$50K–200K' WHEN amount <= 1000000 THEN '$200K–1M'
             WHEN amount > 1000000 THEN '> $1M' END AS revenue_bucket,
        round_even(amount * probability / 100 * 100, 0) / 100 AS weighted_amount,
        round_even(probability / (CASE WHEN days_in_pipeline < 1 THEN 1 ELSE days_in_pipeline END)
                   * 10000, 0) / 10000 AS velocity_score,
        {_yes("stage = 'Closed Won'")} AS is_won,
        {_yes("stage = 'Closed Lost'")} AS is_lost,
        {_QUARTER.format('created_at')} AS quarter,
        {_MONTH.format('created_at')} AS month""",
    "marketing_events": f"""
        {_VISIT}, {_yes('session_duration_sec > 60')} AS is_engaged""",
    "email_campaigns": f"""
        {_yes("action IN ('Opened', 'Clicked')")} AS is_opened,
        {_yes("action = 'Clicked'")} AS is_clicked,
        {_yes("action = 'Bounced'")} AS is_bounced,
        {_yes("action IN ('Unsubscribed', 'Spam')")} AS is_unsub,
        {_MONTH.format('"timestamp"')} AS month""",
    "support_tickets": f"""
        {_yes('''(priority = 'Critical' AND resolution_hours <= 4)
              OR (priority = 'High' AND resolution_hours <= 24)
              OR (priority = 'Medium' AND resolution_hours <= 72)
              OR (priority = 'Low' AND resolution_hours <= 168)''')} AS sla_met,
        {_QUARTER.format('created_at')} AS quarter""",
    "web_analytics": f"""
        {_VISIT}, {_yes('session_duration_sec > 30 AND bounce = 0')} AS engaged_session""",
}


def processed(entity: str) -> str:
    """A query for the processed entity."""
    return f"SELECT r.*, {FEATURES[entity]} FROM ({RAW[entity]}) r"


def with_entities(body: str, *entities: str) -> str:
    """A query over CTEs named after the processed entities it reads."""
    ctes = ", ".join(f"{name} AS ({processed(name)})" for name in entities)
    return f"WITH {ctes} {body}"
