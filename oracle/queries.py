"""SQL per registered query. Column names and types equal those of the Spark results."""

from oracle.entities import FEATURES, processed, with_entities


def _sum(column: str, decimals: int = 2) -> str:
    return f"CAST(coalesce(SUM(CAST({column} AS DECIMAL(18, {decimals}))), 0) AS DOUBLE)"


def _mean(column: str, decimals: int) -> str:
    total = f"CAST(SUM(CAST({column} AS DECIMAL(18, {decimals}))) AS DOUBLE)"
    return f"{total} / nullif(COUNT({column}), 0)"


def _flags(column: str) -> str:
    return f"CAST(coalesce(SUM({column}), 0) AS BIGINT)"


_REVENUE = f"""{_sum('amount')} AS total_revenue, {_sum('weighted_amount')} AS weighted_pipeline,
    {_mean('amount', 2)} AS avg_deal_size, COUNT(deal_id) AS deal_count,
    {_flags('is_won')} AS win_count, {_flags('is_lost')} AS loss_count"""
_DEALS = f"""{_sum('amount')} AS total_revenue, {_mean('amount', 2)} AS avg_deal_size,
    COUNT(deal_id) AS deal_count, AVG(is_won) AS win_rate"""
_EVENTS = """COUNT(event_id) AS event_count, AVG(session_duration_sec) AS avg_session_duration,
    AVG(is_engaged) AS engagement_rate"""
_EMAILS = """COUNT(email_event_id) AS total_sent, AVG(is_opened) AS open_rate,
    AVG(is_clicked) AS click_rate"""
_CONTACTS = """COUNT(contact_id) AS "count", AVG(lead_score) AS avg_lead_score,
    AVG(engagement_index) AS avg_engagement"""
_TICKETS = f"""COUNT(ticket_id) AS ticket_count, {_mean('resolution_hours', 1)} AS avg_resolution_hours,
    AVG(sla_met) AS sla_compliance, AVG(satisfaction_score) AS avg_satisfaction"""
_WEB = """COUNT(session_id) AS sessions, AVG(bounce) AS bounce_rate,
    AVG(conversion) AS conversion_rate"""
_FIRMS = f"""COUNT(company_id) AS company_count, AVG(employee_count) AS avg_employees,
    {_mean('annual_revenue', 2)} AS avg_revenue"""

# table name -> (entity, key, measures)
_GROUPED = {
    "revenue_by_quarter": ("deals", "quarter", _REVENUE),
    "revenue_by_month": ("deals", "month", _REVENUE),
    "deals_by_region": ("deals", "region",
                        f"{_DEALS}, {_mean('velocity_score', 4)} AS avg_velocity"),
    "deals_by_industry": ("deals", "industry", _DEALS),
    "pipeline_stages": ("deals", "stage", f"""COUNT(deal_id) AS "count",
        {_sum('amount')} AS total_value, {_mean('probability', 1)} AS avg_probability,
        AVG(days_in_pipeline) AS avg_days"""),
    "deals_by_pipeline": ("deals", "pipeline", _DEALS),
    "marketing_by_channel": ("marketing_events", "channel",
                             f"{_EVENTS}, AVG(page_depth) AS avg_page_depth"),
    "marketing_by_month": ("marketing_events", "month", _EVENTS),
    "marketing_by_event_type": ("marketing_events", "event_type", _EVENTS),
    "email_performance": ("email_campaigns", "campaign_type", f"""{_EMAILS},
        AVG(is_bounced) AS bounce_rate, AVG(is_unsub) AS unsub_rate"""),
    "email_by_month": ("email_campaigns", "month", f"{_EMAILS}, AVG(is_bounced) AS bounce_rate"),
    "email_by_hour": ("email_campaigns", "send_hour", _EMAILS),
    "contacts_by_lifecycle": ("contacts", "lifecycle_stage", _CONTACTS),
    "contacts_by_source": ("contacts", "lead_source", _CONTACTS),
    "support_by_category": ("support_tickets", "category", _TICKETS),
    "support_by_priority": ("support_tickets", "priority", _TICKETS),
    "web_by_page": ("web_analytics", "page_url", f"""{_WEB},
        AVG(session_duration_sec) AS avg_duration, AVG(page_views) AS avg_page_views"""),
    "web_by_country": ("web_analytics", "country",
                       f"{_WEB}, AVG(session_duration_sec) AS avg_duration"),
    "web_by_device": ("web_analytics", "device_type",
                      f"{_WEB}, AVG(session_duration_sec) AS avg_duration"),
    "web_by_month": ("web_analytics", "month", f"{_WEB}, AVG(engaged_session) AS engagement_rate"),
    "companies_by_industry": ("companies", "industry",
                              f"{_FIRMS}, AVG(website_traffic_monthly) AS avg_traffic"),
    "companies_by_region": ("companies", "region", _FIRMS),
}


def grouped(name: str) -> str:
    entity, key, measures = _GROUPED[name]
    return f"SELECT {key}, {measures} FROM {entity} WHERE {key} IS NOT NULL GROUP BY {key}"


def _r(value: str, digits: int) -> str:
    """Correctly rounded decimal text of the binary value."""
    return f"CAST(printf('%.{digits}f', {value}) AS DOUBLE)"


def _pct(column: str, digits: int = 1) -> str:
    return _r(f"{column} * 100", digits)


def _rank(labels: str, column: str) -> str:
    return f"coalesce(list_position({labels}, {column}), 99)"


_SALES = f"""{_r('total_revenue', 2)} AS revenue, {_pct('win_rate')} AS win_rate, deal_count"""
_SCORED = f"""\"count\", {_r('avg_lead_score', 1)} AS avg_score"""
_TRAFFIC = f"""sessions, {_pct('bounce_rate')} AS bounce_rate,
    {_pct('conversion_rate', 2)} AS conversion_rate"""
_COMPANY = f"""company_count AS "count", {_r('avg_revenue', 2)} AS avg_revenue"""
_STAGES = "['Prospecting','Qualification','Proposal','Negotiation','Closed Won','Closed Lost']"
_LIFECYCLE = "['Subscriber','Lead','MQL','SQL','Opportunity','Customer','Evangelist']"
_PRIORITY = "['Critical','High','Medium','Low']"

# chart -> (table, order, label, columns, row limit)
_ORDERED = {
    "revenue_trend": ("revenue_by_month", "month", "month", f"""
        {_r('total_revenue', 2)} AS total_revenue,
        {_r('weighted_pipeline', 2)} AS weighted_pipeline""", None),
    "deals_by_stage": ("pipeline_stages", f"{_rank(_STAGES, 'stage')}, stage", "stage", f"""
        "count" AS counts, {_r('total_value', 2)} AS "values" """, None),
    "deals_by_region": ("deals_by_region", "total_revenue DESC, region", "region", _SALES, None),
    "deals_by_industry": ("deals_by_industry", "total_revenue DESC, industry", "industry", _SALES,
                          None),
    "deals_by_pipeline": ("deals_by_pipeline", "pipeline", "pipeline", _SALES, None),
    "marketing_channels": ("marketing_by_channel", "event_count DESC, channel", "channel", f"""
        event_count, {_pct('engagement_rate')} AS engagement_rate,
        {_r('avg_session_duration', 0)} AS avg_duration""", None),
    "marketing_trend": ("marketing_by_month", "month", "month", f"""
        event_count, {_pct('engagement_rate')} AS engagement_rate""", None),
    "marketing_event_types": ("marketing_by_event_type", "event_count DESC, event_type",
                              "event_type", f"""
        event_count, {_pct('engagement_rate')} AS engagement_rate""", None),
    "email_performance": ("email_performance", "campaign_type", "campaign_type", f"""
        {_pct('open_rate')} AS open_rate, {_pct('click_rate')} AS click_rate,
        {_pct('bounce_rate')} AS bounce_rate, {_pct('unsub_rate', 2)} AS unsub_rate""", None),
    "email_trend": ("email_by_month", "month", "month", f"""
        {_pct('open_rate')} AS open_rate, {_pct('click_rate')} AS click_rate""", None),
    "email_by_hour": ("email_by_hour", "send_hour", "printf('%02d:00', send_hour) AS hour", f"""
        {_pct('open_rate')} AS open_rate, {_pct('click_rate')} AS click_rate""", None),
    "contacts_lifecycle": ("contacts_by_lifecycle",
                           f"{_rank(_LIFECYCLE, 'lifecycle_stage')}, lifecycle_stage",
                           "lifecycle_stage", _SCORED, None),
    "contacts_by_source": ("contacts_by_source", '"count" DESC, lead_source', "lead_source",
                           _SCORED, None),
    "support_by_category": ("support_by_category", "ticket_count DESC, category", "category", f"""
        ticket_count, {_r('avg_resolution_hours', 1)} AS avg_resolution,
        {_pct('sla_compliance')} AS sla_compliance,
        {_r('avg_satisfaction', 1)} AS satisfaction""", None),
    "support_by_priority": ("support_by_priority", f"{_rank(_PRIORITY, 'priority')}, priority",
                            "priority", f"""
        ticket_count, {_r('avg_resolution_hours', 1)} AS avg_resolution,
        {_pct('sla_compliance')} AS sla_compliance""", None),
    "web_top_pages": ("web_by_page", "sessions DESC, page_url", "page_url", _TRAFFIC, None),
    "web_by_country": ("web_by_country", "sessions DESC, country", "country", f"""
        sessions, {_pct('conversion_rate', 2)} AS conversion_rate""", 15),
    "web_by_device": ("web_by_device", "device_type", "device_type", _TRAFFIC, None),
    "web_trend": ("web_by_month", "month", "month", f"""
        sessions, {_pct('conversion_rate', 2)} AS conversion_rate""", None),
    "companies_by_industry": ("companies_by_industry", "company_count DESC, industry", "industry",
                              _COMPANY, None),
    "companies_by_region": ("companies_by_region", "region", "region", _COMPANY, None),
}


def chart(name: str) -> str:
    table, order, label, columns, limit = _ORDERED[name]
    cut = f"QUALIFY position <= {limit}" if limit else ""
    return f"""SELECT row_number() OVER (ORDER BY {order}) AS position, {label}, {columns}
               FROM ({grouped(table)}) g {cut}"""


def _chart_entity(name: str) -> str:
    return _GROUPED[_ORDERED[name][0]][0]


_KPIS = f"""
    SELECT * FROM
    (SELECT {_r(_sum('amount'), 2)} AS total_revenue,
            {_r(_sum('CASE WHEN is_won = 1 THEN amount END'), 2)} AS won_revenue,
            {_r(_sum('weighted_amount'), 2)} AS pipeline_value,
            {_pct('AVG(is_won)')} AS win_rate,
            {_r(_mean('amount', 2), 2)} AS avg_deal_size,
            COUNT(*) AS total_deals FROM deals),
    (SELECT COUNT(*) AS total_contacts FROM contacts),
    (SELECT COUNT(*) AS total_companies FROM companies),
    (SELECT {_pct('AVG(conversion)', 2)} AS conversion_rate, {_pct('AVG(bounce)')} AS bounce_rate,
            COUNT(*) AS total_sessions FROM web_analytics),
    (SELECT {_r('AVG(satisfaction_score)', 1)} AS avg_csat, {_pct('AVG(sla_met)')} AS sla_compliance,
            COUNT(*) AS total_tickets FROM support_tickets),
    (SELECT {_pct('AVG(is_opened)')} AS email_open_rate,
            {_pct('AVG(is_clicked)')} AS email_click_rate FROM email_campaigns)"""
_KPI_ENTITIES = (
    "deals", "contacts", "companies", "web_analytics", "support_tickets", "email_campaigns",
)

# chart -> its number columns
_SERIES = {
    "revenue_trend": ["total_revenue", "weighted_pipeline"],
    "deals_by_stage": ["counts", "values"],
    "deals_by_region": ["revenue", "win_rate", "deal_count"],
    "deals_by_industry": ["revenue", "win_rate", "deal_count"],
    "deals_by_pipeline": ["revenue", "win_rate", "deal_count"],
    "marketing_channels": ["event_count", "engagement_rate", "avg_duration"],
    "marketing_trend": ["event_count", "engagement_rate"],
    "marketing_event_types": ["event_count", "engagement_rate"],
    "email_performance": ["open_rate", "click_rate", "bounce_rate", "unsub_rate"],
    "email_trend": ["open_rate", "click_rate"],
    "email_by_hour": ["open_rate", "click_rate"],
    "contacts_lifecycle": ["count", "avg_score"],
    "contacts_by_source": ["count", "avg_score"],
    "support_by_category": ["ticket_count", "avg_resolution", "sla_compliance", "satisfaction"],
    "support_by_priority": ["ticket_count", "avg_resolution", "sla_compliance"],
    "web_top_pages": ["sessions", "bounce_rate", "conversion_rate"],
    "web_by_country": ["sessions", "conversion_rate"],
    "web_by_device": ["sessions", "bounce_rate", "conversion_rate"],
    "web_trend": ["sessions", "conversion_rate"],
    "companies_by_industry": ["count", "avg_revenue"],
    "companies_by_region": ["count", "avg_revenue"],
}


def _points() -> str:
    parts = []
    for name, series in _SERIES.items():
        label = _ORDERED[name][2].split(" AS ")[-1]
        for column in series:
            parts.append(
                f"""SELECT '{name}' AS chart, position, CAST({label} AS VARCHAR) AS label,
                    '{column}' AS series, CAST("{column}" AS DOUBLE) AS value
                    FROM chart_{name}"""
            )
    ctes = ", ".join(f"{entity} AS ({processed(entity)})" for entity in FEATURES)
    charts = ", ".join(f"chart_{name} AS ({chart(name)})" for name in _SERIES)
    return f"WITH {ctes}, {charts} " + " UNION ALL ".join(parts)


_TITLES = {
    "revenue_trend": ["Closed Revenue", "Weighted Pipeline"],
    "marketing_trend": ["Events", "Engagement %"],
    "email_trend": ["Open Rate %", "Click Rate %"],
    "web_trend": ["Sessions", "Conversion %"],
}
_FIGURES = [
    "total_revenue", "won_revenue", "pipeline_value", "win_rate", "avg_deal_size", "total_contacts",
    "total_companies", "total_deals", "conversion_rate", "bounce_rate", "total_sessions", "avg_csat",
    "sla_compliance", "total_tickets", "email_open_rate", "email_click_rate",
]


def _json_number(column: str) -> str:
    """A number as JSON text: doubles from 1e7 on in scientific notation, the shortest digits."""
    text = f"CAST(abs({column}) AS VARCHAR)"
    whole = f"split_part({text}, '.', 1)"
    digits = f"rtrim(replace({text}, '.', ''), '0')"
    scientific = f"""CASE WHEN {column} < 0 THEN '-' ELSE '' END || left({digits}, 1) || '.'
        || coalesce(nullif(substr({digits}, 2), ''), '0') || 'E' || (length({whole}) - 1)"""
    return f"""CASE WHEN {column} IS NULL THEN 'null'
        WHEN typeof({column}) = 'BIGINT' OR abs({column}) < 1e7 THEN CAST({column} AS VARCHAR)
        ELSE {scientific} END"""


def _json_list(value: str) -> str:
    return f"'[' || coalesce(string_agg({value}, ',' ORDER BY position), '') || ']'"


def _chart_json(name: str, absent: tuple[str, ...] = ()) -> str:
    """One row, one column: the chart as JSON text."""
    titles = _TITLES.get(name)
    if _chart_entity(name) in absent:
        return f"""SELECT '{{"labels":[],"{'datasets' if titles else 'data'}":[]}}' AS payload"""
    label = _ORDERED[name][2].split(" AS ")[-1]
    labels = _json_list(f"""'"' || {label} || '"'""")
    numbers = [_json_list(_json_number(f'"{column}"')) for column in _SERIES[name]]
    if titles:
        data = " || ',' || ".join(
            f"""'{{"data":' || {values} || ',"label":"{title}"}}'"""
            for title, values in zip(titles, numbers))
        rest = f"""'"datasets":[' || {data} || ']'"""
    else:
        rest = " || ',' || ".join(
            f"""'"{column}":' || {values}""" for column, values in zip(_SERIES[name], numbers))
    return f"""SELECT '{{"labels":' || {labels} || ',' || {rest} || '}}' AS payload FROM ({chart(name)}) c"""


def _payload(absent: tuple[str, ...] = ()) -> str:
    whole = ("total_deals",)
    of_deals = ("total_revenue", "won_revenue", "pipeline_value", "win_rate", "avg_deal_size", "total_deals")
    figures = " || ',' || ".join(
        f"""'"{name}":{'0' if name in whole else '0.0'}'"""
        if "deals" in absent and name in of_deals else f"""'"{name}":' || {_json_number(name)}"""
        for name in _FIGURES)
    charts = " || ',' || ".join(
        f"""'"{name}":' || (SELECT payload FROM ({_chart_json(name, absent)}) j)""" for name in _SERIES)
    return with_entities(
        f"""SELECT '{{"kpis":{{' || (SELECT {figures} FROM ({_KPIS}) k) || '}},' || {charts} || '}}'
            AS payload""", *FEATURES)


def _stored_numbers() -> str:
    parts = [
        f"""SELECT '{name}' AS name, key, measure, value FROM (
                SELECT CAST({_GROUPED[name][1]} AS VARCHAR) AS key,
                       CAST(COLUMNS(* EXCLUDE ({_GROUPED[name][1]})) AS DOUBLE) FROM ({grouped(name)}) g)
            UNPIVOT INCLUDE NULLS (value FOR measure IN (COLUMNS(* EXCLUDE (key))))"""
        for name in _GROUPED
    ]
    return with_entities(" UNION ALL ".join(parts), *FEATURES)


def _stored_charts(absent: tuple[str, ...]) -> str:
    parts = [f"SELECT '{name}' AS chart, payload FROM ({_chart_json(name, absent)}) j" for name in _SERIES]
    return with_entities(" UNION ALL ".join(parts), *FEATURES)


def _funnel(name: str, column: str) -> str:
    return f"""SELECT *, greatest("{column}" / MAX("{column}") OVER () * 100, 8.0::DOUBLE) AS width
               FROM ({chart(name)}) c"""


def _industries() -> str:
    return f"SELECT * EXCLUDE (deal_count) FROM ({chart('deals_by_industry')}) c WHERE position <= 10"


def _share() -> str:
    return f"""SELECT *, sessions / MAX(sessions) OVER () * 100 AS traffic_share
               FROM ({chart('web_top_pages')}) c"""


def _bands() -> str:
    return f"""SELECT *, CASE WHEN sla_compliance >= 70 THEN 'good'
                              WHEN sla_compliance >= 50 THEN 'warning' ELSE 'bad' END AS sla_band
               FROM ({chart('support_by_category')}) c"""


def _volume() -> str:
    return f"""SELECT *, event_count / 1000 AS volume_k FROM ({chart('marketing_channels')}) c"""


_ROW_CHECKS = [
    ("companies", "companies.company_id is present", "company_id IS NOT NULL"),
    ("companies", "companies.company_age is not negative", "company_age >= 0"),
    ("contacts", "contacts.contact_id is present", "contact_id IS NOT NULL"),
    ("contacts", "contacts.engagement_index is within its cap", "engagement_index <= 1000"),
    ("deals", "deals.deal_id is present", "deal_id IS NOT NULL"),
    ("deals", "deals.weighted_amount is not negative", "weighted_amount >= 0"),
    ("deals", "deals.is_won is 0 or 1", "is_won IN (0, 1)"),
    ("support_tickets", "support_tickets.sla_met is 0 or 1", "sla_met IN (0, 1)"),
]


def _quality() -> str:
    parts = [
        f"""SELECT '{name}' AS "check", COUNT(*) AS violations FROM {entity}
            WHERE ({rule}) IS NOT TRUE"""
        for entity, name, rule in _ROW_CHECKS
    ] + [
        f"""SELECT '{table} is not empty' AS "check",
            CASE WHEN COUNT(*) > 0 THEN 0::BIGINT ELSE 1::BIGINT END AS violations
            FROM ({grouped(table)}) g"""
        for table in _GROUPED
    ]
    return with_entities(" UNION ALL ".join(parts), *FEATURES)


def _written() -> str:
    """Row counts of the written layers; a summary has the rows of all its aggregates and one more."""
    parts = []
    for entity in FEATURES:
        parts.append(f"SELECT 'processed' AS layer, '{entity}' AS name, COUNT(*) AS \"rows\" FROM {entity}")
        keys = [key for source, key, _ in _GROUPED.values() if source == entity]
        groups = " + ".join(
            f"(SELECT COUNT(DISTINCT {key}) FROM {entity})" for key in keys
        )
        parts.append(f"SELECT 'summaries', '{entity}', CAST({groups} + 1 AS BIGINT)")
    for table in _GROUPED:
        parts.append(f"SELECT 'aggregated', '{table}', COUNT(*) FROM ({grouped(table)}) g")
    return with_entities(" UNION ALL ".join(parts), *FEATURES)


def _refreshed() -> str:
    """Row counts of the layers of contacts, of which those with a low lead score are gone, and totals."""
    keys = [key for source, key, _ in _GROUPED.values() if source == "contacts"]
    groups = " + ".join(f"(SELECT COUNT(DISTINCT {key}) FROM contacts)" for key in keys)
    parts = [
        "SELECT 'processed' AS layer, 'contacts' AS name, COUNT(*) AS \"rows\" FROM contacts",
        f"SELECT 'summaries', 'contacts', CAST({groups} + 1 AS BIGINT)",
        *[f"SELECT 'aggregated', '{table}', COUNT(*) FROM ({grouped(table)}) g"
          for table, (source, _, _) in _GROUPED.items() if source == "contacts"],
        *[f"SELECT 'served', '{figure}', COUNT(*) FROM ({rows}) t" for figure, rows in {
            "total_contacts": "SELECT 1 FROM contacts", "total_deals": processed("deals"),
            "total_sessions": processed("web_analytics")}.items()],
    ]
    body = " UNION ALL ".join(parts)
    return f"WITH contacts AS (SELECT * FROM ({processed('contacts')}) c WHERE lead_score >= 50) {body}"


def _stored_rows(absent: tuple[str, ...]) -> str:
    parts = [
        f"""SELECT '{name}' AS chart, position, CAST({_ORDERED[name][2].split(" AS ")[-1]} AS VARCHAR) AS label
            FROM ({chart(name)}) c"""
        for name in _ORDERED if _chart_entity(name) not in absent
    ]
    return with_entities(" UNION ALL ".join(parts), *FEATURES)


def feature_sql(entity: str) -> str:
    return processed(entity)


def aggregate_sql(name: str) -> str:
    return with_entities(grouped(name), _GROUPED[name][0])


def chart_sql(name: str) -> str:
    return with_entities(chart(name), _chart_entity(name))


OTHER = {
    "kpi_summary": with_entities(_KPIS, *_KPI_ENTITIES),
    "records_loaded": with_entities(
        f"""SELECT total_contacts + total_deals + total_sessions + total_tickets + total_companies
            AS records_loaded FROM ({_KPIS}) k""", *_KPI_ENTITIES),
    "dashboard_points": _points(),
    "deal_funnel": with_entities(_funnel("deals_by_stage", "counts"), "deals"),
    "lifecycle_funnel": with_entities(_funnel("contacts_lifecycle", "count"), "contacts"),
    "page_traffic_share": with_entities(_share(), "web_analytics"),
    "top_industries": with_entities(_industries(), "deals"),
    "support_sla_bands": with_entities(_bands(), "support_tickets"),
    "channel_volume_k": with_entities(_volume(), "marketing_events"),
    "quality_checks": _quality(),
    "layer_row_counts": _written(),
    "dashboard_payload": _payload(),
    "layer_aggregates": _stored_numbers(),
    "layer_charts": _stored_charts(absent=("marketing_events",)),
    "layer_chart_rows": _stored_rows(absent=("deals",)),
    "layer_refresh": _refreshed(),
    "layer_payload": _payload(),
    "layer_payload_without_deals": _payload(absent=("deals",)),
}
