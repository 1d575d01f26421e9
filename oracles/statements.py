"""One DuckDB statement per registered query, over the star-schema test tables.

The statements are assembled from named table expressions below and state each result the
relational way (joins, ranks), independently of how the Spark side arrives at it.
"""

from __future__ import annotations

Y0, Y1 = 1999, 2000
ENTITY = "1"

# ---------------------------------------------------------------- scalar pieces


def rnd(expression: str, digits: int) -> str:
    # Adding zero turns a negative zero into zero.
    return f"(round({expression}, {digits}) + 0.0)"


def div(top: str, bottom: str) -> str:
    return f"(({top})::DOUBLE / nullif(({bottom})::DOUBLE, 0))"


def pct(new: str, old: str) -> str:
    return rnd(f"{div(f'({new})::DOUBLE - ({old})::DOUBLE', old)} * 100", 2)


def eur(cents: str) -> str:
    return f"(({cents})::DOUBLE / 100.0)"


def big(expression: str) -> str:
    return f"({expression})::BIGINT"


# ---------------------------------------------------------------- source tables

SOURCES = {
    "dim": """
        SELECT s_suppkey::VARCHAR AS hotel_id, n_name AS country, r_name AS region,
               (3 + s_suppkey % 3)::VARCHAR || ' Star' AS hotel_category
        FROM supplier
        JOIN nation ON n_nationkey = s_nationkey
        JOIN region ON r_regionkey = n_regionkey""",
    "ads": """
        SELECT l_orderkey AS okey, l_linenumber AS line, l_suppkey::VARCHAR AS hotel_id,
               l_orderkey::VARCHAR AS campaign_id, l_shipdate::DATE AS day, l_returnflag AS campaign_type,
               100 * l_quantity::BIGINT AS impressions,
               l_quantity::BIGINT * round(l_discount * 100)::BIGINT AS clicks,
               if(l_suppkey % 10 = 9, 0, (l_quantity::BIGINT * round(l_discount * 100)::BIGINT
                                          * round(l_tax * 100)::BIGINT) // 10)::BIGINT AS leads,
               round(l_extendedprice)::BIGINT AS cents
        FROM lineitem""",
    "sales": """
        SELECT o_orderkey::VARCHAR AS booking_id, l_suppkey::VARCHAR AS hotel_id, o_orderdate::DATE AS day,
               o_orderpriority AS travel_type, (l_extendedprice::DECIMAL(18,2) * 100)::BIGINT AS cents
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
}

# ---------------------------------------------------------------- shared table expressions

SHARED = {
    "ad_month": f"""
        SELECT hotel_id, date_trunc('month', day)::DATE AS month, {big('sum(impressions)')} AS impressions,
               {big('sum(clicks)')} AS clicks, {big('sum(leads)')} AS leads, {big('sum(cents)')} AS cents
        FROM ads GROUP BY ALL""",
    "sale_month": f"""
        SELECT hotel_id, date_trunc('month', day)::DATE AS month,
               count(DISTINCT booking_id) AS bookings, {big('sum(cents)')} AS cents
        FROM sales GROUP BY ALL""",
    "span": """
        SELECT date_trunc('month', min(day))::DATE AS first, date_trunc('month', max(day))::DATE AS last
        FROM (SELECT day FROM ads UNION ALL SELECT day FROM sales)""",
    "calendar": "SELECT unnest(generate_series(first, last, INTERVAL 1 MONTH))::DATE AS month FROM span",
    "grid": "SELECT hotel_id, month FROM dim, calendar",
    "filled": """
        SELECT g.hotel_id, g.month, coalesce(a.leads, 0) AS leads, coalesce(s.cents, 0) AS cents
        FROM grid g
        LEFT JOIN ad_month a USING (hotel_id, month)
        LEFT JOIN sale_month s USING (hotel_id, month)""",
    "framed": f"""
        SELECT *, row_number() OVER o AS pos,
               {big('sum(leads) OVER f')} AS l3, {big('sum(cents) OVER f')} AS r3
        FROM filled
        WINDOW o AS (PARTITION BY hotel_id ORDER BY month),
               f AS (PARTITION BY hotel_id ORDER BY month ROWS 2 PRECEDING)""",
    "moved": """
        SELECT *, lag(l3) OVER o AS l3_was, lag(r3) OVER o AS r3_was
        FROM framed WINDOW o AS (PARTITION BY hotel_id ORDER BY month)""",
    # The pair of signs picks the label.
    "named": """
        SELECT *, CASE WHEN pos <= 3 THEN 'Trend not possible' ELSE
               coalesce(map {'1 1': 'increasing', '-1 -1': 'decreasing',
                             '1 -1': 'leads increase, revenue decrease',
                             '-1 1': 'leads decrease, revenue increase'}[
                   sign(l3 - l3_was)::INT || ' ' || sign(r3 - r3_was)::INT], 'stable/mixed') END AS trend
        FROM moved""",
    "grouped": """
        SELECT *, pos - row_number() OVER (PARTITION BY hotel_id, trend ORDER BY month) AS island
        FROM named""",
}


def _mean(total: str, size: str) -> str:
    return f"(({total}) / {size}::DOUBLE)"


_SIZE, _SIZE_WAS = "least(pos, 3)", "nullif(least(pos - 1, 3), 0)"
_L, _L_WAS = _mean("l3::DOUBLE", _SIZE), _mean("l3_was::DOUBLE", _SIZE_WAS)
_R, _R_WAS = _mean(eur("r3"), _SIZE), _mean(eur("r3_was"), _SIZE_WAS)
DIFFS = f"""
    {rnd(f'{_L} - {_L_WAS}', 2)} AS leads_3m_diff_abs,
    {rnd(f'{_R} - {_R_WAS}', 2)} AS revenue_3m_diff_abs,
    {rnd(div(f'{_L} - {_L_WAS}', _L_WAS), 2)} AS leads_3m_diff_pct,
    {rnd(div(f'{_R} - {_R_WAS}', _R_WAS), 2)} AS revenue_3m_diff_pct"""


def statement(body: str, **extra: str) -> str:
    """``body`` with the table expressions it needs in front, in order of definition."""
    known = {**SOURCES, **SHARED, **extra}
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in known:
            if name in words and name not in needed:
                needed.add(name)
                pending.append(known[name])
    parts = [f"{name} AS ({known[name]})" for name in known if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# ---------------------------------------------------------------- monthly figures

S: dict[str, str] = {}

S["monthly_kpis"] = statement(f"""
    SELECT strftime(month, '%B %Y') AS month, hotel_id, country, region, hotel_category,
           impressions, clicks, leads, {eur('cents')} AS cost,
           {rnd(div('clicks', 'impressions'), 4)} AS ctr,
           {rnd(div(eur('cents'), 'clicks'), 2)} AS cpc,
           {rnd(div('leads', 'clicks'), 4)} AS conversion_rate
    FROM ad_month LEFT JOIN dim USING (hotel_id)""")

S["spend_monthly"] = statement(f"""
    SELECT hotel_id, month, impressions, clicks, leads, {eur('cents')} AS cost FROM ad_month""")

S["conv_monthly"] = statement(f"""
    SELECT hotel_id, month, bookings, {eur('cents')} AS revenue FROM sale_month""")

S["month_spine"] = statement("SELECT month FROM calendar")
S["dense_grid"] = statement("SELECT hotel_id, month FROM grid")

# ---------------------------------------------------------------- divergence

TRIPLES = {
    "triples": """
        SELECT c.hotel_id, a.month AS m1, b.month AS m2, c.month AS m3,
               a.cents AS c1, b.cents AS c2, c.cents AS c3, a.leads AS l1, b.leads AS l2, c.leads AS l3
        FROM ad_month c
        JOIN ad_month b ON b.hotel_id = c.hotel_id AND b.month + INTERVAL 1 MONTH = c.month
        JOIN ad_month a ON a.hotel_id = c.hotel_id AND a.month + INTERVAL 2 MONTH = c.month""",
}
_RISE = div(f"{eur('c3')} - {eur('c1')}", eur("c1"))
_DROP = div("l1 - l3", "l1")


def _diverging(condition: str) -> dict[str, str]:
    return {
        **TRIPLES,
        "hits": f"""
            SELECT *, {_RISE} AS rise, {_DROP} AS fall,
                   coalesce({_RISE}, 0) + coalesce({_DROP}, 0) AS score
            FROM triples WHERE {condition}""",
    }


STRICT = "c1 < c2 AND c2 < c3 AND l1 > l2 AND l2 > l3"
LOOSE = "c1 < c3 AND l1 > l3"


def _divergence(condition: str, score: str) -> str:
    return statement(
        f"""
        SELECT hotel_id, country, region, hotel_category, m1 AS month_1, m2 AS month_2, m3 AS month_3,
               {eur('c1')} AS cost_month_1, {eur('c2')} AS cost_month_2, {eur('c3')} AS cost_month_3,
               l1 AS leads_month_1, l2 AS leads_month_2, l3 AS leads_month_3,
               {eur('c3 - c1')} AS abs_cost_increase, l1 - l3 AS abs_leads_drop,
               {rnd('rise', 4)} AS pct_cost_increase, {rnd('fall', 4)} AS pct_leads_drop,
               {rnd('score', 4)} AS {score}
        FROM worst LEFT JOIN dim USING (hotel_id)
        ORDER BY {score} DESC, hotel_id, m3 LIMIT 10""",
        **_diverging(condition),
        worst="""
            SELECT * FROM hits
            QUALIFY row_number() OVER (PARTITION BY hotel_id ORDER BY score DESC, m3) = 1""",
    )


S["rising_cost_falling_leads_strict"] = _divergence(STRICT, "ano_score_pct")
S["rising_cost_falling_leads_loose"] = _divergence(LOOSE, "ano_score")
S["diverging_windows_strict"] = statement(
    f"SELECT hotel_id, m1 AS month_1, m3 AS month_3, {rnd('score', 4)} AS score FROM hits", **_diverging(STRICT)
)
S["diverging_windows_loose"] = statement(
    f"SELECT hotel_id, m1 AS month_1, m3 AS month_3, {rnd('score', 4)} AS score FROM hits", **_diverging(LOOSE)
)

# ---------------------------------------------------------------- trends

S["moving_average_trends"] = statement(
    f"""
    SELECT month, hotel_id, country, region, hotel_category, leads, {eur('cents')} AS revenue,
           {rnd(_L, 2)} AS leads_3m_mov_av, {rnd(_R, 2)} AS revenue_3m_mov_av, {DIFFS},
           len AS total_months_in_current_trend, nth AS current_month_in_trend,
           CASE WHEN pos <= 3 THEN trend
                WHEN len < 3 THEN 'No sustaining trend (< 3 months)'
                ELSE format('{{}} (Phase of {{}} months)', trend, len) END AS consecutive_trend
    FROM measured JOIN dim USING (hotel_id)""",
    measured="""
        SELECT *, count(*) OVER i AS len,
               row_number() OVER (PARTITION BY hotel_id, trend, island ORDER BY month) AS nth
        FROM grouped WINDOW i AS (PARTITION BY hotel_id, trend, island)""",
)
_PHASES = {
    "phases": """
        SELECT hotel_id, trend, count(*) AS months, min(month) AS since, max(month) AS until
        FROM grouped GROUP BY hotel_id, trend, island""",
}
S["longest_trend_runs"] = statement(
    """
    SELECT hotel_id, country, trend, months AS total_months_in_trend, since AS trend_start, until AS trend_end
    FROM phases p JOIN dim USING (hotel_id)
    WHERE trend <> 'Trend not possible'
      AND months = (SELECT max(months) FROM phases q WHERE q.trend = p.trend)""",
    **_PHASES,
)
S["trend_islands"] = statement(
    """
    SELECT hotel_id, trend, months, since AS first_month, until AS last_month,
           row_number() OVER (PARTITION BY hotel_id ORDER BY since) AS run_id
    FROM phases""",
    **_PHASES,
)
S["december_snapshot_trend"] = statement(
    f"""
    SELECT month, hotel_id, country, region, hotel_category, trend AS "trend_3M_mov_av",
           leads_3m_diff_abs, revenue_3m_diff_abs, leads_3m_diff_pct, revenue_3m_diff_pct,
           {rnd('coalesce(leads_3m_diff_pct, 0) + coalesce(revenue_3m_diff_pct, 0)', 2)} AS trend_score_pct
    FROM (SELECT *, {DIFFS} FROM moved_named WHERE month(month) = 12) JOIN dim USING (hotel_id)""",
    moved_named="SELECT * FROM named",
)

# ---------------------------------------------------------------- segments


def _totals(by: str) -> dict[str, str]:
    """Zero-filled totals per entity, or per entity and year for ``by = 'year, '``."""
    key = f"hotel_id, {by}" if by else "hotel_id, "
    using = "hotel_id, year" if by else "hotel_id"
    year = "year(day) AS year, " if by else ""
    spine = "SELECT hotel_id, year FROM dim, years" if by else "SELECT hotel_id FROM dim"
    group = using
    return {
        "years": "SELECT year(day) AS year FROM ads UNION SELECT year(day) FROM sales",
        "ad_sum": f"""
            SELECT hotel_id, {year}sum(impressions) AS i, sum(clicks) AS c, sum(leads) AS l, sum(cents) AS k
            FROM ads GROUP BY {group}""",
        "sale_sum": f"""
            SELECT hotel_id, {year}count(DISTINCT booking_id) AS b, sum(cents) AS r
            FROM sales GROUP BY {group}""",
        "totals": f"""
            SELECT {key}{big('coalesce(i, 0)')} AS impressions, {big('coalesce(c, 0)')} AS clicks,
                   {big('coalesce(l, 0)')} AS leads, {big('coalesce(k, 0)')} AS cost_cents,
                   {big('coalesce(b, 0)')} AS bookings, {big('coalesce(r, 0)')} AS revenue_cents,
                   {div('coalesce(b, 0)', 'coalesce(l, 0)')} AS rate
            FROM ({spine}) LEFT JOIN ad_sum USING ({using}) LEFT JOIN sale_sum USING ({using})""",
    }


def _segments(by: str) -> str:
    part = "PARTITION BY year" if by else ""
    year = "cast(year AS BIGINT) AS year, " if by else ""
    return statement(
        f"""
        SELECT hotel_id, {year}country, region, hotel_category, impressions AS total_impressions,
               clicks AS total_clicks, leads AS total_leads, {eur('cost_cents')} AS total_cost,
               bookings AS total_bookings, {eur('revenue_cents')} AS total_revenue,
               {rnd('rate', 4)} AS conversion_rate, revenue_q, leads_q, conversion_q,
               revenue_q + leads_q + conversion_q AS performance_score,
               CASE WHEN revenue_q + leads_q + conversion_q IS NULL THEN '5 Gap'
                    WHEN revenue_q + leads_q + conversion_q >= 10 THEN '1 Top Performer'
                    WHEN revenue_q + leads_q + conversion_q >= 8 THEN '2 High Performer'
                    WHEN revenue_q + leads_q + conversion_q >= 6 THEN '3 Potential / Optimize'
                    ELSE '4 Weak Performer' END AS segment_category
        FROM tiled LEFT JOIN dim USING (hotel_id)""",
        **_totals(by),
        tiled=f"""
            SELECT *, ntile(4) OVER ({part} ORDER BY revenue_cents, hotel_id) AS revenue_q,
                   ntile(4) OVER ({part} ORDER BY leads, hotel_id) AS leads_q,
                   ntile(4) OVER ({part} ORDER BY rate, hotel_id) AS conversion_q
            FROM totals WHERE leads > 0
            UNION ALL
            SELECT *, NULL, NULL, NULL FROM totals WHERE leads = 0""",
    )


S["segments_total"] = _segments("")
S["segments_by_year"] = _segments("year, ")
S["totals_by_entity"] = statement(
    f"""
    SELECT hotel_id, impressions, clicks, leads, {eur('cost_cents')} AS cost, bookings,
           {eur('revenue_cents')} AS revenue FROM totals""",
    **_totals(""),
)
S["ntile_global"] = """
    SELECT o_orderkey, ntile(100) OVER (ORDER BY o_totalprice, o_orderkey) AS price_tile,
           ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS age_tile
    FROM orders"""

# ---------------------------------------------------------------- series


def _series(step: str, label: str, year: str, steps: str) -> str:
    def side(table: str) -> str:
        return f"SELECT {year} AS y, {step} AS p, * FROM {table} WHERE {year} IN ({Y0}, {Y1})"

    def column(alias: str, what: str, y: int, name: str) -> str:
        total = f"coalesce((SELECT sum({what}) FROM {alias} x WHERE x.p = steps.p AND x.y = {y}), 0)"
        return f"{big(total) if name == 'leads' else eur(total)} AS {name}_{y}"

    columns = [
        column(table, what, y, name)
        for table, what, name in (("ad", "cents", "cost"), ("ad", "leads", "leads"), ("sale", "cents", "revenue"))
        for y in (Y0, Y1)
    ]
    return statement(
        f"SELECT p::BIGINT AS {label}, {', '.join(columns)} FROM steps", ad=side("ads"), sale=side("sales"), steps=steps
    )


S["series_monthly"] = _series("month(day)", "month", "year(day)", "SELECT unnest(range(1, 13)) AS p")
S["series_weekly"] = _series("weekofyear(day)", "week", "isoyear(day)", "SELECT p FROM ad UNION SELECT p FROM sale")
S["series_monthly_named"] = (
    f"SELECT *, strftime(make_date(2000, month::INT, 1), '%B') AS month_name FROM ({S['series_monthly']})"
)

# ---------------------------------------------------------------- anomalies

KPIS = ("ctr", "cpc", "lr", "cpl", "roas", "aov")
LOW_IS_BAD = ("ctr", "lr", "roas", "aov")
CAUSES = [
    ("z_roas <= -2 AND z_cpl >= 2", "ROAS drop, high CPL", "Efficiency Collapse"),
    ("z_ctr <= -2 AND z_cpc >= 2", "low CTR, high CPC", "Ad Crisis"),
    ("z_roas <= -2", "poor ROAS", "Unprofitable campaigns"),
    ("z_aov <= -2", "AOV drop", "Very low revenue per booking (customer value sinking)"),
    ("z_cpl >= 2", "high CPL", "Expensive customer acquisition"),
    ("z_cpc >= 2", "high CPC", "High CPC"),
    ("z_ctr <= -2", "low CTR", "Interest Drop"),
    ("z_lr <= -2", "low lead rate", "Lead Conversion Crisis"),
    ("true", "Anomalous combination in performance metrics", "Anomalous Combination in Performance Metrics"),
]


def _zscores(by: str) -> dict[str, str]:
    rates = {
        "ctr": div("clicks", "impressions"),
        "cpc": div(eur("k"), "clicks"),
        "lr": div("leads", "clicks"),
        "cpl": div(eur("k"), "leads"),
        "roas": div(eur("r"), eur("k")),
        "aov": div(eur("r"), "bookings"),
    }
    badness = " + ".join(f"greatest(0, {'-' if k in LOW_IS_BAD else ''}z_{k})" for k in KPIS)
    return {
        "rated": f"""
            SELECT *, year(month)::BIGINT AS year, {', '.join(f'{v} AS {k}' for k, v in rates.items())}
            FROM (SELECT a.hotel_id, a.month, impressions, clicks, leads, a.cents AS k,
                         coalesce(bookings, 0) AS bookings, coalesce(s.cents, 0) AS r
                  FROM ad_month a LEFT JOIN sale_month s ON s.hotel_id = a.hotel_id AND s.month = a.month)
            WHERE least(impressions, clicks, leads, k) > 0""",
        "standard": f"""
            SELECT *, {', '.join(
                f"{rnd(div(f'{k} - avg({k}) OVER h', f'stddev_samp({k}) OVER h'), 2)} AS z_{k}" for k in KPIS)}
            FROM rated
            WINDOW h AS (PARTITION BY hotel_id{by} ORDER BY month
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        "odd": f"""
            SELECT *, {rnd(badness, 2)} AS anomaly_score,
                   CASE {' '.join(f"WHEN {test} THEN '{label}'" for test, label, _ in CAUSES)} END AS anomaly,
                   CASE {' '.join(f"WHEN {test} THEN '{reason}'" for test, _, reason in CAUSES)} END AS reason
            FROM standard
            WHERE least(z_ctr, z_lr, z_roas, z_aov) <= -2 OR greatest(z_cpc, z_cpl) >= 2
               OR (z_roas <= -1.5 AND z_cpl >= 1.5)""",
    }


_ANOMALY_COLUMNS = f"""
    hotel_id, country, region, hotel_category, month, leads, {rnd(eur('k'), 2)} AS cost, bookings,
    {rnd(eur('r'), 2)} AS revenue, {rnd('ctr', 4)} AS ctr, {rnd('cpc', 2)} AS cpc, {rnd('lr', 4)} AS lr,
    {rnd('cpl', 2)} AS cpl, {rnd('roas', 2)} AS roas, {rnd('aov', 2)} AS aov,
    z_ctr, z_cpc, z_lr, z_cpl, z_roas, z_aov, anomaly_score, anomaly, reason"""

S["anomalies_total"] = statement(
    f"SELECT anomaly_rank, {_ANOMALY_COLUMNS} FROM numbered LEFT JOIN dim USING (hotel_id) WHERE anomaly_rank <= 15",
    **_zscores(""),
    numbered="SELECT *, row_number() OVER (ORDER BY anomaly_score DESC, month, hotel_id) AS anomaly_rank FROM odd",
)
S["anomalies_by_year"] = statement(
    f"SELECT year, {_ANOMALY_COLUMNS} FROM numbered LEFT JOIN dim USING (hotel_id)",
    **_zscores(", year"),
    numbered="""
        SELECT * FROM odd
        QUALIFY row_number() OVER (PARTITION BY year ORDER BY anomaly_score DESC, month, hotel_id) <= 15""",
)
_Z = "SELECT hotel_id, month, z_ctr, z_cpc, z_lr, z_cpl, z_roas, z_aov FROM standard"
S["kpi_zscores"] = statement(_Z, **_zscores(""))
S["kpi_zscores_by_year"] = statement(_Z, **_zscores(", year"))

# ---------------------------------------------------------------- volatility


def _spread(by: str) -> dict[str, str]:
    return {
        "spread": f"""
            SELECT hotel_id{by}, count(*) AS months, {big('sum(leads)')} AS total_leads,
                   {rnd('avg(leads)', 2)} AS avg_monthly_leads, {rnd('stddev_samp(leads)', 2)} AS sd_monthly_leads,
                   {rnd(div('stddev_samp(leads)', 'avg(leads)'), 4)} AS cv_leads,
                   min(leads) AS min_monthly_leads, max(leads) AS max_monthly_leads,
                   max(leads) - min(leads) AS range_leads,
                   list({{'m': month, 'l': leads, 'k': cents}} ORDER BY leads, month)[1] AS low,
                   list({{'m': month, 'l': leads, 'k': cents}} ORDER BY leads DESC, month)[1] AS high
            FROM (SELECT *, year(month)::BIGINT AS year FROM ad_month) GROUP BY hotel_id{by}""",
    }


_SPREAD_COLUMNS = f"""
    months, total_leads, avg_monthly_leads, sd_monthly_leads, cv_leads, min_monthly_leads, max_monthly_leads,
    range_leads, low.m AS min_month, low.l AS min_leads, {eur('low.k')} AS cost_at_min,
    high.m AS max_month, high.l AS max_leads, {eur('high.k')} AS cost_at_max"""
_DIMS = "hotel_id, country, region, hotel_category"
S["volatility_total"] = statement(
    f"SELECT volatility_rank, {_DIMS}, {_SPREAD_COLUMNS} FROM topped LEFT JOIN dim USING (hotel_id)",
    **_spread(""),
    topped="""
        SELECT *, row_number() OVER (ORDER BY cv_leads DESC, sd_monthly_leads DESC, hotel_id) AS volatility_rank
        FROM spread QUALIFY volatility_rank <= 5""",
)
S["volatility_by_year"] = statement(
    f"SELECT volatility_rank, {_DIMS}, year, {_SPREAD_COLUMNS} FROM topped LEFT JOIN dim USING (hotel_id)",
    **_spread(", year"),
    topped="""
        SELECT *, row_number() OVER (PARTITION BY year
                                     ORDER BY cv_leads DESC, sd_monthly_leads DESC, hotel_id) AS volatility_rank
        FROM spread QUALIFY volatility_rank <= 5""",
)
S["lead_spread"] = statement(
    f"SELECT hotel_id, year, {_SPREAD_COLUMNS} FROM spread", **_spread(", year")
)

# ---------------------------------------------------------------- comparisons


def _year_of(table: str, y: int, what: str, where: str) -> str:
    return f"(SELECT {what} FROM {table} WHERE year(day) = {y}{where})"


def _pairs(value: dict[str, tuple[str, str, int | None]]) -> str:
    out = []
    for name, (old, new, digits) in value.items():
        for y, x in ((Y0, old), (Y1, new)):
            out.append(f"{x if digits is None else rnd(x, digits)} AS {name}_{y}")
        out.append(f"{pct(new, old)} AS {name}_change_pct")
    return ", ".join(out)


def _compared(ratio_name: str) -> str:
    return _pairs(
        {
            "cost": (eur("k0"), eur("k1"), 2),
            "leads": ("l0", "l1", None),
            "cost_per_lead": (div(eur("k0"), "l0"), div(eur("k1"), "l1"), 2),
            "bookings": ("b0", "b1", None),
            "revenue": (eur("r0"), eur("r1"), 2),
            "roas": (div(eur("r0"), eur("k0")), div(eur("r1"), eur("k1")), 2),
            ratio_name: (div("b0", "l0"), div("b1", "l1"), 4),
        }
    )


_YEAR_FIGURES = ", ".join(
    f"""{big(_year_of('ads', y, 'sum(cents)', ''))} AS k{n}, {big(_year_of('ads', y, 'sum(leads)', ''))} AS l{n},
        {_year_of('sales', y, 'count(DISTINCT booking_id)', '')} AS b{n},
        {big(f"coalesce({_year_of('sales', y, 'sum(cents)', '')}, 0)")} AS r{n}"""
    for n, y in enumerate((Y0, Y1))
)
S["executive_summary"] = statement(
    f"SELECT {_compared('bookings_per_lead')} FROM figures", figures=f"SELECT {_YEAR_FIGURES}"
)


def _entity_years(where: str) -> str:
    def pick(name: str, n: int, y: int) -> str:
        return f"max({name}) FILTER (WHERE y = {y}) AS {name}{n}"

    picks = ", ".join(pick(name, n, y) for name in "klbr" for n, y in enumerate((Y0, Y1)))
    return statement(
        f"SELECT hotel_id, region, country, {_compared('conversion_rate')} FROM wide LEFT JOIN dim USING (hotel_id)",
        merged=f"""
            SELECT hotel_id, y, {big('coalesce(k, 0)')} AS k, {big('coalesce(l, 0)')} AS l,
                   coalesce(b, 0) AS b, {big('coalesce(r, 0)')} AS r
            FROM (SELECT hotel_id, year(day) AS y, sum(cents) AS k, sum(leads) AS l
                  FROM ads WHERE year(day) IN ({Y0}, {Y1}){where} GROUP BY ALL)
            FULL JOIN (SELECT hotel_id, year(day) AS y, count(DISTINCT booking_id) AS b, sum(cents) AS r
                       FROM sales WHERE year(day) IN ({Y0}, {Y1}){where} GROUP BY ALL) USING (hotel_id, y)""",
        wide=f"SELECT hotel_id, {picks} FROM merged GROUP BY hotel_id",
    )


S["entity_year_comparison"] = _entity_years(f" AND hotel_id = '{ENTITY}'")
S["entity_year_comparison_all"] = _entity_years("")

_FIGURES = {
    "impressions": "impressions",
    "clicks": "clicks",
    "leads": "leads",
    "cost": eur("k"),
    "ctr_pct": div("clicks", "impressions"),
    "cpc": div(eur("k"), "clicks"),
    "lead_rate_pct": div("leads", "clicks"),
    "cost_per_lead": div(eur("k"), "leads"),
    "bookings": "bookings",
    "revenue": eur("r"),
    "roas": div(eur("r"), eur("k")),
    "conversion_rate": div("bookings", "leads"),
}


def _shown(name: str) -> str:
    value = _FIGURES[name]
    if name == "roas":
        value = div(f"coalesce({eur('r')}, 0)", eur("k"))
    if name == "conversion_rate":
        return f"{rnd(div('coalesce(bookings, 0)', 'leads'), 4)} AS {name}"
    if name.endswith("_pct"):
        return f"{rnd(f'{value} * 100', 2)} AS {name}"
    return f"{rnd(f'({value})::DOUBLE', 2)} AS {name}"


S["entity_period_kpis"] = statement(
    f"""
    SELECT hotel_id, region, country, strftime(month, '%B %Y') AS zeitraum,
           {', '.join(_shown(name) for name in _FIGURES)}, 1::BIGINT AS sort_order
    FROM slice LEFT JOIN dim USING (hotel_id)
    UNION ALL BY NAME
    SELECT hotel_id, region, country, 'CHANGE (June vs August %)' AS zeitraum,
           {', '.join(f"{pct(f'n.{name}', f'o.{name}')} AS {name}" for name in _FIGURES)}, 2::BIGINT AS sort_order
    FROM (SELECT DISTINCT hotel_id FROM slice)
    LEFT JOIN valued o ON o.month = DATE '2000-06-01'
    LEFT JOIN valued n ON n.month = DATE '2000-08-01'
    LEFT JOIN dim USING (hotel_id)""",
    slice=f"""
        SELECT a.hotel_id, a.month, impressions, clicks, leads, a.cents AS k, bookings, s.cents AS r
        FROM ad_month a LEFT JOIN sale_month s ON s.hotel_id = a.hotel_id AND s.month = a.month
        WHERE a.hotel_id = '{ENTITY}' AND a.month >= DATE '2000-06-01' AND a.month < DATE '2000-09-01'""",
    valued=f"SELECT month, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _FIGURES.items())} FROM slice",
)
S["filter_result"] = f"""
    SELECT * FROM ({S['segments_by_year']}) WHERE year = 2000
    ORDER BY segment_category, performance_score DESC, total_revenue DESC, hotel_id"""

# ---------------------------------------------------------------- cleaning and checks

_TITLE = """array_to_string(list_transform(regexp_extract_all(trim({}, chr(9) || ' '), '[A-Za-z]+|[^A-Za-z]+'),
            lambda w: upper(w[1]) || lower(w[2:])), '')"""
DIRTY = {
    "untidy": """
        SELECT campaign_id,
               CASE WHEN okey % 103 = 0 THEN NULL WHEN okey % 101 = 0 THEN 'X' || hotel_id ELSE hotel_id END AS hotel_id,
               CASE WHEN okey % 97 <> 0 THEN day END AS date,
               CASE WHEN line = 1 THEN chr(9) || ' city-trip ' ELSE campaign_type END AS campaign_type,
               impressions, clicks AS c0, leads AS l0, okey,
               CASE WHEN okey % 59 = 0 THEN impressions + 1 ELSE clicks END AS clicks,
               CASE WHEN okey % 53 = 0 THEN -cents ELSE cents END AS cents
        FROM ads""",
    "dirty": f"""
        SELECT campaign_id, hotel_id, date, {_TITLE.format('campaign_type')} AS campaign_type, impressions, clicks,
               CASE WHEN okey % 61 = 0 THEN clicks + 1 ELSE l0 END AS leads, cents
        FROM untidy""",
    "floored": """
        SELECT *, greatest(clicks, 0) AS fc, greatest(leads, 0) AS fl, greatest(cents, 0) AS fk FROM dirty""",
    "judged": """
        SELECT *, CASE WHEN fc <= impressions THEN fc END AS vc FROM floored""",
    "repaired": """
        SELECT *, CASE WHEN vc IS NULL OR fl <= vc THEN fl END AS vl FROM judged""",
}
S["clean_tables"] = statement(
    f"SELECT campaign_id, hotel_id, date, campaign_type, impressions, clicks, leads, {eur('cents')} AS cost FROM dirty",
    **DIRTY,
)
S["clean_bookings"] = statement(
    f"""
    SELECT booking_id, hotel_id, day AS booking_date, {_TITLE.format('travel_type')} AS travel_type,
           {eur('cents')} AS revenue FROM sales"""
)
FAULTY = {
    "keyed": "SELECT *, booking_id::BIGINT AS k FROM sales",
    "faulty": f"""
        SELECT booking_id,
               CASE WHEN k % 89 = 0 THEN NULL WHEN k % 83 = 0 THEN 'X' || hotel_id ELSE hotel_id END AS hotel_id,
               CASE WHEN k % 79 <> 0 THEN day END AS booking_date,
               {_TITLE.format("if(k % 2 = 0, lower(travel_type), travel_type)")} AS travel_type,
               CASE WHEN k % 47 = 0 THEN -cents ELSE cents END AS cents
        FROM keyed""",
}
S["repair_bookings"] = statement(
    f"SELECT booking_id, hotel_id, booking_date, travel_type, {eur('greatest(cents, 0)')} AS revenue FROM faulty", **FAULTY
)
S["orphan_bookings"] = statement(
    """
    SELECT booking_id, hotel_id, booking_date, travel_type
    FROM faulty WHERE NOT EXISTS (SELECT 1 FROM dim WHERE dim.hotel_id = faulty.hotel_id)""",
    **FAULTY,
)
S["clean_entities"] = statement("SELECT hotel_id, country, region, hotel_category FROM dim")
S["repair_tables"] = statement(
    f"""
    SELECT campaign_id, hotel_id, date, campaign_type, impressions, vc AS clicks, vl AS leads, {eur('fk')} AS cost
    FROM repaired""",
    **DIRTY,
)


def _count(check: str, table: str, column: str, source: str, test: str) -> str:
    return (
        f"SELECT '{check}' AS \"check\", '{table}' AS \"table\", '{column}' AS \"column\", "
        f"(count(*) FILTER (WHERE {test}))::BIGINT AS n FROM {source}"
    )


AD_TABLE, SALE_TABLE, DIM_TABLE = "campaign_performance", "booking_data", "hotel_information"
_AD_COLUMNS = {
    "campaign_id": "campaign_id",
    "hotel_id": "hotel_id",
    "date": "date",
    "campaign_type": "campaign_type",
    "impressions": "impressions",
    "clicks": "clicks",
    "leads": "leads",
    "cost": "cents",
}
_SALE_COLUMNS = {
    "booking_id": "booking_id",
    "hotel_id": "hotel_id",
    "booking_date": "day",
    "travel_type": "travel_type",
    "revenue": "cents",
}
_DIM_COLUMNS = {c: c for c in ("hotel_id", "country", "region", "hotel_category")}
_TABLES = (
    (AD_TABLE, "dirty", _AD_COLUMNS),
    (SALE_TABLE, "sales", _SALE_COLUMNS),
    (DIM_TABLE, "dim", _DIM_COLUMNS),
)
_MISSING = " UNION ALL ".join(
    f"SELECT * FROM ({_count('missing', table, column, source, f'{x} IS NULL')}) WHERE n > 0"
    for table, source, columns in _TABLES
    for column, x in columns.items()
)
_NONPOSITIVE = " UNION ALL ".join(
    _count("nonpositive", table, column, source, f"{x} <= 0")
    for table, source, column, x in (
        (AD_TABLE, "dirty", "cost", "cents"),
        (AD_TABLE, "dirty", "clicks", "clicks"),
        (AD_TABLE, "dirty", "leads", "leads"),
        (SALE_TABLE, "sales", "revenue", "cents"),
    )
)
_PLAUSIBLE = " UNION ALL ".join(
    (
        _count("invalid", AD_TABLE, "clicks", "floored", "fc > impressions"),
        _count("invalid", AD_TABLE, "leads", "judged", "fl > vc"),
    )
)
_DUPLICATE = (
    f"SELECT 'duplicate' AS \"check\", '{SALE_TABLE}' AS \"table\", 'booking_id' AS \"column\", "
    "(SELECT count(*) - count(DISTINCT booking_id) FROM sales)::BIGINT AS n"
)
_ORPHANS = " UNION ALL ".join(
    _count(
        "orphan", table, "hotel_id", source, "hotel_id IS NULL OR hotel_id NOT IN (SELECT hotel_id FROM dim)"
    )
    for table, source in ((AD_TABLE, "dirty"), (SALE_TABLE, "sales"))
)
S["quality_missing"] = statement(_MISSING, **DIRTY)
S["quality_nonpositive"] = statement(_NONPOSITIVE, **DIRTY)
S["quality_plausibility"] = statement(_PLAUSIBLE, **DIRTY)
S["quality_duplicates"] = statement(_DUPLICATE, **DIRTY)
S["quality_orphans"] = statement(_ORPHANS, **DIRTY)
S["quality_report"] = statement(
    " UNION ALL ".join((_MISSING, _NONPOSITIVE, _PLAUSIBLE, _DUPLICATE, _ORPHANS)), **DIRTY
)
S["orphan_rows"] = statement(
    """
    SELECT campaign_id, hotel_id, date, campaign_type, impressions, clicks, leads
    FROM dirty WHERE NOT EXISTS (SELECT 1 FROM dim WHERE dim.hotel_id = dirty.hotel_id)""",
    **DIRTY,
)
_TYPES = {"date": "date", "booking_date": "date", "cost": "decimal(18,2)", "revenue": "decimal(18,2)"}
_TYPES |= {c: "bigint" for c in ("impressions", "clicks", "leads")}
S["table_summary"] = statement(
    " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", '{_TYPES.get(column, 'string')}' AS type, "
        f"count(*) AS \"rows\", count({x}) AS non_null FROM {source}"
        for table, source, columns in _TABLES
        for column, x in columns.items()
    ),
    **DIRTY,
)

# ---------------------------------------------------------------- questions

# The keyword rules of the question log, first match first.
_ABOUT = rf"regexp_matches(q, '\bhotel\s*{ENTITY}\b|\bhotel_id\s*{ENTITY}\b')"


def _any(*words: str) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


_BY_YEAR = _any("jahr", "year")
# Keywords and labels in order of precedence.
_INTENTS = [
    (f"q = '' OR {_any('hilfe', 'help', 'was kannst', 'beispiele')}", "help"),
    (f"{_ABOUT} AND {_any('jun', 'aug', 'kritische phase')}", "entity_period_kpis"),
    (_ABOUT, "entity_year_comparison"),
    (
        _any("executive summary", "management summary", "gesamtvergleich", "2024 vs", "2025 vs"),
        "executive_summary",
    ),
    (_any("hypothese", "gruende", "warum"), "topic_hypotheses"),
    (_any("zusaetzliche daten", "welche daten", "must have", "nice to have"), "topic_data"),
    (_any("budget", "erhoehen"), "topic_budget"),
    (_any("woechentlich", "weekly", "woche"), "series_weekly"),
    (f"{_any('zeitreihe', 'time series', 'zeitverlauf')} AND {_any('kw', 'kalenderwoche')}", "series_weekly"),
    (_any("zeitreihe", "time series", "zeitverlauf"), "series_monthly"),
    (_any("monatlich", "monthly", "ctr", "cpc", "conversion rate", "performance pro hotel"), "monthly_kpis"),
    (
        f"{_any('steigende kosten', 'sinkende leads', 'auffaellig', 'rising', 'sinking')} AND "
        f"{_any('konsekutiv', 'streng', '3 monate am stueck', 'drei monate am stueck')}",
        "rising_cost_falling_leads_strict",
    ),
    (
        _any("steigende kosten", "sinkende leads", "auffaellig", "rising", "sinking"),
        "rising_cost_falling_leads_loose",
    ),
    (f"{_any('moving average', 'gleitender durchschnitt', 'trend')} AND {_any('top')}", "longest_trend_runs"),
    (_any("moving average", "gleitender durchschnitt", "trend"), "moving_average_trends"),
    (f"{_any('segment')} AND {_BY_YEAR}", "segments_by_year"),
    (_any("segment"), "segments_total"),
    (f"{_any('anomalie', 'anomaly', 'ausreisser')} AND {_BY_YEAR}", "anomalies_by_year"),
    (_any("anomalie", "anomaly", "ausreisser"), "anomalies_total"),
    (f"{_any('volatil', 'schwankung')} AND {_BY_YEAR}", "volatility_by_year"),
    (_any("volatil", "schwankung"), "volatility_total"),
    (_any("handlungsempfehlung", "empfehlung", "summary"), "executive_summary"),
]
_ASKED = {
    "asked": r"""
        SELECT conv_id, turn, replace(replace(replace(replace(
                   regexp_replace(lower(text), '^\s+|\s+$', '', 'g'),
                   'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS q
        FROM conversations WHERE role = 'user'""",
}
_INTENT = f"""CASE {' '.join(f"WHEN {test} THEN '{intent}'" for test, intent in _INTENTS)} ELSE 'unmatched' END"""
S["question_tags"] = statement(f"SELECT conv_id, turn, {_INTENT} AS intent FROM asked", **_ASKED)
S["question_intents"] = statement(
    f"""
    SELECT {_INTENT} AS intent,
           count(*) AS n
    FROM asked GROUP BY 1""",
    **_ASKED,
)
S["question_slots"] = statement(
    rf"""
    SELECT conv_id, turn,
           try_cast(nullif(regexp_extract(q, 'top\s*(\d+)', 1), '') AS BIGINT) AS top_n,
           try_cast(nullif(regexp_extract(q, '\b(20\d{{2}})\b', 1), '') AS BIGINT) AS year,
           nullif(regexp_extract(q, '\bhotel(?:_id)?\s*[:#-]?\s*(\d+)\b', 1), '') AS entity_id,
           {_any('top')} AS top_view, {_BY_YEAR} AS year_view,
           {_any('woechentlich', 'weekly', 'woche', 'kw')} AS week_view,
           {_any('konsekutiv', 'streng', '3 monate am stueck', 'drei monate am stueck')} AS strict_view
    FROM asked""",
    **_ASKED,
)

# ---------------------------------------------------------------- stored tables and rollups

S["stored_round_trip"] = statement(
    f"""
    SELECT 'spend' AS "table", hotel_id, campaign_id AS id, day, campaign_type AS kind, leads, {eur('cents')} AS amount
    FROM ads
    UNION ALL SELECT 'conversions', hotel_id, booking_id, day, travel_type, NULL, {eur('cents')} FROM sales
    UNION ALL SELECT 'entities', hotel_id, country, NULL, hotel_category, NULL, NULL FROM dim"""
)


def _counted(name: str, entity: str, period: str, bookings: str, revenue: str, label: str) -> str:
    return f"""SELECT '{name}' AS analysis, {entity} AS hotel_id, ({period})::VARCHAR AS period,
        {bookings} AS bookings, {revenue} AS revenue, {label} AS label FROM ({S[name]})"""


S["catalogue_from_rollups"] = " UNION ALL ".join(
    [
        _counted("segments_total", "hotel_id", "'all'", "total_bookings", "total_revenue", "segment_category"),
        _counted("segments_by_year", "hotel_id", "year", "total_bookings", "total_revenue", "segment_category"),
        _counted("anomalies_total", "hotel_id", "month", "bookings", "revenue", "anomaly"),
        _counted("anomalies_by_year", "hotel_id", "month", "bookings", "revenue", "anomaly"),
        *[_counted("executive_summary", "NULL", str(y), f"bookings_{y}", f"revenue_{y}", "NULL") for y in (Y0, Y1)],
        *[_counted("entity_year_comparison", "hotel_id", str(y), f"bookings_{y}", f"revenue_{y}", "NULL") for y in (Y0, Y1)],
    ]
)

S["catalogue_side_by_side"] = S["catalogue_from_rollups"]

S["colocated_rollup"] = statement(
    f"""
    SELECT hotel_id, month, impressions, clicks, leads, {eur('a.cents')} AS cost,
           {eur('s.cents')} AS revenue, coalesce(bookings, 0) AS bookings
    FROM ad_month a FULL JOIN sale_month s USING (hotel_id, month)"""
)

S["replaced_months"] = statement(
    f"""
    SELECT booking_id, hotel_id, day AS booking_date, travel_type,
           {eur('if(month(day) <= 3, cents, 0)')} AS revenue FROM sales"""
)

# ---------------------------------------------------------------- broken lines and date formats

NUMBERED = {"numbered": "SELECT *, booking_id::BIGINT AS k FROM sales"}
S["csv_accepted_lines"] = statement(
    f"""
    SELECT booking_id, hotel_id, day AS booking_date, {_TITLE.format('travel_type')} AS travel_type,
           {eur('cents')} AS revenue FROM numbered WHERE k % 71 <> 0 AND k % 73 <> 0""",
    **NUMBERED,
)
S["csv_rejected_lines"] = statement(
    """
    SELECT booking_id || ',' || hotel_id || if(k % 71 = 0, ',' || strftime(day, '%Y-%m-%d') || ',' || travel_type
           || ',' || (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || ',x', '') AS line
    FROM numbered WHERE k % 71 = 0 OR k % 73 = 0""",
    **NUMBERED,
)
_PATTERNS = {
    "dd.MM.yyyy": "%d.%m.%Y",
    "MM/dd/yyyy": "%m/%d/%Y",
    "dd/MM/yyyy": "%d/%m/%Y",
    "dd-MM-yyyy": "%d-%m-%Y",
    "yyyy/MM/dd": "%Y/%m/%d",
    "yyyyMMdd": "%Y%m%d",
}
DATED = {
    **NUMBERED,
    "dated": """
        SELECT *, CASE WHEN k % 79 = 0 THEN 'soon' ELSE strftime(day, '%d/%m/%Y') END AS written
        FROM numbered WHERE k % 79 = 0 OR k % 10 <> 0""",
    "tried": " UNION ALL ".join(
        f"SELECT '{name}' AS format, {i} AS place, count(try_strptime(written, '{pattern}')) AS parsed, count(*) AS others FROM dated"
        for i, (name, pattern) in enumerate(_PATTERNS.items())
    ),
}
# Whoever reads the days beyond the twelfth as well reads more than the month-first format: nothing is ambiguous.
S["date_format_counts"] = statement(
    """
    SELECT 'booking_date' AS "column", format, parsed, others, false AS ambiguous,
           parsed > 0 AND row_number() OVER (ORDER BY parsed DESC, place) = 1 AS chosen
    FROM tried""",
    **DATED,
)
S["bookings_in_column_format"] = statement(
    f"""
    SELECT booking_id, hotel_id, CASE WHEN k % 79 <> 0 THEN day END AS booking_date,
           {_TITLE.format('travel_type')} AS travel_type, {eur('cents')} AS revenue FROM numbered""",
    **NUMBERED,
)

STATEMENTS: dict[str, str] = S
