"""SQL with the same result as each registered query, for a check on another engine.

Doubles are rounded in decimal on both sides; money is summed in whole
accounting units. Of models and file times the SQL checks what does not depend on them.
"""

from __future__ import annotations

RECENT = "DATE '1999-11-01'"
AS_OF = "DATE '2001-11-05'"
ORACLE: dict[str, str] = {}
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (body, needs)


def _add(name: str, body: str, *needs: str) -> None:
    """Registers a statement, with the named subqueries it needs in front."""
    ordered: list[str] = []

    def visit(cte: str) -> None:
        for need in _CTES[cte][1]:
            visit(need)
        if cte not in ordered:
            ordered.append(cte)

    for need in needs:
        visit(need)
    head = ",\n".join(f"{c} AS ({_CTES[c][0]})" for c in ordered)
    ORACLE[name] = (f"WITH {head}\n" if head else "") + body


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def whole(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def rd(x: str, n: int) -> str:
    """Half-up rounding of a double in decimal."""
    return f"CAST(round(CAST(({x}) AS DECIMAL(38,{n + 6})), {n}) AS DOUBLE)"


def units(a: str) -> str:
    return f"SUM(CAST(round_even(({a}) * 10000, 0) AS BIGINT))"


def money(a: str = "Amount") -> str:
    return f"(CAST({units(a)} AS DOUBLE) / 10000.0)"


def money_mean(a: str = "Amount") -> str:
    return f"(CAST({units(a)} AS DOUBLE) / (CAST(COUNT({a}) AS DOUBLE) * 10000))"


def money_rd(a: str = "Amount", n: int = 2) -> str:
    exact = f"CAST({units(a)} AS DECIMAL(34,0)) * CAST(0.0001 AS DECIMAL(4,4))"
    return f"CAST(round({exact}, {n}) AS DOUBLE)"


def mean(q: str = "Quantity") -> str:
    return f"(CAST(SUM({q}) AS DOUBLE) / CAST(COUNT({q}) AS DOUBLE))"


def trunc(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


def total(q: str = "Quantity") -> str:
    return f"CAST(SUM({q}) AS BIGINT)"


def week(d: str) -> str:
    return f"strftime({d}, '%Y-W%U')"


MONTH = "strftime(\"Date\", '%Y-%m')"
WEEKDAY = "CAST((isodow(\"Date\") - 1) AS INTEGER)"
YEAR = "CAST(year(\"Date\") AS INTEGER)"
MON = "CAST(month(\"Date\") AS INTEGER)"


def _day_names(k: str) -> str:
    return (f"list_extract(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday',"
            f"'Sunday'], {k} + 1)")


def _month_names(k: str) -> str:
    return (f"list_extract(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov',"
            f"'Dec'], {k})")


# -- logical tables -------------------------------------------------------------------

_cte("lines", """
SELECT CAST(l_shipdate AS DATE) AS "Date", p_brand || '/' || p_type AS SKU,
       CAST(l_partkey AS VARCHAR) AS Part, CAST(l_quantity AS BIGINT) AS Quantity,
       l_extendedprice * (1 - l_discount) AS Amount, l_extendedprice / l_quantity AS Rate,
       l_linestatus AS Partyname, s_name AS Godown, nf.n_name AS Statefrom,
       nt.n_name AS Stateto, CAST(l_orderkey AS VARCHAR) AS Orderid, l_returnflag AS Flag
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation nf ON s_nationkey = nf.n_nationkey
LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation nt ON c_nationkey = nt.n_nationkey""")
_cte("sales", "SELECT * FROM lines", "lines")
_cte("returned", "SELECT * REPLACE (-Quantity AS Quantity, -Amount AS Amount) FROM lines "
                 "WHERE Flag = 'R'", "lines")
_cte("recent", f'SELECT * FROM lines WHERE "Date" >= {RECENT}', "lines")
_cte("history", f'SELECT * FROM lines WHERE "Date" < {RECENT}', "lines")
_PART = "SELECT * REPLACE (Part AS SKU) FROM "
_cte("p_sales", _PART + "sales", "sales")
_cte("p_returned", _PART + "returned", "returned")
_cte("p_recent", _PART + "recent", "recent")
_cte("p_history", _PART + "history", "history")
_cte("sku_master", "SELECT p_brand || '/' || p_type AS sku, arg_max(p_name, p_partkey) AS "
                   "category FROM part GROUP BY 1")
_cte("moq_terms", """
SELECT p_brand || '/' || p_type AS sku,
       CAST((SUM(p_size) % 50 + 1) * 10 AS BIGINT) AS moq,
       CAST(SUM(p_size) % 14 + 3 AS INTEGER) AS lead_time_days,
       MIN(p_name) AS supplier, CAST(100 AS DOUBLE) AS unit_cost
FROM part WHERE p_type <> 'PROMO' GROUP BY 1""")


def _daily(src: str) -> str:
    return (f'SELECT SKU, "Date", {total()} AS Quantity, {money()} AS Amount, '
            f'COUNT(*) AS Rows, COUNT(Quantity) AS Counted FROM {src} '
            f'WHERE SKU IS NOT NULL GROUP BY 1, 2')


_cte("daily", _daily("recent"), "recent")
_cte("daily_all", _daily("sales"), "sales")
_cte("p_daily", _daily("p_recent"), "p_recent")
_cte("p_daily_all", _daily("p_sales"), "p_sales")


def _profile(daily: str) -> str:
    return f"""
SELECT *, COALESCE(CASE WHEN row_mean > 0 THEN season_mean / row_mean END, 1.0)
         AS seasonal_multiplier,
       CASE WHEN sale_days >= 60 AND previous_mean > 0
            THEN (recent_mean - previous_mean) / previous_mean ELSE CAST(0 AS DOUBLE) END
         AS growth_rate
FROM (SELECT SKU, {big('SUM(Rows)')} AS rows, COUNT(*) AS sale_days, MAX("Date") AS last_date,
        {mean('CASE WHEN r <= 30 THEN Quantity END')} AS recent_mean,
        CASE WHEN COUNT(*) > 30
             THEN {mean('CASE WHEN r BETWEEN 31 AND 60 THEN Quantity END')} END AS previous_mean,
        {mean()} AS daily_mean, stddev_samp(Quantity) AS daily_std,
        CASE WHEN SUM(CASE WHEN in_season THEN Counted END) > 0 THEN
          CAST(SUM(CASE WHEN in_season THEN Quantity END) AS DOUBLE)
          / CAST(SUM(CASE WHEN in_season THEN Counted END) AS DOUBLE) END AS season_mean,
        CAST(SUM(Quantity) AS DOUBLE) / CAST(SUM(Counted) AS DOUBLE) AS row_mean
      FROM (SELECT *, row_number() OVER (PARTITION BY SKU ORDER BY "Date" DESC) AS r,
              month("Date") = month(MAX("Date") OVER (PARTITION BY SKU)
                                    + INTERVAL 30 DAY) AS in_season
            FROM {daily})
      GROUP BY SKU)"""


_cte("profile", _profile("daily"), "daily")
_cte("profile_all", _profile("daily_all"), "daily_all")
_cte("p_profile", _profile("p_daily"), "p_daily")


def _scored(profile: str, history: str) -> str:
    return f"""
SELECT *, CASE WHEN confidence_score >= 80 THEN 'High' WHEN confidence_score >= 60 THEN 'Medium'
               ELSE 'Low' END AS confidence
FROM (SELECT p.*, CAST(
        CASE WHEN sale_days >= 120 THEN 30 WHEN sale_days >= 60 THEN 20 ELSE 10 END
        + CASE WHEN sale_days <= 1 THEN 0
               WHEN daily_mean > 0 AND daily_std / daily_mean < 0.5 THEN 25
               WHEN daily_mean > 0 AND daily_std / daily_mean < 1 THEN 15 ELSE 5 END
        + CASE WHEN abs(growth_rate) < 0.1::DOUBLE THEN 20
               WHEN abs(growth_rate) < 0.3::DOUBLE THEN 15
               WHEN abs(growth_rate) < 0.5 THEN 10 ELSE 5 END
        + CASE WHEN recent_mean >= 10 THEN 15 WHEN recent_mean >= 3 THEN 10 ELSE 5 END
        + CASE WHEN COALESCE(h.n, 0) > 100 THEN 10 WHEN COALESCE(h.n, 0) > 50 THEN 7 ELSE 3 END
        AS INTEGER) AS confidence_score
      FROM {profile} p LEFT JOIN (SELECT SKU, COUNT(*) AS n FROM {history} GROUP BY 1) h
        ON p.SKU = h.SKU)"""


_cte("scored", _scored("profile", "history"), "profile", "history")
_cte("p_scored", _scored("p_profile", "p_history"), "p_profile", "p_history")
_cte("pred", f"""
SELECT s.SKU, GREATEST(0, {trunc('m')}) AS predicted_monthly_quantity,
       GREATEST(CAST(0 AS DOUBLE), m / 30) AS predicted_daily_average, growth_rate,
       seasonal_multiplier, confidence, COALESCE(k.category, 'Unknown Product') AS product_name
FROM (SELECT *, recent_mean * (1 + growth_rate) * 30 * seasonal_multiplier AS m FROM scored
      WHERE rows >= 30 AND sale_days >= 30) s
LEFT JOIN sku_master k ON s.SKU = k.sku""", "scored", "sku_master")
_cte("top15", """
SELECT SKU FROM (SELECT SKU, SUM(CAST(round_even(Amount * 10000, 0) AS BIGINT)) AS m FROM recent
GROUP BY 1) ORDER BY m DESC, SKU LIMIT 15""", "recent")
_cte("pred15", "SELECT * FROM pred WHERE SKU IN (SELECT SKU FROM top15)", "pred", "top15")


def _stock(pred: str) -> str:
    cover = "('0x' || substr(md5(SKU), 1, 4))::INT % 1000 / 100.0::DOUBLE + 5"
    return f"""
SELECT sku, GREATEST(0, st) AS current_stock, {trunc('st * 0.1::DOUBLE')} AS reserved_stock,
       GREATEST(0, {trunc('st * 0.9::DOUBLE')}) AS available_stock
FROM (SELECT SKU AS sku, {trunc(f'predicted_daily_average * ({cover})')} AS st FROM {pred})"""


def _reorder(pred: str, stock: str) -> str:
    return f"""
SELECT sku, stock AS current_stock, {rd('d', 2)} AS predicted_daily_demand, reorder_point,
       safety_stock, moq, lead_time_days, {rd('days', 1)} AS days_remaining,
       stock <= reorder_point AS needs_reorder,
       CASE WHEN stock <= reorder_point
            THEN GREATEST(moq, {trunc('d * (lead_time_days + 30)')} - stock) ELSE 0 END
         AS recommended_order_qty,
       CASE WHEN days < lead_time_days THEN 'High' WHEN stock <= reorder_point THEN 'Medium'
            ELSE 'Low' END AS order_priority
FROM (SELECT *, {trunc('d * lead_time_days + safety_stock')} AS reorder_point,
        CASE WHEN d > 0 THEN stock / d ELSE CAST(999 AS DOUBLE) END AS days
      FROM (SELECT p.SKU AS sku, CAST(i.available_stock AS BIGINT) AS stock,
              p.predicted_daily_average AS d,
              CASE WHEN t.lead_time_days IS NULL
                   THEN GREATEST(20, {trunc('p.predicted_daily_average * 10')})
                   ELSE t.moq END AS moq,
              COALESCE(t.lead_time_days, 14) AS lead_time_days,
              {trunc('p.predicted_daily_average * 4')} AS safety_stock
            FROM {pred} p JOIN {stock} i ON p.SKU = i.sku
            LEFT JOIN moq_terms t ON p.SKU = t.sku))"""


def _schedule(reorder: str) -> str:
    return f"""
SELECT sku, CASE WHEN days_remaining <= lead_time_days THEN 'CRITICAL'
                 WHEN days_remaining <= lead_time_days + 3 THEN 'HIGH' ELSE 'MEDIUM' END
         AS urgency,
       CASE WHEN days_remaining <= lead_time_days THEN 'URGENT - Order Today'
            WHEN days_remaining <= lead_time_days + 3 THEN 'Order within 3 days'
            ELSE 'Order in ' || GREATEST(1, {trunc('days_remaining - lead_time_days - 2')})
                 || ' days' END AS order_date,
       recommended_order_qty AS recommended_qty, moq,
       recommended_order_qty * 100 AS estimated_cost, days_remaining,
       lead_time_days AS lead_time, current_stock, predicted_daily_demand AS daily_demand
FROM {reorder} WHERE needs_reorder"""


_cte("stock", _stock("pred"), "pred")
_cte("reorder", _reorder("pred", "stock"), "pred", "stock", "moq_terms")
_cte("schedule", _schedule("reorder"), "reorder")
_cte("stock15", _stock("pred15"), "pred15")
_cte("reorder15", _reorder("pred15", "stock15"), "pred15", "stock15", "moq_terms")
_cte("schedule15", _schedule("reorder15"), "reorder15")
_cte("months", f"""
SELECT {MONTH} AS month, {money()} AS revenue, {total()} AS quantity FROM sales GROUP BY 1""",
     "sales")
_cte("recent_growth", f"""
SELECT COUNT(*) AS months,
       COALESCE(max_by(CASE WHEN prev > 0 THEN (revenue - prev) / prev * 100 END, month),
                CAST(0 AS DOUBLE)) AS growth_rate
FROM (SELECT *, lag(revenue) OVER (ORDER BY month) AS prev
      FROM (SELECT {MONTH} AS month, {money()} AS revenue FROM recent GROUP BY 1))""", "recent")


def _monthly(src: str) -> str:
    return (f'SELECT SKU, {YEAR} AS "Year", {MON} AS "Month", {total()} AS Quantity, '
            f'{money()} AS Amount, {money_mean("Rate")} AS Rate, '
            f'CAST(date_trunc(\'month\', MIN("Date")) AS DATE) AS "Date" FROM {src} '
            f'WHERE SKU IS NOT NULL GROUP BY 1, 2, 3')


_cte("monthly", _monthly("sales"), "sales")
_cte("monthly_history", _monthly("history"), "history")
_cte("p_monthly_history", _monthly("p_history"), "p_history")
_cte("p_monthly", _monthly("p_sales"), "p_sales")
_cte("p_monthly_recent", _monthly("p_recent"), "p_recent")


def _seasonal(src: str) -> str:
    return f"""
SELECT SKU, "Month" AS month, (q / n) / (SUM(q) OVER w / SUM(n) OVER w) AS factor
FROM (SELECT SKU, "Month", CAST(SUM(Quantity) AS DOUBLE) AS q, CAST(COUNT(*) AS DOUBLE) AS n
      FROM {src} GROUP BY 1, 2)
WINDOW w AS (PARTITION BY SKU)
QUALIFY SUM(n) OVER w >= 12 AND SUM(q) OVER w > 0"""


def _yoy(src: str) -> str:
    return f"""
SELECT SKU, avg(g) AS yoy FROM (
  SELECT SKU, CASE WHEN prev > 0 THEN (q - prev) / prev END AS g, months FROM (
    SELECT SKU, "Year", q, lag(q) OVER (PARTITION BY SKU ORDER BY "Year") AS prev,
           SUM(n) OVER (PARTITION BY SKU) AS months
    FROM (SELECT SKU, "Year", CAST(SUM(Quantity) AS DOUBLE) AS q, COUNT(*) AS n
          FROM {src} GROUP BY 1, 2)))
WHERE months >= 12 GROUP BY 1 HAVING avg(g) IS NOT NULL"""


_cte("seasonal", _seasonal("monthly_history"), "monthly_history")
_cte("yoy", _yoy("monthly_history"), "monthly_history")
_cte("p_seasonal", _seasonal("p_monthly_history"), "p_monthly_history")
_cte("p_yoy", _yoy("p_monthly_history"), "p_monthly_history")


# -- sources, sinks, ingest ---------------------------------------------------------

_add("sales_scan", f'SELECT "Date", SKU, Quantity, Amount, {MONTH} AS "Month", '
                   f'{week(chr(34) + "Date" + chr(34))} AS "Week" FROM sales', "sales")
_add("sales_mixed_headers", f"""
SELECT {MONTH} AS month, COUNT(*) AS rows, {total()} AS quantity, COUNT(DISTINCT SKU) AS skus,
       COUNT(Orderid) AS with_order,
       COUNT(CASE WHEN {YEAR} NOT BETWEEN 1997 AND 1999 THEN Godown END) AS with_godown
FROM sales GROUP BY 1""", "sales")
_add("sales_csv_scan", f"""
SELECT {MONTH} AS month, COUNT(*) AS rows, {total()} AS quantity, COUNT(DISTINCT SKU) AS skus,
       COUNT(Orderid) AS with_order, CAST(0 AS BIGINT) AS with_rate FROM sales GROUP BY 1""",
     "sales")
_add("clean_sales", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS "Year", COUNT(*) AS rows,
       COUNT(DISTINCT l_partkey) AS skus, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT)
         AS quantity
FROM lineitem WHERE l_tax <> 0 GROUP BY 1""")
_add("moq_scan", "SELECT * FROM moq_terms", "moq_terms")
_add("sku_master_scan", "SELECT * FROM sku_master", "sku_master")
_add("first_available", "SELECT 'lineitem' AS source, COUNT(*) AS rows FROM lineitem")
_add("sales_returns_union", f"""
SELECT 'Sales' AS "Type", {YEAR} AS "Year", COUNT(*) AS rows, COUNT(Rate) AS priced_rows,
       {total()} AS quantity FROM sales GROUP BY 2
UNION ALL
SELECT 'Returns', {YEAR}, COUNT(*), CAST(0 AS BIGINT), {total()} FROM returned GROUP BY 2""",
     "sales", "returned")
_add("history_split", f"""
SELECT {YEAR} AS "Year", CAST(quarter("Date") AS INTEGER) AS "Quarter", {MON} AS "Month",
       COUNT(*) AS rows, {total()} AS quantity
FROM sales WHERE "Date" BETWEEN DATE '1996-01-01' AND DATE '1999-10-31' GROUP BY 1, 2, 3""",
     "sales")

_PERFORMANCE = f"""
SELECT SKU, Total_Quantity, Total_Orders, Avg_Quantity_Per_Order, Total_Revenue, Avg_Order_Value,
       First_Sale, Last_Sale, Total_Revenue / Total_Quantity AS Revenue_Per_Unit,
       CAST(Last_Sale - First_Sale + 1 AS INTEGER) AS Days_Active,
       CAST(Total_Quantity AS DOUBLE) / (Last_Sale - First_Sale + 1) AS Daily_Avg_Quantity
FROM (SELECT SKU, {total()} AS Total_Quantity, COUNT(Quantity) AS Total_Orders,
        {rd(mean(), 2)} AS Avg_Quantity_Per_Order, {money_rd()} AS Total_Revenue,
        {rd(money_mean(), 2)} AS Avg_Order_Value,
        MIN("Date") AS First_Sale, MAX("Date") AS Last_Sale
      FROM %s WHERE SKU IS NOT NULL GROUP BY 1)"""
_cte("performance", _PERFORMANCE % "sales", "sales")
_add("write_results", "SELECT * FROM performance", "performance")
_add("save_tables", """
SELECT 'sales_data' AS table_name, COUNT(*) AS rows FROM lineitem
UNION ALL SELECT 'sku_master', COUNT(*) FROM sku_master
UNION ALL SELECT 'moq_leadtime', COUNT(*) FROM moq_terms""", "sku_master", "moq_terms")
_UPLOADS = """
SELECT CAST({number} AS INTEGER) AS version, CAST({uploads} AS INTEGER) AS uploads, COUNT(*) AS rows,
       {total} AS quantity, COUNT(DISTINCT SKU) AS skus FROM sales WHERE {when}"""
_add("versioned_uploads", " UNION ALL ".join(
    _UPLOADS.format(number=n, uploads=min(n, 3), total=total(), when=when) for n, when in enumerate(
        ('"Date" < DATE \'1997-01-01\'', f'"Date" < {RECENT}', "true", "true"), 1)), "sales")
_add("dedupe_loads", f"""
SELECT {YEAR} AS "Year", COUNT(*) AS rows, COUNT(DISTINCT Orderid) AS orders,
       COUNT(DISTINCT SKU) AS skus
FROM (SELECT DISTINCT Orderid, SKU, Statefrom, "Date" FROM p_sales) GROUP BY 1""", "p_sales")
_add("export_schedule_csv", "SELECT * FROM schedule", "schedule")

_cte("comprehensive", f"""
SELECT p.SKU AS sku, COALESCE(k.category, 'Unknown Product') AS product_name,
       cur AS current_monthly_quantity,
       {dbl('p.predicted_monthly_quantity')} AS predicted_monthly_quantity,
       {rd('CASE WHEN cur > 0 THEN (p.predicted_monthly_quantity - cur) / CAST(cur AS DOUBLE)'
           ' * 100 ELSE 0 END', 1)} AS growth_rate_percent,
       COALESCE(s.lead_time, 0) AS lead_time_days,
       COALESCE(s.recommended_qty, 0) AS recommended_order_quantity,
       COALESCE(s.current_stock, cur) AS current_stock,
       {rd('COALESCE(s.days_remaining, 999)', 1)} AS days_remaining,
       COALESCE(s.urgency, 'LOW') AS urgency,
       {dbl('COALESCE(s.estimated_cost, 0)')} AS estimated_cost_inr, p.confidence,
       COALESCE(g.txt, '') AS godown_distribution, CAST(1 AS DOUBLE) AS seasonal_multiplier
FROM pred p
LEFT JOIN (SELECT SKU, {total()} AS q0, COALESCE({total()}, 0) AS cur FROM recent GROUP BY 1) c
  ON p.SKU = c.SKU
LEFT JOIN schedule s ON p.SKU = s.sku
LEFT JOIN (SELECT SKU, string_agg(Godown || '(' || q || ')', '; ' ORDER BY q DESC, Godown) AS txt
           FROM (SELECT SKU, Godown, {total()} AS q FROM recent GROUP BY 1, 2
                 QUALIFY row_number() OVER (PARTITION BY SKU ORDER BY {total()} DESC, Godown)
                         <= 3) GROUP BY 1) g ON p.SKU = g.SKU
LEFT JOIN sku_master k ON p.SKU = k.sku""", "pred", "recent", "schedule", "sku_master")
_add("export_comprehensive_csv", """
SELECT product_name AS Product_Name, sku AS SKU,
       current_monthly_quantity AS Current_Monthly_Quantity,
       predicted_monthly_quantity AS Predicted_Monthly_Quantity,
       growth_rate_percent AS Growth_Rate_Percent, lead_time_days AS Lead_Time_Days,
       recommended_order_quantity AS Recommended_Order_Quantity, current_stock AS Current_Stock,
       days_remaining AS Days_Remaining, urgency AS Urgency,
       estimated_cost_inr AS Estimated_Cost_INR, confidence AS Confidence,
       godown_distribution AS Godown_Distribution, seasonal_multiplier AS Seasonal_Multiplier
FROM comprehensive""", "comprehensive")
_cte("batch", f"""
SELECT p.product_name AS Product_Name, p.SKU,
       {rd('COALESCE(g.q, 0) / CAST((SELECT COUNT(DISTINCT {MONTH}) FROM recent) AS DOUBLE)'.format(MONTH=MONTH), 1)} AS Current_Monthly_Quantity,
       p.predicted_monthly_quantity AS Predicted_Monthly_Quantity,
       {rd('p.growth_rate * 100', 1)} AS Growth_Rate_Percent, s.lead_time AS Lead_Time_Days,
       COALESCE(s.recommended_qty, 0) AS Recommended_Order_Quantity,
       COALESCE(s.current_stock, 0) AS Current_Stock, s.days_remaining AS Days_Remaining,
       COALESCE(s.urgency, 'N/A') AS Urgency, COALESCE(s.estimated_cost, 0)
         AS Estimated_Cost_INR,
       p.confidence AS Confidence, COALESCE(g.txt, 'No godown data') AS Godown_Distribution,
       p.seasonal_multiplier AS Seasonal_Multiplier
FROM pred p LEFT JOIN schedule s ON p.SKU = s.sku
LEFT JOIN (SELECT SKU, CAST(SUM(q) AS BIGINT) AS q,
                  string_agg(Godown || '(' || q || ')', '; ' ORDER BY Godown) AS txt
           FROM (SELECT SKU, Godown, {total()} AS q FROM recent GROUP BY 1, 2) GROUP BY 1) g
  ON p.SKU = g.SKU""", "pred", "schedule", "recent")
_add("report_bundle", """
SELECT 'ordering_schedule' AS sheet, COUNT(*) AS rows FROM schedule
UNION ALL SELECT 'summary_by_urgency', COUNT(DISTINCT urgency) FROM schedule
UNION ALL SELECT 'critical_orders_only', COUNT(*) FROM schedule WHERE urgency = 'CRITICAL'
UNION ALL SELECT 'comprehensive_analysis', COUNT(*) FROM batch
UNION ALL SELECT 'godown_summary', COUNT(DISTINCT (Godown, Statefrom)) FROM recent
UNION ALL SELECT 'sku_by_godown', COUNT(DISTINCT (SKU, Godown)) FROM recent
UNION ALL SELECT 'high_growth_skus', COUNT(*) FROM batch WHERE Growth_Rate_Percent > 50""",
     "schedule", "batch", "recent")
_URGENCY = """
SELECT urgency AS "{0}", CAST(SUM(recommended_qty) AS BIGINT) AS "{1}",
       COUNT(recommended_qty) AS "{2}", CAST(SUM(estimated_cost) AS BIGINT) AS "{3}"
FROM schedule GROUP BY 1"""
_add("title_case_headers", _URGENCY.format("Urgency", "Recommended Qty Sum",
                                           "Recommended Qty Count", "Estimated Cost Sum"),
     "schedule")
_add("urgency_summary", _URGENCY.format("urgency", "recommended_qty_sum",
                                        "recommended_qty_count", "estimated_cost_sum"),
     "schedule")
_add("ingest_sales", f"SELECT COUNT(*) AS records_processed, COUNT(*) AS stored_rows, "
                     f"{total()} AS quantity FROM sales", "sales")
_add("ingest_sku_master", "SELECT COUNT(*) AS skus_processed, COUNT(*) AS stored_rows "
                          "FROM sku_master", "sku_master")
_add("pattern_fold", f"""
SELECT SKU, month, factor, {rd('yoy', 8)} AS yoy FROM seasonal LEFT JOIN yoy USING (SKU)""",
     "seasonal", "yoy")
_add("pattern_cache", """
SELECT COUNT(*) AS factors, COUNT(DISTINCT SKU) AS total_skus,
       (SELECT COUNT(*) FROM yoy) AS yoy_skus FROM seasonal""", "seasonal", "yoy")

# -- projections, filters, scalar functions -------------------------------------------

_add("calendar_features", f"""
SELECT "Date", {total()} AS Quantity, {MONTH} AS "Period",
       {week('"Date"')} AS "Week", {YEAR} AS "Year", {MON} AS "Month",
       CAST(quarter("Date") AS INTEGER) AS "Quarter", {WEEKDAY} AS "DayOfWeek",
       CAST(day("Date") AS INTEGER) AS "DayOfMonth", CAST(weekofyear("Date") AS INTEGER)
         AS "WeekOfYear", dayname("Date") AS "DayName"
FROM sales GROUP BY "Date" """, "sales")
_add("rename_columns", f"""
SELECT Godown AS "FulfillmentCenterID", COUNT(DISTINCT SKU) AS skus,
       COUNT(DISTINCT Orderid) AS orders, {total()} AS quantity FROM sales GROUP BY 1""",
     "sales")
_add("with_product_name", f"""
SELECT s.SKU, quantity, COALESCE(k.category, 'Unknown Product') AS name,
       COALESCE(k.category, s.SKU) AS product_name,
       s.SKU || ' - ' || COALESCE(k.category, s.SKU) AS display
FROM (SELECT SKU, {total()} AS quantity FROM sales GROUP BY 1) s
LEFT JOIN (SELECT * FROM sku_master WHERE sku IN (SELECT sku FROM moq_terms)) k
  ON s.SKU = k.sku""", "sales", "sku_master", "moq_terms")
_add("sku_list", "SELECT sku, category AS name, sku || ' - ' || category AS display "
                 "FROM sku_master", "sku_master")
_add("period_filter", f"""
SELECT 'since' AS period, COUNT(*) AS rows, {total()} AS quantity FROM sales
WHERE "Date" >= DATE '2000-01-01'
UNION ALL SELECT 'before', COUNT(*), {total()} FROM sales WHERE "Date" < DATE '2000-01-01'
UNION ALL SELECT 'between', COUNT(*), {total()} FROM sales
WHERE "Date" >= DATE '1996-01-01' AND "Date" < DATE '1998-01-01'""", "sales")
_add("min_rows_guard", """
SELECT SKU, COUNT(*) AS days, CAST(SUM(Rows) AS BIGINT) AS rows FROM p_daily_all GROUP BY 1
HAVING SUM(Rows) >= 30 AND COUNT(*) >= 30""", "p_daily_all")
_add("cyclic_month", f"""
SELECT {MON} AS "Month", COUNT(*) AS rows,
       {rd(f'sin({MON} * (2 * pi() / 12))', 6)} AS "Month_Sin",
       {rd(f'cos({MON} * (2 * pi() / 12))', 6)} AS "Month_Cos" FROM sales GROUP BY 1""", "sales")
_add("clean_non_finite", """
SELECT SKU, "Date", Quantity, CASE WHEN COALESCE(prev, 0) = 0 THEN CAST(0 AS DOUBLE)
       ELSE (Quantity - prev) / CAST(prev AS DOUBLE) END AS growth
FROM (SELECT *, lag(Quantity) OVER (PARTITION BY SKU ORDER BY "Date") AS prev FROM monthly)""",
     "monthly")
_add("clamp", f"""
SELECT SKU, LEAST(GREATEST(SUM(Quantity) / CAST(100 AS DOUBLE), CAST(20 AS DOUBLE)),
                  CAST(100 AS DOUBLE)) AS clamped FROM sales GROUP BY 1""", "sales")
_add("data_completeness", """
SELECT n AS total_records, d AS missing_date, q AS missing_quantity, a AS missing_amount,
       CAST(n - d - q - a AS DOUBLE) / n * 100 AS completeness,
       CAST(d AS DOUBLE) / n * 100 AS missing_date_percent,
       CAST(q AS DOUBLE) / n * 100 AS missing_quantity_percent,
       CAST(a AS DOUBLE) / n * 100 AS missing_amount_percent
FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (NOT l_tax > 0) AS d,
             COUNT(*) FILTER (l_quantity IS NULL) AS q,
             COUNT(*) FILTER (NOT l_discount > 0) AS a FROM lineitem)""")
_add("validate_prediction_input", """
SELECT sku, errors, errors = '' AS is_valid, COUNT(*) AS requests FROM (
  SELECT SKU AS sku, concat_ws('; ',
    CASE WHEN lag(Quantity, 1) OVER w IS NULL THEN 'Missing required field: quantity_lag1' END,
    CASE WHEN lag(Quantity, 7) OVER w IS NULL THEN 'Missing required field: quantity_lag7' END,
    CASE WHEN lag(Quantity, 30) OVER w IS NULL THEN 'Missing required field: quantity_lag30' END,
    CASE WHEN month("Date") = 12 THEN 'Date must be in valid format (YYYY-MM-DD)' END,
    CASE WHEN month("Date") = 12 THEN 'Month must be between 1 and 12' END) AS errors
  FROM daily_all WINDOW w AS (PARTITION BY SKU ORDER BY "Date"))
GROUP BY 1, 2, 3""", "daily_all")
_add("sku_maturity", """
SELECT sku, CAST(CASE WHEN sku LIKE '%#1/%' OR sku LIKE '%#2/%' THEN 20
                      WHEN length(sku) > 5 THEN 15 ELSE 10 END AS INTEGER) AS maturity_score
FROM sku_master""", "sku_master")

# -- sales reports ------------------------------------------------------------------------

_add("sku_performance", "SELECT * FROM performance", "performance")
_add("sku_performance_by_part", _PERFORMANCE % "p_sales", "p_sales")
_add("top_skus", "SELECT * FROM performance ORDER BY Total_Revenue DESC, SKU LIMIT 20",
     "performance")
_add("identify_top_skus", f"""
SELECT SKU, {money()} AS Total_Revenue, {total()} AS Total_Quantity, MIN("Date") AS First_Sale,
       MAX("Date") AS Last_Sale, COUNT("Date") AS Total_Orders,
       CAST(MAX("Date") - MIN("Date") + 1 AS INTEGER) AS Days_Active,
       CAST(SUM(Quantity) AS DOUBLE) / (MAX("Date") - MIN("Date") + 1) AS Daily_Avg_Quantity,
       {money()} / SUM(Quantity) AS Revenue_Per_Unit
FROM recent GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""", "recent")
_add("monthly_trends", f"""
SELECT *, (Total_Revenue - lag(Total_Revenue) OVER w) / lag(Total_Revenue) OVER w * 100
         AS Revenue_Growth,
       CAST(Total_Quantity - lag(Total_Quantity) OVER w AS DOUBLE)
         / lag(Total_Quantity) OVER w * 100 AS Quantity_Growth
FROM (SELECT {MONTH} AS "Month", {total()} AS Total_Quantity, {money_rd()} AS Total_Revenue,
        COUNT(DISTINCT SKU) AS Unique_SKUs, COUNT(DISTINCT Orderid) AS Unique_Orders
      FROM sales GROUP BY 1) WINDOW w AS (ORDER BY "Month")""", "sales")
_add("dow_revenue", f"""
SELECT CAST(d AS INTEGER) AS weekday, {_day_names('d')} AS "DayOfWeek", a AS "Amount"
FROM range(7) t(d) LEFT JOIN (SELECT {WEEKDAY} AS k, {money()} AS a FROM sales GROUP BY 1)
  ON d = k""", "sales")
_add("weekly_patterns", f"""
SELECT {week('"Date"')} AS "Week", {money()} AS "Amount", {total()} AS "Quantity"
FROM sales GROUP BY 1""", "sales")
_add("weekly_revenue_stats", f"""
SELECT COUNT(*) AS count, {rd('avg(a)', 2)} AS mean, {rd('stddev_samp(a)', 2)} AS std,
       {rd('min(a)', 2)} AS min, {rd('quantile_cont(a, 0.25)', 2)} AS q25,
       {rd('quantile_cont(a, 0.5)', 2)} AS q50, {rd('quantile_cont(a, 0.75)', 2)} AS q75,
       {rd('max(a)', 2)} AS max
FROM (SELECT {week('"Date"')} AS w, {money()} AS a FROM sales GROUP BY 1)""", "sales")
_add("category_counts", "SELECT category, COUNT(*) AS skus FROM sku_master GROUP BY 1",
     "sku_master")
_add("exploration_insights", f"""
SELECT (SELECT COUNT(*) FROM performance) AS total_skus,
       (SELECT {rd('SUM(Total_Revenue)', 2)} FROM (SELECT Total_Revenue FROM performance
         ORDER BY Total_Revenue DESC, SKU LIMIT 10)) AS top10_revenue,
       (SELECT {rd(money_mean('a'), 2)} FROM (SELECT {money()} AS a FROM sales
         GROUP BY "Date")) AS avg_daily_revenue,
       category AS most_active_category, COUNT(*) AS category_skus
FROM sku_master GROUP BY category ORDER BY category_skus DESC, category LIMIT 1""",
     "performance", "sales", "sku_master")
_GROWTH = """
(SELECT max_by(CASE WHEN prev > 0 THEN (revenue - prev) / prev * 100
                    ELSE CAST(0 AS DOUBLE) END, month)
 FROM (SELECT *, lag(revenue) OVER (ORDER BY month) AS prev FROM months))"""
_add("business_overview", f"""
SELECT {money()} AS total_revenue, COUNT(*) AS total_orders, COUNT(DISTINCT SKU) AS unique_skus,
       strftime(MIN("Date"), '%Y-%m-%d') AS start, strftime(MAX("Date"), '%Y-%m-%d') AS "end",
       {_GROWTH} AS growth_rate, {money()} / COUNT(*) AS avg_order_value FROM sales""",
     "sales", "months")
_add("overview_top5", f"""
SELECT s.SKU AS sku, COALESCE(k.category, 'Unknown Product') AS product_name, revenue,
       CAST(row_number() OVER o AS INTEGER) AS position,
       {rd('revenue / SUM(revenue) OVER () * 100', 1)} AS share_percent,
       CASE WHEN row_number() OVER o <= 2 THEN 'Excellent' WHEN row_number() OVER o <= 4
            THEN 'Good' ELSE 'Average' END AS performance
FROM (SELECT SKU, {money()} AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) s
LEFT JOIN sku_master k ON s.SKU = k.sku WINDOW o AS (ORDER BY revenue DESC, s.SKU)""",
     "sales", "sku_master")
_add("overview_monthly_trend", f"""
SELECT month, revenue, quantity,
       {rd('(revenue - b) / b * 100', 1)} AS growth_percent
FROM (SELECT *, COALESCE(lag(revenue) OVER (ORDER BY month), revenue) AS b FROM months)""",
     "months")
_add("godown_summary", f"""
SELECT Godown, Statefrom AS "State_From", COUNT(SKU) AS "Orders", {total()} AS Total_Quantity,
       {money()} AS Total_Revenue FROM sales GROUP BY 1, 2""", "sales")
_add("sku_godown", f"""
SELECT SKU, Godown, {total()} AS "Quantity", {money()} AS "Amount" FROM sales GROUP BY 1, 2""",
     "sales")
_add("godown_top5", f"""
SELECT Godown, {total()} AS "Quantity", {money()} AS "Amount" FROM sales GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 5""", "sales")
_add("sku_top3_godowns", f"""
SELECT SKU, string_agg(Godown || '(' || q || ')', '; ' ORDER BY q DESC, Godown)
         AS godown_distribution
FROM (SELECT SKU, Godown, {total()} AS q FROM sales GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY SKU ORDER BY {total()} DESC, Godown) <= 3)
GROUP BY 1""", "sales")
_add("network_counts", """
SELECT COUNT(DISTINCT Godown) AS unique_godowns, COUNT(DISTINCT Statefrom) AS states_served_from,
       COUNT(DISTINCT Stateto) AS destination_states FROM sales""", "sales")
_add("distinct_from_sketches", f"""
SELECT {MONTH} AS period, COUNT(DISTINCT Orderid) AS orders, COUNT(DISTINCT SKU) AS exact_skus,
       true AS orders_near, true AS exact_skus_near FROM p_sales GROUP BY 1""", "p_sales")
_add("historical_monthly", f"""
SELECT {MONTH} AS period, {money()} AS revenue, {total()} AS quantity FROM history GROUP BY 1
ORDER BY 1 DESC LIMIT 24""", "history")
_add("historical_span", f"""
SELECT COUNT(DISTINCT {MONTH}) AS total_periods, strftime(MIN("Date"), '%Y-%m-%d') AS start,
       strftime(MAX("Date"), '%Y-%m-%d') AS "end" FROM history""", "history")
_add("seasonal_month_means", f"""
SELECT {_month_names(MON)} AS month, {money_mean()} AS avg_revenue,
       {mean()} AS avg_quantity FROM history GROUP BY {MON}""", "history")
_add("yoy_growth", f"""
SELECT year, revenue, CASE WHEN prev > 0 THEN (revenue - prev) / prev * 100
                           ELSE CAST(0 AS DOUBLE) END AS growth_rate
FROM (SELECT *, lag(revenue) OVER (ORDER BY year) AS prev,
             row_number() OVER (ORDER BY year) AS r
      FROM (SELECT {YEAR} AS year, {money()} AS revenue FROM sales GROUP BY 1)) WHERE r > 1""",
     "sales")
_add("channel_summary", f"""
SELECT *, {rd('Total_Revenue / SUM(Total_Revenue) OVER () * 100', 2)} AS Revenue_Percentage,
       {rd('CAST(Total_Orders AS DOUBLE) / SUM(Total_Orders) OVER () * 100', 2)}
         AS Orders_Percentage
FROM (SELECT Partyname, {money_rd()} AS Total_Revenue, COUNT(Amount) AS Total_Orders,
        {rd(money_mean(), 2)} AS Avg_Order_Value, {total()} AS Total_Quantity,
        {rd(mean(), 2)} AS Avg_Quantity_Per_Order FROM sales GROUP BY 1)""", "sales")


def _of(channel: str, what: str) -> str:
    return f"CASE WHEN Partyname = '{channel}' THEN {what} END"


_add("channel_yearly_pivot", f"""
SELECT {YEAR} AS "Year", COALESCE({money(_of('F', 'Amount'))}, 0) AS "F_revenue",
       COALESCE({total(_of('F', 'Quantity'))}, 0) AS "F_quantity",
       COALESCE({money(_of('O', 'Amount'))}, 0) AS "O_revenue",
       COALESCE({total(_of('O', 'Quantity'))}, 0) AS "O_quantity"
FROM sales GROUP BY 1""", "sales")
_add("channel_monthly_pivot", f"""
SELECT {MONTH} AS "Period", COALESCE({money(_of('F', 'Amount'))}, 0) AS "F_revenue",
       COALESCE({money(_of('O', 'Amount'))}, 0) AS "O_revenue"
FROM sales WHERE year("Date") IN (2000, 2001) GROUP BY 1""", "sales")
_add("channel_yearly_share", f"""
SELECT {YEAR} AS "Year",
       COALESCE({money(_of('F', 'Amount'))}, 0) / {money()} * 100 AS "F_percentage",
       COALESCE({money(_of('O', 'Amount'))}, 0) / {money()} * 100 AS "O_percentage"
FROM sales GROUP BY 1""", "sales")
_add("analysis_overview", f"""
SELECT COUNT(*) AS total_records, strftime(MIN("Date"), '%Y-%m-%d') AS start,
       strftime(MAX("Date"), '%Y-%m-%d') AS "end", COUNT(DISTINCT SKU) AS total_skus,
       {money()} AS total_revenue, {total()} AS total_quantity FROM sales""", "sales")
_cte("days", f'SELECT "Date", {total()} AS Quantity FROM sales GROUP BY 1', "sales")
_add("daily_volatility", f"""
SELECT {mean()} AS daily_average, MAX(Quantity) AS peak_daily,
       {rd(f'stddev_samp(Quantity) / {mean()} * 100', 6)} AS volatility FROM days""", "days")
_add("top_skus_by_quantity", f"""
SELECT s.SKU AS sku, quantity, COALESCE(k.category, s.SKU) AS name,
       s.SKU || ' - ' || COALESCE(k.category, s.SKU) AS display
FROM (SELECT SKU, {total()} AS quantity FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) s
LEFT JOIN sku_master k ON s.SKU = k.sku""", "sales", "sku_master")
_add("top_states_by_revenue", f"""
SELECT Stateto AS state, {money()} AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1
LIMIT 10""", "sales")


def _best(key: str, way: str) -> str:
    return (f"(SELECT {key} FROM days GROUP BY 1 ORDER BY {mean()} {way}, 1 LIMIT 1)")


_add("temporal_extremes", f"""
SELECT {_best(WEEKDAY, 'DESC')} AS best_day, {_best(WEEKDAY, 'ASC')} AS worst_day,
       {_best(MON, 'DESC')} AS best_month, {_best(MON, 'ASC')} AS worst_month""", "days")
_add("sales_trend", "SELECT month, quantity FROM months", "months")
_add("sales_trend_daily", """
SELECT strftime("Date", '%Y-%m-%d') AS date, Quantity AS quantity FROM days
ORDER BY "Date" DESC LIMIT 30""", "days")


def _states(cut: str) -> str:
    return f"""
SELECT state, f + o AS total_quantity, f AS first_quantity, o AS second_quantity,
       CASE WHEN f + o > 0 THEN {rd('CAST(f AS DOUBLE) / (f + o) * 100', 1)} ELSE 0 END
         AS first_percentage,
       CASE WHEN f + o > 0 THEN {rd('CAST(o AS DOUBLE) / (f + o) * 100', 1)} ELSE 0 END
         AS second_percentage,
       CASE WHEN f > o THEN 'F' WHEN o > f THEN 'O' ELSE 'Equal' END AS primary_channel
FROM (SELECT Stateto AS state, {total()} AS q,
        COALESCE({total(_of('F', 'Quantity'))}, 0) AS f,
        COALESCE({total(_of('O', 'Quantity'))}, 0) AS o
      FROM sales GROUP BY 1 {cut})"""


_cte("states", _states("ORDER BY 2 DESC, 1 LIMIT 15"), "sales")
_cte("all_states", _states("HAVING Stateto IS NOT NULL"), "sales")
_add("state_channel_distribution", "SELECT * FROM states", "states")
_add("state_channel_summary", """
SELECT COUNT(*) AS total_states, COUNT(*) FILTER (primary_channel = 'F') AS first_dominant_states,
       COUNT(*) FILTER (primary_channel = 'O') AS second_dominant_states,
       COUNT(*) FILTER (primary_channel = 'Equal') AS equal_states FROM all_states""", "all_states")
_add("bi_month_extremes", """
SELECT b.month AS best_month, b.quantity AS best_quantity, w.month AS worst_month,
       w.quantity AS worst_quantity
FROM (SELECT * FROM months ORDER BY quantity DESC, month LIMIT 1) b,
     (SELECT * FROM months ORDER BY quantity, month LIMIT 1) w""", "months")
_add("bi_sku_performance", f"""
SELECT SKU, {total()} AS Total_Quantity, {rd(mean(), 2)} AS Avg_Daily,
       COUNT(Quantity) AS Records, {money_rd()} AS Total_Revenue FROM sales GROUP BY 1""",
     "sales")
_add("bi_state_performance", f"""
SELECT Stateto, {total()} AS "Quantity", {money()} AS "Amount" FROM sales GROUP BY 1""", "sales")
_cte("shares", f"""
SELECT (SELECT CAST(SUM(q) FILTER (r <= 5) AS DOUBLE) / SUM(q) * 100 FROM (
          SELECT {total()} AS q, row_number() OVER (ORDER BY {total()} DESC, SKU) AS r
          FROM sales GROUP BY SKU)) AS top_5_sku_share,
       (SELECT SUM(a) FILTER (r <= 5) / SUM(a) * 100 FROM (
          SELECT {money()} AS a, row_number() OVER (ORDER BY {money()} DESC, Stateto) AS r
          FROM sales GROUP BY Stateto)) AS top_5_state_share""", "sales")
_add("bi_concentration", f"SELECT {rd('top_5_sku_share', 6)} AS top_5_sku_share, "
                         f"{rd('top_5_state_share', 6)} AS top_5_state_share FROM shares",
     "shares")


def _means(kind: str, key: str, label: str) -> str:
    return f"""
SELECT '{kind}' AS kind, k, {label} AS label, m AS avg_quantity,
       k = first_value(k) OVER (ORDER BY m DESC, k) AS is_best,
       k = first_value(k) OVER (ORDER BY m, k) AS is_worst
FROM (SELECT {key} AS k, {mean()} AS m FROM sales GROUP BY 1)"""


_add("bi_row_means", _means("weekday", WEEKDAY, _day_names("k")) + " UNION ALL "
     + _means("month", MON, _month_names("k")), "sales")
_add("price_stats", f"""
SELECT {rd(money_mean('Rate'), 4)} AS avg_price, {rd('stddev_samp(Rate)', 4)} AS price_std,
       {rd('min(Rate)', 4)} AS min_price, {rd('max(Rate)', 4)} AS max_price,
       {rd('stddev_samp(Rate) / avg(Rate) * 100', 4)} AS price_volatility,
       {rd('corr(Rate, Quantity)', 6)} AS price_quantity_corr,
       CASE WHEN corr(Rate, Quantity) < -0.1 THEN 'reduces demand'
            WHEN corr(Rate, Quantity) > 0.1 THEN 'increases demand'
            ELSE 'minimal impact' END AS price_effect FROM sales""", "sales")
_add("kpi_report", f"""
SELECT {money()} AS total_revenue, {total()} AS total_units, COUNT(*) AS total_orders,
       COUNT(DISTINCT SKU) AS total_skus, (SELECT {mean()} FROM days) AS daily_avg,
       (SELECT {rd('top_5_sku_share', 6)} FROM shares) AS top_5_sku_share,
       (SELECT {rd('top_5_state_share', 6)} FROM shares) AS top_5_state_share,
       {money()} / COUNT(*) AS avg_order_value,
       {money()} / COUNT(DISTINCT SKU) AS revenue_per_sku FROM sales""",
     "sales", "days", "shares")

# -- windows and features -----------------------------------------------------------------

_W = 'WINDOW w AS (PARTITION BY SKU ORDER BY "Date")'
_add("daily_sku_sales", 'SELECT SKU, "Date", Quantity, Amount, Rows AS "Rows", '
                        'Counted AS "Counted" FROM daily_all', "daily_all")
_LAGS = ", ".join(f'lag({c}, {k}) OVER w AS "{c}_lag_{k}"' for k in (1, 3, 7, 14, 30)
                  for c in ("Quantity", "Amount"))
_add("daily_lags", f'SELECT SKU, "Date", Quantity, Amount, {_LAGS} FROM daily_all {_W}',
     "daily_all")


def _over(fn: str, c: str, n: int, need: int | None = None) -> str:
    frame = (f'(PARTITION BY SKU ORDER BY "Date" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)')
    return (f"CASE WHEN COUNT({c}) OVER {frame} = {need or n} THEN {fn}({c}) OVER {frame} END")


_MEANS = ", ".join(f'{rd(_over("avg", c, n), 6)} AS "{c}_rolling_{n}"' for n in (7, 14, 30)
                   for c in ("Quantity", "Amount"))
_add("daily_rolling_means", f'SELECT SKU, "Date", Quantity, Amount, {_MEANS} FROM daily_all',
     "daily_all")


def _slope(n: int) -> str:
    frame = (f'(PARTITION BY SKU ORDER BY "Date" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)')
    return rd(f"CASE WHEN COUNT(Quantity) OVER {frame} = {n} "
              f"THEN regr_slope(Quantity, i) OVER {frame} END", 6)


_cte("numbered", f'SELECT *, row_number() OVER w AS i FROM daily_all {_W}', "daily_all")
_SLOPES = ", ".join(f'{_slope(n)} AS "Quantity_trend_{n}d"' for n in (7, 30))
_add("daily_trend_slope", f'SELECT SKU, "Date", Quantity, Amount, {_SLOPES} FROM numbered',
     "numbered")
_add("daily_features", f"""
SELECT * FROM (
  SELECT SKU, "Date", Quantity, Amount, {YEAR} AS "Year", {MON} AS "Month",
         {WEEKDAY} AS "DayOfWeek", CAST(day("Date") AS INTEGER) AS "DayOfMonth",
         CAST(weekofyear("Date") AS INTEGER) AS "WeekOfYear", {_LAGS}, {_MEANS}, {_SLOPES}
  FROM numbered {_W} QUALIFY SUM(Rows) OVER (PARTITION BY SKU) >= 30)
WHERE "Quantity_lag_30" IS NOT NULL AND "Quantity_trend_30d" IS NOT NULL""", "numbered")
_add("rolling_stats", 'SELECT SKU, "Date", Quantity, ' + ", ".join(
    (f'{rd(_over(fn, "Quantity", n), 4)}' if name in ("mean", "std")
     else _over(fn, "Quantity", n)) + f' AS "Quantity_{name}_{n}"'
    for n in (7, 14, 30, 90)
    for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
     + " FROM daily_all", "daily_all")
_add("monthly_sku_sales", "SELECT * FROM monthly", "monthly")


def _monthly_features(src: str) -> str:
    def lag(k: int) -> str:
        return f"CAST(lag(Quantity, {k}) OVER w AS DOUBLE)"

    def ma(k: int) -> str:
        return _over("avg", "Quantity", k)

    def change(k: int) -> str:
        return (f"CASE WHEN lag(Quantity, {k}) OVER w <> 0 THEN (Quantity - {lag(k)}) "
                f"/ {lag(k)} END")

    return f"""
SELECT SKU, "Year", "Month", Quantity, Amount, "Date",
  COALESCE({lag(1)}, 0) AS "Quantity_Lag1",
  COALESCE(CASE WHEN n >= 4 THEN {lag(3)} ELSE {lag(1)} END, 0) AS "Quantity_Lag3",
  COALESCE(CASE WHEN n >= 7 THEN {lag(6)} ELSE {lag(3)} END, 0) AS "Quantity_Lag6",
  COALESCE(CASE WHEN n >= 13 THEN {lag(12)} ELSE {lag(6)} END, 0) AS "Quantity_Lag12",
  COALESCE({rd(ma(3), 6)}, 0) AS "MA_3",
  COALESCE({rd(f'CASE WHEN n >= 6 THEN {ma(6)} ELSE {ma(3)} END', 6)}, 0) AS "MA_6",
  COALESCE({rd(f'CASE WHEN n >= 12 THEN {ma(12)} ELSE {ma(6)} END', 6)}, 0) AS "MA_12",
  COALESCE({rd(f'CASE WHEN n >= 13 THEN {change(12)} WHEN n >= 7 THEN {change(6)} '
               f'ELSE {change(3)} END', 6)}, 0) AS "YoY_Growth",
  CAST(row_number() OVER w - 1 AS INTEGER) AS "Trend",
  CAST("Year" >= 2001 AS INTEGER) AS is_post_restart,
  {rd('sin("Month" * (2 * pi() / 12))', 6)} AS "Month_Sin",
  {rd('cos("Month" * (2 * pi() / 12))', 6)} AS "Month_Cos"
FROM (SELECT *, COUNT(*) OVER (PARTITION BY SKU) AS n FROM {src}) WHERE n >= 3 {_W}"""


_add("monthly_features", _monthly_features("monthly"), "monthly")
_add("monthly_features_short", _monthly_features("p_monthly_recent"), "p_monthly_recent")
_add("restart_features", f"""
SELECT m.SKU, "Year", "Month", Quantity, Amount, "Date",
  {', '.join(f'COALESCE(CAST(lag(Quantity, {k}) OVER w AS DOUBLE), 0) AS "Quantity_Lag{k}"'
             for k in (1, 2, 3))},
  COALESCE({rd(_over('avg', 'Quantity', 2).replace('BY SKU', 'BY m.SKU'), 6)}, 0) AS "MA_2",
  COALESCE({rd(_over('avg', 'Quantity', 3).replace('BY SKU', 'BY m.SKU'), 6)}, 0) AS "MA_3",
  COALESCE({rd('CASE WHEN n >= 6 THEN ' + _over('avg', 'Quantity', 6) + ' ELSE '
               + _over('avg', 'Quantity', 3) + ' END', 6).replace('BY SKU', 'BY m.SKU')}, 0)
    AS "MA_6",
  CAST(row_number() OVER w - 1 AS INTEGER) AS "Trend",
  {rd('sin("Month" * (2 * pi() / 12))', 6)} AS "Month_Sin",
  {rd('cos("Month" * (2 * pi() / 12))', 6)} AS "Month_Cos",
  {rd('COALESCE(factor, 1)', 6)} AS "Historical_Seasonal_Factor",
  {rd('COALESCE(yoy, 0)', 6)} AS "Historical_YoY_Growth", CAST(1 AS INTEGER) AS is_post_restart
FROM (SELECT *, COUNT(*) OVER (PARTITION BY SKU) AS n FROM monthly WHERE "Year" >= 2000) m
LEFT JOIN (SELECT SKU AS s, month AS sm, factor FROM seasonal) ON m.SKU = s AND "Month" = sm
LEFT JOIN (SELECT SKU AS y, yoy FROM yoy) ON m.SKU = y
WHERE n >= 3 WINDOW w AS (PARTITION BY m.SKU ORDER BY "Date")""", "monthly", "seasonal", "yoy")
_add("pct_change", f"""
SELECT SKU, "Year", "Month", Quantity, Amount, "Date",
       CASE WHEN lag(Quantity, 3) OVER w <> 0 THEN CAST(Quantity - lag(Quantity, 3) OVER w
         AS DOUBLE) / lag(Quantity, 3) OVER w END AS "Quantity_change_3"
FROM monthly {_W}""", "monthly")
_add("last_n_rows", """
SELECT p.SKU, sale_days, recent_mean, previous_mean, last_date, d.Quantity AS last_quantity
FROM profile_all p JOIN daily_all d ON p.SKU = d.SKU AND p.last_date = d."Date" """,
     "profile_all")
_add("share_of_total", f"""
SELECT SKU, {total()} AS quantity,
       CAST(SUM(Quantity) AS DOUBLE) / SUM(SUM(Quantity)) OVER () * 100 AS share_percent
FROM sales GROUP BY 1""", "sales")

# -- forecasts ------------------------------------------------------------------------------

_add("predict_next_month", "SELECT * FROM pred15", "pred15")
_add("predict_next_month_all", "SELECT * FROM pred", "pred")
_add("seasonal_multiplier", """
SELECT SKU, CAST(month(last_date + INTERVAL 30 DAY) AS INTEGER) AS month, seasonal_multiplier
FROM profile""", "profile")
_add("confidence_score", "SELECT SKU, sale_days, confidence_score, confidence FROM scored",
     "scored")
_add("confidence_score_by_part",
     "SELECT SKU, sale_days, confidence_score, confidence FROM p_scored", "p_scored")
_add("enhanced_confidence", """
SELECT SKU, sc AS confidence_score, CASE WHEN sc >= 85 THEN 'High' WHEN sc >= 65 THEN 'Medium'
       ELSE 'Low' END AS confidence
FROM (SELECT SKU, CAST(50
  + CASE WHEN abs(growth_rate) < 0.1::DOUBLE THEN 40 WHEN abs(growth_rate) < 0.3::DOUBLE THEN 25
         WHEN abs(growth_rate) < 0.5 THEN 15 ELSE 5 END
  + CASE WHEN predicted_monthly_quantity >= 1000 THEN 30
         WHEN predicted_monthly_quantity >= 300 THEN 20
         WHEN predicted_monthly_quantity >= 100 THEN 15 ELSE 5 END
  + CASE WHEN SKU LIKE '%#1/%' OR SKU LIKE '%#2/%' THEN 20 WHEN length(SKU) > 5 THEN 15
         ELSE 10 END AS INTEGER) AS sc FROM pred)""", "pred")
_add("confidence_distribution", """
SELECT confidence, COUNT(*) AS skus, CAST(SUM(predicted_monthly_quantity) AS BIGINT)
         AS total_predicted FROM pred GROUP BY 1""", "pred")
_add("prediction_report", f"""
SELECT SKU AS sku, product_name, {dbl('predicted_monthly_quantity')} AS monthly_quantity,
       predicted_daily_average AS daily_average, CAST(0 AS DOUBLE) AS growth_rate, confidence
FROM pred""", "pred")
_add("prediction_top10", """
SELECT *, CAST(SUM(predicted_monthly_quantity) OVER () AS BIGINT) AS total_predicted
FROM (SELECT SKU, predicted_monthly_quantity, predicted_daily_average, confidence FROM pred
      ORDER BY 2 DESC, 1 LIMIT 10)""", "pred")
_cte("comparison", f"""
SELECT p.SKU AS sku, COALESCE(k.category, 'Unknown Product') AS product_name,
       p AS predicted_quantity, a AS actual_quantity,
       {rd('CASE WHEN a > 0 THEN LEAST(GREATEST((1 - abs(p - a) / a) * 100, 0), 100) '
           'WHEN p > 0 THEN 0 ELSE 100 END', 1)} AS accuracy_percent,
       {rd('p - a', 1)} AS variance,
       {rd('CASE WHEN a > 0 THEN (p - a) / a * 100 ELSE 0 END', 1)} AS variance_percent,
       confidence,
       CASE WHEN p > a THEN 'over_predicted' WHEN p < a THEN 'under_predicted'
            ELSE 'accurate' END AS status
FROM (SELECT pred.SKU, CAST(predicted_monthly_quantity AS DOUBLE) AS p, confidence,
        COALESCE(q, 0) AS a
      FROM pred LEFT JOIN (SELECT SKU AS s, {total()} AS q FROM recent GROUP BY 1) ON SKU = s) p
LEFT JOIN sku_master k ON p.SKU = k.sku""", "pred", "recent", "sku_master")
_add("prediction_comparison",
     "SELECT * FROM comparison ORDER BY accuracy_percent DESC, sku LIMIT 20", "comparison")
_add("prediction_comparison_summary", f"""
SELECT {rd('avg(accuracy_percent)', 1)} AS average_accuracy, COUNT(*) AS total_items,
       COUNT(*) FILTER (status = 'over_predicted') AS over_predicted,
       COUNT(*) FILTER (status = 'under_predicted') AS under_predicted,
       COUNT(*) FILTER (status = 'accurate') AS accurate,
       COUNT(*) FILTER (accuracy_percent >= 80) AS high_accuracy_items FROM comparison""",
     "comparison")
_add("seasonal_patterns", "SELECT * FROM seasonal", "seasonal")
_add("yoy_patterns", f"SELECT SKU, {rd('yoy', 8)} AS yoy FROM yoy", "yoy")
_add("pattern_lookup", f"""
SELECT r.SKU, r.month, COALESCE(factor, 1) AS seasonal_factor,
       {rd('COALESCE(yoy, 0)', 8)} AS yoy_growth, factor IS NOT NULL AS has_pattern
FROM (SELECT DISTINCT SKU, {MON} AS month FROM p_recent) r
LEFT JOIN p_seasonal s ON r.SKU = s.SKU AND r.month = s.month
LEFT JOIN p_yoy y ON r.SKU = y.SKU""", "p_recent", "p_seasonal", "p_yoy")


def _recent_months(keys: str, src: str) -> str:
    return f"""
SELECT {keys}, COUNT(*) AS months,
       CAST(SUM(q) FILTER (r <= 3) AS DOUBLE) / COUNT(*) FILTER (r <= 3) AS recent_mean,
       CAST(SUM(q) AS DOUBLE) / SUM(n) AS row_mean, CAST(SUM(q) AS BIGINT) AS total_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY mm DESC) AS r
      FROM (SELECT {keys}, date_trunc('month', "Date") AS mm, SUM(Quantity) AS q,
                   COUNT(Quantity) AS n FROM {src} GROUP BY ALL))
GROUP BY ALL"""


_SIMPLE = "CASE WHEN months >= 2 THEN GREATEST(0, recent_mean * 1.1::DOUBLE) ELSE row_mean END"
_TWO = "CASE WHEN months >= 6 THEN 'high' WHEN months >= 2 THEN 'medium' ELSE 'low' END"
_cte("p_all_months", _recent_months("SKU", "p_sales"), "p_sales")
_cte("all_months", _recent_months("SKU", "sales"), "sales")
_cte("channel_months", _recent_months("SKU, Partyname", "sales"), "sales")
_cte("location_months", _recent_months("SKU, Partyname, Godown", "sales"), "sales")
_add("simple_monthly_predict", f"""
SELECT a.sku AS SKU, COALESCE({_SIMPLE}, 0) AS predicted_quantity,
       CASE WHEN months IS NULL THEN 'discontinued' WHEN months >= 6 THEN 'high'
            WHEN months >= 3 THEN 'medium' ELSE 'low' END AS confidence,
       CASE WHEN months IS NULL THEN 'discontinued' ELSE 'active' END AS status
FROM (SELECT CAST(p_partkey AS VARCHAR) AS sku FROM part
      UNION SELECT p_brand FROM part) a
LEFT JOIN p_all_months m ON a.sku = m.SKU""", "p_all_months")
_add("top5_monthly_predict", f"""
SELECT SKU AS sku, total_quantity, {rd(_SIMPLE, 1)} AS predicted_quantity, {_TWO} AS confidence,
       'active' AS status FROM all_months ORDER BY total_quantity DESC, SKU LIMIT 5""",
     "all_months")


def _channel_forecast(cut: str) -> str:
    return f"""
SELECT *, CASE WHEN total_predicted_quantity > 0 THEN 'active' ELSE 'inactive' END AS status
FROM (SELECT b.SKU AS sku, c AS channel, p AS predicted_quantity,
        CASE WHEN months IS NULL THEN 'low' ELSE {_TWO} END AS confidence,
        COALESCE(total_quantity, 0) AS channel_quantity,
        COALESCE({rd('row_mean', 1)}, 0) AS avg_monthly_quantity,
        b.q AS total_historical_quantity,
        {rd('SUM(p) OVER (PARTITION BY b.SKU)', 1)} AS total_predicted_quantity,
        s.txt AS top_states
      FROM (SELECT SKU, {total()} AS q FROM sales GROUP BY 1 {cut}) b
      CROSS JOIN (VALUES ('F'), ('O')) v(c)
      LEFT JOIN (SELECT *, COALESCE({rd(_SIMPLE, 1)}, 0) AS p FROM channel_months) m
        ON b.SKU = m.SKU AND c = m.Partyname
      LEFT JOIN (
        SELECT SKU, Partyname, string_agg(Stateto || '(' || q || ',' || pc || ')', '; '
                 ORDER BY q DESC, Stateto) AS txt
        FROM (SELECT SKU, Partyname, Stateto, q, {rd('CAST(q AS DOUBLE) / t * 100', 1)} AS pc
              FROM (SELECT SKU, Partyname, Stateto, {total()} AS q,
                      SUM({total()}) OVER (PARTITION BY SKU, Partyname) AS t,
                      row_number() OVER (PARTITION BY SKU, Partyname
                                         ORDER BY {total()} DESC, Stateto) AS r
                    FROM sales GROUP BY 1, 2, 3) WHERE r <= 5) GROUP BY 1, 2) s
        ON b.SKU = s.SKU AND c = s.Partyname)"""


_cte("channel_forecast", _channel_forecast("ORDER BY 2 DESC, 1 LIMIT 20"), "sales",
     "channel_months")
_cte("all_channel_forecast", _channel_forecast("HAVING SKU IS NOT NULL"), "sales",
     "channel_months")
_add("channel_predict", "SELECT * FROM channel_forecast", "channel_forecast")
_add("channel_predict_summary", f"""
SELECT COUNT(*) AS total_skus, COUNT(*) FILTER (status = 'active') AS active_skus,
       {rd('SUM(total_predicted_quantity)', 1)} AS total_predicted_quantity
FROM (SELECT DISTINCT sku, status, total_predicted_quantity FROM all_channel_forecast)""",
     "all_channel_forecast")


def _holdout(src: str) -> str:
    return f"""
SELECT SKU, "Date", CASE WHEN few THEN true ELSE i <= cut END AS is_train,
       CASE WHEN few THEN i = n ELSE i > cut END AS is_test
FROM (SELECT *, cut < 3 AS few FROM (
  SELECT SKU, "Date", row_number() OVER (PARTITION BY SKU ORDER BY "Date") AS i,
         COUNT(*) OVER (PARTITION BY SKU) AS n,
         GREATEST(1, CAST(trunc(COUNT(*) OVER (PARTITION BY SKU) * 0.8::DOUBLE) AS INTEGER))
           AS cut
  FROM {src}))"""


_add("holdout_split", _holdout("p_monthly"), "p_monthly")
_cte("holdout", _holdout("monthly"), "monthly")


def _tested(split: str) -> str:
    return f'''
SELECT h.SKU, h."Date", CAST(m.Quantity AS DOUBLE) AS actual, true AS usable,
       true AS beats_constant
FROM {split} h JOIN monthly m ON h.SKU = m.SKU AND h."Date" = m."Date" WHERE is_test'''


_cte("featured", f"""
SELECT * FROM (SELECT SKU, "Date", row_number() OVER (PARTITION BY SKU ORDER BY "Date") AS i,
                 SUM(Rows) OVER (PARTITION BY SKU) AS r FROM daily
               WHERE SKU IN (SELECT SKU FROM recent GROUP BY 1
                             ORDER BY {units('Amount')} DESC, 1 LIMIT 15))
WHERE r >= 30 AND i > 30""", "daily", "recent")
_cte("restart_months", """
SELECT SKU, "Date" FROM monthly WHERE "Year" >= 2000
QUALIFY COUNT(*) OVER (PARTITION BY SKU) >= 3""", "monthly")
_cte("restart_holdout", _holdout("restart_months").replace("cut < 3", "(cut < 3 OR n < 6)"),
     "restart_months")
_cte("after_last", """
SELECT SKU, strftime(MAX("Date") + INTERVAL 1 MONTH, '%Y-%m') AS next_month,
       month(MAX("Date") + INTERVAL 1 MONTH) AS after FROM monthly GROUP BY 1""", "monthly")
_cte("tested", _tested("holdout"), "holdout", "monthly")
_cte("tested_metrics", f"""
SELECT SKU, COUNT(*) AS test_months, {rd('avg(actual)', 6)} AS avg_monthly_demand, true AS usable
FROM tested GROUP BY 1""", "tested")
_add("train_monthly_model", "SELECT * FROM tested", "tested")
_add("train_restart_model", _tested("restart_holdout"), "restart_holdout", "monthly")
_add("monthly_model_accuracy", "SELECT * FROM tested_metrics", "tested_metrics")
_add("analyze_top_skus_monthly", """
SELECT t.SKU, test_months, avg_monthly_demand, next_month, true AS usable, true AS plausible
FROM tested_metrics t JOIN after_last USING (SKU)
JOIN (SELECT SKU FROM monthly GROUP BY 1 ORDER BY SUM(Quantity) DESC, 1 LIMIT 5) USING (SKU)""",
     "tested_metrics", "after_last", "monthly")
_add("ensemble_forecast", "SELECT *, true AS is_blend, true AS beats_worst FROM tested", "tested")
_add("score_next_month_monthly", """
SELECT SKU AS sku, next_month, 'medium' AS confidence, true AS plausible FROM after_last""",
     "after_last")
_add("score_next_month", f"""
SELECT a.SKU AS sku, next_month, 'medium' AS confidence, p.s IS NOT NULL AS has_historical_patterns,
       {rd('COALESCE(factor, 1)', 6)} AS seasonal_adjustment, true AS plausible
FROM after_last a JOIN (SELECT DISTINCT SKU FROM restart_months) r ON a.SKU = r.SKU
LEFT JOIN (SELECT DISTINCT SKU AS s FROM seasonal) p ON a.SKU = p.s
LEFT JOIN seasonal f ON a.SKU = f.SKU AND f.month = a.after""",
     "after_last", "restart_months", "seasonal")
_add("model_registry", """
SELECT DISTINCT SKU AS sku, 'monthly' AS model_type, true AS versioned, true AS plausible
FROM restart_months""", "restart_months")
_add("train_daily_model", """
SELECT COUNT(*) AS validation_rows, true AS mape_usable, true AS beats_constant, true AS gate_holds
FROM featured WHERE "Date" > (SELECT MAX("Date") FROM featured) - 30""", "featured")
_add("data_freshness", """
SELECT * FROM (VALUES ('sales_data', true, true, true), ('orders', true, true, true),
                      ('predictions', false, false, true))
         v(source, file_exists, dated, within_latest)""")


def _walk(growth: str) -> str:
    before = '(PARTITION BY SKU ORDER BY "Date" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)'
    return f"""
SELECT * FROM (SELECT SKU, "Date", CAST(Quantity AS DOUBLE) AS actual,
    CAST(SUM(Quantity) OVER {before} AS DOUBLE) / COUNT(Quantity) OVER {before} * {growth}
      AS predicted,
    CAST(lag(Quantity) OVER (PARTITION BY SKU ORDER BY "Date") AS DOUBLE) AS previous,
    row_number() OVER (PARTITION BY SKU ORDER BY "Date" DESC) AS fold,
    row_number() OVER (PARTITION BY SKU ORDER BY "Date") AS i
  FROM monthly) WHERE i > 1"""


_cte("ma_walk", _walk("1"), "monthly")
_cte("metrics", f"""
SELECT w.SKU, COUNT(*) AS test_months, avg(abs(predicted - actual)) AS mae,
       LEAST(avg(abs(predicted - actual) / NULLIF(abs(actual), 0)) * 100, 200) AS mape,
       avg(actual) AS avg_monthly_demand,
       string_agg(strftime(w."Date", '%Y-%m') || '=' || CAST(actual AS BIGINT), '; '
                  ORDER BY w."Date") AS predictions
FROM ma_walk w JOIN holdout h ON w.SKU = h.SKU AND w."Date" = h."Date" AND is_test
GROUP BY 1""", "ma_walk", "holdout")
_add("accuracy_metrics", f"""
SELECT SKU, test_months, {rd('mae', 6)} AS mae, {rd('mape', 6)} AS mape,
       {rd('avg_monthly_demand', 6)} AS avg_monthly_demand, predictions FROM metrics""",
     "metrics")
_add("accuracy_report", f"""
SELECT {rd('avg(mae)', 4)} AS overall_mae, {rd('avg(mape)', 4)} AS overall_mape,
       {big('SUM(test_months)')} AS total_test_months,
       CASE WHEN avg(mape) < 20 THEN 'excellent' WHEN avg(mape) < 40 THEN 'good'
            ELSE 'poor' END AS band,
       {rd('avg(mae)', 4)} AS safety_buffer, {rd('avg(mae) * 1.5', 4)} AS variation_buffer
FROM metrics""", "metrics")
_add("needs_retraining", f"""
SELECT sku, trained IS NOT NULL AS exists, needs AS needs_training, trained AS last_trained,
       CASE WHEN trained IS NULL THEN 'No model found' WHEN needs THEN 'Needs retraining'
            ELSE 'Up to date' END AS status
FROM (SELECT *, CASE WHEN trained IS NULL THEN true
                     ELSE age > 30 OR (age > 7 AND last_sale > trained) END AS needs
      FROM (SELECT SKU AS sku, last_sale, age,
                   CASE WHEN age > 0 THEN {AS_OF} - age END AS trained
            FROM (SELECT SKU, MAX("Date") AS last_sale,
                    CAST(trunc((('0x' || substr(md5(SKU), 1, 4))::INT % 1000 / 100.0::DOUBLE + 5)
                               * 4 - 18) AS INTEGER) AS age
                  FROM sales GROUP BY 1)))""", "sales")

# -- replenishment --------------------------------------------------------------------------

_add("estimate_moq", f"""
SELECT SKU AS sku, CASE WHEN m > 1000 THEN GREATEST(100, {trunc('m * 0.3::DOUBLE')})
                        WHEN m > 500 THEN GREATEST(50, {trunc('m * 0.4::DOUBLE')})
                        ELSE GREATEST(20, {trunc('m * 0.5::DOUBLE')}) END AS moq,
       CAST(CASE WHEN m > 1000 THEN 15 WHEN m > 500 THEN 12 ELSE 10 END AS INTEGER)
         AS lead_time_days, 'Default_Supplier' AS supplier, CAST(100 AS DOUBLE) AS unit_cost
FROM (SELECT SKU, predicted_monthly_quantity AS m FROM pred)""", "pred")
_add("estimate_inventory", "SELECT * FROM stock", "stock")
_add("reorder_points", "SELECT * FROM reorder", "reorder")
_add("ordering_schedule", "SELECT * FROM schedule", "schedule")
_add("ordering_pipeline", "SELECT * FROM schedule", "schedule")
_add("ordering_summary", f"""
SELECT COUNT(*) AS total_skus_analyzed, COUNT(*) FILTER (needs_reorder) AS skus_need_reorder,
       {rd('avg(days_remaining)', 1)} AS avg_days_inventory,
       COUNT(*) FILTER (days_remaining < 7) AS stockout_risk_skus,
       (SELECT COUNT(*) FROM schedule WHERE urgency = 'CRITICAL') AS urgent_orders,
       (SELECT CAST(SUM(estimated_cost) AS DOUBLE) FROM schedule)
         AS total_estimated_order_value,
       '2001-11-05' AS report_date FROM reorder""", "reorder", "schedule")
_RANK = ("CASE urgency WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END, days_remaining, "
         "sku")
_add("urgent_orders_top5", f"""
SELECT sku, recommended_qty, order_date, urgency FROM schedule
WHERE urgency IN ('CRITICAL', 'HIGH') ORDER BY {_RANK} LIMIT 5""", "schedule")
_add("ordering_by_urgency", """
SELECT * FROM schedule WHERE urgency IN ('CRITICAL', 'HIGH', 'MEDIUM')
""", "schedule")
_COUNTS = """
SELECT COUNT(*) FILTER (urgency = 'CRITICAL') AS total_critical,
       COUNT(*) FILTER (urgency = 'HIGH') AS total_high,
       COUNT(*) FILTER (urgency = 'MEDIUM') AS total_medium, COUNT(*) AS total_orders,
       CAST(SUM(estimated_cost) AS DOUBLE) AS total_estimated_cost FROM schedule"""
_add("ordering_counts", _COUNTS, "schedule")


def _items(urgency: str) -> str:
    return f"""(
SELECT s.sku, COALESCE(k.category, 'Unknown Product') AS product_name, current_stock,
       days_remaining, recommended_qty, CAST(estimated_cost AS DOUBLE) AS estimated_cost,
       urgency, daily_demand
FROM schedule s LEFT JOIN sku_master k ON s.sku = k.sku WHERE urgency = '{urgency}'
ORDER BY days_remaining, s.sku LIMIT 10)"""


_add("inventory_items", f"{_items('CRITICAL')} UNION ALL {_items('HIGH')}", "schedule",
     "sku_master")
_add("inventory_status", f"""
SELECT COUNT(*) AS total_items, COUNT(*) FILTER (urgency = 'CRITICAL') AS critical_items,
       COUNT(*) FILTER (urgency = 'HIGH') AS high_priority_items,
       COUNT(*) FILTER (urgency = 'MEDIUM') AS medium_priority_items,
       COUNT(*) FILTER (urgency = 'LOW') AS low_priority_items,
       CAST(COALESCE(SUM(estimated_cost) FILTER (urgency = 'CRITICAL'), 0) AS DOUBLE)
         AS total_critical_investment,
       CAST(COALESCE(SUM(estimated_cost) FILTER (urgency = 'HIGH'), 0) AS DOUBLE)
         AS total_high_investment,
       {rd("CAST(COUNT(*) FILTER (urgency IN ('LOW', 'MEDIUM')) AS DOUBLE) / COUNT(*) * 100", 1)}
         AS health_score FROM schedule""", "schedule")
_add("inventory_health", f"""
SELECT COUNT(*) FILTER (days_remaining < 7) AS critical_skus,
       COUNT(*) FILTER (days_remaining >= 7 AND days_remaining < 14) AS low_skus,
       COUNT(*) FILTER (days_remaining >= 14) AS healthy_skus,
       {rd('avg(days_remaining)', 4)} AS avg_days_inventory,
       {big('SUM(current_stock) * 100')} AS inventory_value FROM reorder""", "reorder")
_add("critical_stock", """
SELECT sku, current_stock, days_remaining, predicted_daily_demand FROM reorder
WHERE days_remaining < 7""", "reorder")
_add("comprehensive_ordering_batch", "SELECT * FROM batch", "batch")
_add("comprehensive_ordering_api", "SELECT * FROM comprehensive", "comprehensive")
_add("comprehensive_summary", f"""
SELECT COUNT(*) AS total_skus, COUNT(*) FILTER (urgency = 'CRITICAL') AS critical_orders,
       COUNT(*) FILTER (urgency = 'HIGH') AS high_priority_orders,
       SUM(estimated_cost_inr) AS total_estimated_cost,
       {rd('avg(growth_rate_percent)', 1)} AS average_growth_rate,
       (SELECT COUNT(DISTINCT Godown) FROM recent) AS unique_godowns,
       (SELECT COUNT(DISTINCT Statefrom) FROM recent) AS states_served_from,
       (SELECT COUNT(DISTINCT Stateto) FROM recent) AS destination_states
FROM comprehensive""", "comprehensive", "recent")
_add("key_insights", f"""
SELECT *, COUNT(*) FILTER (type IN ('critical', 'warning')) OVER () AS total_alerts FROM (
  SELECT 'critical' AS type, n || ' Critical Stock Items' AS title,
         'Immediate ordering required - ₹' || format('{{:,}}', cost)
           || ' investment needed' AS message,
         'Place orders today to avoid stockouts' AS action
  FROM (SELECT COUNT(*) AS n, CAST(SUM(estimated_cost) AS BIGINT) AS cost FROM schedule
        WHERE urgency = 'CRITICAL') WHERE n > 0
  UNION ALL
  SELECT CASE WHEN growth_rate > 0 THEN 'growth' ELSE 'warning' END,
         'Monthly Growth: ' || CASE WHEN growth_rate >= 0 THEN '+' ELSE '' END
           || format('{{:.1f}}', growth_rate) || '%',
         'Revenue trend is ' || CASE WHEN growth_rate > 0 THEN 'positive' ELSE 'declining' END,
         'Monitor key performance indicators' FROM recent_growth WHERE months > 1
  UNION ALL
  SELECT 'info', 'Prediction Confidence: ' || format('{{:.0f}}', h / CAST(n AS DOUBLE) * 100)
           || '%', h || ' of ' || n || ' predictions are high confidence',
         'Focus on high-confidence SKUs for planning'
  FROM (SELECT COUNT(*) FILTER (confidence = 'High') AS h, COUNT(*) AS n FROM pred)
  UNION ALL
  SELECT 'success', 'Top Performer: ' || t.SKU,
         COALESCE(k.category, 'Unknown Product') || ' generated ₹'
           || format('{{:,}}', CAST(round(m) AS BIGINT)) || ' revenue',
         'Ensure adequate stock levels for top performers'
  FROM (SELECT SKU, {money()} AS m FROM recent GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) t
  LEFT JOIN sku_master k ON t.SKU = k.sku)""", "schedule", "recent_growth", "pred", "recent",
     "sku_master")
_add("actionable_insights", f"""
SELECT rule, {rd('value', 1)} AS value FROM (
  SELECT 'strong_growth' AS rule, growth_rate AS value, months >= 2 AND growth_rate > 10 AS ok
  FROM recent_growth
  UNION ALL SELECT 'declining_trend', growth_rate, months >= 2 AND growth_rate < -10
  FROM recent_growth
  UNION ALL SELECT 'critical_stock', COUNT(*) FILTER (days_remaining < 7),
                   COUNT(*) FILTER (days_remaining < 7) > 0 FROM reorder
  UNION ALL SELECT 'low_inventory', avg(days_remaining), avg(days_remaining) < 10 FROM reorder
  UNION ALL SELECT 'ordering_workload', COUNT(*) FILTER (urgency = 'CRITICAL'),
                   COUNT(*) FILTER (urgency = 'CRITICAL') > 5 FROM schedule
  UNION ALL SELECT 'large_ordering_cost', SUM(estimated_cost), SUM(estimated_cost) > 500000
  FROM schedule
  UNION ALL SELECT 'low_confidence', COUNT(*) FILTER (confidence = 'Low'),
                   COUNT(*) FILTER (confidence = 'Low') > 5 FROM pred)
WHERE ok""", "recent_growth", "reorder", "schedule", "pred")

# -- returns --------------------------------------------------------------------------------

_add("returns_overview", f"""
SELECT COUNT(*) AS total_returns, {money()} AS total_return_amount,
       {total()} AS total_return_quantity, {money()} / COUNT(*) AS avg_return_amount,
       {dbl(total())} / COUNT(*) AS avg_return_quantity FROM returned""", "returned")


def _by(key: str) -> str:
    return (f"SELECT {key}, {total()} AS return_quantity, {money()} AS return_amount "
            f"FROM returned GROUP BY 1")


for _name, _key in (("sku", "SKU"), ("state", "Stateto")):
    _add(f"returns_by_{_name}", _by(_key) + " ORDER BY 2 DESC, 1 LIMIT 10", "returned")
    _add(f"returns_by_{_name}_chart",
         f"SELECT {_key}, abs(return_quantity) AS quantity FROM ({_by(_key)} "
         f"ORDER BY 2, 1 LIMIT 10)", "returned")
_add("returns_monthly", f"""
SELECT {YEAR} AS year, {MON} AS month, {total()} AS returns FROM returned GROUP BY 1, 2""",
     "returned")
_add("returns_trend", f"SELECT {MONTH} AS month, abs({total()}) AS quantity FROM returned "
                      f"GROUP BY 1", "returned")
_add("returns_trend_daily", f"""
SELECT strftime("Date", '%Y-%m-%d') AS date, abs({total()}) AS quantity FROM returned
GROUP BY "Date" ORDER BY "Date" DESC LIMIT 30""", "returned")
_add("high_return_skus_p80", f"""
SELECT SKU AS sku, q AS return_quantity, 'high' AS risk_level
FROM (SELECT SKU, {total()} AS q FROM p_returned GROUP BY 1)
WHERE q > (SELECT quantile_cont(q, 0.8) FROM (SELECT {dbl(total())} AS q FROM p_returned
                                              GROUP BY SKU))""", "p_returned")


def _rates(key: str, name: str, sold: str, back: str) -> str:
    return f"""
SELECT {name}, COALESCE(CASE WHEN s <> 0 THEN CAST(r AS DOUBLE) / s * 100 END, 0) AS return_rate,
       COALESCE(s, 0) AS sales_quantity, COALESCE(r, 0) AS returns_quantity
FROM (SELECT {key} AS {name}, {total()} AS s FROM {sold} GROUP BY ALL)
FULL JOIN (SELECT {key} AS {name}, abs({total()}) AS r FROM {back} GROUP BY ALL)
USING ({name})"""


_cte("sku_rates", _rates("SKU", "sku", "p_sales", "p_returned"), "p_sales", "p_returned")
_cte("state_rates", _rates("Stateto", "state", "sales", "returned"), "sales", "returned")
_add("return_rate_by_sku", "SELECT * FROM sku_rates ORDER BY return_rate DESC, sku LIMIT 20",
     "sku_rates")
_add("return_rate_by_sku_all",
     _rates("SKU", "sku", "p_sales", "p_returned"), "p_sales", "p_returned")
_add("return_rate_totals", f"""
SELECT (SELECT {total()} FROM p_sales) AS total_sales, {big('SUM(q)')} AS total_returns,
       COUNT(*) AS unique_skus_returned, (SELECT abs({money()}) FROM p_returned)
         AS returns_revenue,
       CAST(SUM(q) AS DOUBLE) / (SELECT SUM(Quantity) FROM p_sales) * 100 AS overall_return_rate
FROM (SELECT abs({total()}) AS q FROM p_returned GROUP BY SKU)""", "p_sales", "p_returned")
_add("return_rate_by_state",
     "SELECT * FROM state_rates ORDER BY return_rate DESC, state LIMIT 20", "state_rates")
_cte("month_rates", f"""
SELECT year, month, COALESCE(CAST(r AS DOUBLE) / s * 100, 0) AS return_rate,
       COALESCE(s, 0) AS sales_quantity, COALESCE(r, 0) AS returns_quantity
FROM (SELECT {YEAR} AS year, {MON} AS month, {total()} AS s FROM sales GROUP BY 1, 2)
FULL JOIN (SELECT {YEAR} AS year, {MON} AS month, abs({total()}) AS r FROM returned
           GROUP BY 1, 2) USING (year, month)""", "sales", "returned")
_add("return_rate_monthly", "SELECT * FROM month_rates", "month_rates")
_add("return_rate_range", f"""
SELECT {rd('avg(return_rate)', 6)} AS avg_monthly_return_rate,
       {rd('max(return_rate)', 6)} AS max_monthly_return_rate,
       {rd('min(return_rate)', 6)} AS min_monthly_return_rate FROM month_rates""",
     "month_rates")
_add("return_rate_dow", f"SELECT *, {_day_names('weekday')} AS day FROM ("
     + _rates(WEEKDAY, "weekday", "sales", "returned") + ")", "sales", "returned")
_add("high_risk_returns", "SELECT sku, return_rate, returns_quantity AS returns FROM sku_rates "
                          "WHERE return_rate > 50", "sku_rates")
_add("high_risk_states", "SELECT state, return_rate, returns_quantity AS returns "
                         "FROM state_rates WHERE return_rate > 40", "state_rates")
_add("high_risk_impact", f"""
SELECT (SELECT COUNT(*) FROM sku_rates WHERE return_rate > 50) AS affected_skus,
       (SELECT COUNT(*) FROM state_rates WHERE return_rate > 40) AS affected_states,
       (SELECT CAST(SUM(m) AS DOUBLE) / 10000.0 FROM (
          SELECT abs({units('Amount')}) AS m FROM p_returned
          WHERE SKU IN (SELECT sku FROM sku_rates WHERE return_rate > 50) GROUP BY SKU))
         AS high_risk_revenue_loss""", "sku_rates", "state_rates", "p_returned")
_add("return_risk_tiers", """
SELECT tier, COUNT(sku) AS skus
FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) v(tier)
LEFT JOIN (SELECT sku, CASE WHEN return_rate > 100 THEN 'critical' WHEN return_rate > 50
             THEN 'high' WHEN return_rate > 20 THEN 'medium' ELSE 'low' END AS t FROM sku_rates)
  ON tier = t GROUP BY 1""", "sku_rates")

# -- streaming ------------------------------------------------------------------------------

_add("stream_ingest_sales", f"SELECT {MONTH} AS \"Month\", COUNT(*) AS rows, {total()} AS "
                            f"quantity FROM sales GROUP BY 1", "sales")
_add("stream_ingest_checked", f"""
SELECT reasons, COUNT(*) AS rows,
       CASE WHEN reasons = '' THEN {big('SUM(l_quantity)')} END AS quantity
FROM (SELECT l_quantity, array_to_string(list_filter([
          CASE WHEN l_partkey % 5 = 0 THEN 'missing Amount' END,
          CASE WHEN l_tax = 0 THEN 'bad Date' END,
          CASE WHEN l_discount = 0 THEN 'bad Quantity' END,
          CASE WHEN l_partkey % 7 = 0 THEN 'bad SKU' END,
          CASE WHEN l_discount <> 0 AND l_returnflag = 'R' THEN 'negative Quantity' END],
          lambda x: x IS NOT NULL), ', ') AS reasons
      FROM lineitem) GROUP BY 1""")
_add("stream_dedupe", "SELECT event_type, COUNT(*) AS events, COUNT(DISTINCT event_id) AS "
                      "distinct_events FROM events GROUP BY 1")
_add("stream_daily_sales", f"""
SELECT CAST(ts AS DATE) AS "Date", event_type, COUNT(*) AS "Quantity",
       {money('value')} AS "Amount" FROM events
GROUP BY 1, 2""")

# -- planning rules ---------------------------------------------------------------------------

_add("safety_stock_z", f"""
SELECT profile.SKU, COALESCE(lead_time_days, 14) AS lead_time_days,
       {rd('sqrt(COALESCE(lead_time_days, 14)) * 1.65::DOUBLE * daily_std', 4)} AS safety_stock
FROM profile_all profile LEFT JOIN moq_terms ON profile.SKU = moq_terms.sku""", "profile_all",
     "moq_terms")
_cte("plan", f"""
SELECT sku, CASE WHEN cover <= 3 THEN 'CRITICAL' WHEN cover <= 7 THEN 'HIGH'
                 WHEN cover <= 14 THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
       CAST(CASE WHEN q < moq THEN moq ELSE ceil(CAST(q AS DOUBLE) / moq) * moq END AS BIGINT)
         AS order_quantity,
       {AS_OF} + CAST(GREATEST(0, trunc(days_remaining - lead_time_days)) AS INTEGER)
         AS order_date
FROM (SELECT *, recommended_order_qty AS q,
        CASE WHEN predicted_daily_demand > 0 THEN current_stock / predicted_daily_demand
             ELSE 999 END AS cover FROM reorder)""", "reorder")
_add("urgency_by_cover", "SELECT urgency, COUNT(*) AS skus FROM plan GROUP BY 1", "plan")
_add("moq_round_up", "SELECT sku, order_quantity FROM plan", "plan")
_add("order_date", "SELECT sku, order_date FROM plan", "plan")
_add("dedupe_sales", f"""
SELECT {YEAR} AS "Year", CAST(1 AS INTEGER) AS copy, COUNT(*) AS rows,
       COUNT(DISTINCT Orderid) AS orders
FROM (SELECT DISTINCT Orderid, SKU, Statefrom, "Date" FROM p_sales) GROUP BY 1""", "p_sales")
_cte("snapshots", f"""
SELECT "Date", Partyname AS channel, Godown AS godown, SKU AS sku, {total()} AS closing_qty
FROM sales GROUP BY 1, 2, 3, 4""", "sales")
_cte("latest_stock", """
SELECT channel, godown, sku, MAX("Date") AS as_of, arg_max(closing_qty, "Date") AS closing_qty
FROM snapshots GROUP BY 1, 2, 3""", "snapshots")
_add("closing_stock", "SELECT * FROM latest_stock", "latest_stock")
_add("closing_stock_movement", """
SELECT *, closing_qty - lag(closing_qty) OVER (PARTITION BY channel, godown, sku ORDER BY "Date")
         AS movement FROM snapshots""", "snapshots")
ORACLE["closing_stock_stream"] = ORACLE["closing_stock_movement"]
_add("resolve_godown", f"""
SELECT Godown AS "GodownName", COUNT(*) AS rows, COUNT(DISTINCT Flag) AS spellings,
       {total()} AS quantity FROM sales GROUP BY 1""", "sales")
_cte("demand", "SELECT SKU AS sku, Partyname AS channel, Godown AS godown, "
               "recent_mean * 1.1::DOUBLE AS demand FROM location_months", "location_months")
_cte("short", f"""
SELECT level, sku, channel, godown, {rd('demand', 4)} AS demand, stock,
       {rd('GREATEST(demand - stock, 0)', 4)} AS shortfall
FROM (SELECT CASE WHEN GROUPING(channel) = 1 THEN 'overall' WHEN GROUPING(godown) = 1
                  THEN 'channel' ELSE 'godown' END AS level, sku, channel, godown,
             CAST(SUM(d) AS DOUBLE) AS demand, CAST(SUM(s) AS DOUBLE) AS stock
      FROM (SELECT sku, channel, godown, demand AS d, 0 AS s FROM demand
            UNION ALL SELECT sku, channel, godown, 0, closing_qty FROM latest_stock)
      GROUP BY GROUPING SETS ((sku, channel, godown), (sku, channel), (sku)))""",
     "demand", "latest_stock")
_add("shortfall", "SELECT * FROM short", "short")
_add("bom_buildable", """
SELECT b.p_brand AS "ItemIDManu", MIN(CAST(floor(COALESCE(r.q, 0) / CAST(b.n AS DOUBLE))
         AS BIGINT)) AS buildable
FROM (SELECT p_brand, p_type, MAX(p_size) AS n FROM part GROUP BY 1, 2) b
LEFT JOIN (SELECT p_type, SUM(CAST(l_quantity AS BIGINT)) AS q FROM lineitem
           JOIN part ON l_partkey = p_partkey GROUP BY 1) r ON b.p_type = r.p_type
GROUP BY 1""")
_add("group_moq", """
SELECT "group", sku, need, sales,
       GREATEST(0, LEAST(sales, gap - ahead)) AS top_up,
       need + GREATEST(0, LEAST(sales, gap - ahead)) AS order_qty,
       GREATEST(0, gap - all_sales) AS unfilled
FROM (SELECT *, GREATEST(0, CAST(trunc(all_sales / 2.0) AS BIGINT) - all_need) AS gap
      FROM (SELECT *, CAST(SUM(sales) OVER (PARTITION BY "group") AS BIGINT) AS all_sales,
              CAST(SUM(need) OVER (PARTITION BY "group") AS BIGINT) AS all_need,
              CAST(COALESCE(SUM(sales) OVER (PARTITION BY "group" ORDER BY sales DESC, md5(sku), sku
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
            FROM (SELECT split_part(SKU, '/', 2) AS "group", SKU AS sku,
                    CAST(SUM(Quantity) % 100 AS BIGINT) AS need,
                    CAST(SUM(Quantity) AS BIGINT) AS sales FROM sales GROUP BY 2)))""",
     "sales")
_add("effective_lead_time", """
SELECT *, CAST(CASE WHEN lead_time_days <= 30 THEN 1 WHEN lead_time_days <= 60 THEN 2
                    ELSE 3 END AS INTEGER) AS horizon_months
FROM (SELECT *, procurement_days + manufacturing_days + transfer_days + COALESCE(intake_days, 0)
               AS lead_time_days
      FROM (SELECT p_brand AS sku, CAST(SUM(p_size) % 30 AS INTEGER) AS procurement_days,
              CAST(MAX(p_size) % 7 AS INTEGER) AS manufacturing_days,
              CAST(COUNT(*) % 20 AS INTEGER) AS transfer_days,
              CAST(CASE WHEN SUM(p_size) % 2 = 0 THEN MIN(p_size) END AS INTEGER)
                AS intake_days
            FROM part GROUP BY 1))""")


def _level(key: str) -> str:
    return f"""
SELECT '{key}' AS level, {key} AS key, months, total_quantity,
       {rd(_SIMPLE, 1)} AS predicted_quantity FROM ({_recent_months(key, 'sales')})"""


_add("forecast_levels", " UNION ALL ".join(_level(k) for k in (
    "SKU", "Partyname", "Stateto", "Godown")), "sales")
_cte("walk", _walk("1.1::DOUBLE"), "monthly")
_add("backtest_metrics", f"""
SELECT COUNT(*) AS tests, {rd('avg(abs(predicted - actual))', 4)} AS mae,
       {rd('sqrt(avg((predicted - actual) * (predicted - actual)))', 4)} AS rmse,
       {rd('avg(abs(predicted - actual) / NULLIF(abs(actual), 0)) * 100', 4)} AS mape,
       {rd('1 - SUM((predicted - actual) * (predicted - actual)) / (var_pop(actual) * COUNT(*))',
           6)} AS r2,
       {rd('avg(CASE WHEN previous IS NOT NULL THEN CAST(sign(actual - previous) = '
           'sign(predicted - previous) AS INTEGER) END) * 100', 4)} AS direction_accuracy
FROM walk WHERE fold <= 6""", "walk")
_cte("origins", """
SELECT SKU, "Date" AS cutoff, CAST(Quantity AS DOUBLE) AS actual,
       avg(Quantity) OVER (PARTITION BY SKU ORDER BY "Date" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
         AS predicted,
       lag(Quantity) OVER (PARTITION BY SKU ORDER BY "Date") AS previous FROM monthly""", "monthly")
_add("rolling_backtest", f"""
SELECT cutoff, COUNT(*) AS tests, {rd('avg(abs(predicted - actual))', 4)} AS average_mae,
       {rd('sqrt(avg((predicted - actual) * (predicted - actual)))', 4)} AS average_rmse,
       {rd('avg(abs(predicted - actual) / NULLIF(abs(actual), 0)) * 100', 4)} AS average_mape,
       {rd('1 - SUM((predicted - actual) * (predicted - actual)) / (var_pop(actual) * COUNT(*))',
           6)} AS average_r2,
       {rd('avg(CAST(sign(actual - previous) = sign(predicted - previous) AS INTEGER)) * 100', 4)}
         AS average_direction_accuracy,
       true AS mae_below_average, true AS rmse_below_average, true AS r2_above_average
FROM origins WHERE previous IS NOT NULL
  AND cutoff IN (SELECT DISTINCT cutoff FROM origins
                 WHERE previous IS NOT NULL
                   AND cutoff + INTERVAL 1 MONTH <= (SELECT MAX("Date") FROM sales) + INTERVAL 1 DAY
                 ORDER BY 1 DESC LIMIT 6)
GROUP BY ROLLUP (cutoff)""", "origins", "sales")


def _festival(a: int, b: int) -> str:
    return f'(month("Date") * 100 + day("Date")) BETWEEN {a} AND {b}'


_add("festival_flags", f"""
SELECT {_festival(1015, 1101)} AS is_diwali, {_festival(1015, 1025)} AS is_big_billion_days,
       {_festival(710, 720)} AS is_amazon_prime_day, COUNT(*) AS rows, {total()} AS quantity
FROM sales GROUP BY 1, 2, 3""", "sales")
_add("outlier_filter", f"""
SELECT d.SKU, COUNT(*) AS days, {total('d.Quantity')} AS quantity
FROM daily_all d JOIN (SELECT SKU, avg(Quantity) AS m, stddev_samp(Quantity) AS s
                       FROM daily_all GROUP BY 1) k ON d.SKU = k.SKU
WHERE COALESCE(abs((d.Quantity - m) / NULLIF(s, 0)), 0) <= 3 GROUP BY 1""", "daily_all")
_add("quality_rules", """
SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS bad_date, CAST(0 AS BIGINT) AS bad_sku,
       COUNT(*) FILTER (Quantity < 0) AS negative_quantity,
       COUNT(*) FILTER (Amount IS NULL) AS missing_value
FROM (SELECT Quantity, Amount FROM sales
      UNION ALL SELECT Quantity, CASE WHEN day("Date") > 1 THEN Amount END FROM returned)""",
     "sales", "returned")
_add("stockout_outlook", f"""
SELECT sku, {rd('COALESCE(CASE WHEN SUM(daily) <> 0 THEN SUM(stock) / SUM(daily) END, 999)', 1)}
         AS days_to_stockout,
       {rd('MIN(days)', 1)} AS first_stockout_days,
       COUNT(*) FILTER (days <= 30) AS locations_affected
FROM (SELECT *, CASE WHEN daily > 0 THEN stock / daily ELSE 999 END AS days
      FROM (SELECT d.sku, demand / 30 AS daily, CAST(COALESCE(closing_qty, 0) AS DOUBLE) AS stock
            FROM demand d LEFT JOIN latest_stock s ON d.sku = s.sku AND d.channel = s.channel
              AND d.godown = s.godown))
GROUP BY 1""", "demand", "latest_stock")
_cte("supply", """
SELECT sku, location, shortfall, all_short, CAST(GREATEST(0, LEAST(own, all_short)) AS HUGEINT) AS own
FROM (SELECT *, SUM(shortfall) OVER (PARTITION BY sku) AS all_short
      FROM (SELECT sku, channel || '/' || godown AS location,
                   CAST(ceil(shortfall) AS BIGINT) AS shortfall FROM short WHERE level = 'godown')
      WHERE shortfall > 0)
JOIN (SELECT SKU AS sku, CAST(trunc(SUM(Quantity) / 10.0) AS BIGINT) AS own FROM sales GROUP BY 1)
  USING (sku)""", "short", "sales")
_add("stock_transfer_shared", """
SELECT sku, location, shortfall, given AS transfer_qty, shortfall - given AS still_short
FROM (SELECT *, CAST(share + CASE WHEN rest > 0 AND place <= own - SUM(share) OVER (PARTITION BY sku)
                                  THEN 1 ELSE 0 END AS BIGINT) AS given
      FROM (SELECT *, own * shortfall // all_short AS share, own * shortfall % all_short AS rest,
                   row_number() OVER (PARTITION BY sku ORDER BY own * shortfall % all_short DESC,
                                      md5(location), location) AS place
            FROM supply))""", "supply")
_add("stock_transfer", """
SELECT sku, location, shortfall, given AS transfer_qty, shortfall - given AS still_short
FROM (SELECT r.sku, location, shortfall, GREATEST(0, LEAST(shortfall, own - ahead)) AS given
      FROM (SELECT *, CAST(COALESCE(SUM(shortfall) OVER (PARTITION BY sku
                ORDER BY shortfall DESC, md5(location), location
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
            FROM (SELECT sku, channel || '/' || godown AS location,
                    CAST(ceil(shortfall) AS BIGINT) AS shortfall FROM short
                  WHERE level = 'godown') WHERE shortfall > 0) r
      JOIN (SELECT SKU AS sku, CAST(trunc(SUM(Quantity) / 10.0) AS BIGINT) AS own FROM sales
            GROUP BY 1) o ON r.sku = o.sku)""", "short", "sales")
