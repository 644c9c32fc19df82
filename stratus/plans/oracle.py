"""Independent DuckDB SQL for every driver-table query (the correctness
oracle). Views ``lineitem``, ``supplier``, ``nation``, ``orders``,
``events`` … are registered by the caller.

Two helpers keep the comparison exact rather than approximately equal:

* ``_r(x, n)`` rounds HALF_UP on the shortest decimal text of the double,
  which is what Spark's ``round`` does (DuckDB's own ROUND works on the
  binary value and differs at ties). ``DECIMAL(38,18)`` keeps the text
  exact — narrower decimals round it on the way in.
* ``_mean(x)`` / ``_sum(x)`` are the order-independent decimal forms that
  the Spark side uses with ``scale=2``.
"""

from __future__ import annotations


def _r(x: str, n: int) -> str:
    return f"CAST(ROUND(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), {n}) AS DOUBLE)"


def _sum(x: str, s: int = 2) -> str:
    return f"(SUM(CAST(({x}) AS DECIMAL(18,{s})))::DOUBLE)"


def _mean(x: str, s: int = 2) -> str:
    return f"({_sum(x, s)} / NULLIF(COUNT({x}), 0))"


_IS_DAY = "(hour(ts) >= 6 AND hour(ts) < 18)"

_SEASON = """CASE WHEN month(l_shipdate) IN (12,1,2) THEN 'winter'
                  WHEN month(l_shipdate) IN (3,4,5) THEN 'spring'
                  WHEN month(l_shipdate) IN (6,7,8) THEN 'summer'
                  WHEN month(l_shipdate) IN (9,10,11) THEN 'autumn' END"""

_L = f"""L AS (
  SELECT n.n_name, li.l_shipdate, li.l_quantity, li.l_extendedprice, li.l_discount, li.l_tax,
         CAST(year(li.l_shipdate) AS INTEGER) AS year,
         CAST(month(li.l_shipdate) AS INTEGER) AS month,
         CAST(li.l_shipdate AS DATE) AS date,
         {_SEASON.replace('l_shipdate', 'li.l_shipdate')} AS season,
         CAST(CASE WHEN month(li.l_shipdate) IN (1,2) THEN year(li.l_shipdate) - 1
                   ELSE year(li.l_shipdate) END AS INTEGER) AS winter_season_year
  FROM lineitem li
  JOIN supplier s ON li.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

_EV = """EV AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def _windows(size_min: int, aggs: str, extra_cols: str = "") -> str:
    """Sliding windows of ``size_min`` minutes every 5 minutes, epoch
    aligned: each event falls into size/5 windows."""
    n = size_min // 5
    return f"""W AS (
  SELECT event_type, window_start, window_start + INTERVAL {size_min} MINUTE AS window_end,
         {aggs}
  FROM (SELECT e.*{extra_cols},
               time_bucket(INTERVAL 5 MINUTE, e.ts) - CAST(r.i AS INTEGER) * INTERVAL 5 MINUTE
                 AS window_start
        FROM EV e, range(0, {n}) r(i)) x
  GROUP BY event_type, window_start)"""


def _base(col: str, name: str, table: str = "lineitem", date_col: str = "l_shipdate") -> str:
    return f"""SELECT CAST(year({date_col}) AS INTEGER) AS hist_year,
                     CAST(month({date_col}) AS INTEGER) AS hist_month,
                     {_r(_mean(col), 3)} AS {name}
              FROM {table} GROUP BY 1, 2"""


SQL: dict[str, str] = {}

SQL["enrich"] = f"""
SELECT event_id, ts, user_id, trim(event_type) AS event_type,
       {_r('value / 3.6', 2)} AS value,
       strftime(ts, '%m-%d') AS month_day,
       CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
       CAST(ts AS DATE) AS date,
       COALESCE({_IS_DAY}, false) AS is_day,
       {_SEASON.replace('l_shipdate', 'ts')} AS season,
       CAST(CASE WHEN month(ts) IN (1,2) THEN year(ts) - 1 ELSE year(ts) END AS INTEGER)
         AS winter_season_year,
       COALESCE({_r('value / 3.6', 2)} > 3, false) AS is_large,
       COALESCE({_r('value / 3.6', 2)} > 3 AND trim(event_type) = 'view', false) AS is_large_view
FROM events"""

_RANGE = f"""
WITH D AS (
  SELECT user_id, CAST(ts AS DATE) AS d,
         max(CASE WHEN {_IS_DAY} THEN value END) AS mx,
         min(CASE WHEN NOT {_IS_DAY} THEN value END) AS mn
  FROM events GROUP BY 1, 2),
R AS (SELECT user_id, {_r('mx - mn', 2)} AS rng FROM D WHERE mx IS NOT NULL AND mn IS NOT NULL),
E AS (SELECT user_id, {_r(_mean('rng'), 2)} AS avg_range,
             {_r('max(rng)', 2)} AS max_day_range, {_r('min(rng)', 2)} AS min_day_range
      FROM R GROUP BY 1),
K AS (SELECT *, CAST(rank() OVER (ORDER BY avg_range DESC) AS INTEGER) AS rank FROM E)"""

SQL["diurnal_range_rank"] = _RANGE + "\nSELECT * FROM K"
SQL["top_k"] = _RANGE + "\nSELECT * FROM K WHERE rank <= 10"

SQL["calendar_profile"] = f"""
WITH {_L}
SELECT n_name, month,
       {_r(_mean('l_quantity'), 2)} AS avg_quantity,
       {_r(_mean('l_extendedprice'), 2)} AS avg_price,
       {_r(_mean('l_discount') + ' * 24', 2)} AS avg_daily_discount,
       {_r(_mean('l_tax'), 2)} AS avg_tax,
       {_r(_mean('l_discount'), 2)} AS avg_discount
FROM L GROUP BY n_name, month"""

SQL["flagged_days_rank"] = f"""
WITH {_L},
C AS (SELECT n_name, winter_season_year, COUNT(DISTINCT date) AS flagged_days
      FROM L WHERE month IN (12,1,2) AND l_discount > 0.08
      GROUP BY 1, 2)
SELECT *, CAST(dense_rank() OVER (PARTITION BY winter_season_year ORDER BY flagged_days DESC)
               AS INTEGER) AS rank_in_season
FROM C"""

SQL["extreme_days_rank"] = f"""
WITH {_L},
D AS (SELECT n_name, date, year, min(l_quantity) AS lo, max(l_quantity) AS hi
      FROM L GROUP BY 1, 2, 3),
F AS (SELECT *, COALESCE(lo < 2, false) AS cold, COALESCE(hi > 49, false) AS heat FROM D),
C AS (SELECT n_name, year, COUNT(*) AS total_extreme_days,
             COUNT(*) FILTER (WHERE cold) AS extreme_low_days,
             COUNT(*) FILTER (WHERE heat) AS extreme_high_days
      FROM F WHERE cold OR heat GROUP BY 1, 2)
SELECT *, CAST(dense_rank() OVER (PARTITION BY year ORDER BY total_extreme_days DESC)
               AS INTEGER) AS rank_in_year
FROM C"""

SQL["season_yoy_change"] = f"""
WITH {_L},
S AS (SELECT n_name, year, season,
             {_r(_mean('l_extendedprice'), 2)} AS avg_price,
             {_r(_mean('l_quantity') + ' * 24', 2)} AS avg_daily_quantity,
             {_r(_mean('l_tax'), 2)} AS avg_tax
      FROM L WHERE month IN (6,7,8,12,1,2) GROUP BY 1, 2, 3),
G AS (SELECT *, lag(avg_price) OVER (PARTITION BY n_name, season ORDER BY year) AS pp,
                lag(avg_daily_quantity) OVER (PARTITION BY n_name, season ORDER BY year) AS pq
      FROM S)
SELECT n_name, year, season, avg_price, avg_daily_quantity, avg_tax,
       {_r('CASE WHEN pp IS NOT NULL THEN avg_price - pp ELSE 0.0 END', 2)}
         AS price_change_vs_prev_year,
       {_r('CASE WHEN pq IS NOT NULL THEN avg_daily_quantity - pq ELSE 0.0 END', 2)}
         AS quantity_change_vs_prev_year
FROM G"""

SQL["season_step_change"] = f"""
WITH {_L},
S AS (SELECT n_name, year, season,
             {_r(_mean('l_quantity'), 2)} AS avg_quantity,
             {_r(_mean('l_discount'), 2)} AS avg_discount,
             {_r(_mean('l_tax'), 2)} AS avg_tax,
             CAST(CASE season WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 WHEN 'autumn' THEN 3
                  WHEN 'winter' THEN 4 ELSE 0 END AS INTEGER) AS season_order
      FROM L GROUP BY 1, 2, 3),
G AS (SELECT *, lag(avg_quantity) OVER (PARTITION BY n_name, year ORDER BY season_order) AS pv
      FROM S)
SELECT n_name, year, season, avg_quantity, avg_discount, avg_tax, season_order,
       {_r('CASE WHEN pv IS NOT NULL THEN avg_quantity - pv ELSE 0.0 END', 2)}
         AS quantity_change_vs_prev_season
FROM G"""

_HOURS = f"""
WITH {_L},
H AS (SELECT n_name, winter_season_year,
             COUNT(*) FILTER (WHERE l_tax > 0.04 AND l_discount < 0.05) AS flagged_count,
             COUNT(*) AS total_count
      FROM L WHERE month IN (12,1,2) GROUP BY 1, 2),
P AS (SELECT *, {_r('flagged_count / total_count * 100', 2)} AS flagged_pct FROM H)"""

SQL["flagged_hours_rank"] = _HOURS + """
SELECT *, CAST(dense_rank() OVER (PARTITION BY winter_season_year ORDER BY flagged_count ASC)
               AS INTEGER) AS rank_in_season
FROM P"""

SQL["season_vs_entity_mean"] = _HOURS + f""",
M AS (SELECT *, {_r('avg(flagged_count) OVER (PARTITION BY n_name)', 2)} AS entity_avg_count
      FROM P),
Q AS (SELECT *, {_r('flagged_count - entity_avg_count', 2)} AS diff_from_entity_avg FROM M)
SELECT *, CASE WHEN diff_from_entity_avg < -10 THEN 'znacajno ispod proseka'
               WHEN diff_from_entity_avg < 0 THEN 'ispod proseka'
               WHEN diff_from_entity_avg > 10 THEN 'znacajno iznad proseka'
               WHEN diff_from_entity_avg > 0 THEN 'iznad proseka'
               ELSE 'prosek' END AS vs_entity_avg
FROM Q"""

SQL["hot_day_cooccurrence"] = f"""
WITH {_L},
D AS (SELECT n_name, date, year, max(l_extendedprice) AS mx,
             {_r(_sum('l_quantity'), 2)} AS total
      FROM L GROUP BY 1, 2, 3),
Y AS (SELECT n_name, year, COUNT(*) AS total_hot_days,
             COUNT(*) FILTER (WHERE total > 50) AS hot_days_with_high_qty,
             {_r(_sum('total'), 2)} AS total_qty_on_hot_days
      FROM D WHERE mx > 60000 GROUP BY 1, 2),
P AS (SELECT *, {_r('hot_days_with_high_qty / total_hot_days * 100', 2)} AS high_qty_pct_yearly,
             CAST(SUM(total_hot_days) OVER (PARTITION BY n_name) AS BIGINT)
               AS total_hot_days_all_years,
             CAST(SUM(hot_days_with_high_qty) OVER (PARTITION BY n_name) AS BIGINT)
               AS total_hot_high_qty_days_all_years,
             {_r('SUM(CAST(total_qty_on_hot_days AS DECIMAL(18,2))) OVER (PARTITION BY n_name)', 2)}
               AS total_qty_all_years
      FROM Y)
SELECT *, {_r('total_hot_high_qty_days_all_years / total_hot_days_all_years * 100', 2)}
            AS high_qty_pct_all_years
FROM P"""

SQL["diurnal_oscillation_rank"] = f"""
WITH D AS (
  SELECT user_id, CAST(ts AS DATE) AS d, CAST(date_trunc('week', ts) AS DATE) AS week,
         max(CASE WHEN {_IS_DAY} THEN value END) AS mx,
         min(CASE WHEN NOT {_IS_DAY} THEN value END) AS mn
  FROM events GROUP BY 1, 2, 3),
R AS (SELECT user_id, week, {_r('mx - mn', 2)} AS osc FROM D
      WHERE mx IS NOT NULL AND mn IS NOT NULL),
P AS (SELECT user_id, week, {_r(_mean('osc'), 2)} AS avg_oscillation,
             {_r('max(osc)', 2)} AS max_oscillation, {_r('min(osc)', 2)} AS min_oscillation
      FROM R GROUP BY 1, 2),
PR AS (SELECT *, CAST(rank() OVER (PARTITION BY week ORDER BY avg_oscillation DESC) AS INTEGER)
                   AS rank_in_week FROM P),
O AS (SELECT user_id, {_r(_mean('avg_oscillation'), 2)} AS overall_avg_oscillation
      FROM PR GROUP BY 1),
OR_ AS (SELECT *, CAST(rank() OVER (ORDER BY overall_avg_oscillation DESC) AS INTEGER)
                    AS overall_rank FROM O)
SELECT PR.*, OR_.overall_avg_oscillation, OR_.overall_rank
FROM PR LEFT JOIN OR_ ON PR.user_id = OR_.user_id"""

_BUCKETS = f"""
WITH {_L},
E AS (SELECT n_name, {_r(_mean('l_quantity'), 2)} AS avg_quantity,
             {_r(_mean('l_discount') + ' * 24', 2)} AS avg_daily_discount,
             {_r(_mean('l_extendedprice'), 2)} AS avg_price
      FROM L GROUP BY 1),
B AS (SELECT *, CAST(ntile(4) OVER (ORDER BY avg_daily_discount, n_name) AS INTEGER)
                  AS discount_quartile FROM E),
BL AS (SELECT *, CASE discount_quartile WHEN 1 THEN 'Q1 - Najsuvlji' WHEN 2 THEN 'Q2 - Suvlji'
                      WHEN 3 THEN 'Q3 - Kišovitiji' WHEN 4 THEN 'Q4 - Najkišovitiji' END
                   AS quartile_label FROM B)"""

SQL["quantile_bucket"] = _BUCKETS + "\nSELECT * FROM BL"

SQL["bucket_summary"] = _BUCKETS + f"""
SELECT discount_quartile, quartile_label,
       {_r(_mean('avg_quantity'), 2)} AS avg_quantity_in_quartile,
       {_r(_mean('avg_daily_discount'), 2)} AS avg_daily_discount_in_quartile,
       {_r(_mean('avg_price'), 2)} AS avg_price_in_quartile
FROM BL GROUP BY 1, 2"""

SQL["pearson"] = f"""
WITH {_L}
SELECT {_r('corr(l_quantity, l_extendedprice)', 10)} AS pearson_correlation FROM L"""

SQL["pearson_by_entity"] = f"""
WITH {_L}
SELECT n_name, {_r('corr(l_quantity, l_extendedprice)', 10)} AS pearson_correlation
FROM L GROUP BY 1"""

SQL["distinct_entities"] = f"WITH {_L}\nSELECT DISTINCT n_name FROM L"

SQL["sliding_stats"] = f"""
WITH {_EV},
{_windows(60, f"{_r(_mean('value'), 3)} AS avg_value, min(value) AS min_value, "
              "max(value) AS max_value, COUNT(*) AS event_count")}
SELECT * FROM W"""

SQL["monthly_baseline"] = f"""
SELECT hist_year AS year, hist_month AS month, hist_avg_quantity
FROM ({_base('l_quantity', 'hist_avg_quantity')})"""

SQL["stream_vs_baseline"] = f"""
WITH {_EV},
{_windows(60, f"{_r(_mean('value'), 3)} AS stream_avg_value, COUNT(*) AS event_count")},
B AS ({_base('l_quantity', 'hist_avg_quantity')})
SELECT W.event_type, W.window_start, W.window_end, B.hist_year, B.hist_month,
       W.stream_avg_value, B.hist_avg_quantity,
       {_r('W.stream_avg_value - B.hist_avg_quantity', 3)} AS abs_deviation,
       {_r('(W.stream_avg_value - B.hist_avg_quantity) / NULLIF(B.hist_avg_quantity, 0) * 100.0', 3)}
         AS pct_deviation,
       W.event_count
FROM W JOIN B ON month(W.window_start) = B.hist_month"""

SQL["stream_vs_baseline_orders"] = f"""
WITH {_EV},
{_windows(60, f"{_r(_mean('k'), 3)} AS stream_avg_k, COUNT(*) AS event_count")},
B AS ({_base('o_totalprice', 'hist_avg_totalprice', 'orders', 'o_orderdate')})
SELECT W.event_type, W.window_start, W.window_end, B.hist_year, B.hist_month,
       W.stream_avg_k, B.hist_avg_totalprice,
       {_r('W.stream_avg_k - B.hist_avg_totalprice', 3)} AS abs_deviation,
       {_r('(W.stream_avg_k - B.hist_avg_totalprice) / NULLIF(B.hist_avg_totalprice, 0) * 100.0', 3)}
         AS pct_deviation,
       W.event_count
FROM W JOIN B ON month(W.window_start) = B.hist_month"""

SQL["flood_rule"] = f"""
WITH {_EV},
{_windows(90, f"{_r(_mean('k'), 3)} AS stream_avg_cloud, "
              f"{_r(_mean('value'), 3)} AS stream_avg_pressure, "
              f"{_r('min(value)', 3)} AS stream_min_pressure, "
              f"{_r('max(value)', 3)} AS stream_max_pressure, COUNT(*) AS event_count")},
B AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS hist_year,
             CAST(month(l_shipdate) AS INTEGER) AS hist_month,
             {_r(_mean('l_quantity'), 3)} AS hist_avg_cloud,
             {_r(_mean('l_quantity'), 3)} AS hist_avg_pressure
      FROM lineitem GROUP BY 1, 2),
J AS (SELECT W.*, B.*,
             {_r('(stream_avg_cloud - hist_avg_cloud) / (CASE WHEN hist_avg_cloud <> 0 THEN hist_avg_cloud ELSE 1.0 END) * 100.0', 3)} AS cloud_anomaly_pct,
             {_r('stream_max_pressure - stream_min_pressure', 3)} AS pressure_drop_hpa,
             {_r('hist_avg_pressure - stream_avg_pressure', 3)} AS pressure_below_hist
      FROM W JOIN B ON month(W.window_start) = B.hist_month),
A AS (SELECT *, cloud_anomaly_pct > 30.0 AS high_cloud_anomaly,
             pressure_drop_hpa > 3.0 AS pressure_drop_alert,
             pressure_below_hist >= 2.0 AS pressure_below_hist_alert FROM J)
SELECT event_type, window_start, window_end, hist_year, hist_month,
       stream_avg_cloud, hist_avg_cloud, cloud_anomaly_pct,
       stream_avg_pressure, stream_min_pressure, stream_max_pressure,
       hist_avg_pressure, pressure_drop_hpa, pressure_below_hist,
       high_cloud_anomaly, pressure_drop_alert, pressure_below_hist_alert,
       high_cloud_anomaly AND pressure_drop_alert AND pressure_below_hist_alert AS flood_risk,
       event_count
FROM A"""

SQL["heat_rule"] = f"""
WITH {_EV},
{_windows(30, "min(k) AS min_humidity, max(k) AS max_humidity, "
              f"{_mean('k', 0)} AS avg_humidity, {_mean('value')} AS avg_temp, "
              "max(value) AS max_temp")},
J AS (SELECT *, CAST(max_humidity - min_humidity AS INTEGER) AS humidity_jump FROM W)
SELECT event_type, window_start, window_end, min_humidity, max_humidity, avg_humidity,
       humidity_jump, avg_temp, max_temp,
       CASE WHEN humidity_jump > 20 OR (max_humidity > 85 AND avg_temp > 35) THEN 'CRITICAL'
            WHEN humidity_jump > 12 OR (max_humidity > 75 AND avg_temp > 33) THEN 'HIGH'
            WHEN humidity_jump > 8 THEN 'MEDIUM'
            ELSE 'LOW' END AS risk_level
FROM J"""

SQL["wind_rule"] = f"""
WITH {_EV},
{_windows(30, f"{_r(_mean('value'), 2)} AS avg_wind_speed, {_r('min(value)', 2)} AS min_wind_speed, "
              f"{_r('max(value)', 2)} AS max_wind_speed, {_r(_mean('gust'), 2)} AS avg_gust, "
              f"{_r('max(gust)', 2)} AS max_gust, {_r(_mean('dir'), 2)} AS avg_wind_dir, "
              f"{_r('min(dir)', 2)} AS min_wind_dir, {_r('max(dir)', 2)} AS max_wind_dir",
          ", CAST(e.k AS DOUBLE) AS gust, e.k * CAST(3.6 AS DOUBLE) AS dir")},
P AS (SELECT *,
        {_r('CASE WHEN min_wind_speed > 0 THEN (max_wind_speed - min_wind_speed) / min_wind_speed * 100.0 END', 2)} AS wind_speed_rise_pct,
        {_r('CASE WHEN avg_wind_speed > 0 THEN (max_gust - avg_wind_speed) / avg_wind_speed * 100.0 END', 2)} AS gust_above_avg_pct,
        fmod(abs(max_wind_dir - min_wind_dir), 360.0) AS raw_diff
      FROM W),
Q AS (SELECT *, {_r('CASE WHEN raw_diff > 180.0 THEN 360.0 - raw_diff ELSE raw_diff END', 2)}
                  AS wind_dir_change FROM P),
A AS (SELECT *, wind_speed_rise_pct > 50.0 AS speed_alert, gust_above_avg_pct > 30.0 AS gust_alert,
             wind_dir_change > 45.0 AS direction_alert FROM Q)
SELECT event_type, window_start, window_end, avg_wind_speed, min_wind_speed, max_wind_speed,
       wind_speed_rise_pct, avg_gust, max_gust, gust_above_avg_pct, avg_wind_dir,
       wind_dir_change, speed_alert, gust_alert, direction_alert,
       speed_alert OR gust_alert OR direction_alert AS wind_alert
FROM A"""

# The streaming replay keeps the last emission per window: same rows as the
# batch windows.
SQL["stream_window_replay"] = SQL["sliding_stats"]
SQL["stream_heat_replay"] = SQL["heat_rule"]
SQL["stream_ordered_replay"] = SQL["sliding_stats"]
SQL["stream_value_history_replay"] = SQL["stream_vs_baseline"]
SQL["stream_k_history_replay"] = SQL["stream_vs_baseline_orders"]
SQL["stream_flood_replay"] = SQL["flood_rule"]
SQL["stream_wind_replay"] = SQL["wind_rule"]

SQL["order_ranks"] = """
SELECT o_orderkey, o_orderpriority, o_totalprice,
       CAST(rank() OVER (ORDER BY o_totalprice DESC) AS INTEGER) AS price_rank,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS priority_rank,
       CAST(ntile(100) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)
            AS INTEGER) AS price_percentile
FROM orders"""

SQL["pearson_nulls"] = f"""
WITH {_L},
N AS (SELECT n_name, CASE WHEN l_quantity > 5 THEN l_quantity END AS x,
             CASE WHEN l_discount < 0.07 THEN l_extendedprice END AS y FROM L)
SELECT n_name, {_r('corr(x, y)', 10)} AS pearson_correlation FROM N GROUP BY n_name"""

SQL["entity_baseline"] = f"""
WITH {_EV},
{_windows(60, f"{_r(_mean('value'), 3)} AS stream_avg_value, COUNT(*) AS event_count")},
B AS (SELECT event_type, CAST(year(ts) AS INTEGER) AS hist_year,
             CAST(month(ts) AS INTEGER) AS hist_month, {_r(_mean('value'), 3)} AS hist_avg_value
      FROM events GROUP BY ALL)
SELECT W.event_type, W.window_start, W.window_end, B.hist_year, B.hist_month,
       W.stream_avg_value, B.hist_avg_value,
       {_r('W.stream_avg_value - B.hist_avg_value', 3)} AS abs_deviation,
       {_r('(W.stream_avg_value - B.hist_avg_value) / NULLIF(B.hist_avg_value, 0) * 100.0', 3)}
         AS pct_deviation,
       W.event_count
FROM W JOIN B ON month(W.window_start) = B.hist_month AND W.event_type = B.event_type"""
