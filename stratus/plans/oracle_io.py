"""DuckDB SQL of the queries of ``ingest`` and ``streams``: what should be read back, stated
on the tables themselves."""

from __future__ import annotations

from stratus.plans.oracle import _L, SQL as _SQL, _mean, _r

SQL: dict[str, str] = {}

SQL["csv_quarantine"] = """
WITH K AS (SELECT *, (l_orderkey * 7 + l_linenumber) % 40 AS kind,
                  CAST(l_quantity AS DECIMAL(18,2))::VARCHAR AS q,
                  CAST(l_extendedprice AS DECIMAL(18,2))::VARCHAR AS p,
                  strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem)
SELECT CASE WHEN kind > 4 THEN l_orderkey END AS l_orderkey,
       CASE WHEN kind > 4 THEN l_linenumber END AS l_linenumber,
       CASE WHEN kind > 4 AND kind <> 6 THEN l_quantity END AS l_quantity,
       CASE WHEN kind > 4 THEN l_extendedprice END AS l_extendedprice,
       CASE WHEN kind > 4 THEN CAST(l_shipdate AS DATE) END AS l_shipdate,
       CASE WHEN kind = 5 THEN l_returnflag || ',x' WHEN kind > 4 THEN l_returnflag END AS l_returnflag,
       CASE kind WHEN 0 THEN concat_ws(',', l_orderkey, l_linenumber, q, p)
                 WHEN 1 THEN concat_ws(',', l_orderkey, l_linenumber, q, p, d, l_returnflag, 'extra')
                 WHEN 2 THEN concat_ws(',', l_orderkey, l_linenumber, 'n/a', p, d, l_returnflag)
                 WHEN 3 THEN concat_ws(',', l_orderkey, l_linenumber, q, '12.3.4', d, l_returnflag)
                 WHEN 4 THEN concat_ws(',', l_orderkey, l_linenumber, q, p, '1996-13-45', l_returnflag)
       END AS raw_line
FROM K"""

SQL["partition_reload"] = f"""
WITH {_L}
SELECT n_name, l_shipdate, year, month,
       CASE WHEN year = 1996 AND month = 3 THEN l_quantity + 100 ELSE l_quantity END AS l_quantity
FROM L WHERE year * 100 + month BETWEEN 199602 AND 199701
         AND NOT (year = 1996 AND month = 3 AND l_quantity <= 10)"""

SQL["kafka_payloads"] = """
WITH E AS (SELECT *, event_id % 50 AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
           FROM events),
     R AS (SELECT *, CASE kind WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not JSON'
                               WHEN 3 THEN 'wrong type' WHEN 4 THEN 'no name'
                               WHEN 6 THEN 'no payload' WHEN 7 THEN 'not UTF-8' END AS reason FROM E)
SELECT 'observations' AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS "offset",
       ts AS "timestamp", reason,
       CASE WHEN reason IS NULL THEN event_type END AS name,
       CASE WHEN reason IS NULL THEN value END AS temperature,
       CASE WHEN reason IS NULL THEN k END AS humidity,
       CASE WHEN reason IS NULL AND kind <> 5 THEN k + 0.5::DOUBLE END AS gust
FROM R"""

_PAIR = f"""SELECT b.*, s.avg_quantity_in_quartile, s.avg_daily_discount_in_quartile,
       s.avg_price_in_quartile
FROM ({_SQL['quantile_bucket']}) b JOIN ({_SQL['bucket_summary']}) s
     USING (discount_quartile, quartile_label)"""
_EARLY = _PAIR.replace("FROM lineitem li",
                       "FROM (SELECT * FROM lineitem WHERE l_shipdate < '1998-01-01') li")
SQL["published_pair"] = f"""
SELECT *, 'first' AS stage FROM ({_EARLY}) UNION ALL
SELECT *, 'after failure' FROM ({_EARLY}) UNION ALL
SELECT *, 'second' FROM ({_PAIR})"""

SQL["batch_ledger"] = """
SELECT event_id, user_id, value,
       (CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END)::BIGINT AS batch_id,
       (CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 5 END)::INTEGER AS delivery
FROM events"""

SQL["text_times"] = f"""
WITH K AS (SELECT *, event_id % 12 AS kind FROM events),
     T AS (SELECT event_id, trim(event_type) AS event_type, {_r('value / 3.6', 2)} AS value,
                  CASE WHEN kind < 5 THEN NULL
                       WHEN kind = 6 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
                       WHEN kind = 7 THEN date_trunc('minute', ts)
                       ELSE date_trunc('second', ts) END AS ts,
                  CASE kind WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'not a time'
                            WHEN 3 THEN 'unknown format' WHEN 4 THEN 'unknown format' END AS time_error
           FROM K)
SELECT event_id, event_type, value, ts, time_error, strftime(ts, '%m-%d') AS month_day,
       CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(ts AS DATE) AS date,
       coalesce(hour(ts) >= 6 AND hour(ts) < 18, FALSE) AS is_day,
       CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring'
            WHEN month(ts) IN (6, 7, 8) THEN 'summer' WHEN month(ts) IN (9, 10, 11) THEN 'autumn' END
           AS season,
       CAST(CASE WHEN month(ts) IN (1, 2) THEN year(ts) - 1 ELSE year(ts) END AS INTEGER)
           AS winter_season_year
FROM T"""

SQL["ordered_files"] = """
SELECT o_orderkey, o_orderpriority, o_totalprice,
       row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS row_no
FROM orders"""


def _slices(time: str, n: int, source: str = "events") -> str:
    """Rows of ``source`` with the number of their micro-batch: the time range cut into
    ``n`` slices of whole seconds, those without rows left out."""
    return f"""
S AS (SELECT *, dense_rank() OVER (ORDER BY (epoch_us({time}) - lo) // (len * 1000000)) - 1 AS batch
      FROM {source}, (SELECT epoch_us(min({time})) AS lo,
           ((epoch_us(max({time})) - epoch_us(min({time}))) // 1000000) // {n} + 1 AS len FROM {source}))"""


# late filter of a batch: the largest time up to the batch before the last, less five minutes
_LATE = f"""
A AS (SELECT event_id, ts, event_type, value, ts + CASE WHEN event_id % 10 = 3 THEN INTERVAL 8 DAY
             WHEN event_id % 50 = 7 THEN INTERVAL 15 DAY ELSE INTERVAL 0 DAY END AS arrival
      FROM events),
{_slices('arrival', 6, 'A')},
M AS (SELECT batch, max(ts) AS last FROM S GROUP BY batch),
W AS (SELECT batch, (SELECT date_trunc('millisecond', max(x.last)) - INTERVAL 5 MINUTE FROM M x
                     WHERE x.batch <= M.batch - 2) AS watermark FROM M),
P AS (SELECT S.*, watermark, time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS window_start,
             watermark IS NULL OR time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE
                 + INTERVAL 60 MINUTE > watermark AS is_open
      FROM S JOIN W USING (batch), range(12) t(i))"""

SQL["late_data_report"] = f"""
WITH {_LATE},
E AS (SELECT batch, event_id, any_value(ts) AS ts, count(*) FILTER (is_open) AS n_open FROM P
      GROUP BY batch, event_id),
B AS (SELECT batch, count(*) AS n_rows, count(*) FILTER (n_open = 0) AS n_late,
             sum(12 - n_open)::BIGINT AS n_closed FROM E GROUP BY batch)
SELECT batch AS batch_id, watermark, n_rows, n_late, n_closed, E.event_id, E.ts
FROM B JOIN W USING (batch) LEFT JOIN (SELECT * FROM E WHERE n_open = 0) E USING (batch)"""

_WINDOW_VALUES = f"""window_start + INTERVAL 60 MINUTE AS window_end,
       {_r(_mean('value'), 3)} AS avg_value, min(value) AS min_value, max(value) AS max_value,
       count(*) AS event_count"""

SQL["late_data_windows"] = f"""
WITH {_LATE}
SELECT event_type, window_start, {_WINDOW_VALUES} FROM P WHERE is_open GROUP BY 1, 2"""

SQL["stream_restart"] = f"""
WITH {_slices('ts', 4)},
P AS (SELECT S.*, time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS window_start
      FROM S, range(12) t(i))
SELECT event_type, window_start, {_WINDOW_VALUES}, count(DISTINCT batch) AS n_emissions
FROM P GROUP BY 1, 2"""

SQL["entity_list_stream"] = f"""
WITH P AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS window_start
           FROM events, range(12) t(i) WHERE event_type IN ('view', 'purchase')),
     G AS (SELECT event_type, window_start, {_WINDOW_VALUES} FROM P GROUP BY 1, 2)
SELECT *, (SELECT count(*) FROM G) AS state_rows FROM G"""
