"""The same results in DuckDB SQL, written without a look at the Spark plans."""

from __future__ import annotations

_SALES = """
sales AS (
  SELECT CASE WHEN event_id % 11 = 0 THEN 'not-a-date'
              ELSE strftime(ts, '%Y-%m-%d') END AS sales_date,
         strftime(ts, '%H:%M:%S.%g') AS sales_time,
         CAST(user_id AS VARCHAR) AS item_code,
         CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS sales_quantity,
         value AS sales_price,
         CASE WHEN event_type = 'error' THEN 'return' ELSE 'sale' END AS sales_return,
         CASE WHEN event_id % 7 <> 0 THEN 'N' END AS is_discount
  FROM events
)"""

_SALES_BY_EVENT = _SALES.replace("  FROM events", "         , event_id\n  FROM events")

_MASTER = """
master AS (
  SELECT CASE WHEN c_custkey % 10 = 9 THEN 'old-' ELSE '' END
           || CAST(c_custkey AS VARCHAR) AS item_code,
         CASE WHEN c_custkey % 3 = 0 THEN '  ' || c_name || ' ' ELSE c_name END AS item_name,
         CAST(c_nationkey AS VARCHAR) AS category_code,
         nullif(c_mktsegment, 'BUILDING') AS category_name
  FROM customer
)"""

_TIMED = """
timed AS (
  SELECT * EXCLUDE (sales_date, sales_time),
         try_strptime(sales_date || ' ' || sales_time, '%Y-%m-%d %H:%M:%S.%g')
           AS sales_datetime
  FROM sales
)"""

_JOINED = """
joined AS (
  SELECT s.item_code, m.item_name, s.sales_quantity, s.sales_price, s.sales_return,
         s.is_discount, m.category_code, m.category_name, s.sales_datetime
  FROM timed s JOIN master m ON s.item_code = m.item_code
)"""

_COMPLETE = """
complete AS (
  SELECT * FROM joined
  WHERE item_code IS NOT NULL AND item_name IS NOT NULL
    AND sales_quantity IS NOT NULL AND NOT isnan(sales_quantity)
    AND sales_price IS NOT NULL AND NOT isnan(sales_price)
    AND sales_return IS NOT NULL AND is_discount IS NOT NULL
    AND category_code IS NOT NULL AND category_name IS NOT NULL
    AND sales_datetime IS NOT NULL
)"""

_PROCESSED = """
processed AS (
  SELECT *, sales_quantity * sales_price AS sales_amount
  FROM complete WHERE sales_return = 'sale'
)"""


def _windows(table: str) -> str:
    return f"""
  SELECT time_bucket(INTERVAL 5 MINUTE, t.sales_datetime, TIMESTAMP '1970-01-01')
           - k * INTERVAL 5 MINUTE AS window_start,
         time_bucket(INTERVAL 5 MINUTE, t.sales_datetime, TIMESTAMP '1970-01-01')
           - k * INTERVAL 5 MINUTE + INTERVAL 10 MINUTE AS window_end,
         t.*
  FROM {table} t, (VALUES (0), (1)) AS offsets(k)
  WHERE t.sales_datetime IS NOT NULL"""


_LONG_WINDOWED = """
windowed AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, p.sales_datetime, TIMESTAMP '1970-01-01')
           - k * INTERVAL 5 MINUTE AS window_start,
         window_start + INTERVAL 2 HOUR AS window_end,
         p.*
  FROM processed p, range(24) AS offsets(k)
)"""

_WINDOWED = f"""
windowed AS ({_windows("processed")}
)"""


def _statistics(condition: str) -> str:
    return f"""
statistics AS (
  SELECT window_start, window_end, item_code, item_name, category_code, category_name,
         round(sum(sales_amount), 2) AS total_sales_amount,
         round(sum(sales_quantity), 2) AS total_sales_quantity
  FROM windowed
  WHERE {condition}
  GROUP BY ALL
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_TO_PROCESSED = (_SALES, _MASTER, _TIMED, _JOINED, _COMPLETE, _PROCESSED)
_PROCESSED_ROWS = f"{_with(*_TO_PROCESSED)}\nSELECT * FROM processed"


def _report(condition: str = "true") -> str:
    return f"{_with(*_TO_PROCESSED, _WINDOWED, _statistics(condition))}\nSELECT * FROM statistics"


# A run closes the windows its final watermark has passed.
_CLOSED = """
WHERE window_end <= (SELECT max(sales_datetime) FROM processed) - INTERVAL 15 MINUTE"""
_COUNTABLE = """
countable AS (
  SELECT * FROM timed
  WHERE item_code IS NOT NULL AND sales_quantity IS NOT NULL AND NOT isnan(sales_quantity)
    AND sales_price IS NOT NULL AND NOT isnan(sales_price)
    AND sales_return = 'sale' AND is_discount IS NOT NULL AND sales_datetime IS NOT NULL
)"""
# Messages of two runs; the text beside each sale is no record.
_ROUTED = """
arrived AS (
  SELECT *, CASE WHEN sales_date < '2024-01-16' AND sales_price < 20 THEN 0 ELSE 1 END AS batch
  FROM (SELECT s.*, try_strptime(sales_date || ' ' || sales_time, '%Y-%m-%d %H:%M:%S.%g') AS sales_datetime
        FROM sales s)
), examined AS (
  SELECT *, CASE
    WHEN item_code IS NULL OR sales_quantity IS NULL OR isnan(sales_quantity) OR sales_price IS NULL
      OR isnan(sales_price) OR sales_return IS NULL OR is_discount IS NULL THEN 'missing field'
    WHEN sales_datetime IS NULL THEN 'unreadable time' END AS problem
  FROM arrived
), routed AS (
  SELECT *, CASE
    WHEN problem IS NOT NULL THEN 'dead'
    WHEN sales_return <> 'sale' THEN 'returned'
    WHEN batch = 1 AND time_bucket(INTERVAL 5 MINUTE, sales_datetime, TIMESTAMP '1970-01-01') + INTERVAL 10 MINUTE
      <= (SELECT max(sales_datetime) FROM examined WHERE batch = 0 AND problem IS NULL AND sales_return = 'sale')
         - INTERVAL 15 MINUTE THEN 'late'
    ELSE 'kept' END AS fate
  FROM examined
)"""
_EARLY = "sales_datetime < TIMESTAMP '2024-01-16' AND sales_price < 20"
_REPORT = _report()
_SALES_ROWS = f"{_with(_SALES)}\nSELECT * FROM sales"



def _exact(measure: str) -> str:
    """The exact sum in units of 2^-90, put together from 30 binary digits at a time."""
    digits = " + ".join(
        f"(({measure}_units // {1 << 30 * (k + 3)}::HUGEINT) % {1 << 30})::DOUBLE * pow(2.0, {30 * k})"
        for k in (-3, -2, -1, 0)
    )
    return f"{measure}_sign * ({digits} + ({measure}_units // {1 << 120}::HUGEINT)::DOUBLE * pow(2.0, 30))"


_EXACT_REPORT = f"""{_with(*_TO_PROCESSED, _WINDOWED)},
units AS (
  SELECT window_start, window_end, item_code, item_name, category_code, category_name,
         sum((sales_amount * pow(2.0, 90))::HUGEINT) AS amount,
         sum((sales_quantity * pow(2.0, 90))::HUGEINT) AS quantity
  FROM windowed GROUP BY ALL
), signed AS (
  SELECT *, CASE WHEN amount < 0 THEN -1 ELSE 1 END AS amount_sign, abs(amount) AS amount_units,
         CASE WHEN quantity < 0 THEN -1 ELSE 1 END AS quantity_sign, abs(quantity) AS quantity_units
  FROM units
)
SELECT window_start, window_end, item_code, item_name, category_code, category_name,
       {_exact("amount")} AS total_sales_amount, {_exact("quantity")} AS total_sales_quantity
FROM signed"""

ORACLES: dict[str, str] = {
    "join_sales_master": f"""{_with(_SALES, _MASTER)}
SELECT s.*, m.* EXCLUDE (item_code) FROM sales s JOIN master m ON s.item_code = m.item_code""",
    "event_time": f"{_with(_SALES, _TIMED)}\nSELECT * FROM timed",
    "drop_incomplete": f"""{_with(_SALES, _MASTER, _TIMED, _JOINED, _COMPLETE)}
SELECT * FROM complete""",
    "completed_sales": f"{_SALES_ROWS} WHERE sales_return = 'sale'",
    "sales_amount": f"""{_with(_SALES)}
SELECT *, sales_quantity * sales_price AS sales_amount FROM sales""",
    "process_sales": _PROCESSED_ROWS,
    "process_sales_salted": _PROCESSED_ROWS,
    "sliding_window_assign": f"{_with(_SALES, _TIMED)}{_windows('timed')}",
    "sales_statistics": _REPORT,
    "analyzed_process_sales": _REPORT,
    "sales_statistics_sorted": f"{_REPORT} ORDER BY window_start",
    "decode_csv_messages": _SALES_ROWS,
    "csv_scan": _SALES_ROWS,
    "csv_scan_master": f"{_with(_MASTER)}\nSELECT * FROM master",
    "csv_sink": _REPORT,
    "batch_job": _REPORT,
    "statistics_payload": f"""{_with(*_TO_PROCESSED, _WINDOWED, _statistics("true"))}
SELECT *, window_start AS key_window_start, window_end AS key_window_end,
       item_code AS key_item_code, item_name AS key_item_name,
       category_code AS key_category_code, category_name AS key_category_name
FROM statistics""",
    "sales_statistics_long_windows": f"""
{_with(*_TO_PROCESSED, _LONG_WINDOWED, _statistics("true"))}
SELECT * FROM statistics""",
    # Six in eight sales carry a blank or a line break too many.
    "event_time_untidy": f"""{_with(_SALES_BY_EVENT)}
SELECT * EXCLUDE (sales_date, sales_time, event_id),
       CASE WHEN event_id % 8 IN (0, 6)
            THEN try_strptime(sales_date || ' ' || sales_time, '%Y-%m-%d %H:%M:%S.%g')
       END AS sales_datetime
FROM sales""",
    "stream_statistics_append": f"{_REPORT}{_CLOSED}",
    "stream_statistics_complete": _REPORT,
    # Late sales miss the windows that the first run closed, and only those.
    "stream_late_sales": _report(
        f"""({_EARLY}) OR window_end >
    (SELECT max(sales_datetime) FROM processed WHERE {_EARLY}) - INTERVAL 15 MINUTE"""
    )
    + _CLOSED,
    "stream_statistics_at_closing": f"""{_with(*_TO_PROCESSED, _COUNTABLE, _WINDOWED, _statistics("true"))}
SELECT * FROM statistics
WHERE window_end <= (SELECT max(sales_datetime) FROM countable) - INTERVAL 15 MINUTE""",
    # Beside every sale stands a text that is none.
    "stream_sales_account": f"""{_with(_SALES, _ROUTED)}
SELECT batch::BIGINT AS batch, 2 * count(*) AS messages, count(*) FILTER (fate = 'kept') AS kept,
       count(*) FILTER (fate = 'late') AS late, count(*) FILTER (fate = 'returned') AS returned,
       count(*) FILTER (fate = 'dead') + count(*) AS dead
FROM routed GROUP BY batch""",
    "stream_late_side_output": f"""{_with(_SALES, _ROUTED)}
SELECT * EXCLUDE (batch, sales_datetime, problem, fate) FROM routed WHERE fate = 'late'""",
    "dead_letters": f"""{_with(_SALES, _ROUTED)}
SELECT problem, count(*) AS n FROM examined WHERE problem IS NOT NULL GROUP BY problem
UNION ALL SELECT 'unreadable record', count(*) FROM examined""",
    "usable_messages": f"""{_with(_SALES, _ROUTED)}
SELECT * EXCLUDE (batch, sales_datetime, problem) FROM examined WHERE problem IS NULL""",
    "stream_statistics_upserts": _REPORT,
    "stream_open_windows": f"""{_with(*_TO_PROCESSED, _WINDOWED, _statistics("true"))}
SELECT *, CASE WHEN window_end <= (SELECT max(sales_datetime) FROM processed) - INTERVAL 10 DAY
               THEN 'no' ELSE 'yes' END AS open
FROM statistics""",
    "consumed_statistics": _REPORT,
    "sales_statistics_exact": _EXACT_REPORT,
    "incremental_report": _EXACT_REPORT,
    "published_report": _REPORT,
    "statistics_of_two_days": f"""{_REPORT}
WHERE window_start >= TIMESTAMP '2024-01-10' AND window_end <= TIMESTAMP '2024-01-12'""",
}
