"""Fixed values shared by every source, operator and sink.

Schemas are DDL strings, because that one form is accepted by readers
(``.schema(...)``), by ``from_csv`` / ``from_json`` and by the JDBC
``customSchema`` property alike.
"""

# Record layouts, key names, patterns and window defaults.
SALES_SCHEMA = (
    "sales_date STRING, sales_time STRING, item_code STRING, "
    "sales_quantity DOUBLE, sales_price DOUBLE, "
    "sales_return STRING, is_discount STRING"
)
MASTER_SCHEMA = (
    "item_code STRING, item_name STRING, "
    "category_code STRING, category_name STRING"
)
STATISTICS_SCHEMA = (
    "window_start TIMESTAMP, window_end TIMESTAMP, "
    "item_code STRING, item_name STRING, "
    "category_code STRING, category_name STRING, "
    "total_sales_amount DOUBLE, total_sales_quantity DOUBLE"
)
EVENT_TIME_PATTERN = "yyyy-MM-dd HH:mm:ss.SSS"
COMPLETED_SALE = "sale"
WINDOW_LENGTH = "10 minutes"
WINDOW_SLIDE = "5 minutes"
ALLOWED_LATENESS = "15 minutes"
SALES_TOPIC = "sales_topic"
STATISTICS_TOPIC = "sales_data_statistics_topic"
MASTER_TABLE = "item_master_table"


def column_names(ddl: str) -> list[str]:
    """Column names of one of the DDL strings above, in order."""
    return [field.split()[0] for field in ddl.split(",")]


SALES_COLUMNS = column_names(SALES_SCHEMA)
MASTER_COLUMNS = column_names(MASTER_SCHEMA)
STATISTICS_COLUMNS = column_names(STATISTICS_SCHEMA)
GROUP_COLUMNS = ["window_start", "window_end", *MASTER_COLUMNS]
GROUP_SCHEMA = ",".join(STATISTICS_SCHEMA.split(",")[: len(GROUP_COLUMNS)])

# Column order of an enriched sale: first as joined, then once its date and
# time have become one timestamp and the amount is known.
_ENRICHED = [
    "item_code",
    "item_name",
    "sales_quantity",
    "sales_price",
    "sales_return",
    "is_discount",
    "category_code",
    "category_name",
]
JOINED_COLUMNS = ["sales_date", "sales_time", *_ENRICHED]
PROCESSED_COLUMNS = [*_ENRICHED, "sales_datetime", "sales_amount"]
