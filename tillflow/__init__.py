"""Sales statistics on Spark: one set of DataFrame functions, stream and batch."""

from tillflow.operators.windows import order_statistics
from tillflow.plans.batch_job import run_batch_job
from tillflow.plans.process import process_item_sales_data
from tillflow.plans.statistics import analyze_item_sales_data_statistics, sales_statistics
from tillflow.settings import JoinSettings, WindowSettings
from tillflow.streaming.job import start_statistics_job, statistics_stream

__all__ = [
    "JoinSettings",
    "WindowSettings",
    "analyze_item_sales_data_statistics",
    "order_statistics",
    "process_item_sales_data",
    "run_batch_job",
    "sales_statistics",
    "start_statistics_job",
    "statistics_stream",
]
