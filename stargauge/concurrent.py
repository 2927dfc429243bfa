"""Independent Spark jobs side by side, so that small ones share the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target


def side_by_side[Item, Result](
    spark: SparkSession,
    run: Callable[[Item], Result],
    items: Iterable[Item],
    parallelism: int = 4,
) -> list[Result]:
    """``run`` of every item, in the order of the items."""
    work = list(items)
    if parallelism < 2 or len(work) < 2:
        return [run(item) for item in work]
    with ThreadPoolExecutor(min(parallelism, len(work))) as pool:
        target = inheritable_thread_target(spark)(run)
        running = [pool.submit(target, item) for item in work]
        return [job.result() for job in running]
