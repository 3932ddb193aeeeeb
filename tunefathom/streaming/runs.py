"""A log-structured table of a stream's batches: levels of runs, merged as they fill up, and a list of the live ones.

Each batch adds a run. When a level holds ``fan`` runs they become one run of the next level. The list of live runs is
written beside the runs and gets its name (the batch) by one rename, so a reader sees all of a batch or nothing, and a
batch that is run again starts from the list before it. Replaced runs stay until the owner of the folder expires them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

FAN = 8


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _newest(spark: SparkSession, path: str, before: int | None) -> str | None:
    files, folder = _system(spark, f"{path}/_live")
    if not files.exists(folder):
        return None
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    numbers = [int(n) for n in names if n.lstrip("-").isdigit() and (before is None or int(n) < before)]
    return f"{path}/_live/{max(numbers)}" if numbers else None


def live_runs(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """The runs to read, as the newest batch (below ``before``) has left them."""
    newest = _newest(spark, path, before)
    return sorted(r["value"] for r in spark.read.text(newest).collect()) if newest else []  # as many lines as runs are live


def _level(run: str) -> int:
    return int(run.rsplit("/", 2)[1].removeprefix("level-"))


def add_run(spark: SparkSession, path: str, batch: int, rows: DataFrame, merge: Callable[[DataFrame], DataFrame] | None, fan: int = FAN, by: str | None = None,
            order: list[str] = []) -> None:
    """Write ``rows`` as the run of ``batch`` and merge full levels: by ``merge``, or by putting runs together.

    ``by`` partitions a run's files by a column, which readers can then prune by; tasks write even ranges of it and of
    ``order``, which rows are sorted by in a file. ``rows`` are read twice then.
    """
    def write(level: int, frame: DataFrame) -> str:
        run = f"{path}/level-{level}/{batch}"
        writer = (frame.repartitionByRange(by, *order).sortWithinPartitions(by, *order) if by else frame).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(run)
        return run

    live = [*live_runs(spark, path, batch), write(0, rows)]
    level = 0
    while len(full := [r for r in live if _level(r) == level]) >= fan:
        together = reduce(DataFrame.unionByName, [spark.read.schema(rows.schema).parquet(r) for r in full])
        live = [r for r in live if r not in full] + [write(level + 1, merge(together) if merge else together)]
        level += 1
    files, target = _system(spark, f"{path}/_live/{batch}")
    _, draft = _system(spark, f"{path}/_live/_{batch}")
    stream = files.create(draft, True)
    stream.write(bytearray("\n".join(live).encode()))
    stream.close()
    files.delete(target, False)
    if not files.rename(draft, target):
        raise OSError(f"could not name the list of live runs {path}/_live/{batch}")
