"""Streaming records through an external program, region by region."""

from __future__ import annotations

import subprocess
import threading
import time
from collections.abc import Callable, Iterator
from itertools import chain, islice

import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.joins import Fields


def _command(command: list[str] | str, files: list[str]) -> list[str]:
    """$0, $1, ... are the local paths of the files, $root the folder that holds them."""
    parts = command.split() if isinstance(command, str) else list(command)
    root = SparkFiles.getRootDirectory()
    out = []
    for p in parts:
        for i in reversed(range(len(files))):
            p = p.replace(f"${i}", SparkFiles.get(files[i].rsplit("/", 1)[-1]))
        out.append(p.replace("$root", root))
    return out


def run_lines(command: list[str], lines: Iterator[str], env: dict[str, str] | None, timeout: float | None) -> Iterator[str]:
    """Lines of a program's output while lines are written to it. A non-zero exit is an error; beyond
    `timeout` seconds from its start the program is killed, which is one too."""
    import os

    p = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, env={**os.environ, **(env or {})})
    failed: list[BaseException] = []
    deadline = time.monotonic() + timeout if timeout else None
    timer = threading.Timer(timeout, p.kill) if timeout else None

    def feed() -> None:
        try:
            for x in lines:
                p.stdin.write(x + "\n")
        except BrokenPipeError:
            pass
        except BaseException as e:  # noqa: BLE001  (raised below, in the task's thread)
            failed.append(e)
        finally:
            try:
                p.stdin.close()
            except BrokenPipeError:
                pass

    writer = threading.Thread(target=feed, daemon=True)
    writer.start()
    if timer:
        timer.start()
    try:
        for line in p.stdout:
            yield line.rstrip("\n")
        writer.join()
        code = p.wait()
    finally:
        if timer:
            timer.cancel()
        if p.poll() is None:
            p.kill()
    if failed:
        raise failed[0]
    if code:
        late = deadline is not None and time.monotonic() >= deadline
        raise RuntimeError(f"{command[0]} " + (f"took more than {timeout} s" if late else f"ended with {code}"))


def pipe(df: DataFrame, command: list[str] | str, to_lines: Callable[..., DataFrame], parse: Callable[[DataFrame], DataFrame], header: list[str] = (), files: list[str] = (), env: dict[str, str] | None = None, flank: int = 0, bin_size: int = 1_000_000, fields: Fields = Fields(), out_fields: Fields | None = Fields(), timeout: float | None = None, partitions: int | None = None) -> DataFrame:
    """Records through a program that reads and writes lines.

    Bins of bin_size positions are dealt out to tasks by hash; a row is copied to every task with a bin
    that it, padded by flank, overlaps. A task runs the program once, fed with the header and its rows
    in order of reference and position.
    to_lines (of sources.sinks) makes the text column `value` and keeps the columns named by `keep`;
    parse turns a text column `value` into records, with the other columns beside them. Of records that several tasks made, as their rows
    were copied, one is kept: that whose start lies in the bins of its task (out_fields None: all are
    kept). Rows without a region are left out.
    """
    spark = df.sparkSession
    for f in files:
        spark.sparkContext.addFile(f)
    s, e = F.greatest(F.lit(0).cast("long"), F.col(fields.start) - flank), F.greatest(F.col(fields.end) + flank, F.col(fields.start) - flank + 1)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    task_of = lambda ref, bin_: F.pmod(F.hash(ref, bin_), F.lit(n))
    bins = F.sequence(F.floor(s / F.lit(bin_size)), F.floor((e - 1) / F.lit(bin_size)))
    # A row goes once to every task that has a bin of it.
    tasks = F.array_distinct(F.transform(bins, lambda b: task_of(F.col(fields.reference), b)))
    placed = df.where(F.col(fields.reference).isNotNull() & F.col(fields.start).isNotNull()).withColumns({"_ref": F.col(fields.reference), "_at": F.col(fields.start)}).withColumn("_task", F.explode(tasks))
    text = to_lines(placed, keep=("_ref", "_task", "_at")).repartitionById(n, "_task").sortWithinPartitions("_ref", "_at")
    head, names = list(header), list(files)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (value for b in batches for value in b["value"])
        first = next(rows, None)
        if first is None:
            return
        out = run_lines(_command(command, names), chain(head, [first], rows), env, timeout)
        part = TaskContext.get().partitionId()
        while some := list(islice(out, 10_000)):
            yield pd.DataFrame({"value": some, "_part": part})

    raw = text.mapInPandas(kernel, "value string, _part int")
    if out_fields is None:
        return parse(raw.select("value"))
    ref = F.col(out_fields.reference)
    own = task_of(ref, F.floor(F.col(out_fields.start) / F.lit(bin_size))) == F.col("_part")
    return parse(raw).where(ref.isNull() | own).drop("_part")
