"""Task and workflow telemetry: summaries of pulses, status, progress, roll-ups, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ordinal import with_ordinal, with_previous, with_rank_in, with_running_max

#: Seconds without a pulse after which a task is taken for aborted, and a workflow for failed.
TASK_EXPIRY, WORKFLOW_EXPIRY = 60, 120


def pulse_summary(pulses: DataFrame, task: str = "task_id", ts: str = "ts", cpu: str = "cpu", mem: str = "mem") -> DataFrame:
    """Per task: samples, peak and mean of cpu and mem, first and last time, duration in seconds."""
    seconds = F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))
    return pulses.groupBy(task).agg(F.count("*").alias("n"), F.max(cpu).alias("peak_cpu"), F.avg(cpu).alias("mean_cpu"), F.max(mem).alias("peak_mem"), F.avg(mem).alias("mean_mem"), F.floor(seconds / 1_000_000).alias("duration"))


def running_peak(pulses: DataFrame, task: str, order: list[str], value: str) -> DataFrame:
    """Each sample with the peak of its task so far."""
    return with_running_max(pulses, task, *order, value=value, name="peak")


def expired(pulses: DataFrame, now: Column, task: str = "task_id", ts: str = "ts", seconds: int = TASK_EXPIRY) -> DataFrame:
    """(task, silent): tasks without a pulse for longer than ``seconds``."""
    silent = F.floor((F.unix_micros(now) - F.unix_micros(F.max(ts))) / 1_000_000)
    return pulses.groupBy(task).agg(silent.alias("silent")).where(F.col("silent") > seconds)


def status_counts(tasks: DataFrame, status: str = "status") -> DataFrame:
    return tasks.groupBy(status).agg(F.count("*").alias("n"))


def latest_status(events: DataFrame, task: str, order: list[str], status: str) -> DataFrame:
    """(task, status): the last status of each task."""
    return events.groupBy(task).agg(F.max_by(status, F.struct(*order)).alias(status))


def completion(substeps: DataFrame, step: str, skipped: Column) -> DataFrame:
    """Per step: completed and skipped substeps, and the completed share."""
    done, left_out = F.count_if(~skipped), F.count_if(skipped)
    return substeps.groupBy(step).agg(done.alias("n_completed"), left_out.alias("n_skipped"), (done / (done + left_out)).alias("ratio"))


def combined_result(results: DataFrame, batch: str, code: Column, failed: Column, skipped: Column) -> DataFrame:
    """Per batch of tasks: return code (one for each exception and the others' sum), and whether all, some or none were skipped."""
    n = F.count("*")
    out = results.groupBy(batch).agg(F.sum(F.when(failed, 1).otherwise(code)).cast("bigint").alias("ret_code"), F.count_if(skipped).alias("n_skipped"), n.alias("n"))
    return out.select(batch, "ret_code", F.when(F.col("n_skipped") == F.col("n"), "all").when(F.col("n_skipped") > 0, "partial").otherwise("none").alias("skipped"))


def resources(tasks: DataFrame, batch: str, walltime: str, mem: str, cores: str, workers: int = 1, nodes: int = 1) -> DataFrame:
    """Per batch: what it needs as one job: rounds of workers times wall time, workers times memory and cores.

    Tasks that ask for different amounts cannot be batched: an error.
    """
    same = F.count_distinct(walltime, mem, cores)
    rounds = F.ceil(F.count("*") / (workers * nodes))
    out = tasks.groupBy(batch).agg((rounds * F.max(walltime)).alias("walltime"), (F.max(mem) * workers).alias("mem"), (F.max(cores) * workers).alias("cores"), same.alias("_kinds"))
    checked = F.when(F.col("_kinds") > 1, F.raise_error(F.lit("tasks of one batch ask for different resources"))).otherwise(F.col("walltime"))
    return out.select(batch, checked.cast("bigint").alias("walltime"), F.col("mem").cast("bigint").alias("mem"), F.col("cores").cast("bigint").alias("cores"))


def completion_totals(substeps: DataFrame, step: str, skipped: Column) -> DataFrame:
    """One row: steps, and steps all, some and none of whose substeps were skipped, with completed and skipped substeps over all steps, and a sentence that says so."""
    by_step = completion(substeps, step, skipped)
    done, out = F.col("n_completed"), F.col("n_skipped")
    totals = by_step.agg(
        F.count("*").alias("n_steps"), F.count_if((done > 0) & (out == 0)).alias("n_run"), F.count_if((done > 0) & (out > 0)).alias("n_partial"), F.count_if((done == 0) & (out > 0)).alias("n_ignored"),
        F.coalesce(F.sum(done), F.lit(0)).alias("n_completed"), F.coalesce(F.sum(out), F.lit(0)).alias("n_skipped"),
    )
    counted = lambda c, what: F.concat(F.col(c).cast("string"), F.lit(f" {what}"), F.when(F.col(c) == 1, "").otherwise("s"))
    return totals.withColumn("said", F.concat(counted("n_steps", "step"), F.lit(" ("), counted("n_completed", "completed substep"), F.lit(", "), counted("n_skipped", "skipped substep"), F.lit(")")))


def common_values(params: DataFrame, batch: str = "batch", member: str = "member", key: str = "key", value: str = "value") -> DataFrame:
    """(batch, key, value) that all members of a batch have, and with one value."""
    own = params.groupBy(batch, member, key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count_if(F.col(value).isNull()).alias("_nulls"))
    size = own.select(batch, member).distinct().groupBy(batch).agg(F.count("*").alias("_n"))
    found = own.groupBy(batch, key).agg(F.count("*").alias("_have"), F.min("_low").alias(value), F.max("_high").alias("_high"), F.sum("_nulls").alias("_nulls"))
    return found.join(size, batch).where((F.col("_have") == F.col("_n")) & (F.col(value) == F.col("_high")) & (F.col("_nulls") == 0)).select(batch, key, value)


def trunks(substeps: DataFrame, order: str, size: int, skipped: Column) -> DataFrame:
    """Substeps that are not skipped, packed ``size`` to a trunk in their order."""
    kept = with_ordinal(substeps.where(~skipped), order, name="_at")
    return kept.withColumn("trunk", F.floor(F.col("_at") / size)).withColumn("slot", F.col("_at") % size).drop("_at")


def merged_log(log: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    """The last value of each key of a log."""
    return log.groupBy(*key).agg(F.max_by(value, seq).alias(value))


def timeline(runs: DataFrame, run: str, start: str, end: str) -> DataFrame:
    """Per run: whole percents before, during (at least one) and after it, of the time that all runs span."""
    bounds = runs.agg(F.min(start).alias("_first"), F.max(end).alias("_last"))
    total = F.greatest(F.col("_last") - F.col("_first"), F.lit(1))
    share = lambda x: F.floor(x * 100 / total)
    out = runs.join(F.broadcast(bounds))  # one row
    before, during = share(F.col(start) - F.col("_first")), F.greatest(F.lit(1), share(F.col(end) - F.col(start)))
    return out.select(run, before.alias("before_pct"), during.alias("during_pct"), F.greatest(F.lit(0), 100 - before - during).cast("bigint").alias("after_pct"))


def duration(status: Column, now: Column, running: Column, modified: Column) -> Column:
    """Seconds that a task ran: until now while it runs, else until its last change; null if it never ran."""
    return F.when(running.isNull(), None).when(status == "running", now - running).otherwise(modified - running)


def gaps(pulses: DataFrame, task: str, order: list[str], ts: str, seconds: int) -> DataFrame:
    """Pulses that follow the one before by more than ``seconds``."""
    since = F.floor((F.unix_micros(ts) - F.unix_micros("_before")) / 1_000_000)
    return with_previous(pulses, task, *order, values={"_before": ts}).withColumn("gap", since).drop("_before").where(F.col("gap") > seconds)


def even_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` evenly spaced rows with their place; all if there are no more."""
    placed = with_ordinal(rows, order, name="at")
    m = rows.count()
    if n >= m:
        return placed
    wanted = rows.sparkSession.range(n).select(F.floor(F.col("id") * m / n).cast("bigint").alias("_x"))
    return placed.join(wanted.select((F.col("_x") + m // (2 * n)).alias("at")), "at", "left_semi")


def tail(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows."""
    return rows.orderBy(F.desc(order)).limit(n)


def tail_in(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    ranked = with_rank_in(rows, key, order, name="_r")
    size = ranked.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    return ranked.join(size, F.col(key).eqNullSafe(F.col("_k"))).where(F.col("_r") >= F.col("_n") - n).drop("_r", "_k", "_n")


def is_sorted(rows: DataFrame, order: str, value: str) -> bool:
    """Whether ``value`` never falls along ``order``: neighbours meet by their ordinals, not in one window."""
    placed = with_ordinal(rows.select(order, value), order, name="at")
    later = placed.select((F.col("at") - 1).alias("at"), F.col(value).alias("_next"))
    return placed.join(later, "at").where(F.col(value) > F.col("_next")).isEmpty()
