"""Steps and what they leave: outputs by step and by name, bodies per group, conditions, workflows.

Outputs of steps are a table (step, ord, name, label, gid, pos); a step is a
name or ``name_N`` with a number.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ordinal import with_ordinal
from tessella.functions.patterns import extract
from tessella.operators.dag import edges_by_order
from tessella.operators.ranges import named_like
from tessella.operators.targets import TargetSet

_NUMBERED = r"^(.*)_([0-9]+)$"


def step_number(step: Column) -> Column:
    """The number of ``name_N``; null without one."""
    return F.regexp_extract(step, _NUMBERED, 2).try_cast("int")


def step_name(step: Column) -> Column:
    return F.when(step.rlike(_NUMBERED), F.regexp_extract(step, _NUMBERED, 1)).otherwise(step)


def resolve_steps(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, step): the step of that very name, else the last ``name_N`` by number."""
    exact = wanted.join(steps.select(F.col("step").alias("wanted"), F.col("step").alias("_exact")).distinct(), "wanted", "left")
    last = steps.where(step_number(F.col("step")).isNotNull()).groupBy(step_name(F.col("step")).alias("wanted")).agg(F.max_by("step", step_number(F.col("step"))).alias("_last"))
    return exact.join(last, "wanted", "left").select("wanted", F.coalesce("_exact", "_last").alias("step")).where(F.col("step").isNotNull())


def _outputs(outputs: DataFrame, order: list[str], attributes: list[str]) -> TargetSet:
    rows = outputs.select(*(F.col(o).alias(f"_{i}") for i, o in enumerate(order)), F.lit("file").alias("kind"), "name", F.coalesce("label", F.lit("")).alias("label"), *attributes)
    return TargetSet(with_ordinal(rows, *(f"_{i}" for i in range(len(order)))).select("idx", "kind", "name", "label", *attributes))


def _asked(outputs: DataFrame, steps: str | int | list, current: str | None) -> list[str]:
    """Names of the steps asked for: numbers are steps of the current workflow, -1 the one before the current."""
    out = []
    for step in steps if isinstance(steps, (list, tuple)) else [steps]:
        if isinstance(step, str):
            out.append(step)
            continue
        m = re.fullmatch(_NUMBERED, current or "")
        if isinstance(step, bool) or not m:
            raise ValueError("a step by number needs a current step of the form name_N")
        if step >= 0:
            out.append(f"{m[1]}_{step}")
            continue
        if step != -1:
            raise ValueError("of negative steps there is only -1, the one before")
        own = outputs.select("step").where((step_name(F.col("step")) == m[1]) & (step_number(F.col("step")) < int(m[2])))
        before = own.agg(F.max_by("step", step_number(F.col("step")))).first()[0]  # one row
        if before is None:
            raise ValueError(f"no step comes before {current}")
        out.append(before)
    return out


def output_from(outputs: DataFrame, steps: str | int | list, attributes: list[str] = (), *, current: str | None = None, group_by: object = None, paired_with: dict | None = None, group_with: dict | None = None, for_each: list | dict | None = None, pattern: str | None = None, remove_empty_groups: bool = False) -> TargetSet:
    """Outputs of steps, one step after the other as named, each in its order; labelled by step.

    A step is a name, a number in the workflow of ``current``, or -1 for the
    step before it.  The options then work on the collection as on any other:
    pattern, paired_with, group_by, group_with, for_each, remove_empty_groups.
    """
    spark = outputs.sparkSession
    asked = spark.createDataFrame(list(enumerate(_asked(outputs, steps, current))), "_step_ord long, wanted string")
    found = resolve_steps(outputs.select("step").distinct(), asked.select("wanted").distinct()).join(asked, "wanted")
    out = _outputs(outputs.drop("label").join(found, "step").withColumn("label", F.col("step")), ["_step_ord", "ord"], list(attributes))
    for name, value in (extract(F.col("name"), pattern) if pattern else {}).items():
        out = out.with_attribute(name, value)
    for name, values in (paired_with or {}).items():
        out = out.paired_with(name, values)
    if group_by is not None:
        out = out.group_by(group_by)
    for name, values in (group_with or {}).items():
        out = out.group_with(name, values)
    if for_each is not None:
        out = out.for_each(*(for_each if isinstance(for_each, list) else [for_each]))
    return out.remove_empty_groups() if remove_empty_groups else out


def collect_outputs(outputs: DataFrame, n_groups: int) -> TargetSet:
    """Outputs of substeps (gid, ord, name) as one collection with a group each, the empty ones too; of a name that comes again only the first stays."""
    rows = outputs.select("gid", F.col("ord").alias("pos"), F.lit("file").alias("kind"), "name", F.lit("").alias("label"))
    numbered = with_ordinal(rows, "gid", "pos")
    groups = outputs.sparkSession.range(n_groups).select(F.col("id").alias("gid"))
    ts = TargetSet(numbered.select("idx", "kind", "name", "label"), numbered.select("gid", "pos", "idx"), groups)
    return ts.first_of_name()


def shared_values(values: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row: for each variable of substeps (gid, ...) its value in the last substep under the name given, and ``step_<name>``, the list over all substeps.

    The list is what the contract of a shared variable is; it fits one row.
    """
    lists = [F.transform(F.array_sort(F.collect_list(F.struct("gid", F.col(v).alias("v")))), lambda e: e["v"]).alias(f"step_{n}") for v, n in names.items()]
    return values.agg(*(F.max_by(v, "gid").alias(n) for v, n in names.items()), *lists)


def shared_totals(values: DataFrame, names: list[str]) -> DataFrame:
    """One row: sums of variables over all substeps, their number, and the last substep's values; nothing is listed."""
    return values.agg(F.count("*").alias("n_substeps"), *(F.sum(v).alias(f"total_{v}") for v in names), *(F.max_by(v, "gid").alias(f"last_{v}") for v in names))


def named_output(outputs: DataFrame, label: str) -> TargetSet:
    """Outputs under a label, of the first step that has it; none if there is no such label."""
    own = outputs.where(F.col("label") == label)
    first = own.groupBy().agg(F.min_by("step", F.struct(F.coalesce(step_number(F.col("step")), F.lit(0)), "step")).alias("step"))
    return _outputs(own.join(F.broadcast(first), "step"), ["ord"], [])  # one row


def previous_step(steps: DataFrame) -> DataFrame:
    """(step, previous): the step before, by number, in each workflow."""
    rows = steps.select(step_name(F.col("step")).alias("workflow"), F.col("step").alias("node_id"), F.coalesce(step_number(F.col("step")), F.lit(0)).alias("node_index"))
    return edges_by_order(rows).select(F.col("dst").alias("step"), F.col("src").alias("previous"))


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst) that joins two workflows (step): the first of the second follows the last of the first."""
    order = F.struct(F.coalesce(step_number(F.col("step")), F.lit(0)), "step")
    last = first.agg(F.max_by("step", order).alias("src"))
    return last.join(F.broadcast(second.agg(F.min_by("step", order).alias("dst"))))  # one row each


def run_body(ts: TargetSet, body: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python body for each group that has members: it gets the number and the members in order.

    For what columns cannot say; a group has to fit a task.
    """
    rows = ts.members.join(ts.targets, "idx")

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return body(int(key[0]), part.sort_values("pos", ignore_index=True))

    return rows.groupBy("gid").applyInPandas(one, schema)


def fail_if(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows; one under the condition ends the query with the message."""
    checked = F.when(condition, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return rows.where(checked)


def warn_if(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    """The rows; how many meet the condition is an observed metric of that name."""
    return rows.observe(name, F.count_if(condition).alias("n"))


def regenerate(nodes: DataFrame, io: DataFrame, lost: DataFrame) -> DataFrame:
    """Nodes with those pending again that made a lost target; io has node_id, role, target."""
    makers = io.where("role = 'output'").join(lost.select("target").distinct(), "target", "left_semi").select("node_id").distinct().withColumn("_again", F.lit(True))
    status = F.when(F.col("_again") & (F.col("status") == "completed"), "pending").otherwise(F.col("status"))
    return nodes.join(makers, "node_id", "left").withColumn("status", status).drop("_again")


#: Which previewer shows a file, first match first.
PREVIEWERS = (("*.csv", "csv"), ("*.xls*", "excel"), ("*.gz", "gz"), ("*.zip", "zip"), ("*.tar*", "tar"), ("*.txt", "text"), ("*.md", "markdown"), ("*.html", "html"), ("*.svg", "svg"), ("*.png", "image"), ("*.jpg", "image"), ("*.gif", "image"), ("*.pdf", "pdf"), ("*.dot", "dot"))


#: Which previewer shows a file by how its content starts, where its name says nothing.
BY_CONTENT = ((r"(?is)^\s*(<!doctype html|<html)", "html"), (r"(?s)^%PDF-", "pdf"), (r"(?s)^\s*(<\?xml[^>]*>\s*)?<svg", "svg"), (r"(?s)^\s*(di)?graph\s", "dot"))


def previewer(path: Column, default: str = "text", content: Column | None = None) -> Column:
    """The previewer of a path by its name, then by its content if that is given."""
    out = F.when(F.lit(False), "")
    for pattern, name in PREVIEWERS:
        out = out.when(named_like(path, pattern), name)
    for pattern, name in BY_CONTENT if content is not None else ():
        out = out.when(F.coalesce(content.rlike(pattern), F.lit(False)), name)
    return out.otherwise(default)
