"""Dependencies between steps: edges, dangling targets, readiness, reach, levels.

Nodes and their inputs and outputs are tables; loops over them keep the
frontier distributed, write each round to the shared folder and learn only
whether it was empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ordinal import with_previous
from tessella.functions.patterns import compile_pattern
from tessella.shared import cut


class CycleError(ValueError):
    """The steps depend on each other in a circle."""


def node_ids(nodes: DataFrame, identity: list[str]) -> DataFrame:
    """One node for each identity."""
    return nodes.withColumn("node_id", F.md5(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in identity)))).dropDuplicates(["node_id"])


def edges_by_target(io: DataFrame) -> DataFrame:
    """(src, dst): dst reads what src writes; io has node_id, role (output, or else) and target."""
    made = io.where("role = 'output'").select("target", F.col("node_id").alias("src"))
    used = io.where("role <> 'output'").select("target", F.col("node_id").alias("dst"))
    return made.join(used, "target").where("src <> dst").select("src", "dst").distinct()


def edges_by_variable(nodes: DataFrame) -> DataFrame:
    """(src, dst): a later step of the same workflow uses a variable that an earlier one changes."""
    changes = nodes.select("workflow", F.col("node_id").alias("src"), F.col("node_index").alias("i"), F.explode("changed_vars").alias("v"))
    uses = nodes.select("workflow", F.col("node_id").alias("dst"), F.col("node_index").alias("j"), F.explode("used_vars").alias("v"))
    return changes.join(uses, ["workflow", "v"]).where("i < j").select("src", "dst").distinct()


def edges_by_order(nodes: DataFrame) -> DataFrame:
    """(src, dst): each step after the one before it in its workflow; numbers need not be consecutive."""
    rows = nodes.select("workflow", "node_index", "node_id")
    return with_previous(rows, "workflow", "node_index", values={"_src": "node_id"}).select(F.col("_src").alias("src"), F.col("node_id").alias("dst")).where(F.col("src").isNotNull())


def edges_of_undetermined(nodes: DataFrame) -> DataFrame:
    """(src, dst): steps whose input is not known yet follow the step before, and every earlier step that changes a variable that they need.

    ``nodes`` as in ``edges_by_variable``, with a boolean ``undetermined``.
    """
    waiting = nodes.where("undetermined").select(F.col("node_id").alias("dst"))
    return edges_by_order(nodes).unionByName(edges_by_variable(nodes)).distinct().join(waiting, "dst", "left_semi").select("src", "dst")


def variables_used(sections: DataFrame) -> DataFrame:
    """(node_id, used_vars): all variables of a step: those it uses, those it reads from elsewhere and its parameters, sorted."""
    every = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("used", "accessed", "parameters"))))))
    return sections.select("node_id", every.alias("used_vars"))


def dangling(io: DataFrame, files: DataFrame) -> DataFrame:
    """(target, exists): wanted but made by no node."""
    wanted = io.where("role <> 'output'").select("target").distinct()
    made = io.where("role = 'output'").select("target").distinct()
    there = files.select("target").distinct().withColumn("_t", F.lit(True))
    return wanted.join(made, "target", "left_anti").join(there, "target", "left").select("target", F.col("_t").isNotNull().alias("exists"))


def providers(wanted: DataFrame, exact: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(target, step, bindings): who makes a target: an exact entry, else the first pattern that matches.

    ``exact``: (target, step); ``patterns``: (pattern, step) in order of
    precedence.  Bindings are a map of wildcard values.  Two steps that make one
    wanted target, and two steps of one pattern, are errors.
    """
    if len({q for q, _ in patterns}) < len(set(patterns)):
        raise ValueError("several steps provide the targets of one pattern")
    known = exact.groupBy("target").agg(F.min("step").alias("_exact"), (F.min("step") != F.max("step")).alias("_several"))
    found = wanted.select("target").distinct().join(known, "target", "left")
    found = found.where(F.when(F.col("_several"), F.raise_error(F.concat(F.lit("several steps provide "), F.col("target"))).cast("boolean")).otherwise(F.lit(True)))
    step = F.when(F.col("_exact").isNotNull(), F.col("_exact"))
    bindings = F.when(F.col("_exact").isNotNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    for pattern, name in patterns:
        regex, names = compile_pattern(pattern)
        hit = F.col("target").rlike(regex)
        step = step.when(hit, name)
        bindings = bindings.when(hit, F.map_from_arrays(F.lit(names), F.array(*(F.regexp_extract("target", regex, i + 1) for i in range(len(names))))) if names else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return found.select("target", step.alias("step"), bindings.alias("bindings")).where(F.col("step").isNotNull())


def resolve(io: DataFrame, exact: DataFrame, patterns: list[tuple[str, str, list[str]]], files: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(io, unresolved): nodes added for targets that nobody makes, until none is added.

    ``exact``: (target, step); ``patterns``: (pattern, step, inputs), whose
    inputs are name patterns over the wildcards.  A target that exists and has
    no provider needs no node; one that does neither is unresolved.  A node
    that is added is called ``step|target``.  Each round is written and only
    learns whether it was empty; its frontier is what the round before wanted.
    """
    needs = {step: inputs for _, step, inputs in patterns}
    files = files.select("target").distinct()
    wanted = cut(dangling(io, files).select("target"))
    done, unresolved, rounds = io.select("node_id", "role", "target"), wanted.limit(0), 0
    while not wanted.isEmpty():
        rounds += 1
        if rounds > most:
            raise CycleError(f"targets still need others after {most} rounds")
        found = cut(providers(wanted, exact, [(q, step) for q, step, _ in patterns]))
        unresolved = unresolved.unionByName(wanted.join(found.select("target"), "target", "left_anti").join(files, "target", "left_anti"))
        node = F.concat_ws("|", "step", "target")
        new = found.select(node.alias("node_id"), F.lit("output").alias("role"), "target")
        for step, inputs in needs.items():
            for text in inputs:
                made = expand_pattern(text, F.col("bindings"))
                new = new.unionByName(found.where(F.col("step") == step).select(node.alias("node_id"), F.lit("input").alias("role"), made.alias("target")))
        new = cut(new)
        done = done.unionByName(new)
        made = done.where("role = 'output'").select("target").distinct()
        wanted = cut(new.where("role <> 'output'").select("target").distinct().join(made, "target", "left_anti").join(unresolved, "target", "left_anti"))
    return done, unresolved


def expand_pattern(text: str, bindings: Column) -> Column:
    """A name pattern with the values of its wildcards from a map."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*(F.lit(x) if i % 2 == 0 else F.coalesce(F.try_element_at(bindings, F.lit(x)), F.lit("")) for i, x in enumerate(parts)))


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending nodes all of whose predecessors are completed; nodes have node_id and status."""
    open_ = nodes.where("status <> 'completed'").select(F.col("node_id").alias("src"))
    waiting = edges.join(open_, "src").select(F.col("dst").alias("node_id")).distinct()
    return nodes.where("status = 'pending'").join(waiting, "node_id", "left_anti")


def reachable(edges: DataFrame, start: DataFrame, backwards: bool = False) -> DataFrame:
    """(node_id, depth) of all nodes that start reaches, itself included, at the least depth; circles do no harm."""
    a, b = ("dst", "src") if backwards else ("src", "dst")
    steps = cut(edges.select(F.col(a).alias("node_id"), F.col(b).alias("_next")).distinct())
    front = seen = cut(start.select("node_id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not front.isEmpty():
        depth += 1
        front = cut(front.join(steps, "node_id").select(F.col("_next").alias("node_id")).distinct().join(seen, "node_id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
        if depth % 8 == 0:  # what was seen stays a union of a few tables
            seen = cut(seen)
    return seen


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, level): rounds of steps that can run together.  A circle raises ``CycleError``.

    Every node keeps the number of its open predecessors; a round takes off
    those of the last level, joined by its edges alone, and is written once.
    """
    arcs = cut(edges.select("src", "dst").distinct())
    open_ = arcs.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("open"))
    level = 0
    state = cut(nodes.select("node_id").distinct().join(open_, "node_id", "left").select("node_id", F.coalesce("open", F.lit(0)).alias("open"), F.when(F.col("open").isNull(), 0).alias("level")))
    while not state.where(F.col("level") == level).isEmpty():
        closed = state.where(F.col("level") == level).select(F.col("node_id").alias("src")).join(arcs, "src").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("_n"))
        left = F.col("open") - F.coalesce("_n", F.lit(0))
        level += 1
        state = cut(state.join(closed, "node_id", "left").select("node_id", left.alias("open"), F.when(F.col("level").isNull() & (left == 0), level).otherwise(F.col("level")).alias("level")))
    stuck = state.where("level IS NULL")
    if not stuck.isEmpty():
        raise CycleError(f"{stuck.count()} steps depend on each other in a circle")
    return state.select("node_id", "level")


def blocked(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Nodes that a failed node keeps from running."""
    return reachable(edges, failed).where("depth > 0").select("node_id")


def after_failure(nodes: DataFrame, edges: DataFrame, failed: DataFrame, mode: str = "default") -> DataFrame:
    """(node_id, status): what becomes of nodes (node_id, status) once some have failed.

    ``default``: what does not depend on a failed node goes on, the rest is
    blocked; ``abort``: nothing that is not completed or running goes on;
    ``ignore``: failed nodes count as completed and all the others go on.
    """
    if mode not in ("default", "abort", "ignore"):
        raise ValueError(f"unknown error mode {mode!r}")
    marked = nodes.join(failed.select("node_id").distinct().withColumn("_failed", F.lit(True)), "node_id", "left")
    if mode == "ignore":
        return marked.select("node_id", F.when(F.col("_failed"), "ignored").otherwise(F.col("status")).alias("status"))
    own = F.when(F.col("_failed"), "failed")
    if mode == "abort":
        return marked.select("node_id", own.when(F.col("status") == "pending", "aborted").otherwise(F.col("status")).alias("status"))
    held = blocked(edges, failed).distinct().withColumn("_held", F.lit(True))
    return marked.join(held, "node_id", "left").select("node_id", own.when(F.col("_held") & (F.col("status") == "pending"), "blocked").otherwise(F.col("status")).alias("status"))


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a graph description with a colour for each status; a table, written like any other."""
    colour = F.create_map(*(F.lit(x) for kv in {"completed": "green", "failed": "red", "running": "yellow", "pending": "blue"}.items() for x in kv))
    boxes = nodes.select(F.format_string('"%s" [color=%s];', F.col("node_id").cast("string"), F.coalesce(F.try_element_at(colour, F.col("status")), F.lit("black"))).alias("line"))
    return boxes.unionByName(edges.select(F.format_string('"%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line")))
