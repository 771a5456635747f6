"""What has to be run again: signatures, validity of files, freshness, tracked files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import SECONDS

MODES = ("default", "skip", "distributed", "assert", "build", "force", "ignore")


def signature_id(*parts: Column) -> Column:
    """Hash of a step's body, targets and canonical variables."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def signature_ids(io: DataFrame, variables: DataFrame | None = None, body: str = "body") -> DataFrame:
    """(step_id, sig_id) from rows (step_id, body, role, ord, name) and variables (step_id, var, value).

    The names of each role count in their order, variables by their names.  A
    row of the role ``index`` (its name the number of the loop group) makes
    signatures of groups differ whose output is not known yet.
    """
    names = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("ord", "name")))), lambda e: e["name"])
    listed = io.groupBy("step_id", body).agg(*(F.array_join(names(r), "\x1e").alias(r) for r in ("input", "output", "depends", "index")))
    if variables is None:
        return listed.select("step_id", signature_id(F.col(body), F.col("input"), F.col("output"), F.col("depends"), F.lit(""), F.col("index")).alias("sig_id"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("var", "value"))), lambda e: F.concat(e["var"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit(""))))
    context = variables.groupBy("step_id").agg(F.array_join(pairs, "\x1e").alias("_vars"))
    return listed.join(context, "step_id", "left").select("step_id", signature_id(F.col(body), F.col("input"), F.col("output"), F.col("depends"), F.col("_vars"), F.col("index")).alias("sig_id"))


def groups_to_run(signatures: DataFrame, stored: DataFrame) -> DataFrame:
    """(step_id, gid, sig_id) of loop groups without a stored signature: a loop that grew runs its new groups only."""
    return signatures.join(stored.select("sig_id").distinct(), "sig_id", "left_anti").select("step_id", "gid", "sig_id")


def file_state(size: Column, mtime: Column, md5: Column, stored_size: Column, stored_mtime: Column, stored_md5: Column, zapped: Column) -> Column:
    """Validity of a file against its signature; the hash is compared last, where it has to be."""
    return (
        F.when(stored_md5.isNull(), "no signature")
        .when(zapped, F.when(md5 == stored_md5, "valid").otherwise("changed"))
        .when(size.isNull(), "missing")
        .when(size != stored_size, "changed")
        .when(mtime == stored_mtime, "valid")
        .when(md5 == stored_md5, "valid")
        .otherwise("changed")
    )


def compare_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, state) of every file of either side; both have name, size, mtime, md5, current also zapped."""
    s = stored.select("name", *(F.col(c).alias(f"_{c}") for c in ("size", "mtime", "md5")))
    c = F.col
    return current.join(s, "name", "full").select("name", file_state(c("size"), c("mtime"), c("md5"), c("_size"), c("_mtime"), c("_md5"), F.coalesce(c("zapped"), F.lit(False))).alias("state"))


def validate(current: DataFrame, stored: DataFrame, contexts: DataFrame, stored_contexts: DataFrame) -> DataFrame:
    """(step_id, reason): why a step cannot be skipped, ``match`` if it can.

    The first of these that holds: no signature; a target missing; a variable
    missing; a variable differs; a target without signature; a target changed.
    ``current``/``stored``: (step_id, role, name, md5); contexts: (step_id, var, value_md5).
    """
    t = current.select("step_id", "role", "name", "md5", F.lit(True).alias("_here")).join(stored.select("step_id", "role", "name", F.col("md5").alias("_md5"), F.lit(True).alias("_known")), ["step_id", "role", "name"], "full")
    targets = t.groupBy("step_id").agg(
        F.count_if("_known").alias("n_known"),
        F.count_if(F.col("_known") & (F.col("_here").isNull() | F.col("md5").isNull())).alias("n_missing"),
        F.count_if(F.col("_here") & F.col("_known").isNull()).alias("n_unsigned"),
        F.count_if(F.col("_here") & F.col("_known") & (F.col("md5") != F.col("_md5"))).alias("n_changed"),
    )
    v = contexts.select("step_id", "var", "value_md5", F.lit(True).alias("_here")).join(stored_contexts.select("step_id", "var", F.col("value_md5").alias("_md5")), ["step_id", "var"], "right")
    variables = v.groupBy("step_id").agg(F.count_if(F.col("_here").isNull()).alias("n_lost"), F.count_if(F.col("_here") & ~F.col("value_md5").eqNullSafe(F.col("_md5"))).alias("n_differ"))
    joined = targets.join(variables, "step_id", "left").na.fill(0, ["n_lost", "n_differ"])
    reason = (
        F.when(F.col("n_known") == 0, "no signature")
        .when(F.col("n_missing") > 0, "missing target")
        .when(F.col("n_lost") > 0, "missing variable")
        .when(F.col("n_differ") > 0, "variable changed")
        .when(F.col("n_unsigned") > 0, "target without signature")
        .when(F.col("n_changed") > 0, "target changed")
        .otherwise("match")
    )
    return joined.select("step_id", reason.alias("reason"))


def to_run(decisions: DataFrame, mode: str = "default") -> DataFrame:
    """Steps that run in a mode, from ``validate``'s decisions."""
    if mode not in MODES:
        raise ValueError(f"unknown signature mode {mode!r}")
    if mode in ("force", "ignore"):
        return decisions
    if mode == "build":
        return decisions.limit(0)
    if mode == "assert":
        return decisions.where(F.when(F.col("reason") != "match", F.raise_error(F.concat(F.lit("signature mismatch: "), F.col("step_id").cast("string")))).otherwise(F.lit(False)))
    return decisions.where(F.col("reason") != "match")


def later_than(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, fresh): the oldest of left is newer than the newest of right; nothing right is fresh, nothing left is not.

    Both have key and mtime.
    """
    a, b = left.groupBy(key).agg(F.min("mtime").alias("_a")), right.groupBy(key).agg(F.max("mtime").alias("_b"))
    return a.join(b, key, "full").select(key, (F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a") > F.col("_b")))).alias("fresh"))


def overlapping(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(gid, name) that are input and output of one substep."""
    return inputs.select("gid", "name").distinct().join(outputs.select("gid", "name").distinct(), ["gid", "name"])


def shared_outputs(outputs: DataFrame) -> DataFrame:
    """(name, n): outputs that several substeps claim."""
    return outputs.select("gid", "name").distinct().groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def missing_inputs(members: DataFrame, files: DataFrame) -> DataFrame:
    """(gid, n_missing) of all groups: under the lenient policy those above zero are skipped."""
    seen = members.join(files.select("name").distinct().withColumn("_here", F.lit(True)), "name", "left")
    return seen.groupBy("gid").agg(F.count_if(F.col("_here").isNull()).alias("n_missing"))


def tracked(files: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return files.join(known.select(key).distinct(), key, "left_semi")


def untracked(files: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return files.join(known.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key of an append-only store: what an upsert would have left."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("_r")).select(key, "_r.*")


def zap(files: DataFrame, condition: Column) -> DataFrame:
    """Files whose content is given up and whose signature stays."""
    return files.withColumn("zapped", F.coalesce(F.col("zapped"), F.lit(False)) | condition)


def age_filter(mtime: Column, now: Column, age: str, unit: str = "d") -> Column:
    """At least ``age`` old; with a minus sign at most that.  Unknown times pass no filter."""
    m = re.fullmatch(r"([+-]?)(\d+(?:\.\d+)?)([smhd]?)", age.strip())
    if not m:
        raise ValueError(f"{age!r} is no age")
    limit = float(m[2]) * SECONDS[m[3] or unit]
    return F.coalesce((now - mtime <= limit) if m[1] == "-" else (now - mtime >= limit), F.lit(False))


def size_filter(size: Column, limit: int) -> Column:
    """At least ``limit`` bytes; at most that many if negative."""
    return F.coalesce(size <= -limit if limit < 0 else size >= limit, F.lit(False))
