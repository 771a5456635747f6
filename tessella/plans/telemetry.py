"""Queries of telemetry and previews: ``events`` are pulses, users tasks, event types states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import preview
from tessella.operators import telemetry as m
from tessella.plans import tables as t
from tessella.plans.query import query


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


@query("""SELECT user_id AS task_id, count(*) AS n, max(value) AS peak_cpu, round(avg(CAST(round(value * 100) AS BIGINT)), 4) AS mean_cpu, max(event_id) AS peak_mem, round(avg(event_id), 4) AS mean_mem, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration FROM events GROUP BY 1""")
def pulse_summary(spark: SparkSession, d: str) -> DataFrame:
    pulses = t.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), "value", _cents("value").alias("cents"), F.col("event_id").alias("mem"))
    s = m.pulse_summary(pulses, cpu="cents")
    return s.select("task_id", "n", (F.col("peak_cpu") / 100).alias("peak_cpu"), F.round("mean_cpu", 4).alias("mean_cpu"), "peak_mem", F.round("mean_mem", 4).alias("mean_mem"), "duration")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events")
def running_peak(spark: SparkSession, d: str) -> DataFrame:
    return m.running_peak(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "peak")


_NOW = "2024-01-31 00:00:00"


@query(f"SELECT * FROM (SELECT user_id, (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(max(ts))) // 1000000 AS silent FROM events GROUP BY 1) WHERE silent > 28800")
def heartbeat_expired(spark: SparkSession, d: str) -> DataFrame:
    pulses = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return m.expired(pulses, F.lit(_NOW).cast("timestamp"), "user_id", "ts", 28800)


@query("SELECT event_type AS status, count(*) AS n FROM (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    last = m.latest_status(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return m.status_counts(last.withColumnRenamed("event_type", "status"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_completed, count(*) FILTER (event_type = 'error') AS n_skipped, count(*) FILTER (event_type <> 'error') / count(*) AS ratio FROM events GROUP BY 1")
def completion_ratio(spark: SparkSession, d: str) -> DataFrame:
    return m.completion(t.table(spark, d, "events"), "user_id", F.col("event_type") == "error")


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE l_linenumber END) AS BIGINT) AS ret_code, CASE WHEN count(*) FILTER (l_linestatus = 'F') = count(*) THEN 'all' WHEN count(*) FILTER (l_linestatus = 'F') > 0 THEN 'partial' ELSE 'none' END AS skipped FROM lineitem GROUP BY 1""")
def combine_results(spark: SparkSession, d: str) -> DataFrame:
    return m.combined_result(t.table(spark, d, "lineitem"), "l_orderkey", F.col("l_linenumber"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")


@query("SELECT l_orderkey, CAST(ceil(count(*) / 4.0) * (30 + l_orderkey % 7) AS BIGINT) AS walltime, CAST(2 * (4 + l_orderkey % 3) AS BIGINT) AS mem, CAST(2 * (1 + l_orderkey % 5) AS BIGINT) AS cores FROM lineitem GROUP BY l_orderkey")
def resource_rollup(spark: SparkSession, d: str) -> DataFrame:
    tasks = t.table(spark, d, "lineitem").select("l_orderkey", (30 + F.col("l_orderkey") % 7).alias("w"), (4 + F.col("l_orderkey") % 3).alias("m"), (1 + F.col("l_orderkey") % 5).alias("c"))
    return m.resources(tasks, "l_orderkey", "w", "m", "c", workers=2, nodes=2)


@query("""WITH p AS (SELECT l_orderkey AS batch, row_number() OVER () AS member, * FROM lineitem), k AS (SELECT batch, member, 'flag' AS key, l_returnflag AS value FROM p UNION ALL SELECT batch, member, 'status', l_linestatus FROM p UNION ALL SELECT batch, member, 'mode', 'x' FROM p WHERE l_linenumber <> 3 UNION ALL SELECT batch, member, 'rare', CASE WHEN l_linenumber <> 2 THEN 'y' END FROM p)
SELECT batch, key, min(value) AS value FROM k JOIN (SELECT batch, count(*) AS n FROM p GROUP BY 1) USING (batch) GROUP BY 1, 2 HAVING count(DISTINCT value) = 1 AND count(DISTINCT member) = any_value(n) AND count(value) = count(*)""")
def common_values(spark: SparkSession, d: str) -> DataFrame:
    """Parameters that all subtasks of a batch share: one is missing in some of them, one is null in some."""
    lines = t.table(spark, d, "lineitem")
    member = F.xxhash64(*lines.columns)
    value = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "mode": F.when(F.col("l_linenumber") != 3, "x"), "rare": F.when(F.col("l_linenumber") != 2, "y")}
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in value.items()))
    rows = lines.select(F.col("l_orderkey").alias("batch"), member.alias("member"), F.explode(pairs).alias("p")).select("batch", "member", "p.*")
    return m.common_values(rows.where("key <> 'mode' OR value IS NOT NULL"))


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS a, count(*) FILTER (event_type = 'error') AS b FROM events GROUP BY 1),
x AS (SELECT count(*) AS n_steps, count(*) FILTER (a > 0 AND b = 0) AS n_run, count(*) FILTER (a > 0 AND b > 0) AS n_partial, count(*) FILTER (a = 0) AS n_ignored, CAST(sum(a) AS BIGINT) AS n_completed, CAST(sum(b) AS BIGINT) AS n_skipped FROM s)
SELECT *, n_steps || ' steps (' || n_completed || ' completed substeps, ' || n_skipped || ' skipped substeps)' AS said FROM x""")
def completion_totals(spark: SparkSession, d: str) -> DataFrame:
    return m.completion_totals(t.table(spark, d, "events"), "user_id", F.col("event_type") == "error")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN CAST(-1 AS BIGINT) WHEN l_returnflag = 'N' THEN CAST(20000 - epoch_us(l_shipdate) // 86400000000 AS BIGINT) ELSE CAST(l_linenumber AS BIGINT) END AS days FROM lineitem""")
def task_durations(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems are tasks that start when shipped: some never ran, some run still, the rest ended days later."""
    lines = t.table(spark, d, "lineitem")
    shipped = F.unix_date(F.col("l_shipdate").cast("date"))
    status = F.when(F.col("l_returnflag") == "N", "running").otherwise("completed")
    return lines.select("l_orderkey", "l_linenumber", m.duration(status, F.lit(20000), F.when(F.col("l_linestatus") != "F", shipped), shipped + F.col("l_linenumber")).cast("bigint").alias("days")).na.fill(-1, ["days"])


@query("SELECT 'event_id' AS along, TRUE AS ordered UNION ALL SELECT 'value', (SELECT count(*) = 0 FROM (SELECT value, lead(value) OVER (ORDER BY event_id) AS n FROM events) WHERE value > n)")
def sorted_columns(spark: SparkSession, d: str) -> DataFrame:
    """Whether columns never fall along the order of events."""
    e = t.table(spark, d, "events").select("event_id", "value", F.col("event_id").alias("copy"))
    return spark.createDataFrame([("event_id", m.is_sorted(e, "event_id", "copy")), ("value", m.is_sorted(e, "event_id", "value"))], "along string, ordered boolean")


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 16 AS trunk, (row_number() OVER (ORDER BY event_id) - 1) % 16 AS slot FROM events WHERE event_type <> 'error'")
def trunking(spark: SparkSession, d: str) -> DataFrame:
    return m.trunks(t.table(spark, d, "events"), "event_id", 16, F.col("event_type") == "error").select("event_id", "trunk", "slot")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def merged_log(spark: SparkSession, d: str) -> DataFrame:
    return m.merged_log(t.table(spark, d, "events"), ["user_id", "event_type"], "value", "event_id")


@query("""WITH r AS (SELECT user_id, epoch_us(min(ts)) // 1000000 AS a, epoch_us(max(ts)) // 1000000 AS b FROM events GROUP BY 1), w AS (SELECT *, min(a) OVER () AS f, greatest(max(b) OVER () - min(a) OVER (), 1) AS tot FROM r),
s AS (SELECT user_id, (a - f) * 100 // tot AS before_pct, greatest(1, (b - a) * 100 // tot) AS during_pct FROM w) SELECT user_id, before_pct, CAST(during_pct AS BIGINT) AS during_pct, CAST(greatest(0, 100 - before_pct - during_pct) AS BIGINT) AS after_pct FROM s""")
def timeline_pct(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    runs = t.table(spark, d, "events").groupBy("user_id").agg(F.min(s).alias("a"), F.max(s).alias("b"))
    return m.timeline(runs, "user_id", "a", "b")


@query("SELECT event_id, gap FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000000 AS gap FROM events) WHERE gap > 43200")
def pulse_gaps(spark: SparkSession, d: str) -> DataFrame:
    pulses = t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return m.gaps(pulses, "user_id", ["ts", "event_id"], "ts", 43200).select("event_id", "gap")


@query("WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pl, count(*) OVER () AS m FROM events) SELECT event_id FROM e WHERE pl IN (SELECT x * (SELECT max(m) FROM e) // 50 + (SELECT max(m) FROM e) // 100 FROM range(50) AS r(x))")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return m.even_sample(t.table(spark, d, "events").select("event_id"), "event_id", 50).select("event_id")


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 20")
def tail(spark: SparkSession, d: str) -> DataFrame:
    return m.tail(t.table(spark, d, "events").select("event_id", "user_id"), "event_id", 20)


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def tail_per_task(spark: SparkSession, d: str) -> DataFrame:
    return m.tail_in(t.table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 3)


@query("SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE list_has_any([l_returnflag, l_linestatus], ['R', 'O'])")
def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with any of the tags."""
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return lines.where(F.arrays_overlap(F.array("l_returnflag", "l_linestatus"), F.lit(["R", "O"])))


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 200")
def table_head(spark: SparkSession, d: str) -> DataFrame:
    return preview.table(t.table(spark, d, "part").select("p_partkey", "p_name", "p_size"), [F.desc("p_size"), "p_partkey"])


@query("""WITH s AS (SELECT * FROM part ORDER BY p_partkey LIMIT 2000), k AS (SELECT 'p_size' AS y, CAST(p_size AS DOUBLE) AS v, * FROM s UNION ALL SELECT 'p_retailprice', p_retailprice, * FROM s)
SELECT y || '|p_type=' || p_type AS series, CAST(p_partkey AS DOUBLE) AS x, v AS y FROM k""")
def scatter_series(spark: SparkSession, d: str) -> DataFrame:
    return preview.series(t.table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], ["p_type"], ["p_partkey"])


@query("""WITH l AS (SELECT doc_id AS file, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS text FROM documents) SELECT file, count(*) OVER (PARTITION BY file) AS n_lines, CAST(n AS INTEGER) AS n, text FROM l QUALIFY n < 5""")
def head_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = t.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return preview.head_lines(lines)
