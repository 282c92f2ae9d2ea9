"""Run history and token accounting over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import runs
from lodestar.plans.starmap import Star
from lodestar.queries.registry import query


def _events(spark, sf_dir):
    return Star(spark, sf_dir).table("events")


@query("select user_id, arg_max(event_id, (ts, event_id)) as last_event from events group by user_id")
def last_commit(spark, sf_dir):
    return runs.latest_per_key(_events(spark, sf_dir).withColumn("last_event", F.col("event_id")), ["user_id"], ["ts", "event_id"], "last_event")


@query("select event_id, user_id from events where event_type = 'purchase' order by ts desc, event_id desc limit 20")
def recent_runs_topk(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("select event_id, lag(event_type) over w as previous, event_type is distinct from lag(event_type) over w as changed from events window w as (partition by user_id order by ts, event_id)")
def commit_delta_lag(spark, sf_dir):
    return runs.commit_changes(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "previous", "changed")


@query("""with s as (select user_id as application, event_type as commit, lag(event_type) over (partition by user_id order by ts, event_id) as previous, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
select application, bool_and(coalesce(commit = previous, false)) and bool_and(application % 2 = 0) as skipped from s where r <= 2 group by application""")
def skip_gate(spark, sf_dir):
    w = Window.partitionBy("user_id")
    s = _events(spark, sf_dir).select(F.col("user_id").alias("application"), F.col("event_type").alias("commit"), F.lag("event_type").over(w.orderBy("ts", "event_id")).alias("previous"), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("r"))
    return runs.skip_if_unchanged(s.where("r <= 2").withColumn("flag", F.col("application") % 2 == 0))


@query("select event_type as scope, sum(floor(value)::bigint)::bigint as tokens, count(*) as calls from events group by 1 union all select null, sum(floor(value)::bigint)::bigint, count(*) from events")
def token_ledger(spark, sf_dir):
    return runs.token_ledger(_events(spark, sf_dir).select(F.col("event_type").alias("scope"), F.floor("value").alias("tokens")))


@query("select user_id, sum(floor(value)::bigint)::bigint as after, sum(case when ts < timestamp '2024-01-15' then floor(value)::bigint else 0 end)::bigint as before, sum(case when ts >= timestamp '2024-01-15' then floor(value)::bigint else 0 end)::bigint as delta from events group by user_id")
def run_token_delta(spark, sf_dir):
    tokens, old = F.floor("value"), F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    g = _events(spark, sf_dir).groupBy("user_id").agg(F.sum(tokens).alias("after"), F.sum(F.when(old, tokens).otherwise(0)).alias("before"))
    return g.withColumn("delta", F.col("after") - F.col("before"))


@query("select event_type as metric, count(*) as counter, arg_max(value, (ts, event_id)) as gauge from events group by event_type")
def metrics_gauges(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("counter"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))


def _window_sql(seconds: int) -> str:
    return f"select event_id, (sum(floor(value)::bigint) over (partition by event_type order by ts range between interval {seconds} seconds preceding and current row))::bigint as used from events"


@query(_window_sql(60))
def tpm_window_60s(spark, sf_dir):
    return runs.trailing_sum(_events(spark, sf_dir).withColumn("tokens", F.floor("value")), "event_type", "ts", "tokens", 60).select("event_id", "used")


@query(_window_sql(3600))
def tpm_window_1h(spark, sf_dir):
    return runs.trailing_sum(_events(spark, sf_dir).withColumn("tokens", F.floor("value")), "event_type", "ts", "tokens", 3600).select("event_id", "used")


@query("""with recursive e as (select event_type || user_id % 10 as tier, ts, floor(value)::bigint as n, row_number() over (partition by event_type || user_id % 10 order by ts, event_id) as r from events),
s(tier, r, win, ok) as (
  select tier, 0::bigint, []::struct(moment timestamp, n bigint)[], false from (select distinct tier from e)
  union all select tier, r, case when fits then list_append(w, {'moment': ts, 'n': n}) else w end, fits from (
    select *, coalesce(list_sum(list_transform(w, lambda x: x.n)), 0) + n <= 60 or len(w) = 0 as fits from (
      select e.*, list_filter(s.win, lambda x: x.moment >= e.ts - interval 3600 seconds) as w from s join e on e.tier = s.tier and e.r = s.r + 1)))
select tier, count_if(ok) as admitted, count(*) as asked from s where r > 0 group by tier""")
def throttle_admission(spark, sf_dir):
    u = _events(spark, sf_dir).select(F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("tier"), "ts", "event_id", F.floor("value").alias("tokens"))
    return runs.admitted(u, 60, "tier", "ts", "tokens", 3600, "event_id").groupBy("tier").agg(F.count_if("admitted").alias("admitted"), F.count("*").alias("asked"))


@query("select range::bigint as attempt, least(3000, 500 * 2 ** range)::bigint as wait_ms from range(6)")
def backoff_schedule(spark, sf_dir):
    return spark.range(6).select(F.col("id").alias("attempt"), T.backoff_ms(F.col("id")).alias("wait_ms"))


@query("""with f as (select event_id, [401, 429, 503, null, null, 404, null, 403][event_id % 8 + 1] as status, [null, 'slow', null, 'Timeout reached', 'empty answer', null, null, 'x'][event_id % 8 + 1] as detail from events)
select event_id, case when status in (401, 403) then 'Unauthorized' when status = 429 then 'RateLimited' when status in (500, 502, 503, 504) then 'ServerError'
when contains(lower(coalesce(detail, '')), 'timeout') then 'Timeout' when contains(lower(coalesce(detail, '')), 'empty') then 'EmptyResponse' when status = 404 then 'NotFound' else 'Unknown' end as reason from f""")
def failure_reason_case(spark, sf_dir):
    at = (F.col("event_id") % 8 + 1).cast("int")
    status, detail = F.array(*map(F.lit, (401, 429, 503, None, None, 404, None, 403))), F.array(*map(F.lit, (None, "slow", None, "Timeout reached", "empty answer", None, None, "x")))
    f = _events(spark, sf_dir).select("event_id", F.element_at(status, at).alias("status"), F.element_at(detail, at).alias("detail"))
    return f.select("event_id", T.failure_reason(F.col("status"), F.col("detail")).alias("reason"))


@query("select user_id % 10 as application, event_type as reason, count(*) as n from events group by 1, 2")
def fallback_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("application"), F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@query("select o_custkey as application, count(*) + 1 as next from orders group by 1")
def next_version(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    v = Star(spark, sf_dir).table("orders").select(F.col("o_custkey").alias("application"), F.row_number().over(w).cast("long").alias("number"))
    return runs.next_version(v)


@query("select o_custkey as application, string_agg(o_orderkey::varchar, ' ' order by o_orderkey desc) as versions from orders group by 1")
def version_pick_desc(spark, sf_dir):
    g = Star(spark, sf_dir).table("orders").groupBy(F.col("o_custkey").alias("application")).agg(F.sort_array(F.collect_list("o_orderkey"), asc=False).alias("k"))
    return g.select("application", F.array_join(F.transform("k", lambda k: k.cast("string")), " ").alias("versions"))


@query("select p_brand, p_partkey, row_number() over w as place, lag(p_type) over w is distinct from p_type as new_group from part window w as (partition by p_brand order by p_type, p_partkey)")
def nav_order(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_type", "p_partkey")
    p = Star(spark, sf_dir).table("part")
    return p.select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place"), (~F.lag("p_type").over(w).eqNullSafe(F.col("p_type"))).alias("new_group"))


@query("select event_id % 3 = 0 as done, count(*) as runs from events group by 1")
def run_completion(spark, sf_dir):
    e = _events(spark, sf_dir)
    begun, ends = e.select(F.col("event_id").alias("run_id")), e.where("event_id % 3 = 0").select(F.col("event_id").alias("run_id"), F.col("ts").alias("completed_at"), F.lit("Completed").alias("status"))
    return runs.completed(begun, ends).groupBy((F.col("status") == "Completed").alias("done")).agg(F.count("*").alias("runs"))
