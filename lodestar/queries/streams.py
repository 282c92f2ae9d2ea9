"""Streaming queries and their batch twins over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators.extract import react_components
from lodestar.plans.starmap import Star
from lodestar.queries.registry import query
from lodestar.streaming import incremental as inc



def _stream(spark, sf_dir):
    """The events as a file stream, in one micro-batch; UTC instants, as watermarks need."""
    table = Star(spark, sf_dir).table("events")
    s = spark.readStream.schema(table.schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


_TUMBLING = "select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2"


@query(_TUMBLING)
def window_tumbling(spark, sf_dir):
    e = Star(spark, sf_dir).table("events")
    return inc.windows(e, "1 day").select(F.col("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""select b + to_hours(6 * k)::interval as start, event_type, count(*) as n, round(sum(value), 6) as total from (select *, time_bucket(interval '6 hours', ts) - interval '18 hours' as b from events), range(4) r(k) group by 1, 2""")
def window_sliding(spark, sf_dir):
    e = Star(spark, sf_dir).table("events")
    return inc.windows(e, "1 day", "6 hours").select("start", "event_type", "n", F.round("total", 6).alias("total"))


_SESSION = """with g as (select *, case when ts - lag(ts) over w >= interval '6 hours' or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g) select min(ts) as start, user_id, count(*) as n from s group by user_id, session"""


@query(_SESSION)
def window_session(spark, sf_dir):
    return inc.sessions(Star(spark, sf_dir).table("events"), "6 hours").select("start", "user_id", "n")


_CLOSED = "(select max(ts) - interval '10 minutes' from events)"


@query(f"select * from ({_TUMBLING}) where start + interval '1 day' <= {_CLOSED}")
def stream_tumbling(spark, sf_dir):
    """Append mode gives the windows that the watermark has closed."""
    got = inc.drained(inc.windows(_stream(spark, sf_dir), "1 day"), spark)
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"select * exclude (last) from ({_SESSION.replace('count(*) as n', 'count(*) as n, max(ts) as last')}) where last + interval '6 hours' <= {_CLOSED}")
def stream_session(spark, sf_dir):
    got = inc.drained(inc.sessions(_stream(spark, sf_dir), "6 hours"), spark)
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("select 'src/C' || user_id || '.tsx' as path, 'C' || user_id as name from events group by user_id")
def stream_incremental(spark, sf_dir):
    """Events as file changes: each batch extracts the components of the files it brings; the last batch of a path counts."""
    s = _stream(spark, sf_dir).select(F.concat(F.lit("src/C"), "user_id", F.lit(".tsx")).alias("path"), F.concat(F.lit("export function C"), "user_id", F.lit("() {}")).alias("text"))
    import os

    from lodestar.plans.lineage import durable
    durable(spark.range(1))
    base = f"{spark.sparkContext.getCheckpointDir()}/incremental-{os.urandom(8).hex()}"
    inc.incremental(s, lambda b: react_components(b.dropDuplicates(["path"])), f"{base}/store", f"{base}/state")
    return inc.current(spark, f"{base}/store").where("name is not null").select("path", "name").distinct()
