"""Run history, token accounting, throttling: append-only tables and windows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def completed(begun: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs with their latest completion, if any: completion is a row of its own, never an update."""
    last = ends.groupBy("run_id").agg(F.max(F.struct("completed_at", "status")).alias("e")).select("run_id", "e.completed_at", "e.status")
    return begun.join(last, "run_id", "left").withColumn("status", F.coalesce("status", F.lit("Running")))


def commit_changes(rows: DataFrame, keys: list[str], order: list[str], commit: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("previous", F.lag(commit).over(w)).withColumn("changed", ~F.col(commit).eqNullSafe(F.col("previous")))


def skip_if_unchanged(states: DataFrame) -> DataFrame:
    """(application, skipped) from (application, commit, previous, flag): skipped only if the flag is set, every previous commit is known and equal."""
    same = F.col("previous").isNotNull() & (F.col("commit") == F.col("previous"))
    return states.groupBy("application").agg((F.bool_and(F.coalesce(same, F.lit(False))) & F.bool_and("flag")).alias("skipped"))


def token_ledger(uses: DataFrame) -> DataFrame:
    """Sums by scope and, under a null scope, over all."""
    return uses.groupBy("scope").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls")).unionByName(uses.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls")).withColumn("scope", F.lit(None).cast("string")))


def trailing_sum(uses: DataFrame, tier: str, ts: str, tokens: str, seconds: int = 60) -> DataFrame:
    """Each use with ``used``: the whole-number tokens of its tier in the trailing window, itself included.

    Time is cut into spans of the window's length, so a window is the span so far and what is left of
    the span before: all of it at the start, less each use when it has left the window. A running sum
    over a span's uses and those departures gives every window, whatever the number of uses in it, and
    spans are summed side by side.
    """
    micros = F.expr(f"cast(1000000 * cast(cast(`{ts}` - cast('1970-01-01 00:00:00' as {dict(uses.dtypes)[ts]}) as interval second) as decimal(24,6)) as bigint)")
    length = seconds * 1_000_000
    own = F.struct(*[F.col(f"`{c}`") for c in uses.columns])
    # at one moment uses come together and before departures; uses without time are their own span
    rows = uses.select(own.alias("own"), F.col(f"`{tier}`").alias("tier"), micros.alias("at"), F.col(f"`{tokens}`").alias("n")).withColumn("span", F.floor(F.col("at") / F.lit(length).cast("decimal(20,0)")).cast("long"))
    none = F.lit(None).cast(rows.schema["own"].dataType)
    timed = rows.where("at is not null and n is not null").groupBy("tier", "span", "at").agg(F.sum("n").alias("n"), F.count("*").alias("many"))
    begun = timed.groupBy("tier", "span").agg(F.sum("n").alias("n"), F.sum("many").alias("many")).select("tier", (F.col("span") + 1).alias("span"), ((F.col("span") + 1) * length).alias("at"), F.lit(0).alias("turn"), "n", "many", none.alias("own"))
    left = timed.select("tier", (F.col("span") + 1).alias("span"), (F.col("at") + length).alias("at"), F.lit(2).alias("turn"), (-F.col("n")).alias("n"), (-F.col("many")).alias("many"), none.alias("own"))
    here = rows.select("tier", "span", "at", F.lit(1).alias("turn"), "n", F.col("n").isNotNull().cast("long").alias("many"), "own")
    by = Window.partitionBy("tier", "span").orderBy("at", "turn")  # rows of one moment and turn are summed together
    summed = here.unionByName(begun).unionByName(left).withColumn("used", F.when(F.sum("many").over(by) > 0, F.sum("n").over(by)))
    return summed.where("turn = 1").select("own.*", "used")


def admitted(uses: DataFrame, most: int, tier: str, ts: str, tokens: str, seconds: int = 60, order: str | None = None) -> DataFrame:
    """Each use with ``admitted``: it fits into the trailing window of what was admitted before it, or that window is empty.

    A limit of 0 admits all. What is refused takes no room, so a tier is gone through in order of
    time; only the window is held, and tiers are gone through side by side.
    """
    if most == 0:
        return uses.withColumn("admitted", F.lit(True))
    names, schema = uses.columns, uses.withColumn("admitted", F.lit(True)).schema
    where = {c: names.index(c) for c in (tier, ts, tokens)}

    def run(batches):
        import datetime
        from collections import deque

        import pyarrow as pa

        now, window, held, span = None, deque(), 0, datetime.timedelta(seconds=seconds)
        for batch in batches:
            good = []
            for t, at, n in zip(*(batch.column(where[c]).to_pylist() for c in (tier, ts, tokens))):
                if t != now:
                    now, held = t, 0
                    window.clear()
                while window and window[0][0] < at - span:
                    held -= window.popleft()[1]
                fits = held + n <= most or not window
                good.append(fits)
                if fits:
                    window.append((at, n))
                    held += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good)], names=[*names, "admitted"])

    return uses.repartition(tier).sortWithinPartitions(tier, ts, *([order] if order else [])).mapInArrow(run, schema)


def with_repositories(runs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Runs with ``repositories``: their repository rows in order of name, empty without any."""
    rest = [c for c in repositories.columns if c != "run_id"]
    g = repositories.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("repository", *[c for c in rest if c != "repository"]))).alias("repositories"))
    return runs.join(g, "run_id", "left").withColumn("repositories", F.coalesce("repositories", F.filter(F.array(F.lit(None).cast(g.schema["repositories"].dataType.elementType)), lambda x: x.isNotNull())))


def repository_runs(runs: DataFrame, repositories: DataFrame, application: str) -> DataFrame:
    """The repository rows of an application's runs."""
    return repositories.join(runs.where(F.col("application") == application).select("run_id", "application"), "run_id")


def stored_results(results: DataFrame) -> DataFrame:
    """The last result saved under each id."""
    rest = [c for c in results.columns if c not in ("id", "seq")]
    return results.groupBy("id").agg(F.max(F.struct("seq", *rest)).alias("r")).select("id", *[f"r.{c}" for c in rest])


def outcomes(diagnostics: DataFrame) -> DataFrame:
    """(run_id, outcome, level): Partial with any error, else Completed, and the level it is logged at."""
    g = diagnostics.groupBy("run_id").agg(F.when(F.bool_or(F.col("severity") == "Error"), "Partial").otherwise("Completed").alias("outcome"))
    return g.withColumn("level", F.when(F.col("outcome") == "Partial", "Warning").otherwise("Information"))


def lifecycle(reports: DataFrame) -> DataFrame:
    """(execution, seq, problem): reports that a run's life does not allow: before it runs, after its end, or a second end."""
    w = Window.partitionBy("execution").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("state").isin("Completed", "Failed")
    ended, begun = F.coalesce(F.max(ends.cast("int")).over(w), F.lit(0)) == 1, F.coalesce(F.max((F.col("state") == "Running").cast("int")).over(w), F.lit(0)) == 1
    problem = F.when(ended & ends, "ended twice").when(ended, "after the end").when(~begun & (F.col("state") != "Running"), "before the start")
    return reports.withColumn("problem", problem).where("problem is not null").select("execution", "seq", "problem")


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("application").agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next"))
