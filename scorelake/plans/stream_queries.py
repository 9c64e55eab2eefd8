"""Scoring and stability over streams; each equals its batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions.columns import constants
from scorelake.functions.ordered import exact_quantiles
from scorelake.functions.placing import place
from scorelake.functions.state import stage, staging_path
from scorelake.operators import scaling, woe
from scorelake.plans.binning_queries import fitted_bins
from scorelake.plans.model_queries import INTERCEPT, MODEL, MODEL_VARIABLES, SCALING, _SCORED_MODEL, _SCORED_SELECT, _rounded_scores
from scorelake.plans.registry import query
from scorelake.plans.views import TARGET, development, scored, table
from scorelake.streaming import monitor


def _drain(stream, spark, mode="append"):
    """Run a stream over everything available into a Parquet sink and read it back."""
    path = staging_path(spark)
    run = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", staging_path(spark))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _as_stream(df):
    """The staged files of a table, read as a stream."""
    staged = stage(df)
    spark = df.sparkSession
    folder = staged.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(df.schema).parquet(folder)


@query("stream_score", f"{_SCORED_MODEL} {_SCORED_SELECT}")
def stream_score(spark, sf_dir):
    dev = development(spark, sf_dir)
    bins = fitted_bins(spark, sf_dir, MODEL_VARIABLES, dev)
    fitted = woe.woe_table(woe.woe_cells(dev, bins, TARGET))
    sample = scored(spark, sf_dir).select("app_key", "role", *MODEL_VARIABLES)
    coefficients = scaling.coefficients_table(dev, INTERCEPT, MODEL)
    stream = monitor.score_stream(_as_stream(sample), bins, fitted, coefficients, SCALING)
    return _rounded_scores(_drain(stream, spark))


@query(
    "stream_psi",
    """WITH d AS (SELECT date_trunc('day', ts) AS window_start, value FROM events WHERE value IS NOT NULL),
    base AS (SELECT value FROM d WHERE window_start <= (SELECT min(window_start) + INTERVAL 4 DAY FROM d)),
    e AS (SELECT list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS b FROM base),
    bc AS (SELECT len(list_filter(b, lambda x: x <= value)) AS bin, count(*) AS en FROM base, e GROUP BY 1),
    last AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events WHERE value IS NOT NULL),
    c AS (SELECT window_start, len(list_filter(b, lambda x: x <= value)) AS bin, count(*) AS n FROM d, e GROUP BY ALL),
    t AS (SELECT window_start, sum(n) AS total FROM c, last WHERE window_start + INTERVAL 1 DAY <= mark GROUP BY window_start),
    f AS (SELECT t.window_start, total, bc.bin, en, coalesce(n, 0) AS n, sum(en) OVER (PARTITION BY t.window_start) AS etotal
      FROM t CROSS JOIN bc LEFT JOIN c ON c.window_start = t.window_start AND c.bin = bc.bin),
    p AS (SELECT *, CASE WHEN n = 0 THEN 0.5 / total ELSE n / total END AS ap, en / etotal AS ep FROM f)
    SELECT strftime(window_start, '%Y-%m-%d') AS day, CAST(max(total) AS BIGINT) AS row_count, round(sum((ap - ep) * ln(ap / ep)), 6) AS psi FROM p GROUP BY 1""",
)
def stream_psi(spark, sf_dir):
    """Daily PSI of event values against the deciles of the first five days, for closed windows."""
    events = table(spark, sf_dir, "events").select("ts", "value").filter("value IS NOT NULL")
    utc = events.withColumn("ts", F.col("ts").cast("timestamp"))
    first = utc.agg(F.date_trunc("day", F.min("ts")).alias("d")).first().d
    baseline = stage(utc.filter(F.date_trunc("day", "ts") <= F.lit(first) + F.expr("INTERVAL 4 DAYS")))
    points = exact_quantiles(baseline, ["value"], [k / 10 for k in range(1, 10)])
    edges = sorted({r.q for r in points.collect()})
    placed = place(baseline, "value", constants(baseline, [(edges,)], "breaks array<double>"), left_closed=True)
    expected = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    counts = _drain(monitor.window_counts(_as_stream(utc), "value", edges, "ts"), spark)
    return monitor.window_psi(counts, expected).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "row_count", "psi"
    )


# Arrival: a period's rows come together, but some one period late (kept: their window is open) and some three late (dropped).
_LATE, _TOO_LATE = "event_id % 50 = 7", "event_id % 50 = 13"


@query(
    "stream_psi_late",
    f"""WITH d AS (SELECT ts, value, event_id, CAST(floor(epoch(ts) / 432000) AS BIGINT) AS period FROM events WHERE value IS NOT NULL),
    e AS (SELECT list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS b FROM d WHERE period <= (SELECT min(period) + 1 FROM d)),
    bc AS (SELECT len(list_filter(b, lambda x: x <= value)) AS bin, count(*) AS en FROM d, e WHERE period <= (SELECT min(period) + 1 FROM d) GROUP BY 1),
    kept AS (SELECT * FROM d WHERE NOT ({_TOO_LATE})),
    c AS (SELECT period, len(list_filter(b, lambda x: x <= value)) AS bin, count(*) AS n FROM kept, e GROUP BY ALL),
    t AS (SELECT period, sum(n) AS total FROM c WHERE (period + 1) * 432000 <= (SELECT epoch(max(ts)) - 3600 FROM d) GROUP BY period),
    f AS (SELECT t.period, total, bc.bin, en, coalesce(n, 0) AS n, sum(en) OVER (PARTITION BY t.period) AS etotal
      FROM t CROSS JOIN bc LEFT JOIN c ON c.period = t.period AND c.bin = bc.bin),
    p AS (SELECT *, CASE WHEN n = 0 THEN 0.5 / total ELSE n / total END AS ap, en / etotal AS ep FROM f)
    SELECT strftime(make_timestamp(period * 432000 * 1000000), '%Y-%m-%d') AS start_day, CAST(max(total) AS BIGINT) AS row_count,
      round(sum((ap - ep) * ln(ap / ep)), 6) AS psi, (SELECT count(*) > 0 FROM d WHERE {_LATE}) AS late_rows FROM p GROUP BY period""",
)
def stream_psi_late(spark, sf_dir):
    """PSI of five-day windows while rows arrive late; every arrival is a run of its own on the state the runs before it left."""
    events = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    period = F.floor(F.unix_timestamp("ts") / 432000)
    moved = F.when(F.expr(_TOO_LATE), 3).when(F.expr(_LATE), 1).otherwise(0)
    arriving = stage(events.select("*", period.alias("period"), (period + moved).alias("arrival")))
    ends = arriving.agg(F.min("period").alias("first"), F.max("arrival").alias("last")).first()
    baseline = arriving.filter(F.col("period") <= ends.first + 1)
    edges = sorted({r.q for r in exact_quantiles(baseline, ["value"], [k / 10 for k in range(1, 10)]).collect()})
    placed = place(baseline, "value", constants(baseline, [(edges,)], "breaks array<double>"), left_closed=True)
    expected = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    inbox, sink, state = staging_path(spark), staging_path(spark), staging_path(spark)
    for arrival in range(ends.first, ends.last + 1):
        arriving.filter(F.col("arrival") == arrival).select("ts", "value").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("ts timestamp, value double").parquet(inbox)
        counts = monitor.window_counts(stream, "value", edges, "ts", window="5 days")
        run = counts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    late = arriving.filter(_LATE).limit(1).count() > 0
    closed = spark.read.schema(counts.schema).parquet(sink)
    return monitor.window_psi(closed, expected).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("start_day"), "row_count", "psi", F.lit(late).alias("late_rows")
    )
