"""Telemetry over the events table, and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from jikjo.operators import sampling, telemetry
from jikjo.operators.ordering import numbered
from jikjo.plans.registry import query, table
from jikjo.streaming import telemetry as stream

ORDER = ["ts", "event_id"]
EV = "(select * from events where user_id is not null)"


def events(spark, d):
    return table(spark, d, "events").where("user_id is not null")


@query(
    f"""select user_id, arg_max(value, (ts, event_id)) filter (value is not null) as value, arg_max(event_type, (ts, event_id)) as event_type, arg_max(props, (ts, event_id)) filter (props is not null) as props, count(*) as n_events from {EV} group by user_id"""
)
def k4_last_values(spark, d):
    """K3 to K5, K8: the last known value of each field."""
    return telemetry.last_values(events(spark, d), ["user_id"], ORDER, ["value", "event_type", "props"])


@query(
    f"""select user_id, began, case when nk = 'purchase' then nt end as ended, case when nk = 'purchase' then greatest(0.0e0, (epoch_us(nt) - epoch_us(began)) / 1e6) end as seconds from (
  select user_id, event_type, ts as began, lead(event_type) over w as nk, lead(ts) over w as nt from {EV} where event_type in ('signup', 'purchase') window w as (partition by user_id order by ts, event_id)) where event_type = 'signup'"""
)
def k6_pairs(spark, d):
    """Begins with their ends."""
    p = telemetry.paired(events(spark, d), "user_id", ORDER, F.col("event_type"), "signup", "purchase", "ts")
    return p.withColumn("seconds", F.when(F.col("ended").isNotNull(), F.col("seconds")))


@query(
    f"""select user_id, round(sum(value * case when i = 1 then 0.9e0 ** (n - 1) else 0.1e0 * 0.9e0 ** (n - i) end), 6) as ema, max(n) as n from (
  select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from {EV} where value is not null) group by user_id"""
)
def h8_ema(spark, d):
    """H8, K4: a moving average, seeded with the first value."""
    return telemetry.ema(events(spark, d), "user_id", ORDER, "value").withColumn("ema", F.round("ema", 6))


@query(f"select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 49 preceding and current row), 9) as mean, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as change from {EV}")
def h7_trailing(spark, d):
    """H6, H7: trailing mean, and change since the one before."""
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    return e.select("event_id", F.round(telemetry.trailing_mean(e, "user_id", ORDER, "value"), 9).alias("mean"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))


@query(
    f"""select event_id, round(case when span > 0 then 10 / span end, 6) as per_second from (
  select event_id, (epoch_us(ts) - epoch_us(lag(ts, 10) over (partition by event_type order by ts, event_id))) / 1e6 as span from {EV})"""
)
def k10_rate(spark, d):
    """Throughput over the last ten events of a kind."""
    return telemetry.rate(events(spark, d), "event_type", ORDER, "ts", 10).select("event_id", F.round("per_second", 6).alias("per_second"))


@query(f"select event_type, count(*) as n, round(avg(value), 6) as mean, round(avg(value) * greatest(0, 3000 - count(*)), 6) as eta, count(distinct user_id) as users, count(*) filter (value is null) as failed from {EV} group by event_type")
def g24_eta(spark, d):
    """Mean duration by what remains; totals of a sweep."""
    e = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value").isNull()).alias("failed"))
    return e.select("event_type", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") * F.greatest(F.lit(0), 3000 - F.col("n")), 6).alias("eta"), "users", "failed")


_EMA = "sum(value * case when i = 1 then 0.9e0 ** (n - 1) else 0.1e0 * 0.9e0 ** (n - i) end)"


@query(
    f"""select key, n_events, last_value, round(ema, 6) as ema from (select cast(user_id as varchar) as key, count(*) as n_events, arg_max(value, (ts, event_id)) filter (value is not null) as last_value from {EV} group by user_id)
  left join (select cast(user_id as varchar) as key, {_EMA} as ema from (
    select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from {EV} where value is not null) group by user_id) using (key)"""
)
def k4_stream_state(spark, d):
    """The same state kept by a stream over the files, drained; held against the batch twin."""
    files = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/events.parquet*")
    return stream.drained(stream.last_values(files, "user_id"), "events-state").select("key", "n_events", "last_value", F.round("ema", 6).alias("ema"))


_RUN = "(select *, (ts, event_id) as o from events where user_id is not null)"


@query(
    f"""with e as {_RUN}, r as (select user_id, max(o) filter (event_type = 'error') as r from e group by user_id),
  v as (select user_id, {_EMA} as ema from (select user_id, value, row_number() over (partition by user_id order by o) as i, count(*) over (partition by user_id) as n from e where event_type = 'view' and value is not null) group by user_id),
  p as (select user_id, o, event_type, case when event_type = 'purchase' and lag(event_type) over w = 'signup' then greatest(0.0e0, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 1e6) end as s from e where event_type in ('signup', 'purchase') window w as (partition by user_id order by o)),
  q as (select user_id, count(*) filter (event_type = 'signup') as begun, count(*) filter (event_type = 'purchase') as finished, coalesce(sum(s), 0) as seconds from p join r using (user_id) where r is null or o > r group by user_id),
  l as (select user_id, count(*) as n_events, arg_max(event_id % 500, o) filter (event_type = 'view') as step, arg_max(value, o) filter (event_type = 'click' and value is not null) as samples_per_s from e group by user_id)
select cast(user_id as varchar) as key, n_events, cast(step as int) as step, round(samples_per_s, 6) as samples_per_s, round(ema, 6) as ema, round(nullif(ema, 0) * greatest(0, 1000 - step), 6) as eta,
  coalesce(begun, 0) as trials_begun, coalesce(finished, 0) as trials_finished, round(coalesce(seconds, 0), 3) as trial_seconds from l left join v using (user_id) left join q using (user_id)"""
)
def k3_boards(spark, d):
    """K3 to K8: router, progress with moving average and ETA, throughput, trials and resets in one stateful processor.

    The events stand in for a bus: a view is progress, a click throughput, signup and purchase begin and end a trial, an error begins a sweep.
    """
    files = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/events.parquet*")
    kind, seconds = F.col("event_type"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    when = lambda k, v: F.when(kind == k, v)
    bus = files.select(
        "user_id", "event_id", seconds.alias("ts"),
        when("view", F.lit("progress")).when(kind == "click", "throughput").alias("section"),
        when("signup", F.lit("trial_begin")).when(kind == "purchase", "trial_end").when(kind == "error", "sweep_begin").alias("event"),
        when("view", (F.col("event_id") % 500).cast("int")).alias("step"), when("view", F.lit(1000)).alias("total_steps"),
        when("view", F.col("value")).alias("step_time"), when("click", F.col("value")).alias("samples_per_s"),
    )
    b = stream.drained(stream.boards(bus, "user_id", "event_id"), "boards")
    rounded = [F.round(c, 6).alias(c) for c in ("samples_per_s", "ema", "eta")]
    return b.select("key", "n_events", "step", *rounded, "trials_begun", "trials_finished", F.round("trial_seconds", 3).alias("trial_seconds"))


@query(
    f"""select e.user_id, count(*) as n, round(sum(value), 6) as total from {EV} e left join (select user_id, max((ts, event_id)) as r from {EV} where event_type = 'error' group by user_id) x using (user_id)
where x.r is null or (e.ts, e.event_id) > x.r group by e.user_id"""
)
def k7_since_reset(spark, d):
    """K7: what came after the last event that resets the state."""
    k = telemetry.since_reset(events(spark, d), "user_id", ORDER, F.col("event_type") == "error")
    return k.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


# --- samples -------------------------------------------------------------------------

_DOC = "(select doc_id, source from documents where doc_id is not null)"


def ids(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").where("doc_id is not null")


@query(f"select doc_id from (select doc_id, row_number() over (order by doc_id) as r, count(*) over () as n from {_DOC}) where (r - 1) % greatest(1, n // 300) = 0")
def i2_strided(spark, d):
    """Every s-th row."""
    return sampling.strided(ids(spark, d), "doc_id", 300).select("doc_id")


@query(f"select doc_id, source from {_DOC} order by md5('42:' || doc_id), doc_id limit 100")
def i3_shuffled_head(spark, d):
    """The head of a seeded shuffle."""
    return sampling.shuffled_head(ids(spark, d), "doc_id", 100, 42)


@query("select item_id from lambada where coalesce(text, context, '') <> '' and coalesce(target, answer, '') <> '' order by md5('42:' || item_id), item_id limit 80")
def f13_item_sample(spark, d):
    """the first valid items of a seeded shuffle."""
    valid = table(spark, d, "lambada").where((F.coalesce("text", "context") != "") & (F.coalesce("target", "answer") != ""))
    return sampling.shuffled_head(valid.select("item_id"), "item_id", 80, 42)


@query(f"select doc_id from (select doc_id, row_number() over (order by doc_id) as r, count(*) over () as n from {_DOC}) where r - 1 in (select cast(floor(i * (select count(*) - 1 from {_DOC}) / 49) as bigint) from range(50) t(i))")
def i7_evenly_spaced(spark, d):
    """Fifty even steps over all rows."""
    return sampling.evenly_spaced(ids(spark, d), "doc_id", 50).select("doc_id")


@query("select doc_id from (select doc_id, -ln((cast('0x' || left(md5('7:' || doc_id), 8) as bigint) + 1) / 4294967296.0e0) / n_chars as e from documents where n_chars > 0) order by e, doc_id limit 200")
def i8_weighted(spark, d):
    """I8: without replacement, chances by weight."""
    return sampling.weighted(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 200, 7).select("doc_id")


@query(f"select doc_id, case when cast('0x' || left(md5('42:' || doc_id), 8) as bigint) % 10 < 1 then 'eval' else 'train' end as part, case when r <= n * 0.8e0 then 'head' else 'tail' end as half from (select doc_id, row_number() over (order by doc_id) as r, count(*) over () as n from {_DOC})")
def i11_split(spark, d):
    """A seeded 90/10 split, and the first 80 %."""
    x = ids(spark, d)
    n = x.count()
    return numbered(x, ["doc_id"], "r").select("doc_id", sampling.split("doc_id", 42, 1).alias("part"), F.when(F.col("r") <= n * 0.8, "head").otherwise("tail").alias("half"))


@query(f"select draw, doc_id from (select i as draw, least(cast(floor((cast('0x' || left(md5('3:' || i), 8) as bigint) + 1) / 4294967296.0e0 * (select count(*) from {_DOC})) as bigint) + 1, (select count(*) from {_DOC})) as r from range(40) t(i)) join (select doc_id, row_number() over (order by doc_id) as r from {_DOC}) using (r)")
def a19_with_replacement(spark, d):
    """Draws with replacement."""
    return sampling.with_replacement(ids(spark, d), "doc_id", 40, 3).select("draw", "doc_id")
