"""Event-at-a-time state machines as folds and windows over a user's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.operators.sequence import Dealt, asof_join, once_within, pieces
from qualitylens.plans.registry import query
from qualitylens.session import Scratch, table


def machine(events: DataFrame, value: Column, start: int, entries: list[int], unit: int, step) -> DataFrame:
    """user_id, state: ``step`` folded over a user's values in order.

    A state is a count of ``unit`` plus one of ``entries``, the machine's own
    states. A stretch of events is folded from each of them, and the stretches'
    results are then followed one after the other."""
    effect = lambda s: F.array(*[F.aggregate(s, F.lit(e), step) for e in entries])
    rows = pieces(events, "user_id", ["ts", "event_id"], value, effect)
    at = lambda a: F.array_position(F.array(*[F.lit(e) for e in entries]), (a % unit).cast("int")).cast("int")
    return rows.select("user_id", F.aggregate("pieces", F.lit(start), lambda a, x: (a - a % unit + F.element_at(x, at(a))).cast("int")).alias("state"))


def _sql_fold(value: str, start: str, step: str, out: str) -> str:
    return f"with s as (select user_id, list_reduce(list_prepend({start}, list({value} order by ts, event_id)), lambda a, x: {step}) as state from events group by 1) select user_id, {out} from s"


@query("q160_event_fold", """with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
select user_id, string_agg(event_type, ',' order by ts, event_id) filter (rn <= 30) as ring, count(*) filter (event_type = 'error') as errors from r group by 1""")
def q160(spark, sf):
    """The last thirty kinds of a user, and how many errors there were."""
    r = table(spark, sf, "events").withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    ring = F.array_sort(F.collect_list(F.when(F.col("rn") <= 30, F.struct("ts", "event_id", "event_type"))))
    return r.groupBy("user_id").agg(F.array_join(F.transform(ring, lambda x: x["event_type"]), ",").alias("ring"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("q161_hypothesis_update", _sql_fold("case event_type when 'purchase' then 3 when 'error' then -2 else 0 end", "10", "greatest(0, least(20, a + x))", "round(state / 20.0::double, 4) as confidence, state >= 14 as confirmed"))
def q161(spark, sf):
    """A confidence that rises by 0.15 and falls by 0.10, kept between 0 and 1,
    in units of 0.05. A stretch of events is a shift between a least and a
    greatest outcome."""
    v = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", -2).otherwise(0)
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(20), x))
    step = lambda a, x: F.struct(clamp(a["lo"] + x).alias("lo"), clamp(a["hi"] + x).alias("hi"), (a["shift"] + x).alias("shift"))
    effect = lambda s: F.aggregate(s, F.struct(F.lit(0).alias("lo"), F.lit(20).alias("hi"), F.lit(0).alias("shift")), step)
    s = pieces(table(spark, sf, "events"), "user_id", ["ts", "event_id"], v, effect)
    state = F.aggregate("pieces", F.lit(10), lambda a, x: F.least(x["hi"], F.greatest(x["lo"], a + x["shift"])))
    return s.select("user_id", F.round(state / 20.0, 4).alias("confidence"), (state >= 14).alias("confirmed"))


#: Fixed value: events after which a prediction that nothing has met expires.
_EXPIRY = 20


@query("q162_prediction_check", f"""with e as (select *, row_number() over (partition by user_id order by ts, event_id) as pos, cast(json_extract_string(props, '$.k') as int) % 4 as sig from events),
o as (select user_id, sig, pos, event_type from e where event_type in ('purchase', 'error')), l as (select user_id, max(pos) as last from o group by 1),
p as (select p.user_id, p.pos, o.pos as met, o.event_type as outcome from e p asof left join o on p.user_id = o.user_id and p.sig = o.sig and p.pos < o.pos where p.event_type = 'view'),
s as (select user_id, case when met - pos <= {_EXPIRY} then case outcome when 'purchase' then 'confirmed' else 'falsified' end when last - pos > {_EXPIRY} then 'expired' else 'pending' end as status from p left join l using (user_id))
select user_id, count(*) filter (status = 'confirmed') as confirmed, count(*) filter (status = 'falsified') as falsified, count(*) filter (status = 'expired') as expired, count(*) filter (status = 'pending') as pending,
  case when count(*) filter (status in ('confirmed', 'falsified')) >= 5 then round(count(*) filter (status = 'confirmed') / cast(count(*) filter (status in ('confirmed', 'falsified')) as double), 4) end as accuracy from s group by 1""")
def q162(spark, sf):
    """A view predicts that the next outcome of its signature is a purchase. The
    next outcome of the same user and signature tells, if it comes within
    ``_EXPIRY`` of the user's events; a later outcome of any kind finds the
    prediction expired."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 4).alias("sig"))
    e = Scratch(spark).save(Dealt(e, ["user_id"], ["ts", "event_id"]).total(pos=lambda r: F.lit(1)).rows())
    o = e.where(F.col("event_type").isin("purchase", "error")).select("user_id", "sig", "pos", "event_type")
    p = asof_join(e.where("event_type = 'view'").select("user_id", "sig", "pos"), o, ["user_id", "sig"], "pos", "pos", name="met", forward=True, strict=True, tolerance=_EXPIRY)
    p = p.join(o.groupBy("user_id").agg(F.max("pos").alias("last")), "user_id", "left")
    told = F.when(F.col("met.event_type") == "purchase", "confirmed").when(F.col("met").isNotNull(), "falsified")
    p = p.select("user_id", F.coalesce(told, F.when(F.col("last") - F.col("pos") > _EXPIRY, "expired"), F.lit("pending")).alias("status"))
    kinds = ("confirmed", "falsified", "expired", "pending")
    g = p.groupBy("user_id").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    checked = F.col("confirmed") + F.col("falsified")
    return g.withColumn("accuracy", F.when(checked >= 5, F.round(F.col("confirmed") / checked, 4)))


# the state is one number: entries * 10000 + mode * 1000 + rows in a row
@query("q163_hysteresis_mode", _sql_fold("case when value >= 70 then 1 when value < 10 then -1 else 0 end", "0", "case when a % 10000 >= 1000 then case when x = -1 then a - a % 10000 else a end when x = 1 then case when a % 1000 = 1 then a - a % 10000 + 11000 else a + 1 end else a - a % 1000 end", "(state // 10000)::int as entries, state % 10000 >= 1000 as active"))
def q163(spark, sf):
    """On after two high values in a row, off at a low one."""
    v = F.when(F.col("value") >= 70, 1).when(F.col("value") < 10, -1).otherwise(0)

    def step(a, x):
        on = F.when(x == -1, a - a % 10000).otherwise(a)
        off = F.when(x == 1, F.when(a % 1000 == 1, a - a % 10000 + 11000).otherwise(a + 1)).otherwise(a - a % 1000)
        return F.when(a % 10000 >= 1000, on).otherwise(off)

    s = machine(table(spark, sf, "events"), v, 0, [0, 1, 1000], 10_000, step)
    return s.select("user_id", F.expr("cast(state div 10000 as int)").alias("entries"), (F.col("state") % 10000 >= 1000).alias("active"))


@query("q164_cooldown", _sql_fold("(event_type = 'error')::int", "10", "case when x = 1 and a % 1000 >= 10 then a - a % 1000 + 1000 else a - a % 1000 + least(a % 1000 + 1, 10) end", "(state // 1000)::int as fires"))
def q164(spark, sf):
    """Fires only if ten events have passed since it last did."""
    step = lambda a, x: F.when((x == 1) & (a % 1000 >= 10), a - a % 1000 + 1000).otherwise(a - a % 1000 + F.least(a % 1000 + 1, F.lit(10)))
    s = machine(table(spark, sf, "events"), (F.col("event_type") == "error").cast("int"), 10, list(range(11)), 1000, step)
    return s.select("user_id", F.expr("cast(state div 1000 as int)").alias("fires"))


@query("q165_edit_cycle", """with r as (select *, count(*) filter (event_type = 'purchase') over (partition by user_id order by ts, event_id) as epoch_no from events),
c as (select user_id, epoch_no, count(*) filter (event_type = 'error') as n from r group by all) select user_id, max(n) as worst, arg_max(n, epoch_no) as open_errors from c group by 1""")
def q165(spark, sf):
    """Errors since the last success, now and at worst."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    r = Dealt(e, ["user_id"], ["ts", "event_id"]).total(epoch_no=lambda r: (r["event_type"] == "purchase").cast("int")).rows()
    c = r.groupBy("user_id", "epoch_no").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return c.groupBy("user_id").agg(F.max("n").alias("worst"), F.max_by("n", "epoch_no").alias("open_errors"))


@query("q166_sessions", """with g as (select *, coalesce(epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) > 14400, true) as fresh from events), s as (select *, count(*) filter (fresh) over (partition by user_id order by ts, event_id) as session from g)
select user_id, session, count(*) as events from s group by all""")
def q166(spark, sf):
    """Sessions that end after four hours without an event."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    d = Dealt(e, ["user_id"], ["ts", "event_id"]).previous(was=lambda r: r["at"])
    fresh = lambda r: F.coalesce(r["at"] - r["was"] > 14400, F.lit(True)).cast("int")
    return d.total(session=fresh).rows().groupBy("user_id", "session").agg(F.count("*").alias("events"))


@query("q167_compaction_gate", """with d as (select user_id, cast(cast(ts as date) as varchar) as day, count(*) as n, avg(value) as v from events group by all), x as (select *, v - lag(v) over (partition by user_id order by day) as delta from d) select user_id, day from x where n >= 3 and v > 60 and abs(delta) > 20""")
def q167(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return d.withColumn("delta", F.col("v") - F.lag("v").over(W.partitionBy("user_id").orderBy("day"))).where("n >= 3 and v > 60 and abs(delta) > 20").select("user_id", "day")


@query("q168_ttl_dedup", """with recursive s as (select user_id, event_type, event_id, epoch(ts) as t, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events),
r as (select user_id, event_type, event_id, rn, t as kept_at, true as kept from s where rn = 1
  union all select s.user_id, s.event_type, s.event_id, s.rn, case when s.t - kept_at >= 86400 then s.t else kept_at end, s.t - kept_at >= 86400 from r join s on s.user_id = r.user_id and s.event_type = r.event_type and s.rn = r.rn + 1)
select event_id from r where kept""")
def q168(spark, sf):
    """Deliveries of a key that was not stored within the day before. Only a
    delivery that is new stores its key, so a repeated one does not prolong its life."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    return once_within(e, ["user_id", "event_type"], "at", "event_id", 86_400).select("event_id")


@query("q169_daily_counter", "with r as (select event_id, row_number() over (partition by cast(ts as date) order by ts, event_id) as rn from events) select event_id from r where rn <= 140")
def q169(spark, sf):
    """The events of a day within its limit."""
    w = W.partitionBy(F.col("ts").cast("date")).orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).alias("rn")).where("rn <= 140").select("event_id")


#: The signals of a session, their weight, and what fires them over its last fifty actions (rn 1 is the newest; far: seconds before it).
#: Commands are clicks and errors (which fail), reads views, checks purchases, plans and edits signups. Sample actions lie hours apart, so windows are in days.
_ACTIONS, _DAY = 50, 86_400
_BASH = "event_type in ('click', 'error')"
_SIGNALS = {
    "approach_cycling": ("hard", f"count(distinct case when event_type = 'error' and far <= 2 * {_DAY} then sig end) >= 3"),
    "failure_amnesia": ("hard", "max(case when event_type = 'error' and rn <= 30 then same30 end) >= 2"),
    "brute_force_escalation": ("hard", f"count(distinct case when {_BASH} then sig end) > count(distinct case when event_type = 'purchase' then sig end)"),
    "integration_verification_debt": ("hard", "sum(case when event_type = 'signup' and rn < check_rn then 1 else 0 end) >= case when max(case when rn = 1 then event_type end) = 'click' then 1 else 5 end"),
    "premature_action": ("soft", f"sum(case when {_BASH} and rn <= 10 then 1 else 0 end) > 3 * greatest(sum(case when event_type = 'view' and rn <= 10 then 1 else 0 end), 1) and 2 * sum(case when event_type = 'error' and rn <= 10 then 1 else 0 end) > sum(case when {_BASH} and rn <= 10 then 1 else 0 end)"),
    "tool_repetition": ("soft", f"max(case when far <= 3 * {_DAY} then near end) >= 4"),
    "serial_discovery": ("soft", "count(distinct case when event_type = 'error' then sig end) >= 3 and sum(case when event_type = 'purchase' and rn <= 10 then 1 else 0 end) = 0"),
    "verification_debt": ("soft", "sum(case when rn < calm_rn then 1 else 0 end) >= 8"),
    "mass_delegation": ("soft", f"sum(case when event_type = 'signup' and far <= {_DAY} then 1 else 0 end) >= 3"),
    "redundant_planning": ("soft", "max(case when event_type = 'purchase' then rn end) > min(case when event_type = 'signup' then rn end)"),
    "consecutive_failures": ("nudge", "sum(case when event_type = 'error' and rn < done_rn then 1 else 0 end) >= 3"),
}
_LATEST = "coalesce(min(case when {} then rn end) over (partition by user_id), 99) as {}"
_SEEN = [
    "count(case when rn <= 30 then 1 end) over (partition by user_id, sig, event_type) as same30", f"count(case when far <= 3 * {_DAY} then 1 end) over (partition by user_id, sig, event_type) as near",
    _LATEST.format("event_type = 'purchase'", "check_rn"), _LATEST.format("event_type = 'click'", "done_rn"), _LATEST.format("event_type in ('view', 'purchase')", "calm_rn"),
]


@query("q172_signal_detectors", f"""with e as (select user_id, event_type, epoch(ts) as t, cast(json_extract_string(props, '$.k') as int) % 12 as sig, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events),
r as (select *, max(t) over (partition by user_id) - t as far from e where rn <= {_ACTIONS}), s as (select *, {', '.join(_SEEN)} from r)
{' union all '.join(f"select user_id, '{n}' as signal, '{w}' as weight from s group by user_id having {c}" for n, (w, c) in _SIGNALS.items())}""")
def q172(spark, sf):
    """The signals that a session's last actions give, by weight, in one pass:
    tasks keep fifty actions of each session before they are shuffled."""
    newest = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("t"), (F.get_json_object("props", "$.k").cast("int") % 12).alias("sig"), F.row_number().over(newest).alias("rn"))
    r = e.where(F.col("rn") <= _ACTIONS).withColumn("far", F.max("t").over(W.partitionBy("user_id")) - F.col("t"))
    s = r.selectExpr("*", *_SEEN)
    fired = s.groupBy("user_id").agg(*[F.expr(c).alias(n) for n, (_, c) in _SIGNALS.items()])
    rows = F.array(*[F.when(F.col(n), F.struct(F.lit(n).alias("signal"), F.lit(w).alias("weight"))) for n, (w, _) in _SIGNALS.items()])
    return fired.select("user_id", F.explode(F.array_compact(rows)).alias("s")).select("user_id", "s.*")


@query("q114_ordered_channels", """with g as (select event_type as name, round(sum(value), 2) as weight from events group by 1) select name, row_number() over (order by -weight, name) as pos from g""")
def q114(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.sum("value"), 2).alias("weight"))
    return g.select("name", F.row_number().over(W.orderBy(-F.col("weight"), "name")).cast("long").alias("pos"))
