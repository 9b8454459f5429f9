"""Window, sequence, time and top-k queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.functions.scalar import clamp, linear_decay
from qualitylens.operators import relational as R
from qualitylens.operators import sequence as S
from qualitylens.operators.patterns import first_rule, pattern_hits
from qualitylens.operators.selection import quantiles
from qualitylens.plans.adapters import FINDINGS, findings
from qualitylens.plans.registry import query
from qualitylens.session import table

_ORDER = ["ts", "event_id"]


def _timed(spark, sf):
    """Events with their time in seconds."""
    return table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("ts").cast("timestamp").cast("double").alias("at"))


@query("q095_half_trend", """with d as (select event_type, cast(ts as date) as day, cast(count(*) as double) as n from events group by all),
r as (select *, row_number() over (partition by event_type order by day) - 1 as i, count(*) over (partition by event_type) as m from d),
g as (select event_type, any_value(m) as n, avg(n) filter (i < m // 2) as a, avg(n) filter (i >= m // 2) as b from r group by 1)
select event_type, case when n < 4 then 'no_data' when b < a * 0.8 then 'improving' when b > a * 1.2 then 'degrading' else 'stable' end as trend, round(a, 3) as first_half, round(b, 3) as second_half from g""")
def q095(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").cast("double").alias("v"))
    return S.half_trend(d, ["event_type"], "day", "v").select("event_type", "trend", F.round("first_half", 3).alias("first_half"), F.round("second_half", 3).alias("second_half"))


@query("q096_time_to_success", """with e as (select user_id, min(ts) as t from events where event_type = 'error' group by 1)
select e.user_id, (epoch_us(min(p.ts)) - epoch_us(t)) // 1000 as ms from e join events p on p.user_id = e.user_id and p.event_type = 'purchase' and p.ts > t group by e.user_id, t""")
def q096(spark, sf):
    """From the first failure to the first later success."""
    e = table(spark, sf, "events")
    first = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("t"))
    j = e.where("event_type = 'purchase'").join(first, "user_id").where("ts > t").groupBy("user_id", "t").agg(F.min("ts").alias("p"))
    return j.select("user_id", F.expr("timestampdiff(MILLISECOND, t, p)").alias("ms"))


@query("q097_trailing_streak", """with r as (select user_id, event_type = 'error' or event_type = 'view' as hit, ts, event_id from events), l as (select user_id, max(struct_pack(a := ts, b := event_id)) as m from r where not hit group by 1)
select r.user_id, count(*) filter (m is null or struct_pack(a := ts, b := event_id) > m) as streak from r left join l using (user_id) group by 1""")
def q097(spark, sf):
    """Length of the last run of errors or views per user."""
    return S.trailing_streak(table(spark, sf, "events"), "user_id", _ORDER, F.col("event_type").isin("error", "view"))


@query("q098_longest_run", """with r as (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as g from events),
n as (select user_id, event_type, g, count(*) as n from r group by all) select user_id, event_type, max(n) as longest from n group by all""")
def q098(spark, sf):
    return S.longest_run(table(spark, sf, "events"), "user_id", _ORDER, "event_type")


_DAILY = "d as (select cast(cast(o_orderdate as date) as varchar) as day, sum(o_totalprice) as v from orders group by 1), x as (select day, v, v - lag(v) over (order by day) as delta from d)"


def _daily(spark, sf):
    """A row per day, so windows over all of them stay small."""
    d = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return d.withColumn("delta", F.col("v") - F.lag("v").over(W.orderBy("day")))


@query("q099_sustained_below", f"""with {_DAILY}, b as (select day, count(*) filter (abs(delta) < 400000) over (order by day rows between current row and 2 following) as n from x) select min(day) as onset, count(*) as windows from b where n = 3""")
def q099(spark, sf):
    """The first of three small changes in a row."""
    n = F.count_if(F.abs("delta") < 400000).over(W.orderBy("day").rowsBetween(0, 2))
    return _daily(spark, sf).withColumn("n", n).where("n = 3").agg(F.min("day").alias("onset"), F.count("*").alias("windows"))


@query("q100_moving_average", f"with {_DAILY} select day, round(delta, 2) as delta, round(avg(abs(delta)) over (order by day rows between 4 preceding and current row), 2) as ma from x")
def q100(spark, sf):
    ma = F.avg(F.abs("delta")).over(W.orderBy("day").rowsBetween(-4, 0))
    return _daily(spark, sf).select("day", F.round("delta", 2).alias("delta"), F.round(ma, 2).alias("ma"))


_LOUD = """u as (select user_id, cast(cast(ts as date) as varchar) as day, event_type = 'error' as e from events), g as (select user_id, day, bool_or(e) as loud from u group by all)"""


@query("q101_transition", f"with {_LOUD}, t as (select *, lag(loud) over (partition by user_id order by day) as was from g) select user_id, day from t where was and not loud")
def q101(spark, sf):
    """Loud before and silent now."""
    g = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg(F.bool_or(F.col("event_type") == "error").alias("loud"))
    return g.withColumn("was", F.lag("loud").over(W.partitionBy("user_id").orderBy("day"))).where("was and not loud").select("user_id", "day")


@query("q102_kind_tradeoff", """with g as (select cast(cast(ts as date) as varchar) as day, count(*) filter (event_type = 'error') as a, count(*) filter (event_type = 'purchase') as b from events group by 1),
t as (select *, lag(a) over (order by day) as pa, lag(b) over (order by day) as pb from g) select day, a < pa and b < pb as tradeoff from t where pa is not null""")
def q102(spark, sf):
    """One kind fell as another fell with it."""
    g = table(spark, sf, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("a"), F.count_if(F.col("event_type") == "purchase").alias("b"))
    w = W.orderBy("day")
    t = g.withColumn("pa", F.lag("a").over(w)).withColumn("pb", F.lag("b").over(w)).where("pa is not null")
    return t.select("day", ((F.col("a") < F.col("pa")) & (F.col("b") < F.col("pb"))).alias("tradeoff"))


@query("q103_sliding_count", """select event_id, count(*) over (partition by user_id, event_type order by ts range between interval 1 day preceding and current row) as in_range from events""")
def q103(spark, sf):
    """Rows of the same kind within the day before each."""
    return S.count_in_range(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 86400).select("event_id", "in_range")


@query("q104_row_window_features", """with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events)
select user_id, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'click') as clicks, round(median(gap) filter (rn <= 10), 3) as median_gap, count(distinct event_type) as kinds from r where rn <= 20 group by 1""")
def q104(spark, sf):
    """Shares and gaps over the last twenty rows of a user."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", F.col("ts").cast("timestamp").cast("double").alias("at"))
    r = S.Dealt(e, ["user_id"], _ORDER).previous(was=lambda r: r["at"]).rows().withColumn("gap", F.col("at") - F.col("was"))
    r = r.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(*[F.desc(c) for c in _ORDER]))).where("rn <= 20")  # tasks keep twenty a user before they meet
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    return r.groupBy("user_id").agg(is_("view").alias("views"), is_("click").alias("clicks"), F.round(F.percentile(F.when(F.col("rn") <= 10, F.col("gap")), 0.5), 3).alias("median_gap"), F.countDistinct("event_type").alias("kinds"))


@query("q105_error_repetition", """with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type = 'error')
select user_id, count(*) as n, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 as span_ms from r where rn <= 30 group by 1 having count(*) >= 2""")
def q105(spark, sf):
    r = table(spark, sf, "events").where("event_type = 'error'").withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(*[F.desc(c) for c in _ORDER]))).where("rn <= 30")
    g = r.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).where("n >= 2")
    return g.select("user_id", "n", F.expr("timestampdiff(MILLISECOND, a, b)").alias("span_ms"))


@query("q106_ratio_predicate", """with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
select user_id from r where rn <= 10 group by 1 having count(*) filter (event_type = 'view') > 1.5 * count(*) filter (event_type = 'click') and avg(case when event_type = 'error' then 1.0 else 0 end) > 0.1""")
def q106(spark, sf):
    r = table(spark, sf, "events").withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(*[F.desc(c) for c in _ORDER]))).where("rn <= 10")
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    return r.groupBy("user_id").agg(is_("view").alias("v"), is_("click").alias("c"), is_("error").alias("e"), F.count("*").alias("n")).where("v > 1.5 * c and e / n > 0.1").select("user_id")


@query("q109_recurrence", f"with {FINDINGS} select channel, file, count(distinct run) as snapshots from f group by all")
def q109(spark, sf):
    return findings(spark, sf).groupBy("channel", "file").agg(F.countDistinct("run").alias("snapshots"))


@query("q110_persistent", f"with {FINDINGS} select channel, file from f where run = (select min(run) from f) intersect select channel, file from f where run = (select max(run) from f)")
def q110(spark, sf):
    """In the first snapshot and in the last."""
    f = findings(spark, sf).select("channel", "file", "run")
    ends = f.agg(F.min("run").alias("a"), F.max("run").alias("b"))
    g = f.crossJoin(F.broadcast(ends)).groupBy("channel", "file").agg(F.bool_or(F.col("run") == F.col("a")).alias("x"), F.bool_or(F.col("run") == F.col("b")).alias("y"))
    return g.where("x and y").select("channel", "file")


@query("q111_budgeted_prefix", f"with {FINDINGS}, r as (select ord, channel, file, row_number() over (partition by channel, file order by ord) as rn from f) select ord from r where rn <= 2")
def q111(spark, sf):
    """The first rows of each fingerprint, within its budget."""
    return findings(spark, sf).withColumn("rn", F.row_number().over(W.partitionBy("channel", "file").orderBy("ord"))).where("rn <= 2").select("ord")


@query("q112_char_budget", """with r as (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars, doc_id) as rn, sum(n_chars) over (partition by source order by n_chars, doc_id) as total from documents) select source, doc_id from r where rn <= 2 and total <= 150""")
def q112(spark, sf):
    """The first two within a budget of characters: tasks keep two rows a
    source before they meet."""
    w = W.partitionBy("source").orderBy("n_chars", "doc_id")
    first = table(spark, sf, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).alias("rn")).where("rn <= 2")
    return first.withColumn("total", F.sum("n_chars").over(w)).where("total <= 150").select("source", "doc_id")


@query("q113_severity_sort", f"""with {FINDINGS} select run, row_number() over (partition by run order by case severity when 'blocking' then 0 when 'warning' then 1 else 2 end, file, ord) as pos, ord from f""")
def q113(spark, sf):
    """The rows of every run in the order of its report."""
    rank = F.when(F.col("severity") == "blocking", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    rows = S.Dealt(findings(spark, sf).select("run", rank.alias("rank"), "file", "ord"), ["run"], ["rank", "file", "ord"])
    return rows.total(pos=lambda r: F.lit(1)).rows().select("run", "pos", "ord")


@query("q115_top_partners", """with s as (select distinct l_orderkey, p_brand from lineitem join part on l_partkey = p_partkey), c as (select x.p_brand as a, y.p_brand as b, count(*) as n from s x join s y on x.l_orderkey = y.l_orderkey and x.p_brand < y.p_brand group by all)
select a, b, n from c where a = 'Brand#11' or b = 'Brand#11' order by n desc, a, b limit 5""")
def q115(spark, sf):
    """The partners that change most with one item."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = R.pair_counts(j, "l_orderkey", "p_brand")
    return p.where("a = 'Brand#11' or b = 'Brand#11'").orderBy(F.desc("n"), "a", "b").limit(5)


@query("q116_work_queue", """select o_custkey, count(*) as n, min(o_orderpriority) as first_priority from orders where o_orderstatus = 'O' group by 1 having count(*) >= 2 order by first_priority, n desc, o_custkey limit 20""")
def q116(spark, sf):
    g = table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("first_priority")).where("n >= 2")
    return g.orderBy("first_priority", F.desc("n"), "o_custkey").limit(20)


@query("q117_priority_batch", "select o_orderkey, o_totalprice from orders where o_orderstatus <> 'F' order by o_totalprice desc, o_orderkey limit 25")
def q117(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus <> 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("q118_p90_cut", "select o_orderkey, o_totalprice from orders where o_totalprice > (select quantile_cont(o_totalprice, 0.9) from orders) order by o_totalprice desc, o_orderkey limit 5")
def q118(spark, sf):
    o = table(spark, sf, "orders")
    (p90,) = quantiles(o, "o_totalprice", [0.9])
    return o.where(F.col("o_totalprice") > F.lit(p90)).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("q119_bounded_eviction", "with r as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rn from customer) select c_nationkey, c_custkey from r where rn <= 20")
def q119(spark, sf):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("c_nationkey", "c_custkey")


@query("q120_representative_sample", "with r as (select lang, doc_id, row_number() over (partition by lang order by (doc_id in (select doc_id from labels)) desc, n_chars desc, doc_id) as rn from documents) select lang, doc_id from r where rn <= 10")
def q120(spark, sf):
    """Known ones first, then the largest, within the budget."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id").distinct().withColumn("known", F.lit(1)), "doc_id", "left")
    w = W.partitionBy("lang").orderBy(F.coalesce("known", F.lit(0)).desc(), F.desc("n_chars"), "doc_id")
    return d.withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("lang", "doc_id")


@query("q121_keyword_retrieval", """with k as (select distinct w from (select unnest(string_split(text, ' ')[2:4]) as w from benchmark) where length(w) >= 5),
h as (select doc_id, count(*) as score from documents join k on contains(text, w) group by 1) select doc_id, score from h order by score desc, doc_id limit 20""")
def q121(spark, sf):
    """The texts with most of the keywords, of a table of any number of them."""
    words = F.slice(F.split("text", " "), 2, 3)
    k = table(spark, sf, "benchmark").select(F.explode(words).alias("w")).where("length(w) >= 5").distinct()
    hits = pattern_hits(table(spark, sf, "documents").select("doc_id", "text"), "text", k, "w")
    return hits.select("doc_id", F.size("hits").cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query("q153_linear_decay", "select event_id, round(0.6 * greatest(0.0, 1 - event_id / 50.0), 4) as alpha from events")
def q153(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(linear_decay(F.col("event_id")), 4).alias("alpha"))


@query("q154_confidence_decay", """with m as (select max(ts) as now from events), l as (select user_id, max(ts) as t from events where event_type = 'purchase' group by 1)
select user_id, round(0.9 - 0.05 * floor(datediff('millisecond', t, now) / 3600000.0), 4) as confidence, 0.9 - 0.05 * floor(datediff('millisecond', t, now) / 3600000.0) <= 0 as expired from l, m""")
def q154(spark, sf):
    """A step down per hour since the last success."""
    e = table(spark, sf, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("t")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    c = 0.9 - 0.05 * F.floor(F.expr("timestampdiff(MILLISECOND, t, now)") / 3600000.0)
    return last.select("user_id", F.round(c, 4).alias("confidence"), (c <= 0).alias("expired"))


@query("q155_staleness", """with g as (select user_id, epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events) select user_id, count(*) filter (gap > 14400) as session_gaps, round(least(1.0, max(gap) / 86400), 4) as staleness from g group by 1""")
def q155(spark, sf):
    """Long gaps between a user's events, and the longest."""
    g = S.Dealt(_timed(spark, sf), ["user_id"], _ORDER).previous(was=lambda r: r["at"]).rows().select("user_id", (F.col("at") - F.col("was")).alias("gap"))
    return g.groupBy("user_id").agg(F.count_if(F.col("gap") > 14400).alias("session_gaps"), F.round(clamp(F.max("gap") / 86400), 4).alias("staleness"))


@query("q156_ewma", "select user_id, round(list_reduce(list(value order by ts, event_id), lambda a, x: 0.7 * x + 0.3 * a), 6) as ewma from events where value is not null group by 1")
def q156(spark, sf):
    return S.ewma(table(spark, sf, "events"), "user_id", _ORDER, "value").select("user_id", F.round("ewma", 6).alias("ewma"))


@query("q157_backoff", "select event_type, count(*) filter (value > 100) as failures, 30.0 * pow(2.0, least(count(*) filter (value > 100) // 100, 6)) as wait from events group by 1")
def q157(spark, sf):
    from qualitylens.functions.scalar import backoff

    g = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("failures"))
    return g.select("event_type", "failures", backoff(F.lit(30.0), F.expr("failures div 100")).alias("wait"))


#: Fixed value: the day on which waivers are judged.
_TODAY = "1998-01-01"
_WAIVERS = """select s_suppkey as id, case s_suppkey % 6 when 0 then 'F/1-URGENT::' || s_suppkey when 1 then 'F/1*::*' || s_suppkey when 2 then 'O/?-H*::' || s_suppkey || '*' when 3 then '*::' || s_suppkey || '?' when 4 then 'P/[!12]*::*' || s_suppkey else 'O/*' || s_suppkey end as symbol,
  case when s_suppkey % 11 = 0 then '' else s_name end as reason, case when s_suppkey % 5 = 0 then null when s_suppkey % 7 = 0 then 'soon' when s_suppkey % 3 = 0 then '1997-06-30' else '1999-12-31' end as expires from supplier"""


@query("q158_waiver_expiry", f"""with w as (select * from ({_WAIVERS}) where symbol <> '' and reason <> ''), d as (select *, try_cast(expires as date) as day from w),
l as (select * from d where expires is null or day >= date '{_TODAY}'), o as (select o_orderkey, o_orderstatus || '/' || o_orderpriority || '::' || o_orderkey as symbol from orders),
x as (select symbol, max(id) as id from l where not contains(symbol, '*') group by 1), g as (select o.o_orderkey, min(l.id) as id from o join l on contains(l.symbol, '*') and o.symbol glob l.symbol group by 1),
m as (select o.o_orderkey, coalesce(x.id, g.id) as waiver from o left join x on x.symbol = o.symbol left join g on g.o_orderkey = o.o_orderkey)
select o_orderkey, waiver, case when waiver is null then 'open' else 'waived' end as state from m union all select null, id, 'expired' from d where day < date '{_TODAY}'""")
def q158(spark, sf):
    """What waivers remove: whole names first, then patterns in order; expired
    waivers are listed, those with a date that does not parse, or without a
    symbol or a reason, do not count."""
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    w = spark.sql(_WAIVERS).where("symbol <> '' and reason <> ''").withColumn("day", F.try_to_date("expires", "yyyy-MM-dd"))
    live = w.where(F.col("expires").isNull() | (F.col("day") >= F.lit(_TODAY).cast("date"))).select("id", "symbol")
    symbol = F.concat("o_orderstatus", F.lit("/"), "o_orderpriority", F.lit("::"), F.col("o_orderkey").cast("string"))
    m = first_rule(table(spark, sf, "orders").select("o_orderkey", symbol.alias("symbol")), live, "symbol", "symbol", "id")
    m = m.select("o_orderkey", F.col("rule.id").alias("waiver"), F.when(F.col("rule").isNull(), "open").otherwise("waived").alias("state"))
    expired = w.where(F.col("day") < F.lit(_TODAY).cast("date"))
    return m.union(expired.select(F.lit(None).cast("long"), "id", F.lit("expired")))


@query("q159_debounce", "select event_id, coalesce(epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) < 3600, false) as suppressed from events")
def q159(spark, sf):
    """Suppressed if the user was seen within the hour before."""
    rows = S.Dealt(_timed(spark, sf), ["user_id"], _ORDER).previous(was=lambda r: r["at"]).rows()
    return rows.select("event_id", F.coalesce(F.col("at") - F.col("was") < 3600, F.lit(False)).alias("suppressed"))
