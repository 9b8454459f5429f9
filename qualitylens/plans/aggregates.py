"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.functions.scalar import fingerprint, severity_rank
from qualitylens.operators import relational as R
from qualitylens.operators.selection import quantiles_by
from qualitylens.plans.adapters import FINDINGS, KILLS, findings, kills
from qualitylens.plans.registry import query
from qualitylens.session import table


@query("q062_dedup_keep_best", f"""with {FINDINGS}, r as (select *, row_number() over (partition by file, channel, run
  order by case severity when 'blocking' then 2 when 'warning' then 1 else 0 end desc, confidence desc, ord) as rn from f)
select file, channel, run, severity, confidence, ord from r where rn = 1""")
def q062(spark, sf):
    """The worst, surest, then first finding per file, kind and run."""
    f = findings(spark, sf)
    best = R.keep_best(f, ["file", "channel", "run"], [-severity_rank(F.col("severity")), -F.col("confidence"), F.col("ord")])
    return best.select("file", "channel", "run", "severity", "confidence", "ord")


@query("q063_multi_measure_summary", """select l_returnflag, count(*) as n, count(*) filter (l_discount > 0.05) as discounted,
  count(*) filter (l_linestatus = 'O') as open_lines, cast(sum(l_quantity) as double) as quantity from lineitem group by l_returnflag""")
def q063(spark, sf):
    """Conditional counts in one pass."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), F.sum("l_quantity").alias("quantity")
    )


@query("q064_telemetry_summary", """select cast(cast(ts as date) as varchar) as day, count(*) as events, count(*) filter (event_type = 'error') as errors,
  round(avg(value), 3) as avg_value, round(100.0 * count(*) filter (event_type <> 'error') / count(*), 1) as clean_rate from events group by 1""")
def q064(spark, sf):
    """Totals, averages and rates per day."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.round(F.avg("value"), 3).alias("avg_value"),
        F.round(100.0 * F.count_if(F.col("event_type") != "error") / F.count("*"), 1).alias("clean_rate"),
    )


@query("q065_feature_usage", """select event_type, count(*) as uses, count(distinct user_id) as users,
  round(100.0 * count(*) / (select count(*) from events), 2) as pct from events group by event_type""")
def q065(spark, sf):
    """Uses, distinct users and share of the total per feature."""
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("uses"), F.countDistinct("user_id").alias("users"))
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row per feature
    return g.withColumn("pct", F.round(100.0 * F.col("uses") / F.sum("uses").over(total), 2))


@query("q066_quality_economics", """select o_orderpriority, count(*) as n, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 4) as pass_rate,
  round(avg(o_totalprice), 2) as avg_price, count(*) filter (o_orderstatus = 'P') as partial from orders group by 1""")
def q066(spark, sf):
    """Pass rate, mean and reasons per priority."""
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 4).alias("pass_rate"),
        F.round(F.avg("o_totalprice"), 2).alias("avg_price"),
        F.count_if(F.col("o_orderstatus") == "P").alias("partial"),
    )


@query("q067_token_economics", """select round(avg(value) filter (event_type = 'purchase'), 4) as avg_purchase, round(avg(abs(value - 100)), 4) as avg_abs,
  count(*) filter (event_type = 'view') as views, round(count(*) filter (event_type = 'signup') / cast(count(*) as double), 4) as signup_rate from events""")
def q067(spark, sf):
    """Null-safe averages of several event streams."""
    is_ = lambda t: F.col("event_type") == t
    return table(spark, sf, "events").agg(
        F.round(F.avg(F.when(is_("purchase"), F.col("value"))), 4).alias("avg_purchase"),
        F.round(F.avg(F.abs(F.col("value") - 100)), 4).alias("avg_abs"),
        F.count_if(is_("view")).alias("views"),
        F.round(F.count_if(is_("signup")) / F.count("*"), 4).alias("signup_rate"),
    )


@query("q068_perf_economics", """select event_type, round(sum(value), 2) as total, round(avg(value), 4) as mean, max(value) as worst from events group by event_type""")
def q068(spark, sf):
    """Sum, mean and worst per event."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("worst"))


@query("q069_pattern_bank", f"""with {FINDINGS}, spine as (select run, row_number() over (order by run desc) as back from (select distinct run from f)),
g as (select channel, run, count(*) as n, count(distinct file) as files from f group by all)
select channel, cast(sum(n) as bigint) as lifetime, count(*) filter (back <= 5) as recent_runs,
  cast(coalesce(sum(n) filter (back = 1), 0) as bigint) as in_last, (count(*) filter (back <= 5) >= 3 or coalesce(sum(n) filter (back = 1), 0) >= 3) as alert
from g join spine using (run) group by channel""")
def q069(spark, sf):
    """Lifetime and recurrence per kind over the last five runs of all."""
    f = findings(spark, sf)
    spine = f.select("run").distinct().withColumn("back", F.row_number().over(W.orderBy(F.desc("run"))))  # a row per run
    g = f.groupBy("channel", "run").agg(F.count("*").alias("n"))
    out = g.join(F.broadcast(spine.where("back <= 5")), "run", "left").groupBy("channel").agg(
        F.sum("n").alias("lifetime"), F.count("back").alias("recent_runs"), F.coalesce(F.sum(F.when(F.col("back") == 1, F.col("n"))), F.lit(0)).alias("in_last")
    )
    return out.withColumn("alert", (F.col("recent_runs") >= 3) | (F.col("in_last") >= 3))


@query("q070_issue_memory", """select user_id, event_type, count(*) as seen, count(*) > 1 as repeated, min(event_id) as first_id from events group by all""")
def q070(spark, sf):
    """Count per signature, and whether it was seen before."""
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("seen"), F.min("event_id").alias("first_id"))
    return g.withColumn("repeated", F.col("seen") > 1)


@query("q071_finding_index", f"""with {FINDINGS} select substr(sha256(channel || '|' || file), 1, 16) as fp, count(*) as n,
  max(case severity when 'blocking' then 2 when 'warning' then 1 else 0 end) as rank, arg_min(confidence, ord) as first_confidence from f group by 1""")
def q071(spark, sf):
    """Count, worst severity and first confidence per fingerprint."""
    f = findings(spark, sf).withColumn("fp", fingerprint(F.col("channel"), F.col("file")))
    return f.groupBy("fp").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank"), F.min_by("confidence", "ord").alias("first_confidence"))


@query("q072_severity_volume", f"""with {FINDINGS}, c as (select channel, count(*) filter (severity = 'blocking') as b, count(*) filter (severity = 'warning') as w,
  count(*) filter (severity = 'informational') as i from f group by channel)
select channel, round(least(2.0, (b + 0.35 * w + 0.1 * i) * case when i > 0.8 * (b + w + i) then 0.3 else 1.0 end / 1000), 6) as score from c""")
def q072(spark, sf):
    """Weighted volume, damped where most is informational, capped."""
    s = F.col("severity")
    c = findings(spark, sf).groupBy("channel").agg(F.count_if(s == "blocking").alias("b"), F.count_if(s == "warning").alias("w"), F.count_if(s == "informational").alias("i"))
    raw = F.col("b") + 0.35 * F.col("w") + 0.1 * F.col("i")
    damp = F.when(F.col("i") > 0.8 * (F.col("b") + F.col("w") + F.col("i")), 0.3).otherwise(1.0)
    return c.select("channel", F.round(F.least(F.lit(2.0), raw * damp / 1000), 6).alias("score"))


@query("q073_mode", """with g as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by all),
r as (select *, row_number() over (partition by user_id order by n desc, f) as rn from g) select user_id, event_type as top, n from r where rn = 1""")
def q073(spark, sf):
    """The most common type per user, the first seen of equals."""
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return R.keep_best(g, ["user_id"], [-F.col("n"), F.col("f")]).select("user_id", F.col("event_type").alias("top"), "n")


_FUSION = """with s as (select l_partkey as target, l_returnflag as lens, 1 - product(1 - l_discount) as support, count(*) as n from lineitem group by all)
select target, count(*) as lenses, round(1 - product(1 - support), 4) as fused from s group by target"""


@query("q074_noisy_or_fusion", _FUSION)
def q074(spark, sf):
    """Noisy-or of the evidence per target over distinct lenses."""
    li = table(spark, sf, "lineitem")
    s = li.groupBy(F.col("l_partkey").alias("target"), "l_returnflag").agg((1 - F.product(1 - F.col("l_discount"))).alias("support"))
    return s.groupBy("target").agg(F.count("*").alias("lenses"), F.round(1 - F.product(1 - F.col("support")), 4).alias("fused"))


@query("q075_file_fusion", """select l_suppkey as file, round(least(1.0, sum(l_discount * case l_returnflag when 'A' then 2.0 when 'R' then 1.5 else 1.0 end) / 20), 4) as score from lineitem group by 1""")
def q075(spark, sf):
    """Lens-weighted sum per file, capped at one."""
    weight = F.when(F.col("l_returnflag") == "A", 2.0).when(F.col("l_returnflag") == "R", 1.5).otherwise(1.0)
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(F.sum(F.col("l_discount") * weight).alias("s"))
    return g.select("file", F.round(F.least(F.lit(1.0), F.col("s") / 20), 4).alias("score"))


@query("q076_project_rollup", """select r_name, n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def q076(spark, sf):
    """Counts and totals rolled up from nations to regions to all."""
    t = lambda n: table(spark, sf, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("q077_distribution_merge", """select k, count(*) as n, count(distinct user_id) as sessions from (select user_id, cast(json_extract_string(props, '$.k') as int) as k from events) group by k""")
def q077(spark, sf):
    """Merged counts of a map's keys with distinct sessions."""
    e = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sessions"))


@query("q079_effectiveness", """select lang, count(*) as n, round(avg(case when quality = 1 then 1.0 when quality = 0 then 0.0 end), 4) as strength,
  round(avg(case when toxic = 0 then 1.0 else 0.0 end), 4) as clean, count(*) filter (quality = 1 and toxic = 0) as actionable
from documents join labels using (doc_id) group by lang""")
def q079(spark, sf):
    """Mean strength and ratios per language."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    return d.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(q == 1, 1.0).when(q == 0, 0.0)), 4).alias("strength"),
        F.round(F.avg(F.when(t == 0, 1.0).otherwise(0.0)), 4).alias("clean"),
        F.count_if((q == 1) & (t == 0)).alias("actionable"),
    )


@query("q080_marginal_calibration", """with j as (select lang, quality from documents join labels using (doc_id)),
t as (select sum(quality) as q, count(*) as n from j), g as (select lang, sum(quality) as q, count(*) as n from j group by lang)
select lang, round(g.q / cast(g.n as double) - (t.q - g.q) / cast(t.n - g.n as double), 4) as delta,
  round(least(0.95, greatest(0.1, 0.5 + 0.4 * (g.q / cast(g.n as double) - (t.q - g.q) / cast(t.n - g.n as double)))), 4) as weight from g, t""")
def q080(spark, sf):
    """P(hit | present) - P(hit | absent) per kind, as a clamped weight."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    g = d.groupBy("lang").agg(F.sum("quality").alias("q"), F.count("*").alias("n"))
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row per language
    g = g.withColumn("tq", F.sum("q").over(all_)).withColumn("tn", F.sum("n").over(all_))
    delta = F.col("q") / F.col("n") - (F.col("tq") - F.col("q")) / (F.col("tn") - F.col("n"))
    return g.select("lang", F.round(delta, 4).alias("delta"), F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.1), 0.5 + 0.4 * delta)), 4).alias("weight"))


@query("q081_symmetry_classes", f"""with {KILLS}, s as (select mutant, list_sort(list(test)) as tests from k group by mutant) select tests, count(*) as mutants, min(mutant) as first from s group by tests""")
def q081(spark, sf):
    """Mutants grouped by the set of tests that kill them."""
    s = kills(spark, sf).groupBy("mutant").agg(F.array_sort(F.collect_list("test")).alias("tests"))
    return s.groupBy("tests").agg(F.count("*").alias("mutants"), F.min("mutant").alias("first"))


@query("q082_pairwise_jaccard_distance", """with s as (select distinct n_regionkey as cat, l_partkey as item from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
c as (select cat, count(*) as n from s group by cat), i as (select a.cat as a, b.cat as b, count(*) as n from s a join s b on a.item = b.item and a.cat < b.cat group by all)
select x.cat as a, y.cat as b, round(1 - coalesce(i.n, 0) / cast(x.n + y.n - coalesce(i.n, 0) as double), 4) as distance from c x join c y on x.cat < y.cat left join i on i.a = x.cat and i.b = y.cat""")
def q082(spark, sf):
    """1 - Jaccard of the item sets of each pair of categories, by shared items."""
    t = lambda n: table(spark, sf, n)
    s = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("n_regionkey").alias("cat"), F.col("l_partkey").alias("item")).distinct()
    c = s.groupBy("cat").agg(F.count("*").alias("n"))
    shared = R.pair_counts(s, "item", "cat").withColumnRenamed("n", "both")
    pairs = c.select(F.col("cat").alias("a"), F.col("n").alias("na")).join(c.select(F.col("cat").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    both = F.coalesce("both", F.lit(0))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.round(1 - both / (F.col("na") + F.col("nb") - both), 4).alias("distance"))


@query("q083_unique_kills", f"""with {KILLS}, s as (select mutant, count(*) as n, min(test) as test from k group by mutant) select test, count(*) as only_here from s where n = 1 group by test""")
def q083(spark, sf):
    """Mutants that exactly one test kills, per test."""
    s = kills(spark, sf).groupBy("mutant").agg(F.count("*").alias("n"), F.min("test").alias("test"))
    return s.where("n = 1").groupBy("test").agg(F.count("*").alias("only_here"))


@query("q084_cohesion", """with g as (select distinct c_nationkey as src, s_nationkey as dst from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey)
select a.n_regionkey as package, count(*) filter (a.n_regionkey = b.n_regionkey) as intra, count(*) as edges, round(count(*) filter (a.n_regionkey = b.n_regionkey) / cast(count(*) as double), 4) as cohesion
from g join nation a on src = a.n_nationkey join nation b on dst = b.n_nationkey group by 1""")
def q084(spark, sf):
    """Share of a package's edges that stay within it."""
    from qualitylens.plans.adapters import edges

    n = table(spark, sf, "nation")
    g = edges(spark, sf).join(n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("package")), "src").join(n.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("to")), "dst")
    out = g.groupBy("package").agg(F.count_if(F.col("package") == F.col("to")).alias("intra"), F.count("*").alias("edges"))
    return out.withColumn("cohesion", F.round(F.col("intra") / F.col("edges"), 4))


@query("q085_density", """with g as (select distinct c_nationkey as src, s_nationkey as dst from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey),
u as (select distinct least(src, dst) as a, greatest(src, dst) as b from g where src <> dst), n as (select count(*) as n from (select src from g union select dst from g))
select (select count(*) from u) as edges, n.n as nodes, round((select count(*) from u) / (n.n * (n.n - 1) / 2.0), 4) as density from n""")
def q085(spark, sf):
    """Undirected edges over possible ones."""
    from qualitylens.plans.adapters import edges

    g = edges(spark, sf)
    u = g.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count("*").alias("edges"))
    n = g.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("nodes"))
    return u.crossJoin(F.broadcast(n)).withColumn("density", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) / 2.0), 4))


@query("q086_percentiles", """select o_orderpriority, round(median(o_totalprice), 2) as med, round(quantile_cont(o_totalprice, 0.9), 2) as p90,
  quantile_cont(o_totalprice, 0.9) >= 5 * median(o_totalprice) as skewed from orders group by 1""")
def q086(spark, sf):
    """Median, linear 90th percentile and skew per priority."""
    g = quantiles_by(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", [0.5, 0.9])
    return g.select("o_orderpriority", F.col("q")[0].alias("m"), F.col("q")[1].alias("p")).select("o_orderpriority", F.round("m", 2).alias("med"), F.round("p", 2).alias("p90"), (F.col("p") >= 5 * F.col("m")).alias("skewed"))


@query("q087_fan_in_out", """with g as (select distinct c_nationkey as src, s_nationkey as dst from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey)
select n_nationkey as node, coalesce(o.n, 0) as fan_out, coalesce(i.n, 0) as fan_in from nation left join (select src, count(*) as n from g group by src) o on src = n_nationkey left join (select dst, count(*) as n from g group by dst) i on dst = n_nationkey""")
def q087(spark, sf):
    """Distinct neighbours in either direction, zero-filled."""
    from qualitylens.plans.adapters import edges

    g = edges(spark, sf)
    both = g.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(g.select("dst", F.lit(0), F.lit(1)))
    d = both.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return n.join(d, "node", "left").na.fill(0, ["fan_out", "fan_in"])


@query("q088_bias_adjustments", """with g as (select event_type, count(distinct user_id) as sessions, count(*) as n, count(*) filter (value > 100) as accepted from events group by 1)
select event_type, cast(case when sessions < 5 then 0.0 when accepted > 0.5 * n then 0.1 when accepted < 0.1 * n then -0.1 else 0.0 end as double) as adjustment from g""")
def q088(spark, sf):
    """A step up or down by acceptance where there are sessions enough."""
    g = table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("sessions"), F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("accepted"))
    step = F.when(F.col("sessions") < 5, 0.0).when(F.col("accepted") > 0.5 * F.col("n"), 0.1).when(F.col("accepted") < 0.1 * F.col("n"), -0.1).otherwise(0.0)
    return g.select("event_type", step.alias("adjustment"))


@query("q089_probe_validity", """with d as (select user_id, count(*) filter (event_type = 'error') as fires, count(*) as events from events group by 1)
select round(avg(abs(0.5 - least(1.0, 10.0 * fires / events))), 4) as mad, case when avg(abs(0.5 - least(1.0, 10.0 * fires / events))) < 0.15 then 'valid'
  when avg(abs(0.5 - least(1.0, 10.0 * fires / events))) < 0.3 then 'weak' else 'invalid' end as verdict from d""")
def q089(spark, sf):
    """Mean absolute difference of a prior and what was observed, banded."""
    d = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("fires"), F.count("*").alias("events"))
    m = d.agg(F.avg(F.abs(F.lit(0.5) - F.least(F.lit(1.0), 10.0 * F.col("fires") / F.col("events")))).alias("m"))
    return m.select(F.round("m", 4).alias("mad"), F.when(F.col("m") < 0.15, "valid").when(F.col("m") < 0.3, "weak").otherwise("invalid").alias("verdict"))


@query("q090_last_n_metrics", """with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
select user_id, count(*) as n, round(avg(case when event_type = 'purchase' then 1.0 else 0.0 end), 4) as success, count(distinct event_type) as tools from r where rn <= 10 group by user_id""")
def q090(spark, sf):
    """Rates over the last ten rows per user."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    r = table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 10")
    return r.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)), 4).alias("success"), F.countDistinct("event_type").alias("tools"))


@query("q091_spikiness", """with g as (select n_regionkey, n_nationkey, count(*) as n from customer join nation on c_nationkey = n_nationkey group by all)
select n_regionkey, round(stddev_pop(n / cast(m as double)), 4) as spiky from (select *, max(n) over (partition by n_regionkey) as m from g) group by 1""")
def q091(spark, sf):
    """Population deviation of normalised depths."""
    g = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))
    g = g.withColumn("m", F.max("n").over(W.partitionBy("n_regionkey")))
    return g.groupBy("n_regionkey").agg(F.round(F.stddev_pop(F.col("n") / F.col("m")), 4).alias("spiky"))


@query("q092_audit_banding", """select case when n_chars < 500 then 'weak' when n_chars < 3000 then 'fair' else 'strong' end as band, count(*) as n, count(quality) as labelled,
  count(*) filter (toxic = 1) as vulnerable from documents left join labels using (doc_id) group by 1""")
def q092(spark, sf):
    """Counts per band, and how many are covered by labels."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    b = F.when(F.col("n_chars") < 500, "weak").when(F.col("n_chars") < 3000, "fair").otherwise("strong")
    return d.groupBy(b.alias("band")).agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("vulnerable"))


@query("q093_mapping_diagnostics", """with g as (select user_id, event_type, count(*) as n from events group by all), r as (select *, sum(n) over (partition by user_id) as t, row_number() over (partition by user_id order by n desc, event_type) as rn from g)
select user_id, event_type as reason, round(n / cast(t as double), 4) as share from r where rn = 1""")
def q093(spark, sf):
    """The leading reason and its share."""
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    t = g.groupBy("user_id").agg(F.sum("n").alias("t"), F.min_by(F.struct("event_type", "n"), F.struct(-F.col("n"), "event_type")).alias("top"))
    return t.select("user_id", F.col("top.event_type").alias("reason"), F.round(F.col("top.n") / F.col("t"), 4).alias("share"))


@query("q094_worst_severity", f"""with {FINDINGS} select file, max(case severity when 'blocking' then 2 when 'warning' then 1 else 0 end) as worst, bool_or(severity <> 'informational') as actionable from f group by file""")
def q094(spark, sf):
    """The worst severity and whether anything is actionable, per file."""
    return findings(spark, sf).groupBy("file").agg(F.max(severity_rank(F.col("severity"))).alias("worst"), F.bool_or(F.col("severity") != "informational").alias("actionable"))


@query("q078_module_rollup", """select n_regionkey as module, cast(sum(p_size) as bigint) as sigma, count(*) as edges, round(avg(p_size), 4) as mean_gamma, sum(p_size) < 5 as small
from (select distinct l_partkey, s_nationkey from lineitem join supplier on l_suppkey = s_suppkey) x join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey group by 1""")
def q078(spark, sf):
    """Sums and means per module."""
    t = lambda n: table(spark, sf, n)
    x = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_nationkey").distinct()
    j = x.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("n_regionkey").alias("module")).agg(F.sum("p_size").alias("sigma"), F.count("*").alias("edges"), F.round(F.avg("p_size"), 4).alias("mean_gamma"), (F.sum("p_size") < 5).alias("small"))


