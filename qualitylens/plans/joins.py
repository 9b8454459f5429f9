"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualitylens.functions.scalar import severity_rank
from qualitylens.operators import relational as R
from qualitylens.plans.adapters import EDGES, FINDINGS, KILLS, edges, findings, kills
from qualitylens.plans.registry import query
from qualitylens.session import Scratch, table


@query("q041_inner_join", """select lang, case when avg(quality) < 0.8 then 'COH001' when avg(1 - toxic) < 0.9 then 'COH002' else 'OK' end as code, count(*) as n from documents join labels using (doc_id) group by lang""")
def q041(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    g = j.groupBy("lang").agg(F.avg("quality").alias("q"), F.avg(1 - F.col("toxic")).alias("t"), F.count("*").alias("n"))
    return g.select("lang", F.when(F.col("q") < 0.8, "COH001").when(F.col("t") < 0.9, "COH002").otherwise("OK").alias("code"), "n")


@query("q042_spec_composition", f"""with {EDGES}, o as (select src, count(*) as fan_out from g group by src)
select n_nationkey as node, n_name, fan_out, case when fan_out >= 24 then 'COH102' when n_regionkey > 3 then 'COH103' else 'COH101' end as code from nation join o on src = n_nationkey""")
def q042(spark, sf):
    o = edges(spark, sf).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "node")
    return n.join(o, "node").select("node", "n_name", "fan_out", F.when(F.col("fan_out") >= 24, "COH102").when(F.col("n_regionkey") > 3, "COH103").otherwise("COH101").alias("code"))


@query("q043_left_join_coverage", "select source, count(*) as total, count(quality) as matched, round(count(quality) / cast(count(*) as double), 4) as coverage from documents left join labels using (doc_id) group by source")
def q043(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("matched")).withColumn("coverage", F.round(F.col("matched") / F.col("total"), 4))


@query("q044_star_ledger", """select n_name, o_orderstatus, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all""")
def q044(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


_SPANS = "s as (select o_custkey as cust, min(o_orderdate) as a, min(o_orderdate) + interval 180 day as b from orders group by 1)"


@query("q045_interval_join", f"""with {_SPANS} select cust, count(*) as n, count(distinct l_suppkey) as contexts from lineitem join orders on l_orderkey = o_orderkey join s on cust = o_custkey where l_shipdate between a and b group by cust""")
def q045(spark, sf):
    """What falls within each span of the same key."""
    o = table(spark, sf, "orders")
    spans = o.groupBy(F.col("o_custkey").alias("cust")).agg(F.min("o_orderdate").alias("a")).withColumn("b", F.expr("a + interval 180 days"))
    points = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("cust"), "l_shipdate", "l_suppkey")
    return R.interval_join(points, spans, "cust", "l_shipdate", "a", "b").groupBy("cust").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("contexts"))


@query("q046_span_coverage", """select o_orderkey, count(l_shipdate) filter (l_shipdate > o_orderdate + interval 90 day) = 0 and count(l_shipdate) > 0 as covered from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def q046(spark, sf):
    """Whether nothing is missing within each span; none at all is uncovered."""
    j = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(((F.count_if(F.expr("l_shipdate > o_orderdate + interval 90 days")) == 0) & (F.count("l_shipdate") > 0)).alias("covered"))


@query("q047_fallback_join", """with p as (select page_id, regexp_extract(url, '://[^?#]*', 0) as path, regexp_extract(url, '/([^/?#]+)', 1) as suffix from pages)
select p.page_id, case when a.n > 1 then a.hit when b.n > 1 then b.hit end as hit, case when a.n > 1 then 'path' when b.n > 1 then 'suffix' else 'none' end as via
from p left join (select path, min(page_id) as hit, count(*) as n from p group by 1) a on p.path = a.path left join (select suffix, min(page_id) as hit, count(*) as n from p group by 1) b on p.suffix = b.suffix""")
def q047(spark, sf):
    """The first of those with the same exact key, else of those with the same weaker one."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://[^?#]*", 0).alias("path"), F.regexp_extract("url", "/([^/?#]+)", 1).alias("suffix"))
    first = lambda key, hit: p.groupBy(key).agg(F.min("page_id").alias(hit), F.count("*").alias(f"n_{hit}"))
    j = p.join(first("path", "a"), "path", "left").join(first("suffix", "b"), "suffix", "left")
    by_path, by_suffix = F.col("n_a") > 1, F.col("n_b") > 1
    return j.select("page_id", F.when(by_path, F.col("a")).when(by_suffix, F.col("b")).alias("hit"), F.when(by_path, "path").when(by_suffix, "suffix").otherwise("none").alias("via"))


@query("q049_full_outer_provenance", """select coalesce(d.doc_id, l.doc_id) as id, case when d.doc_id is not null and l.doc_id is not null then 'hybrid' when d.doc_id is not null then 'dynamic' else 'static' end as origin
from documents d full join labels l on d.doc_id = l.doc_id""")
def q049(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("d"))
    j = d.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("l")), "id", "full")
    return j.select("id", F.when(F.col("d").isNotNull() & F.col("l").isNotNull(), "hybrid").when(F.col("d").isNotNull(), "dynamic").otherwise("static").alias("origin"))


@query("q050_edge_join", f"""with {EDGES}, d as (select c_nationkey as k, count(*) as n from customer group by 1)
select src, dst, round((a.n + b.n) * (1 - least(1.0, b.n / 100.0)), 4) as gamma from g join nation x on src = x.n_nationkey join nation y on dst = y.n_nationkey join d a on a.k = src join d b on b.k = dst where x.n_regionkey <> y.n_regionkey""")
def q050(spark, sf):
    """Edges between modules with the weights of both ends."""
    d = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey").join(d, "k")
    a = n.select(F.col("k").alias("src"), F.col("n_regionkey").alias("ra"), F.col("n").alias("na"))
    b = n.select(F.col("k").alias("dst"), F.col("n_regionkey").alias("rb"), F.col("n").alias("nb"))
    j = edges(spark, sf).join(a, "src").join(b, "dst").where("ra <> rb")
    return j.select("src", "dst", F.round((F.col("na") + F.col("nb")) * (1 - F.least(F.lit(1.0), F.col("nb") / 100.0)), 4).alias("gamma"))


@query("q051_pair_enumeration", """with s as (select distinct l_orderkey, p_brand from lineitem join part on l_partkey = p_partkey)
select x.p_brand as a, y.p_brand as b, count(*) as n from s x join s y on x.l_orderkey = y.l_orderkey and x.p_brand < y.p_brand group by all having count(*) >= 3""")
def q051(spark, sf):
    """Pairs that change together, counted over small groups."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return R.pair_counts(j, "l_orderkey", "p_brand", 3)


@query("q052_semi_join", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def q052(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("q053_anti_join_orphans", "select c_custkey, c_name from customer where c_acctbal > 0 and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def q053(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 100000")
    return table(spark, sf, "customer").where("c_acctbal > 0").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("q054_untested", "select doc_id, lang from documents where source not like '%0' and doc_id not in (select doc_id from labels)")
def q054(spark, sf):
    return table(spark, sf, "documents").where("source not like '%0'").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("q055_stale_symbols", "select distinct l_partkey as symbol from lineitem where l_returnflag = 'R' and not exists (select 1 from part where p_partkey = l_partkey and p_size <= 40)")
def q055(spark, sf):
    """Symbols that failing tests name and the source no longer has."""
    p = table(spark, sf, "part").where("p_size <= 40")
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.col("l_partkey").alias("symbol")).distinct()


@query("q056_signature_diff", """with o as (select o_custkey as f, o_orderpriority as p from orders where o_orderstatus = 'F' group by all), n as (select o_custkey as f, o_orderpriority as p from orders where o_orderstatus = 'O' group by all),
b as (select f from o intersect select f from n)
select f, p, 'added' as change from n where f in (select f from b) and not exists (select 1 from o where o.f = n.f and o.p = n.p)
union all select f, p, 'removed' from o where f in (select f from b) and not exists (select 1 from n where o.f = n.f and o.p = n.p)""")
def q056(spark, sf):
    """Parameters added to and removed from what exists before and after."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("f"), F.col("o_orderpriority").alias("p"), "o_orderstatus")
    before, after = (o.where(F.col("o_orderstatus") == s).select("f", "p").distinct() for s in ("F", "O"))
    both = before.select("f").intersect(after.select("f"))
    added = after.join(before, ["f", "p"], "left_anti").withColumn("change", F.lit("added"))
    return added.union(before.join(after, ["f", "p"], "left_anti").withColumn("change", F.lit("removed"))).join(both, "f", "left_semi")


@query("q057_containment_join", """with s as (select o_custkey as k, list_distinct(list(o_orderpriority || o_orderstatus)) as items, count(*) as n from orders group by 1)
select x.k as subsumed, min(y.k) as superset, any_value(x.n) as tests from s x join s y on y.n > x.n and list_has_all(y.items, x.items) group by x.k""")
def q057(spark, sf):
    """Customers all whose kinds of orders another customer with more orders
    has, and the first such customer."""
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.concat("o_orderpriority", "o_orderstatus")).alias("items"), F.count("*").alias("n"))
    s = Scratch(spark).save(s)
    return R.first_superset(s, "o_custkey", "items", "n").join(s, "o_custkey").select(F.col("o_custkey").alias("subsumed"), "superset", F.col("n").alias("tests"))


@query("q059_impact_join", f"""with {EDGES} select distinct n_name as changed, dst from g join nation on n_nationkey = src where n_regionkey = 1""")
def q059(spark, sf):
    """What one hop from the changed files reaches."""
    n = table(spark, sf, "nation").where("n_regionkey = 1")
    return edges(spark, sf).join(n, F.col("n_nationkey") == F.col("src")).select(F.col("n_name").alias("changed"), "dst").distinct()


@query("q060_longest_prefix", """with r as (select * from (values ('com', 'a'), ('com/example', 'b'), ('net/example', 'c'), ('org', 'd')) t(prefix, layer)),
p as (select page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#:]*)', 1), '.')), '/') as path from pages),
m as (select page_id, layer, row_number() over (partition by page_id order by length(prefix) desc) as rn from p join r on path = prefix or path like prefix || '/%')
select p.page_id, layer from p left join (select * from m where rn = 1) m using (page_id)""")
def q060(spark, sf):
    """The layer of the longest prefix of each path."""
    layers = spark.createDataFrame([("com", "a"), ("com/example", "b"), ("net/example", "c"), ("org", "d")], "prefix string, layer string")
    path = F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/?#:]*)", 1), r"\.")), "/")
    pages = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return R.longest_prefix(pages, layers, "path", "prefix", "layer").select("page_id", "layer")


@query("q061_claim_scope", """select page_id, case when url like '%/fr/%' then 'french' when url like '%spam%' then 'spam' when url like '%ref=%' then 'referred' end as claim from pages""")
def q061(spark, sf):
    """The first claim whose scope is part of the path."""
    claim = None
    for scope, name in (("/fr/", "french"), ("spam", "spam"), ("ref=", "referred")):
        hit = F.col("url").contains(scope)
        claim = F.when(hit, name) if claim is None else claim.when(hit, name)
    return table(spark, sf, "pages").select("page_id", claim.alias("claim"))




@query("q122_finding_delta", f"""with {FINDINGS}, h as (select file, channel, count(*) filter (run = '2024-01-10') as n0, count(*) filter (run = '2024-01-11') as n1,
  max(confidence) filter (run = '2024-01-10') as r0, max(confidence) filter (run = '2024-01-11') as r1 from f where run in ('2024-01-10', '2024-01-11') group by all)
select file, channel, n1 - least(n0, n1) as new, n0 - least(n0, n1) as resolved, case when coalesce(r1 > r0, false) then least(n0, n1) else 0 end as escalated,
  case when coalesce(r1 > r0, false) then 0 else least(n0, n1) end as still_active from h""")
def q122(spark, sf):
    """Day over day: new, resolved, escalated, still active."""
    f = findings(spark, sf)
    day = lambda d: f.where(F.col("run") == d).groupBy("file", "channel").agg(F.count("*").alias("n"), F.max("confidence").alias("rank"))
    out = R.bag_delta(day("2024-01-10"), day("2024-01-11"), ["file", "channel"])
    return out.select("file", "channel", *[F.col(c).cast("long").alias(c) for c in ("new", "resolved", "escalated", "still_active")])


@query("q123_shared_files", f"with {FINDINGS} select file from f group by file having count(distinct channel) = (select count(distinct channel) from f)")
def q123(spark, sf):
    """Files that every channel has: an intersection by counting."""
    f = findings(spark, sf).select("file", "channel").distinct()
    n = f.groupBy("file").agg(F.count("*").alias("n"))
    all_ = f.agg(F.countDistinct("channel").alias("all"))
    return n.crossJoin(F.broadcast(all_)).where(F.col("n") == F.col("all")).select("file")


@query("q124_convergent_files", f"""with {FINDINGS} select file, run, count(distinct channel) as channels, case when max(case severity when 'blocking' then 2 when 'warning' then 1 else 0 end) = 0 then 'warning' else 'kept' end as action from f group by all having count(distinct channel) >= 3""")
def q124(spark, sf):
    """Files that three channels or more hit in a run."""
    g = findings(spark, sf).groupBy("file", "run").agg(F.countDistinct("channel").alias("channels"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    return g.where("channels >= 3").select("file", "run", "channels", F.when(F.col("worst") == 0, "warning").otherwise("kept").alias("action"))


#: What channels (suppliers) publish, consume and report, and which ones are active; more keys than this are too many.
_MANY = 10
_WIRING = f"""with act as (select s_suppkey as channel from supplier where s_acctbal >= 0),
pub as (select l_suppkey as channel, l_partkey as key, bool_or(l_tax > 0.06) as optional from lineitem where l_linenumber = 7 and l_returnflag = 'A' and l_linestatus = 'F' group by all),
con as (select l_suppkey as channel, l_partkey as key, bool_or(l_linestatus = 'O') as optional from lineitem where l_linenumber = 1 and l_returnflag = 'R' group by all),
got as (select distinct l_suppkey as channel, l_partkey as key from lineitem where l_linenumber < 4),
pm as (select key, max(channel) as publisher from pub join act using (channel) group by 1),
miss as (select channel, key from con where not optional and not exists (select 1 from pm where pm.key = con.key))
select 'missing_publisher' as kind, channel, key, null::bigint as detail from miss join act using (channel)
union all select 'chain_break', con.channel, con.key, miss.key from con join act using (channel) join pm using (key) join miss on miss.channel = pm.publisher
union all select 'missing_metric', channel, key, null from pub join act using (channel) where not optional and not exists (select 1 from got where got.channel = pub.channel and got.key = pub.key)
union all select 'schema_growth', channel, null, count(*) from pub group by channel having count(*) > {_MANY}"""


@query("q125_wiring_check", _WIRING)
def q125(spark, sf):
    """Faults in what channels publish and consume: a required key that no active
    channel publishes; a consumed key whose publisher lacks one itself; a
    declared key that the channel's results lack; too many keys."""
    li = table(spark, sf, "lineitem")
    keys = lambda where: li.where(where).select(F.col("l_suppkey").alias("channel"), F.col("l_partkey").alias("key"), "l_tax", "l_linestatus")
    active = table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("channel"))
    pub = keys("l_linenumber = 7 and l_returnflag = 'A' and l_linestatus = 'F'").groupBy("channel", "key").agg(F.bool_or(F.col("l_tax") > 0.06).alias("optional"))
    con = keys("l_linenumber = 1 and l_returnflag = 'R'").groupBy("channel", "key").agg(F.bool_or(F.col("l_linestatus") == "O").alias("optional"))
    scratch = Scratch(spark)
    pub, con = scratch.save(pub), scratch.save(con)
    by_key = pub.join(active, "channel").groupBy("key").agg(F.max("channel").alias("publisher"))
    miss = scratch.save(con.where("not optional").join(by_key, "key", "left_anti").select("channel", "key"))
    fault = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "channel", "key", detail.cast("long").alias("detail"))
    chain = con.join(active, "channel").join(by_key, "key").join(miss.select(F.col("channel").alias("publisher"), F.col("key").alias("upstream")), "publisher")
    lacking = pub.where("not optional").join(active, "channel").join(keys("l_linenumber < 4").select("channel", "key"), ["channel", "key"], "left_anti")
    wide = pub.groupBy("channel").agg(F.count("*").alias("n")).where(F.col("n") > _MANY).withColumn("key", F.lit(None).cast("long"))
    none = F.lit(None)
    return fault(miss.join(active, "channel"), "missing_publisher", none).union(fault(chain, "chain_break", F.col("upstream"))).union(fault(lacking, "missing_metric", none)).union(fault(wide, "schema_growth", F.col("n")))


@query("q126_cross_file_duplicates", """select substr(sha256(lower(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) as hash, count(*) as copies, min(doc_id) as keeper from documents group by 1 having count(*) > 1""")
def q126(spark, sf):
    """Texts that are equal but for case and white space, and which to keep."""
    key = F.substring(F.sha2(F.lower(F.regexp_replace("text", r"\s+", " ")), 256), 1, 16)
    return table(spark, sf, "documents").groupBy(key.alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("keeper")).where("copies > 1")


@query("q127_union_first_wins", """with u as (select 0 as src, lower(trim(n_name)) as t from nation union all select 1, lower(trim(r_name)) from region union all select 2, lower(trim(c_mktsegment)) from customer)
select t, min(src) as src from u group by t""")
def q127(spark, sf):
    """Several sources, the first wins for a text."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    u = table(spark, sf, "nation").select(F.lit(0).alias("src"), norm("n_name").alias("t")).union(table(spark, sf, "region").select(F.lit(1), norm("r_name"))).union(table(spark, sf, "customer").select(F.lit(2), norm("c_mktsegment")))
    return u.groupBy("t").agg(F.min("src").alias("src"))


@query("q107_greedy_coverage", f"""with {KILLS}, n as (select test, count(*) as kills from k group by test), fr as (select mutant, test, row_number() over (partition by mutant order by kills desc, test) as rn from k join n using (test)),
w as (select test, count(*) as new from fr where rn = 1 group by test)
select test, kills, coalesce(new, 0) as new, cast(sum(coalesce(new, 0)) over (order by kills desc, test) as bigint) as covered, coalesce(new, 0) = 0 as redundant from n left join w using (test)""")
def q107(spark, sf):
    """Greedy cumulative coverage in one static order."""
    return R.greedy_order(kills(spark, sf)).select("test", "kills", "new", "covered", (F.col("new") == 0).alias("redundant"))


@query("q108_trajectory_phase", f"""with {KILLS}, n as (select test, count(*) as kills from k group by test), fr as (select mutant, test, row_number() over (partition by mutant order by kills desc, test) as rn from k join n using (test)),
w as (select test, count(*) as new from fr where rn = 1 group by test), o as (select row_number() over (order by kills desc, test) as step, coalesce(new, 0) as new from n left join w using (test)), t as (select cast(sum(new) as double) as t from o)
select count(*) filter (new > 0) as useful, min(step) filter (step > 1 and new / t < 1 / 20.0) as tail_onset from o, t""")
def q108(spark, sf):
    """Useful steps, and where new coverage falls below a bound."""
    g = R.greedy_order(kills(spark, sf))
    return g.agg(F.count_if(F.col("new") > 0).alias("useful"), F.min(F.when((F.col("rank") > 1) & (F.col("new") / F.col("total") < 1 / 20.0), F.col("rank"))).cast("long").alias("tail_onset"))


@query("q136_min_killing_set", f"with {KILLS} select distinct test from k")
def q136(spark, sf):
    """The tests of all convergence steps; steps that kill nothing new are
    steps too, so the set is not minimal."""
    return R.greedy_order(kills(spark, sf)).select("test").distinct()
