"""Scans, projections, filters and scalar derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualitylens.functions.scalar import band, clamp, fingerprint, geometric_mean
from qualitylens.operators.patterns import exempted
from qualitylens.plans.adapters import FINDINGS, findings
from qualitylens.plans.registry import query
from qualitylens.session import table


@query("q002_scan_telemetry", "select event_id, user_id, value from events where ts >= timestamp '2024-01-20' and event_type = 'error'")
def q002(spark, sf):
    """Date pruning and an equality predicate, both pushed to the scan."""
    return table(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-20 00:00:00' and event_type = 'error'").select("event_id", "user_id", "value")


@query("q003_scan_json_document", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where cast(json_extract_string(props, '$.k') as int) > 50")
def q003(spark, sf):
    """Typed fields of a JSON document; a malformed one is null and drops out."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", "p.k").where("k > 50")


@query("q004_star_scan", """select p_brand, s_nationkey, count(*) as n from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by all""")
def q004(spark, sf):
    """A fact table with two look-ups."""
    t = lambda n: table(spark, sf, n)
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"))


@query("q006_commit_file_sets", """select l_orderkey as commit_id, list_sort(list(distinct p_brand)) as files from lineitem join part on l_partkey = p_partkey group by 1""")
def q006(spark, sf):
    """The set of files of each commit."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("l_orderkey").alias("commit_id")).agg(F.array_sort(F.collect_set("p_brand")).alias("files"))


@query("q012_retention_top_n", """with r as (select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_orderdate desc, o_orderkey desc) as rn from orders)
select o_orderstatus, o_orderkey, rn from r where rn <= 50""")
def q012(spark, sf):
    """The newest fifty per type."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 50")


@query("q014_content_hash_cache", """with c as (select distinct sha256(text) as h from documents where doc_id % 2 = 0)
select doc_id, substr(sha256(text), 1, 16) as key, c.h is not null as hit from documents left join c on sha256(text) = c.h where doc_id % 2 = 1""")
def q014(spark, sf):
    """Which texts an earlier run has already answered, by content hash."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    cache = d.where("doc_id % 2 = 0").select("h").distinct().withColumn("hit", F.lit(True))
    return d.where("doc_id % 2 = 1").join(cache, "h", "left").select("doc_id", F.substring("h", 1, 16).alias("key"), F.coalesce("hit", F.lit(False)).alias("hit"))


@query("q015_json_path_page", "select event_id, json_extract_string(props, '$.k') as k from events order by event_id limit 10 offset 20")
def q015(spark, sf):
    """A JSON path with a stable page of rows."""
    return table(spark, sf, "events").orderBy("event_id").offset(20).limit(10).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("q016_drilldown", "select event_id, user_id, value from events where event_type = 'error' order by value desc, event_id limit 10")
def q016(spark, sf):
    """The worst rows of a kind."""
    return table(spark, sf, "events").where("event_type = 'error'").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "user_id", "value")


@query("q017_issue_id", f"with {FINDINGS} select ord, substr(sha256(channel || '|' || file || '|' || ord), 1, 12) as issue_id from f")
def q017(spark, sf):
    return findings(spark, sf).select("ord", fingerprint(F.col("channel"), F.col("file"), F.col("ord"), length=12).alias("issue_id"))


@query("q018_fingerprint", f"with {FINDINGS} select distinct substr(sha256(channel || '|' || file || '|' || severity), 1, 16) as fp, channel, file from f")
def q018(spark, sf):
    """Line-insensitive identity of findings."""
    return findings(spark, sf).select(fingerprint(F.col("channel"), F.col("file"), F.col("severity")).alias("fp"), "channel", "file").distinct()


@query("q019_issue_signature", """select page_id, regexp_extract(url, '://([^?#]*)', 1) as full_key, regexp_extract(url, '([^/?#]*)/?([?#].*)?$', 1) as base_key from pages""")
def q019(spark, sf):
    """Recurrence keys by whole path and by base name."""
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("full_key"), F.regexp_extract("url", r"([^/?#]*)/?([?#].*)?$", 1).alias("base_key"))


@query("q020_path_normalise", """select page_id, regexp_extract(url, '://([^/?#]*)', 1) || '::' || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') as canonical from pages""")
def q020(spark, sf):
    path = F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "/+$", "")
    return table(spark, sf, "pages").select("page_id", F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("::"), path).alias("canonical"))


@query("q021_severity_override", """select l_orderkey, l_linenumber, case when l_returnflag || l_linestatus = 'NO' then 'off' when l_returnflag = 'A' then 'warning' when l_returnflag = 'N' then 'info' else 'default' end as severity from lineitem""")
def q021(spark, sf):
    """Exact key first, then its prefix, then the default: two map look-ups."""
    exact, prefix = F.create_map(F.lit("NO"), F.lit("off")), F.create_map(F.lit("A"), F.lit("warning"), F.lit("N"), F.lit("info"))
    key = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(exact[key], prefix[F.col("l_returnflag")], F.lit("default")).alias("severity"))


#: Sections under which a linter's exemptions may stand too.
_ALIASES = {"error": ("fault", "slip"), "view": ("look",)}


@query("q022_exemption_filter", """with i as (select event_id, event_type as linter, 'K' || cast(json_extract_string(props, '$.k') as int) % 5 as kind, 'm' || user_id || '.py' as base, 'src/' || user_id % 7 || '/m' || user_id || '.py' as path from events),
x as (select s as section, case when quality = 1 then 'm' || doc_id || '.py' else 'src/' || doc_id % 7 || '/m' || doc_id || '.py' end as name, case when doc_id % 4 > 0 then ['K' || doc_id % 5, 'K' || toxic] else [] end as codes
  from labels, (select unnest(['error', 'slip', 'look', 'click', 'K1', 'K3']) as s) where (doc_id + length(s)) % 3 > 0),
s as (select event_id, 0 as pos, linter as section from i union all select event_id, 1, case linter when 'error' then 'fault' else 'look' end from i where linter in ('error', 'view')
  union all select event_id, 2, 'slip' from i where linter = 'error' union all select event_id, 3, kind from i),
m as (select event_id, kind, arg_min(codes, pos * 2 + case when x.name = base then 0 else 1 end) as codes from s join i using (event_id) join x on x.section = s.section and x.name in (base, path) group by all)
select event_id, linter, kind from i where event_id not in (select event_id from m where len(codes) = 0 or list_contains(codes, kind))""")
def q022(spark, sf):
    """Findings that no exemption covers: its section is the linter, an alias or
    the kind, its file a base name or a path, its codes all or some."""
    k, user, doc = F.get_json_object("props", "$.k").cast("int"), F.col("user_id"), F.col("doc_id")
    path = lambda n: F.concat(F.lit("src/"), n % 7, F.lit("/m"), n, F.lit(".py"))
    i = table(spark, sf, "events").select("event_id", F.col("event_type").alias("linter"), F.concat(F.lit("K"), k % 5).alias("kind"), path(user).alias("file"))
    sections = F.explode(F.array(*[F.lit(s) for s in ("error", "slip", "look", "click", "K1", "K3")]))
    codes = F.when(doc % 4 > 0, F.array(F.concat(F.lit("K"), doc % 5), F.concat(F.lit("K"), F.col("toxic"))))
    x = table(spark, sf, "labels").select("*", sections.alias("section")).where((doc + F.length("section")) % 3 > 0)
    x = x.select("section", F.when(F.col("quality") == 1, F.concat(F.lit("m"), doc, F.lit(".py"))).otherwise(path(doc)).alias("file"), codes.alias("codes"))
    return exempted(i, x, "linter", "kind", "file", _ALIASES).where("not exempt").select("event_id", "linter", "kind")


@query("q023_suppress_downgrade", f"""with {FINDINGS}, n as (select channel, file, count(*) as seen from f group by all)
select ord, case when channel = 'error' and confidence < 0.8 and seen >= 3 then 'informational' else severity end as severity from f join n using (channel, file)
where not (channel = 'view' and seen >= 10)""")
def q023(spark, sf):
    """Tuning by signature: suppressed rows go, eligible ones are downgraded."""
    f = findings(spark, sf)
    n = f.groupBy("channel", "file").agg(F.count("*").alias("seen"))
    eligible = (F.col("channel") == "error") & (F.col("confidence") < 0.8) & (F.col("seen") >= 3)
    return f.join(n, ["channel", "file"]).where("not (channel = 'view' and seen >= 10)").select("ord", F.when(eligible, "informational").otherwise(F.col("severity")).alias("severity"))


@query("q024_effort_roi", """select l_returnflag, case l_returnflag when 'A' then 5.0 when 'R' then 2.0 else 10.0 end::double as effort, round(sum(l_discount) / greatest(case l_returnflag when 'A' then 5.0 when 'R' then 2.0 else 10.0 end, 0.1), 4) as roi from lineitem group by 1, 2""")
def q024(spark, sf):
    effort = F.coalesce(F.create_map(F.lit("A"), F.lit(5.0), F.lit("R"), F.lit(2.0))[F.col("l_returnflag")], F.lit(10.0))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_discount").alias("s")).select("l_returnflag", effort.alias("effort"), F.round(F.col("s") / F.greatest(effort, F.lit(0.1)), 4).alias("roi"))


@query("q025_change_kind", """select l_orderkey, case when bool_and(l_returnflag = 'N') then 'build' when bool_or(l_returnflag = 'R') then 'docs' when bool_and(l_linestatus = 'F') then 'test' else 'logic' end as kind,
  case when count(*) > 5 then 'high' when count(*) > 2 then 'medium' else 'low' end as risk from lineitem group by 1""")
def q025(spark, sf):
    """Priority case over all / any of a change's files, then its risk."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_returnflag") == "N").alias("all_n"), F.bool_or(F.col("l_returnflag") == "R").alias("any_r"), F.bool_and(F.col("l_linestatus") == "F").alias("all_f"), F.count("*").alias("n")
    )
    kind = F.when(F.col("all_n"), "build").when(F.col("any_r"), "docs").when(F.col("all_f"), "test").otherwise("logic")
    return g.select("l_orderkey", kind.alias("kind"), band(F.col("n"), (6, "high"), (3, "medium"), default="low").alias("risk"))


@query("q026_diff_lines", """with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), p as (select doc_id + 1 as doc_id, line from l)
select doc_id, cast(count(*) filter (o.line is null) as bigint) as added from (select distinct * from l) n left join (select distinct * from p) o using (doc_id, line) group by doc_id""".replace("o.line is null", "o.has is null").replace("(select distinct * from p) o", "(select distinct doc_id, line, 1 as has from p) o"))
def q026(spark, sf):
    """Distinct lines that a text has and the one before it has not."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    before = lines.select((F.col("doc_id") + 1).alias("doc_id"), "line", F.lit(1).alias("has"))
    return lines.join(before, ["doc_id", "line"], "left").groupBy("doc_id").agg(F.count_if(F.col("has").isNull()).alias("added"))


@query("q027_tier_selection", """select o_orderkey, case when o_totalprice > 200000 and o_orderstatus = 'P' then 'full' when o_orderpriority like '1%' then 'fast' when o_totalprice < 50000 then 'skip' else 'standard' end as tier from orders""")
def q027(spark, sf):
    p = F.col("o_totalprice")
    tier = F.when((p > 200000) & (F.col("o_orderstatus") == "P"), "full").when(F.col("o_orderpriority").startswith("1"), "fast").when(p < 50000, "skip").otherwise("standard")
    return table(spark, sf, "orders").select("o_orderkey", tier.alias("tier"))


@query("q028_edit_scope", f"""with {FINDINGS}, e as (select distinct file from f where channel = 'purchase') select channel, count(*) filter (e.file is not null) as related, count(*) filter (e.file is null and f.file is not null) as ambient, count(*) filter (f.file is null) as unknown from f left join e on f.file = e.file group by channel""")
def q028(spark, sf):
    """Per channel what touches edited files, what does not, and what cannot tell."""
    f = findings(spark, sf)
    e = f.where("channel = 'purchase'").select("file").distinct().withColumn("edited", F.lit(True))
    j = f.join(e, "file", "left")
    return j.groupBy("channel").agg(F.count_if(F.col("edited").isNotNull()).alias("related"), F.count_if(F.col("edited").isNull() & F.col("file").isNotNull()).alias("ambient"), F.count_if(F.col("file").isNull()).alias("unknown"))


@query("q029_working_tree_scope", """select d.doc_id, case when d.doc_id is null then 'unknown' when l.doc_id is null then 'new_file' when l.toxic = 1 then 'modified' else 'committed' end as scope from documents d left join labels l on d.doc_id = l.doc_id""")
def q029(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    scope = F.when(F.col("doc_id").isNull(), "unknown").when(F.col("known").isNull(), "new_file").when(F.col("toxic") == 1, "modified").otherwise("committed")
    return d.select("doc_id", scope.alias("scope"))


@query("q030_gap_waterfall", """select d.doc_id, case when quality = 1 and toxic = 0 then 'SPECIFIED' when n_chars < 100 then 'BUDGET_INSTABILITY' when quality is null and n_chars > 5000 then 'DISCOVERY_FAILURE' when toxic = 1 then 'REAL_UNDERSPECIFICATION' when quality is null then 'UNPROFILED' else 'SPECIFIED' end as gap
from documents d left join labels l on d.doc_id = l.doc_id""")
def q030(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    q, t, n = F.col("quality"), F.col("toxic"), F.col("n_chars")
    gap = (
        F.when((q == 1) & (t == 0), "SPECIFIED").when(n < 100, "BUDGET_INSTABILITY").when(q.isNull() & (n > 5000), "DISCOVERY_FAILURE")
        .when(t == 1, "REAL_UNDERSPECIFICATION").when(q.isNull(), "UNPROFILED").otherwise("SPECIFIED")
    )
    return d.select("doc_id", gap.alias("gap"))


_RISK = "least(1.0, case when c_acctbal < 0 then 0.3 else 0.0 end + case when c_nationkey >= 5 then 0.2 else 0.0 end + case when c_nationkey >= 15 then 0.1 else 0.0 end + case when c_mktsegment like 'A%' then 0.2 else 0.0 end + case when c_acctbal < 500 then 0.1 else 0.0 end)"


@query("q031_risk_score", f"select c_custkey, cast(round({_RISK}, 4) as double) as risk, case when {_RISK} >= 0.7 then 'P0' when {_RISK} >= 0.4 then 'P1' else 'P2' end as risk_band from customer")
def q031(spark, sf):
    """Additive score with a cap, and its band."""
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    risk = F.least(F.lit(1.0), part(b < 0, 0.3) + part(n >= 5, 0.2) + part(n >= 15, 0.1) + part(F.col("c_mktsegment").startswith("A"), 0.2) + part(b < 500, 0.1))
    return table(spark, sf, "customer").select("c_custkey", F.round(risk, 4).alias("risk"), band(risk, (0.7, "P0"), (0.4, "P1"), default="P2").alias("risk_band"))


@query("q032_sigma_predictor", """select p_partkey, cast(case when p_size < 5 then 1 when p_size < 15 then p_size else ceil(0.8 * p_size) end as bigint) as sigma, case when p_size > 20 or (p_size > 12 and p_retailprice < 1000) then 'B' else 'A' end as regime from part""")
def q032(spark, sf):
    s = F.col("p_size")
    sigma = F.when(s < 5, F.lit(1)).when(s < 15, s).otherwise(F.ceil(0.8 * s))
    return table(spark, sf, "part").select("p_partkey", sigma.cast("long").alias("sigma"), F.when((s > 20) | ((s > 12) & (F.col("p_retailprice") < 1000)), "B").otherwise("A").alias("regime"))


@query("q033_health_vector", """with g as (select c_nationkey as nation, least(1.0, greatest(0.0, avg(c_acctbal) / 10000)) as a, count(*) filter (c_acctbal > 0) / cast(count(*) as double) as b, case when count(*) > 50 then 1 / (1 + count(*) / 100.0) end as c from customer group by 1)
select nation, round(case when a <= 0 or b <= 0 then 0.0 when c is null then sqrt(a * b) else pow(a * b * c, 1 / 3.0) end, 4) as health from g""")
def q033(spark, sf):
    """Geometric mean of the axes that are measured."""
    n = F.count("*")
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        clamp(F.avg("c_acctbal") / 10000).alias("a"), (F.count_if(F.col("c_acctbal") > 0) / n).alias("b"), F.when(n > 50, 1 / (1 + n / 100.0)).alias("c")
    )
    return g.select("nation", F.round(geometric_mean(F.array("a", "b", "c")), 4).alias("health"))


@query("q034_reconcile", """select d.doc_id, case when l.doc_id is null then 'NO_EMPIRICAL_DATA' when quality = 1 and toxic = 1 then 'CONTRADICTS' when quality = 0 and toxic = 0 then 'TOPOLOGY_LIMITED' else 'AGREES' end as verdict from documents d left join labels l on d.doc_id = l.doc_id""")
def q034(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    v = F.when(F.col("known").isNull(), "NO_EMPIRICAL_DATA").when((F.col("quality") == 1) & (F.col("toxic") == 1), "CONTRADICTS").when((F.col("quality") == 0) & (F.col("toxic") == 0), "TOPOLOGY_LIMITED").otherwise("AGREES")
    return d.select("doc_id", v.alias("verdict"))


@query("q035_hotspot_priority", "select p_partkey, round(case when p_size > 40 then 3.0 when p_size > 20 then 1.5 else 0.5 end + least(p_size / 30.0, 1.0) * 0.2 + least(p_retailprice / 1000, 2.0) * 0.4, 4) as priority from part")
def q035(spark, sf):
    s = F.col("p_size")
    p = F.when(s > 40, 3.0).when(s > 20, 1.5).otherwise(0.5) + F.least(s / 30.0, F.lit(1.0)) * 0.2 + F.least(F.col("p_retailprice") / 1000, F.lit(2.0)) * 0.4
    return table(spark, sf, "part").select("p_partkey", F.round(p, 4).alias("priority"))


@query("q036_scheduler_priority", "select o_orderkey, round(40 * least(o_totalprice / 300000, 1.0) + case when o_orderstatus = 'P' then 30.0 else 0.0 end + case when o_orderpriority like '1%' then 20.0 when o_orderpriority like '2%' then 5.0 else 0.0 end, 3) as priority from orders")
def q036(spark, sf):
    p = F.col("o_orderpriority")
    score = 40 * F.least(F.col("o_totalprice") / 300000, F.lit(1.0)) + F.when(F.col("o_orderstatus") == "P", 30.0).otherwise(0.0) + F.when(p.startswith("1"), 20.0).when(p.startswith("2"), 5.0).otherwise(0.0)
    return table(spark, sf, "orders").select("o_orderkey", F.round(score, 3).alias("priority"))


@query("q037_authority_escalation", """with g as (select user_id, least(1.0, ln(count(*) filter (event_type = 'error') + 1) / ln(6.0)) as r, avg(case when event_type = 'purchase' then 1.0 else 0.0 end) as c from events group by 1)
select user_id, round(r, 4) as recurrence, case when r * case when c < 0.5 then 1.5 - c else 1.0 end >= 1.2 then 'block' when r * case when c < 0.5 then 1.5 - c else 1.0 end >= 0.8 then 'warn' else 'advise' end as authority from g""")
def q037(spark, sf):
    """Logarithmic recurrence, raised where compliance is low."""
    g = table(spark, sf, "events").groupBy("user_id").agg(
        F.least(F.lit(1.0), F.log(F.count_if(F.col("event_type") == "error") + 1) / F.log(F.lit(6.0))).alias("r"), F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("c")
    )
    score = F.col("r") * F.when(F.col("c") < 0.5, 1.5 - F.col("c")).otherwise(1.0)
    return g.select("user_id", F.round("r", 4).alias("recurrence"), band(score, (1.2, "block"), (0.8, "warn"), default="advise").alias("authority"))


@query("q038_cache_roi", "select l_partkey, round(0.4 * least(1.0, sum(l_quantity) / 1000) + 0.35 * least(1.0, count(*) / 50.0) + 0.25 * (1 - count(distinct l_suppkey) / cast(count(*) as double)), 6) as roi from lineitem group by 1")
def q038(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("d"))
    roi = 0.4 * F.least(F.lit(1.0), F.col("q") / 1000) + 0.35 * F.least(F.lit(1.0), F.col("n") / 50.0) + 0.25 * (1 - F.col("d") / F.col("n"))
    return g.select("l_partkey", F.round(roi, 6).alias("roi"))


@query("q039_delegation", """with g as (select c_nationkey as nation, count(*) as n, count(*) filter (c_acctbal < 0) as bad from customer group by 1)
select nation, round(least(1.0, greatest(0.0, 0.5 + 0.4 * (1 - bad / cast(n as double)) - least(0.3, 0.01 * n))), 4) as suitability from g""")
def q039(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("bad"))
    return g.select("nation", F.round(clamp(0.5 + 0.4 * (1 - F.col("bad") / F.col("n")) - F.least(F.lit(0.3), 0.01 * F.col("n"))), 4).alias("suitability"))


@query("q040_rule_triage", "select p_partkey, case when p_type like '%STEEL%' then 'security' when p_type like 'SMALL%' or p_type like 'ECONOMY%' then 'mechanical' when p_size > 40 then 'structural' else 'other' end as triage from part")
def q040(spark, sf):
    t = F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", F.when(t.contains("STEEL"), "security").when(t.startswith("SMALL") | t.startswith("ECONOMY"), "mechanical").when(F.col("p_size") > 40, "structural").otherwise("other").alias("triage"))
