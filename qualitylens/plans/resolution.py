"""Name resolution, mapping, normalisation and lens queries, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.functions import commands as C
from qualitylens.functions.versions import satisfies
from qualitylens.operators import lenses as L
from qualitylens.plans.registry import query
from qualitylens.session import Scratch, scratch_folder, table
from qualitylens.sources import files as S


@query("q001_source_tree", "select page_id, path from (select page_id, regexp_extract(url, '://([^?#]*)', 1) as path from pages) where path like '%/en/%' and path not like '%.org/%'")
def q001(spark, sf):
    """Paths of a kind, without those below excluded folders."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return p.where(F.col("path").contains("/en/") & ~F.col("path").contains(".org/"))


@query("q005_coverage_json", """with l as (select distinct l_orderkey, l_partkey, l_linenumber as line, l_returnflag as f, l_suppkey % 9 - 2 as t from lineitem)
select 'part/' || l_partkey as file, count(*) filter (f = 'N') as executed, count(*) filter (f = 'R') as missing, count(*) filter (f = 'A') as excluded, count(*) filter (f = 'R' and t >= 0) as branches, coalesce(sum(t) filter (f = 'R' and t >= 0), 0)::bigint as targets from l group by 1""")
def q005(spark, sf):
    """Coverage reports, one an order, written as JSON and read back: lines of each
    state and branches never taken, by file. Lines are dealt by order once, and
    each report is parsed once."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("part/"), "l_partkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("f"), (F.col("l_suppkey") % 9 - 2).alias("t"))
    li = li.repartition("l_orderkey").distinct()
    lines = lambda f: F.collect_list(F.when(F.col("f") == f, F.col("line")))
    branches = F.collect_list(F.when(F.col("f") == "R", F.array(F.col("line"), F.col("t"))))
    c = li.groupBy("l_orderkey", "file").agg(F.struct(lines("N").alias("executed_lines"), lines("R").alias("missing_lines"), lines("A").alias("excluded_lines"), branches.alias("missing_branches")).alias("c"))
    root = scratch_folder(spark, "coverage")
    c.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("file", "c"))).alias("files")).select("files").write.json(root)
    n = lambda c: F.sum(F.size(c).cast("long"))
    targets = F.coalesce(F.sum(F.aggregate("branches", F.lit(0).cast("long"), lambda s, b: s + b.to_line)), F.lit(0))
    return S.coverage_files(spark, root, False).groupBy("file").agg(*[n(s).alias(s) for s in ("executed", "missing", "excluded", "branches")], targets.alias("targets"))


@query("q011_jsonl_append", "select event_type as event, count(*) as n from events group by 1")
def q011(spark, sf):
    """Rows appended to their day's JSON lines, and read back."""
    root = scratch_folder(spark, "telemetry")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("event"), F.lit("p").alias("project"))
    S.append_telemetry(rows, root)
    return S.telemetry(spark, root).groupBy("event").agg(F.count("*").alias("n"))


@query("q013_newest_generation", "select user_id, arg_max(event_id, event_id) as generation, arg_max(event_type, event_id) as event_type from events group by 1")
def q013(spark, sf):
    """The row of the highest generation of each key."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("generation"), "event_type")
    return S.newest_generation(e, "user_id")


@query("q147_bitmap_decode", r"""with h as (select doc_id, unhex(substr(sha256(coalesce(text, '')), 1, 8)) as b from documents)
select doc_id, array_to_string(list_filter(range(32), lambda i: substr(cast(reverse(bin(('0x' || substr(hex(b), 2 * (i // 8) + 1, 2))::int)) as varchar) || '00000000', i % 8 + 1, 1) = '1'), ' ') as lines from h""")
def q147(spark, sf):
    """The numbers of the bits set in a bitmap."""
    b = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(S.decode_numbits(b), lambda x: x.cast("string")), " ").alias("lines"))


_CALLS = """f as (select p_brand as file, p_name as name, max(p_partkey) as key from part group by all),
i as (select p_brand as file, regexp_extract(p_name, '^[^ ]+', 0) as alias, arg_min(p_name, p_partkey) as target from part group by 1, 2),
g as (select p_name as name, arg_max(p_brand, p_partkey) as file from part group by 1),
c as (select distinct x.p_brand as file, x.p_brand || '::' || x.p_name as caller, case when b.l_linenumber % 2 = 0 then y.p_name else regexp_extract(y.p_name, '^[^ ]+', 0) end as called
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber join part x on x.p_partkey = a.l_partkey join part y on y.p_partkey = b.l_partkey)"""


@query("q048_call_resolution", f"""with {_CALLS}, r as (select caller, case when f.name is not null then c.file || '::' || called when gi.name is not null then gi.file || '::' || gi.name when g.name is not null then g.file || '::' || g.name end as callee
  from c left join f on f.file = c.file and f.name = called left join i on i.file = c.file and i.alias = called left join g gi on gi.name = i.target left join g on g.name = called)
select distinct caller, callee from r where callee is not null and callee <> caller""")
def q048(spark, sf):
    """Called names by what their file defines, else by what it imports, else by
    what any file defines (the last wins); calls of oneself are left out."""
    p = table(spark, sf, "part")
    own = p.select(F.col("p_brand").alias("file"), F.col("p_name").alias("called")).distinct().withColumn("own", F.concat_ws("::", "file", "called"))
    alias = F.regexp_extract("p_name", "^[^ ]+", 0)
    imports = p.groupBy(F.col("p_brand").alias("file"), alias.alias("called")).agg(F.min_by("p_name", "p_partkey").alias("target"))
    named = p.groupBy(F.col("p_name").alias("name")).agg(F.max_by("p_brand", "p_partkey").alias("at")).withColumn("key", F.concat_ws("::", "at", "name"))
    li = table(spark, sf, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("x"))
    b = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("y"))
    x = p.select(F.col("p_partkey").alias("x"), F.col("p_brand").alias("file"), F.concat_ws("::", "p_brand", "p_name").alias("caller"))
    y = p.select(F.col("p_partkey").alias("y"), "p_name")
    c = a.join(b, ["l_orderkey", "l_linenumber"]).join(x, "x").join(y, "y")
    c = c.select("file", "caller", F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(alias).alias("called")).distinct()
    imported = named.select(F.col("name").alias("target"), F.col("key").alias("imported"))
    anywhere = named.select(F.col("name").alias("called"), F.col("key").alias("anywhere"))
    r = c.join(own, ["file", "called"], "left").join(imports, ["file", "called"], "left").join(imported, "target", "left").join(anywhere, "called", "left")
    return r.select("caller", F.coalesce("own", "imported", "anywhere").alias("callee")).where("callee is not null and callee <> caller").distinct()


@query("q058_test_mapping", """with p as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages),
h as (select host, count(*) as n, sum(page_id) as s from p group by 1), q as (select path, count(*) as n, sum(page_id) as s from p group by 1)
select page_id, cast(case when h.n = 2 then h.s - page_id when q.n = 2 then q.s - page_id end as bigint) as target, case when h.n = 2 then 'call' when q.n = 2 then 'name' when h.n > 2 or q.n > 2 then 'ambiguous' else 'none' end as via
from p join h using (host) join q using (path)""")
def q058(spark, sf):
    """Strategies in order, each accepted only with exactly one candidate, and why there is none."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    # of two candidates that hold a key the other one is the sum less oneself
    by = lambda key: p.groupBy(key).agg(F.count("*").alias(f"n_{key}"), F.sum("page_id").alias(f"s_{key}"))
    j = p.join(by("host"), "host").join(by("path"), "path")
    target = F.when(F.col("n_host") == 2, F.col("s_host") - F.col("page_id")).when(F.col("n_path") == 2, F.col("s_path") - F.col("page_id"))
    via = F.when(F.col("n_host") == 2, "call").when(F.col("n_path") == 2, "name").when((F.col("n_host") > 2) | (F.col("n_path") > 2), "ambiguous").otherwise("none")
    return j.select("page_id", target.alias("target"), via.alias("via"))


#: A command line of each event, of all the forms that its signature must see through.
_COMMAND = """case event_id % 17 when 0 then 'uv run python -m pytest tests/test_' || user_id || '.py -v' when 1 then 'git ' || event_type || ' -- src/' || user_id when 2 then 'sudo /usr/bin/make -j build.' || event_type
  when 3 then 'env A=1 B=' || user_id || ' nohup git commit -m "fix ' || event_type || ' now"' when 4 then 'cat /usr/local/lib/m' || event_id || '.py' when 5 then 'curl token_' || (100000000 + event_id) || ' out.' || event_type
  when 6 then '"my tool" ' || event_type || '.tar.gz' when 7 then 'sudo env' when 8 then 'echo "unclosed ' || event_type when 9 then props when 10 then '  git' || chr(9) || 'log --oneline ' when 11 then '' when 12 then 'ls .hidden ' || event_type
  when 13 then '/usr/bin/env python3 -m mod_' || user_id when 14 then 'time nice python -m json.tool /a/b/c/' || event_id || '.json' when 15 then 'deploy ' || md5(event_type) || ' prod' || chr(39) || ' to' || chr(39) else event_type || ' /x/' || user_id || '.d/Key_' || event_id || 'abcdefgh' end"""


@query("q142_command_signature", rf"""with c as (select event_id, {_COMMAND} as cmd from events),
w as (select event_id, case when regexp_full_match(cmd, '(?s)(?:[^"'']|"[^"]*"|''[^'']*'')*') then list_transform(regexp_extract_all(cmd, '(?:[^\s"'']|"[^"]*"|''[^'']*'')+'), lambda x: regexp_replace(x, '["'']', '', 'g')) else regexp_extract_all(cmd, '\S+') end as ws from c),
p as (select event_id, regexp_replace(list_reduce(list_prepend('', ws), lambda a, x: a || x || chr(1)), '^(?:uv\x01run\x01|python3?\x01-m\x01|env\x01(?:[^\x01]*=[^\x01]*\x01)*|(?:sudo|nohup|time|nice)\x01)*', '') as rest from w),
a as (select event_id, rest, string_split(rest, chr(1)) as ws from p),
s as (select event_id, rest, regexp_extract(ws[1], '[^/]*$')[1:30] as bin, list_filter(list_transform(list_filter(ws[2:], lambda x: not starts_with(x, '-') and not regexp_matches(x, '(?i){C.SECRET}')),
  lambda x: regexp_replace(regexp_replace(x, '{C.PATH}', '\1', 'g'), '[.][^.]*$', '')), lambda x: x <> '') as stems from a)
select event_id, case when rest = '' then 'unknown:unknown' else bin || ':' || coalesce(stems[1], 'default')[1:30] end as sig from s""")
def q142(spark, sf):
    """What a command runs, whatever starts it."""
    return table(spark, sf, "events").select("event_id", C.command_signature(F.expr(_COMMAND)).alias("sig"))


#: Words that endorse and that forbid.
_FOR, _AGAINST = ("and", "with"), ("not", "was")
_POLARITY = "sign(len(list_filter(ws, lambda x: x in ('and', 'with'))) - len(list_filter(ws, lambda x: x in ('not', 'was'))))"


@query("q146_theory_coherence", f"""with b as (select item_id, list_distinct(string_split_regex(lower(text), '\\s+')) as ws, regexp_extract_all(lower(text), '[a-z]{{4,}}')[1:5] as ks from benchmark),
k as (select distinct item_id, unnest(ks) as k from b), d as (select doc_id, list_distinct(string_split_regex(lower(text), '\\s+')) as ws, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) as ks from documents),
t as (select doc_id, unnest(ks) as k from d), s as (select item_id, doc_id, count(*) as shared from k join t using (k) group by all),
r as (select *, row_number() over (partition by item_id order by shared desc, doc_id) as rn from s), p as (select item_id, {_POLARITY} as p from b), c as (select doc_id, {_POLARITY} as c from d),
m as (select item_id, count(*) as total, count(*) filter (p * c < 0) as contra from r join p using (item_id) join c using (doc_id) where rn <= 10 group by 1)
select item_id, round((total - 2 * contra) / cast(total as double), 4) as coherence, case when total <> 2 * contra then total > 2 * contra end as aligned from m""")
def q146(spark, sf):
    """Whether the claims that share a proposal's first keywords support it: a
    claim of the opposite polarity contradicts."""
    words = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    terms = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)
    count = lambda some: F.size(F.filter(words, lambda x: x.isin(*some)))
    polarity = F.signum(count(_FOR) - count(_AGAINST))
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    k = b.select("item_id", F.explode(F.array_distinct(F.slice(terms, 1, 5))).alias("k"))
    t = d.select("doc_id", F.explode(F.array_distinct(terms)).alias("k"))
    s = t.join(k, "k").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    top = s.withColumn("rank", rank).where("rank <= 10").select("item_id", "doc_id")  # tasks keep ten of each before the shuffle
    m = top.join(d.select("doc_id", polarity.alias("c")), "doc_id").join(b.select("item_id", polarity.alias("p")), "item_id")
    m = m.groupBy("item_id").agg(F.count("*").alias("total"), F.count_if(F.col("p") * F.col("c") < 0).alias("contra"))
    net = F.col("total") - 2 * F.col("contra")
    return m.select("item_id", F.round(net / F.col("total"), 4).alias("coherence"), F.when(net != 0, net > 0).alias("aligned"))


_KINDS = "case p_partkey % 5 when 0 then '' when 1 then 'rc1' when 2 then '.post1' when 3 then '.dev2' else '+local' end"


@query("q152_version_satisfaction", """select p_partkey, k not in (1, 3) and (s > 10 or (s = 10 and m >= 2)) as least, k not in (1, 3) and s = 20 and m >= 1 as compatible, k not in (1, 3) and s = 5 as wild, false as odd,
  s < 30 and not (k in (1, 3) and s = 30) as early, k not in (1, 3) as any_release, k = 2 and s = 7 and m = 3 as exact, k not in (1, 3) and s = 40 and (m > 2 or (m = 2 and false)) or k not in (1, 3) and s > 40 as above
from (select p_partkey, p_size as s, p_partkey % 10 as m, p_partkey % 5 as k from part)""")
def q152(spark, sf):
    """Versions of every kind (final, candidate, post, development, local)
    against specifiers; ``early`` takes pre-releases too."""
    v = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".0"), F.expr(_KINDS))
    names = {"least": ">=10.2", "compatible": "~=20.1", "wild": "==5.*", "odd": ">=new", "any_release": "", "exact": "===7.3.0.post1", "above": ">40.2"}
    p = table(spark, sf, "part").select("p_partkey", v.alias("v"))
    return p.select("p_partkey", *[satisfies(F.col("v"), s).alias(n) for n, s in names.items()], satisfies(F.col("v"), "<30", True).alias("early"))


_FUSED = """k as (select target, lens, signal, {c} as c, count(*) as n from e group by all),
g as (select target, 1 - list_reduce(list_prepend(1.0::double, list(pow(1 - c, n) order by lens, c) filter (signal = 'support')), lambda x, y: x * y) as s,
  1 - list_reduce(list_prepend(1.0::double, list(pow(1 - c, n) order by lens, c) filter (signal = 'oppose')), lambda x, y: x * y) as o, count(distinct lens) filter (signal = 'support') as lenses from k group by 1),
u as (select target, lenses, greatest(s - o, 0) as net from g)"""
_PARTS = """l as (select l_partkey, count(*) as n, count(*) filter (l_returnflag = 'R') / count(*)::double as ret, count(distinct l_suppkey) as sup, count(*) filter (l_linenumber = 1) as firsts, count(*) filter (l_linenumber = 7) as lasts from lineitem group by 1),
p as (select *, p_partkey % 10 / 10.0::double as level from part left join l on p_partkey = l_partkey),
f as (select a.l_partkey as a, b.l_partkey as b, count(*) as c from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2 group by all),
e as (select p_partkey::varchar as target, 'purity' as lens, 0.8::double as confidence, 'support' as signal from p where p_size <= 20
  union all select p_partkey::varchar, 'mutation', ret, 'support' from p where ret >= 0.3
  union all select p_partkey::varchar, 'specification', 1 - level, 'support' from p where p_type in ('ECONOMY', 'STANDARD') and level < 0.5
  union all select p_partkey::varchar, 'specification', level, 'oppose' from p where level >= 0.7
  union all select p_partkey::varchar, 'composition_gap', least((n - 30) / 5.0::double, 1.0), 'support' from p where n > 30
  union all select p_partkey::varchar, 'cohesion', greatest(1 - sup / n::double, 0.1), 'support' from p where sup / n::double < 0.5 or p_size % 3 > 1
  union all select p_partkey::varchar, 'fan_in', least((n - 30) / 10.0::double, 1.0), 'oppose' from p where n - 30 >= 5
  union all select p_partkey::varchar, 'fan_in', 0.4, 'support' from p where n - 30 <= 0
  union all select p_partkey::varchar, 'dep_clustering', 0.5, 'support' from p where p_retailprice > 950
  union all select p_partkey::varchar, 'assertion_quality', greatest(1 - (1 - ret), 0.1), 'support' from p where 1 - ret < 0.8 or ret > 0.4 or (ret is not null and p_size % 2 > 0)
  union all select p_partkey::varchar, 'algebraic', 0.6, 'support' from p where p_partkey % 3 = 0 and p_size % 5 > 0
  union all select p_partkey::varchar, 'algebraic', 0.5, 'oppose' from p where p_partkey % 3 = 1
  union all select p_partkey::varchar, 'import_tracing', 0.6, 'oppose' from p where p_name like '%ring%'
  union all select p_partkey::varchar, 'import_tracing', 0.4, 'support' from p where p_name not like '%ring%' and p_size % 5 <= 2 and p_partkey % 7 <= 3
  union all select p_partkey::varchar, 'call_graph', least(sup / 16.0::double, 1.0), 'support' from p where sup >= 8
  union all select p_partkey::varchar, 'contract_coverage', 0.5, 'support' from p where firsts > 0 and lasts = 0
  union all select p_partkey::varchar, 'cross_channel', 0.5, 'support' from p where p_brand like '%1'
  union all select a || '<->' || b, 'cochange', c / firsts::double, 'oppose' from f join p on a = p_partkey where c / firsts::double >= 0.4
  union all select a || '<->' || b, 'cochange', greatest(1 - c / firsts::double, 0.1), 'support' from f join p on a = p_partkey where c / firsts::double < 0.4)"""


@query("q178_lens_fusion", f"""with {_PARTS}, {_FUSED.replace("{c}", "confidence")}
select target, round(net, 4) as net, lenses, case when net >= 0.75 and lenses >= 3 then 'EXTRACT' when net >= 0.5 and lenses >= 2 then 'SPLIT' else 'INVESTIGATE' end as verdict from u""")
def q178(spark, sf):
    """Wide metrics of parts, and of pairs that open an order, turned into rows
    of evidence by fourteen lenses, and fused into a verdict per target."""
    li = table(spark, sf, "lineitem")
    n = lambda cond, c: F.count_if(F.col(cond[0]) == cond[1]).alias(c)
    by_supplier = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), n(("l_returnflag", "R"), "ret"), n(("l_linenumber", 1), "firsts"), n(("l_linenumber", 7), "lasts"))
    by_part = by_supplier.groupBy(F.col("l_partkey").alias("p_partkey")).agg(*[F.sum(c).alias(c) for c in ("n", "ret", "firsts", "lasts")], F.count("*").alias("sup"))
    p = Scratch(spark).save(table(spark, sf, "part").join(by_part, "p_partkey", "left"))
    c, key = F.col, F.col("p_partkey")
    share = c("ret") / c("n")
    lenses = [
        L.purity(c("p_size") <= 20),
        L.mutation(share),
        L.specification((key % 10) / 10.0, F.when(c("p_type").isin("ECONOMY", "STANDARD"), "B").otherwise("A")),
        L.composition_gap(c("n") - 30),
        L.cohesion(c("sup") / c("n"), c("p_size") % 3),
        L.fan_in(c("n") - 30),
        L.dep_clustering(c("p_retailprice") > 950),
        L.assertion_quality(1 - share, F.when(share > 0.4, 1).when(share.isNotNull(), c("p_size") % 2)),
        L.algebraic(F.when(key % 3 == 0, "safe").when(key % 3 == 1, "unsafe").otherwise("unknown"), c("p_size") % 5),
        L.import_tracing(c("p_name").contains("ring"), c("p_size") % 5, key % 7),
        L.call_graph(c("sup")),
        L.contract_coverage(c("firsts") > 0, c("lasts") > 0),
        L.cross_channel(c("p_brand").endswith("1")),
    ]
    e = L.evidence(p, key.cast("string"), lenses)
    a = li.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("a"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("b"))
    pairs = a.join(b, "l_orderkey").groupBy("a", "b").agg(F.count("*").alias("c")).join(p.select(key.alias("a"), "firsts"), "a")
    e = e.union(L.evidence(pairs, F.concat_ws("<->", "a", "b"), [L.cochange(c("c") / c("firsts"))]))
    g = L.fuse(e)
    verdict = F.when((F.col("net") >= 0.75) & (F.col("lenses") >= 3), "EXTRACT").when((F.col("net") >= 0.5) & (F.col("lenses") >= 2), "SPLIT").otherwise("INVESTIGATE")
    return g.select("target", F.round("net", 4).alias("net"), "lenses", verdict.alias("verdict"))


_FILES = """f as (select p_brand || '/' || p_type as target, count(*) as m, count(distinct p_name) as names, count(*) filter (p_size > 30) as big from part group by 1),
e as (select target, 'cohesion' as lens, greatest(1 - names / m::double, 0.1) as confidence, 'support' as signal from f where names / m::double < 0.5 or big % 4 > 1
  union all select target, 'fan_in', least(m % 12 / 10.0::double, 1.0), 'oppose' from f where m % 12 >= 5
  union all select target, 'fan_in', 0.4, 'support' from f where m % 12 <= 1
  union all select target, 'cochange', big / m::double, 'oppose' from f where big / m::double >= 0.4
  union all select target, 'cochange', greatest(1 - big / m::double, 0.1), 'support' from f where big / m::double < 0.4
  union all select target, 'import_tracing', 0.6, 'oppose' from f where names % 5 = 0
  union all select target, 'import_tracing', 0.4, 'support' from f where names % 5 <> 0 and m % 4 <= 2 and big % 5 <= 3)"""
_WEIGHTED = "least(confidence * case lens when 'cohesion' then 2.0::double when 'fan_in' then 1.5::double else 1.0::double end, 1.0)"


@query("q178_file_lenses", f"""with {_FILES}, {_FUSED.replace("{c}", _WEIGHTED)}
select target, round(net, 4) as net, lenses, case when names / m::double < 0.3 and big % 4 >= 3 and net >= 0.5 and lenses >= 2 then 'SPLIT' when net >= 0.75 and lenses >= 3 then 'SPLIT' else 'INVESTIGATE' end as verdict from u join f using (target)""")
def q178_files(spark, sf):
    """The four lenses on files, weighted, and whether a file is to be split."""
    p = table(spark, sf, "part").withColumn("target", F.concat_ws("/", "p_brand", "p_type"))
    names = p.groupBy("target", "p_name").agg(F.count("*").alias("m"), F.count_if(F.col("p_size") > 30).alias("big"))
    f = names.groupBy("target").agg(F.sum("m").alias("m"), F.count("*").alias("names"), F.sum("big").alias("big"))
    m, big, n = F.col("m"), F.col("big"), F.col("names")
    e = L.evidence(f, F.col("target"), [L.cohesion(n / m, big % 4), L.fan_in(m % 12, few=1), L.cochange(big / m), L.import_tracing(n % 5 == 0, m % 4, big % 5)])
    u = L.fuse(e, L.FILE_WEIGHTS).join(f, "target")
    return u.select("target", F.round("net", 4).alias("net"), "lenses", L.file_verdict(F.col("net"), F.col("lenses"), n / m, big % 4).alias("verdict"))
