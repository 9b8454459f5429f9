"""Graph, text and diagnosis queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.functions import claims as CL
from qualitylens.functions import commands as C
from qualitylens.functions.scalar import noisy_or
from qualitylens.operators import graph as G
from qualitylens.operators import relational as R
from qualitylens.operators.freshness import staleness
from qualitylens.operators.patterns import pattern_hits
from qualitylens.plans.adapters import EDGES, FINDINGS, FIRST, HIERARCHY, PARTS, edges, findings, first_edges, hierarchy, kills, part_edges
from qualitylens.plans.registry import query
from qualitylens.session import Scratch, table


@query("q129_components", """with recursive l as (select distinct doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(line) >= 60),
e as (select distinct a.doc_id as a, b.doc_id as b from l a join (select line, min(doc_id) as doc_id from l group by line) b on a.line = b.line where a.doc_id <> b.doc_id),
u as (select a, b from e union select b, a from e), r as (select a as node, a as root from u union select u.b, r.root from r join u on u.a = r.node where r.root < u.b)
select d.doc_id, coalesce(c.root, d.doc_id) as component from documents d left join (select node, min(root) as root from r group by node) c on d.doc_id = c.node""")
def q129(spark, sf):
    """Documents joined by long lines that they share, directly or through
    others: a star per line rather than all pairs, then connected components."""
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 60)
    lines = lines.select("doc_id", F.md5("line").alias("line")).distinct()
    links = lines.join(lines.groupBy("line").agg(F.min("doc_id").alias("b")), "line").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    found = G.components(links).select(F.col("node").alias("doc_id"), "root")
    return d.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component"))


@query("q130_cycles", f"""with recursive {FIRST}, p as (select src as first, dst as last, [src, dst] as path from g where src < dst
union all select first, dst, list_append(path, dst) from p join g on src = last where dst > first and not list_contains(path, dst) and len(path) < 5)
select len(path) as nodes, array_to_string(path, '-') as path from p join g on src = last and dst = first""")
def q130(spark, sf):
    """All simple cycles of up to five nodes, each from its least node."""
    c = G.cycles(first_edges(spark, sf), 5)
    return c.select(F.size("path").cast("long").alias("nodes"), F.array_join("path", "-").alias("path"))


@query("q131_direct_imports", f"with {EDGES} select src, count(*) as imports, count(*) filter (n_regionkey = 0) as outside from g join nation on dst = n_nationkey group by src")
def q131(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    return edges(spark, sf).join(n, "dst").groupBy("src").agg(F.count("*").alias("imports"), F.count_if(F.col("n_regionkey") == 0).alias("outside"))


@query("q132_impurity_propagation", f"""with recursive {PARTS}, r as (select cast(3 as bigint) as node union select g.src from r join g on g.dst = r.node) select node from r""")
def q132(spark, sf):
    """All that reaches an impure node, until nothing is new."""
    back = part_edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reachable(back, spark.createDataFrame([(3,)], "node long")).select("node")


_TIERS = f"""{HIERARCHY}, p as (select distinct src as node, 0 as tier from g where src not in (select dst from g) union select g.dst, tier + 1 from p join g on g.src = p.node),
t as (select node, max(tier) as tier from p group by node)"""


@query("q133_dependency_tiers", f"with recursive {_TIERS} select node, tier from t")
def q133(spark, sf):
    """Longest-path layers of an acyclic graph."""
    return G.layers(hierarchy(spark, sf))


@query("q134_topological_order", f"""with recursive {_TIERS}, u as (select src, count(*) as unlocks from g group by 1)
select row_number() over (order by tier, coalesce(unlocks, 0) desc, node) as pos, node from t left join u on node = src""")
def q134(spark, sf):
    """An order that respects dependencies, what unlocks most first within a tier."""
    g = Scratch(spark).save(hierarchy(spark, sf))
    u = g.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("unlocks"))
    t = G.layers(g).join(u, "node", "left").select("node", "tier", (-F.coalesce("unlocks", F.lit(0))).alias("less"), F.substring("node", 1, 4).alias("part"))
    return R.running(t, ["tier", "less", "part"], ["node"], pos=F.lit(1)).select((F.col("pos") + 1).alias("pos"), "node")


@query("q135_greedy_set_cover")
def q135(spark, sf):
    """Greedy cover of parts by suppliers, ranked anew at each step."""
    return G.set_cover(kills(spark, sf))


@query("q137_closure", f"""with recursive {HIERARCHY}, c as (select src, dst from g union select c.src, g.dst from c join g on c.dst = g.src) select src, dst from c""")
def q137(spark, sf):
    """Transitive closure."""
    return G.closure(hierarchy(spark, sf))


@query("q139_prefix_packages", f"""with {FIRST}, f as (select p_partkey as module, p_brand as dir, string_split(p_name, ' ')[1] as prefix, p_size = 1 and p_type = 'PROMO' as is_package from part where contains(p_name, ' ')),
i as (select a.dir, a.prefix, count(*) as edges from g join f a on a.module = g.src join f b on b.module = g.dst and b.dir = a.dir and b.prefix = a.prefix group by all)
select dir, prefix, count(*) as files, max(edges) as edges from f join i using (dir, prefix) group by all having count(*) >= 3 and not bool_or(is_package)""")
def q139(spark, sf):
    """Files of a folder that share the name before the first separator: three or
    more, with imports among them, and no package of that name yet."""
    prefix = F.substring_index("p_name", " ", 1)
    f = table(spark, sf, "part").where(F.col("p_name").contains(" ")).select(F.col("p_partkey").alias("module"), F.col("p_brand").alias("dir"), prefix.alias("prefix"), F.expr("p_size = 1 and p_type = 'PROMO'").alias("is_package"))
    side = lambda end: f.select(F.col("module").alias(end), F.struct("dir", "prefix").alias(f"{end}_group"))
    inner = first_edges(spark, sf).join(side("src"), "src").join(side("dst"), "dst").where("src_group = dst_group")
    inner = inner.groupBy("src_group").agg(F.count("*").alias("edges")).select("src_group.*", "edges")
    groups = f.groupBy("dir", "prefix").agg(F.count("*").alias("files"), F.bool_or("is_package").alias("is_package")).where("files >= 3 and not is_package")
    return groups.join(inner, ["dir", "prefix"]).select("dir", "prefix", "files", "edges")


@query("q140_pattern_mining", """with c as (select item_id as pattern, unnest(list_distinct(list_filter(string_split(text, ' ')[1:6], lambda x: length(x) >= 4))) as call from benchmark),
s as (select item_id as pattern, unnest(list_distinct(list_filter(string_split(text, ' ')[7:12], lambda x: length(x) >= 3))) as structure from benchmark),
nc as (select doc_id, pattern, count(*) as calls from documents join c on contains(text, call) group by all), ns as (select distinct doc_id, pattern from documents join s on contains(text, structure))
select pattern, count(*) as n, count(distinct source) as files from nc join ns using (doc_id, pattern) join documents using (doc_id) where calls >= 2 group by 1 having count(*) >= 3 and count(distinct source) >= 2""")
def q140(spark, sf):
    """Patterns of a catalogue found often enough in files enough: a text has a
    pattern with two of its required calls and any of its structures. All
    patterns are looked for in one pass over the texts."""
    b = table(spark, sf, "benchmark")
    some = lambda at, n, role: b.select(F.col("item_id").alias("pattern"), F.lit(role).alias("role"), F.explode(F.array_distinct(F.filter(F.slice(F.split("text", " "), at, 6), lambda x: F.length(x) >= n))).alias("literal"))
    catalogue = some(1, 4, "call").union(some(7, 3, "structure"))
    hits = pattern_hits(table(spark, sf, "documents").select("doc_id", "source", "text"), "text", catalogue, "literal")
    found = hits.select("doc_id", "source", F.explode("hits.pattern").alias("literal")).join(catalogue, "literal")
    role = lambda r: F.count_if(F.col("role") == r)
    have = found.groupBy("doc_id", "source", "pattern").agg(role("call").alias("calls"), role("structure").alias("structures")).where("calls >= 2 and structures >= 1")
    return have.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("source").alias("files")).where("n >= 3 and files >= 2")


#: Fixed value: the least cosine of a match.
_CUT = 0.15
#: Meetings of a text's and a query's term that a task weighs, so that its table of pairs stays some 100 MB.
_MEETINGS = 1_000_000
_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))"


def _parts(rows: int | None, each: int) -> int:
    """Parts of at most ``each`` rows on average, one at least."""
    return max(1, -(-(rows or 0) // each))


@query("q141_tfidf_cosine", f"""with b as (select item_id, unnest({_WORDS}) as t, len({_WORDS}) as n from benchmark), d as (select doc_id, unnest({_WORDS}) as t, len({_WORDS}) as n from documents),
df as (select t, count(*) as df from d group by t), m as (select count(*) as m from documents),
w as (select d.doc_id, d.t, (ln((m + 1.0) / (df + 1)) + 1) / n as w from d join df using (t), m), q as (select item_id, b.t, (ln((m + 1.0) / (coalesce(df, 0) + 1)) + 1) / n as w from b left join df using (t), m),
wn as (select doc_id, sqrt(sum(w * w)) as s from w group by 1), qn as (select item_id, sqrt(sum(w * w)) as s from q group by 1),
c as (select item_id, doc_id, sum(q.w * w.w) as dot from q join w using (t) group by all), z as (select item_id, doc_id, round(dot / (qn.s * wn.s), 4) as cosine from c join qn using (item_id) join wn using (doc_id)),
r as (select *, row_number() over (partition by item_id order by cosine desc, doc_id) as rn from z where cosine >= 0.15) select item_id, doc_id, cosine from r where rn <= 5""")
def q141(spark, sf):
    """The most similar texts of each query, at a cosine of ``_CUT`` or more.

    A vector's scale cancels, so a weight is a term's rarity alone, one or more.
    Texts are dealt by id into as many parts as keep the meetings of a text's and
    a query's term in a part near ``_MEETINGS``, and each part weighs its texts
    against all queries at once. A text's norm is at least the root of its number
    of terms; pairs that even so are below the cut are dropped before norms are
    taken. The documents are read once."""
    scratch = Scratch(spark)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("ws")
    d = scratch.save(table(spark, sf, "documents").select("doc_id", words))
    m = d.count()
    rarity = F.log((m + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    df = scratch.save(d.select(F.explode("ws").alias("t")).groupBy("t").agg(F.count("*").alias("df")))
    q = table(spark, sf, "benchmark").select("item_id", words).select("item_id", F.explode("ws").alias("t")).join(df, "t", "left").select("item_id", "t", "df", rarity.alias("x"))
    q = scratch.save(q)
    norms = q.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    parts = _parts(q.agg(F.sum("df")).first()[0], _MEETINGS)
    dots = d.repartition(parts, "doc_id").select("doc_id", F.size("ws").alias("n"), F.explode("ws").alias("t")).join(q.select("item_id", "t", "x"), "t")
    dots = dots.groupBy("doc_id", "item_id").agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("dot"))
    # cosines are rounded to four places
    met = scratch.save(dots.join(norms, "item_id").where(F.col("dot") / F.sqrt("n") >= F.col("norm") * (_CUT - 1e-4)).select("item_id", "doc_id", "norm", "dot"))
    some = d.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("ws").alias("t")).join(df, "t").select("doc_id", rarity.alias("x"))
    z = met.join(some.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s")), "doc_id")
    z = z.select("item_id", "doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("s")), 4).alias("cosine")).where(F.col("cosine") >= _CUT)
    r = z.withColumn("rn", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("cosine"), "doc_id")))
    return r.where("rn <= 5").select("item_id", "doc_id", "cosine")


#: What an error output adds after a document's text, by its id.
_TAILS = "case doc_id % 6 when 0 then '' when 1 then '{n}========{n}exit code: 1{n}' when 2 then '{n}2026-02-22T10:30:00.123 FATAL: crash {n}  {n}' when 3 then '{n}[12:34] Error in /home/u/proj/src/é_module.py:  bad{n}--- ###{n}Exit_Status=2' when 4 then '{n}status 7{n}exit status of all' else '{n}Done at /tmp/a/b.c and /x/y' end"
_BLANK = r"[\s\x1c-\x1f\x{0085}\p{Z}]+"


@query("q143_error_signature", rf"""with e as (select doc_id, coalesce(text, '') || {_TAILS.replace("{n}", "' || chr(10) || '")} as err from documents),
l as (select doc_id, list_filter(list_transform(string_split_regex(err, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{0085}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_BLANK}|{_BLANK}$', '', 'g')),
  lambda x: not regexp_matches(x, '^[-=_*#]*$') and not regexp_matches(x, '{C.STATUS}'))[-1] as line from e),
s as (select doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(line, ''), '{C.PATH}', '\1', 'g'), '{C.TIME}', '', 'g'), '{C.MARK}', '', 'g')[1:200] as sig from l),
k as (select doc_id, sig, trim(regexp_replace(lower(sig), '{_BLANK}', ' ', 'g')) as plain from s)
select doc_id, length(sig) as n, case when plain = '' then '' else substr(sha256(plain), 1, 16) end as key from k""")
def q143(spark, sf):
    """Key of the last line that says something, without folders and times."""
    err = F.concat(F.coalesce("text", F.lit("")), F.expr(_TAILS.replace("{n}", r"\n")))
    d = table(spark, sf, "documents").select("doc_id", C.error_signature(err).alias("sig"))
    return d.select("doc_id", F.length("sig").cast("long").alias("n"), C.error_key(F.col("sig")).alias("key"))


_TYPES = """c as (select lower(p_name || ' ' || p_type) as s, count(*) as n from part group by 1),
t as (select s, n, unnest(list_distinct(list_filter(string_split(s, ' '), lambda x: len(x) >= 3 and x not in ('the', 'and', 'plated')))) as t from c)"""


@query("q144_token_overlap", f"""with {_TYPES}, m as (select a.s as a, b.s as b, a.n as na, b.n as nb, count(*) as shared from t a join t b on a.t = b.t and a.s < b.s group by all)
select a, b, na, nb, shared from m where shared >= 2 or (length(a) >= 12 and contains(b, a)) or (length(b) >= 12 and contains(a, b))
union all select s, s, n, n, 0 from c where n > 1 and length(s) >= 7""")
def q144(spark, sf):
    """Texts that match: equal ones, one row per text with its copies, and pairs of
    different texts that share two tokens, stop words aside, or hold one another."""
    c = table(spark, sf, "part").groupBy(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("s")).agg(F.count("*").alias("n"))
    plain = lambda x: (F.length(x) >= 3) & ~x.isin("the", "and", "plated")
    t = c.select("s", "n", F.explode(F.array_distinct(F.filter(F.split("s", " "), plain))).alias("t"))
    a, b = t.select(F.col("s").alias("a"), F.col("n").alias("na"), "t"), t.select(F.col("s").alias("b"), F.col("n").alias("nb"), "t")
    m = a.join(b, "t").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    m = m.where("shared >= 2 or (length(a) >= 12 and contains(b, a)) or (length(b) >= 12 and contains(a, b))").select("a", "b", "na", "nb", "shared")
    return m.union(c.where("n > 1 and length(s) >= 7").select("s", "s", "n", "n", F.lit(0).cast("long")))


#: What a note adds after a document's text, by its id: paragraphs of prose, a table, a checklist.
_NOTES = """case doc_id % 7 when 0 then '' when 1 then '{n}{n}The key principle is called **late binding**. It enables reuse because we define it once.{n}Then next steps follow.'
  when 2 then '{n} {n}| because | a table |{n}| hence | no claim |{n}{n}- [ ] therefore a checklist' when 3 then '{n}{n}Why not a monolith? Batch work over streams was chosen. This would break the workflow! Premature tuning can fail'
  when 4 then '{n}{n}  The goal is clear: a correct order. out of scope. Our channel provides analysis, unlike a linter.' when 5 then '{n}{n}**Rationale** modular parts{n}are easier to test than large ones. **Lesson** the fix was a retry.' else ' Since {n}then. Thus' end"""
_CLAIM_BLANK = CL.BLANK.replace("\\x0B", "\\v")
_CLAIM_SCORES = ", ".join(
    f"{{'facet': '{f}', 'score': " + " + ".join(f"case when regexp_matches(s, '{p}') then {w} else 0 end" for of, w, p in CL.RULES if of in (None, f)) + "}" for f in CL.FACETS
)


@query("q145_claim_scoring", rf"""with t as (select doc_id, coalesce(text, '') || {_NOTES.replace("{n}", "' || chr(10) || '")} as text from documents),
j as (select doc_id, regexp_replace(regexp_replace(text, '([^\n]|^)\n([^\n]|$)', '\1 \2', 'g'), '([^\n]|^)\n([^\n]|$)', '\1 \2', 'g') as text from t),
p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\n{_CLAIM_BLANK}*\n'), lambda x: regexp_replace(x, '^{_CLAIM_BLANK}+|{_CLAIM_BLANK}+$', '', 'g')), lambda x: x <> '' and x[1] <> '|' and x[1:3] <> '- [') as ps from j),
l as (select doc_id, flatten(list_transform(ps, lambda x: string_split(regexp_replace(x, '([.!?]){_CLAIM_BLANK}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))) as ss from p),
s as (select doc_id, generate_subscripts(ss, 1) as k, unnest(ss) as s from l),
c as (select doc_id, k, s, unnest([{_CLAIM_SCORES}], recursive := true) from s)
select doc_id, facet, count(*) as claims, max(score)::int as score, first(s order by score desc, k) as claim from c where score >= 1 group by 1, 2""")
def q145(spark, sf):
    """The likely claims of each document and facet, and the strongest, the first of equals."""
    text = F.concat(F.coalesce("text", F.lit("")), F.expr(_NOTES.replace("{n}", r"\n")))
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(CL.sentences(text)).alias("k", "s")).where(CL.may_claim(F.col("s")))
    c = s.select("doc_id", "k", "s", F.explode(CL.claim_scores(F.col("s"))).alias("c")).where("c.score >= 1")
    best = F.max(F.struct("c.score", -F.col("k"), "s")).alias("best")
    g = c.groupBy("doc_id", F.col("c.facet").alias("facet")).agg(F.count("*").alias("claims"), best)
    return g.select("doc_id", "facet", "claims", "best.score", F.col("best.s").alias("claim"))


#: A document's text when its stored state was made, by its id.
_BEFORE = "case when doc_id % 7 = 0 then regexp_replace(text, '^[^{n}]*{n}', '') when doc_id % 11 = 0 then concat(text, {br}, text) when doc_id % 5 = 0 then replace(text, 'th', 'ht') else text end"


@query("q150_content_freshness", rf"""with d as (select doc_id, string_split(text, chr(10)) as now, string_split(case when text is not null then {_BEFORE.replace("{n}", chr(92) + "n").replace("{br}", "chr(10)")} end, chr(10)) as old, doc_id % 10 <> 0 as known from documents),
a as (select doc_id, k, sha256(array_to_string(now[4 * k + 1 : 4 * k + 4], chr(10))) as h from (select doc_id, now, unnest(range((len(now) + 3) // 4)) as k from d where known)),
b as (select doc_id, k, sha256(array_to_string(old[4 * k + 1 : 4 * k + 4], chr(10))) as h from (select doc_id, old, unnest(range((len(old) + 3) // 4)) as k from d where known)),
j as (select coalesce(a.doc_id, b.doc_id) as doc_id, 's' || coalesce(a.k, b.k) as key, a.h as x, b.h as y from a full join b on a.doc_id = b.doc_id and a.k = b.k),
g as (select doc_id, count(*) filter (y is null) as new, count(*) filter (x is null) as removed, string_agg(key, ',' order by key) filter (x <> y) as changed from j group by 1),
o as (select d.doc_id, not known as unknown, known and d.doc_id % 13 = 0 as version_changed, known and d.doc_id % 17 = 0 as manifest_changed, coalesce(new, 0) as n_new, coalesce(removed, 0) as n_removed, coalesce(changed, '') as changed from d left join g on d.doc_id = g.doc_id)
select *, unknown or version_changed or manifest_changed or n_new > 0 or n_removed > 0 or changed <> '' as stale from o""")
def q150(spark, sf):
    """Pages, in sections of four lines, against the states stored for them:
    sections new, gone and changed, another version or manifest entry, no state."""
    d = table(spark, sf, "documents")
    lines = lambda t: F.split(t, "\n")
    part = lambda t, k: F.struct(F.concat(F.lit("s"), k.cast("string")), F.sha2(F.array_join(F.slice(lines(t), 4 * k + 1, 4), "\n"), 256))
    sections = lambda t: F.map_from_entries(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines(t)) + 3) / 4).cast("int") - 1), lambda k: part(t, k)))
    state = lambda t, manifest, version: [F.when(t.isNotNull(), sections(t)).alias("sections"), F.md5(manifest).alias("manifest"), version.alias("version")]
    source = F.concat_ws("|", "lang", "source")
    old = d.where("doc_id % 10 <> 0").withColumn("before", F.expr(_BEFORE.replace("{n}", r"\n").replace("{br}", r"'\n'")))
    old = old.select("doc_id", *state(F.col("before"), F.when(F.col("doc_id") % 17 == 0, F.concat(source, F.lit("|"))).otherwise(source), F.when(F.col("doc_id") % 13 == 0, 1).otherwise(2)))
    out = staleness(d.select("doc_id", *state(F.col("text"), source, F.lit(2))), old, "doc_id")
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return out.select("doc_id", "unknown", "version_changed", "manifest_changed", n("new"), n("removed"), F.array_join("changed", ",").alias("changed"), "stale")


@query("q151_link_integrity", r"""with m as (select distinct split_part(text, ' ', 1) as name from documents), k as (select lower(name) as t from m union select 'home'),
p as (select regexp_extract(html, '<title>([^ <]+)', 1) as page, regexp_extract_all(html, 'href="/([^"]+)"', 1) as links from pages), l as (select page, unnest(links) as target from p)
select 'broken' as kind, page, target, count(*) as n from l where lower(target) not in (select t from k where t is not null) group by all
union all select 'orphan', page, null, count(*) from p where page <> '' and lower(page) not in (select t from k where t is not null) group by page
union all select 'missing', null, name, 1 from m where lower(name) <> 'home' and lower(name) not in (select lower(page) from p where page is not null)""")
def q151(spark, sf):
    """Links to what the manifest (the documents' first words) does not name, pages
    that it does not name, and names without a page; case does not count."""
    title = F.regexp_extract("html", "<title>([^ <]+)", 1)
    p = table(spark, sf, "pages").select(title.alias("page"), F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1).alias("links"))
    m = table(spark, sf, "documents").select(F.substring_index("text", " ", 1).alias("name")).where("name is not null").distinct()
    low = lambda df, c: df.withColumn("t", F.lower(c))
    known = low(m, "name").select("t").union(spark.range(1).select(F.lit("home").alias("t")))
    broken = low(p.select("page", F.explode("links").alias("target")), "target").join(known, "t", "left_anti")
    orphan = low(p.where("page <> ''"), "page").join(known, "t", "left_anti")
    missing = low(m, "name").where("t <> 'home'").join(low(p, "page").select("t"), "t", "left_anti")
    none = F.lit(None).cast("string")
    out = broken.groupBy("page", "target").agg(F.count("*").alias("n")).select(F.lit("broken").alias("kind"), "page", "target", "n")
    out = out.union(orphan.groupBy("page").agg(F.count("*").alias("n")).select(F.lit("orphan"), "page", none, "n"))
    return out.union(missing.select(F.lit("missing"), none, "name", F.lit(1).cast("long")))


@query("q008_markdown_sections", r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as k, unnest(string_split(text, chr(10))) as line from documents),
h as (select *, case when len(string_split(line, ' ')) <= 2 then line end as head from l), s as (select *, count(head) over (partition by doc_id order by k) as section from h)
select doc_id, section, count(*) filter (head is null) as lines, max(head) as heading from s group by all having count(*) filter (head is null) > 0""")
def q008(spark, sf):
    """Lines under their last heading (a line of at most two words); empty sections drop out."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    lines = lines.withColumn("head", F.when(F.size(F.split("line", " ")) <= 2, F.col("line")))
    s = lines.withColumn("section", F.count("head").over(W.partitionBy("doc_id").orderBy("k")))
    return s.groupBy("doc_id", "section").agg(F.count_if(F.col("head").isNull()).alias("lines"), F.max("head").alias("heading")).where("lines > 0")


_COHERENCE = f"""with {FINDINGS}, c as (select run, channel, count(*) filter (severity <> 'informational') as n, count(distinct file) filter (severity <> 'informational') as files, case when avg(value) > 52 then 1 else 0 end as fail from f group by all),
r as (select run, cast(sum(fail) as bigint) as failing, count(*) as channels, cast(coalesce(sum(n) filter (fail = 1), 0) as bigint) as loud_findings from c group by run),
s as (select *, case when channels < 5 then 'degraded' when failing = 0 then 'stable' when failing = 1 then 'isolated' when failing >= 3 then 'systemic' else 'coupled' end as state from r)
select run, state, failing, loud_findings, cast(round(case state when 'degraded' then 0.3 when 'stable' then 1.0 when 'isolated' then 0.8 when 'systemic' then least(1.0, 0.5 + 0.1 * failing) else 0.6 end, 4) as double) as confidence,
  state <> lag(state, 1, state) over (order by run) as changed from s"""


@query("q170_coherence_state", _COHERENCE)
def q170(spark, sf):
    """The state of each run: degraded before stable, isolated, systemic and coupled."""
    f = findings(spark, sf)
    actionable = F.col("severity") != "informational"
    c = f.groupBy("run", "channel").agg(F.count_if(actionable).alias("n"), F.when(F.avg("value") > 52, 1).otherwise(0).alias("fail"))
    r = c.groupBy("run").agg(F.sum("fail").alias("failing"), F.count("*").alias("channels"), F.coalesce(F.sum(F.when(F.col("fail") == 1, F.col("n"))), F.lit(0)).alias("loud_findings"))
    n = F.col("failing")
    state = F.when(F.col("channels") < 5, "degraded").when(n == 0, "stable").when(n == 1, "isolated").when(n >= 3, "systemic").otherwise("coupled")
    s = F.col("state")
    sure = F.when(s == "degraded", 0.3).when(s == "stable", 1.0).when(s == "isolated", 0.8).when(s == "systemic", F.least(F.lit(1.0), 0.5 + 0.1 * n)).otherwise(0.6)
    r = r.withColumn("state", state)
    return r.select("run", "state", "failing", "loud_findings", F.round(sure, 4).alias("confidence"), (s != F.lag("state").over(W.orderBy("run"))).alias("changed")).na.fill(False, ["changed"])


@query("q171_edit_scope_overlay", f"""with {FINDINGS}, e as (select distinct run, file from f where channel = 'purchase'), j as (select f.run, f.channel, count(e.file) as related from f left join e on f.run = e.run and f.file = e.file where f.channel = 'error' group by all)
select run, channel, case when related = 0 then 'stable' when related < 5 then 'isolated' else 'kept' end as overlay from j""")
def q171(spark, sf):
    """Failures all outside what was edited are played down."""
    f = findings(spark, sf)
    e = f.where("channel = 'purchase'").select("run", "file").distinct().withColumn("hit", F.lit(1))
    j = f.where("channel = 'error'").join(e, ["run", "file"], "left").groupBy("run", "channel").agg(F.count("hit").alias("related"))
    return j.select("run", "channel", F.when(F.col("related") == 0, "stable").when(F.col("related") < 5, "isolated").otherwise("kept").alias("overlay"))


@query("q173_decomposition_verdict", """with l as (select p_partkey, case when p_size > 25 then least(0.5 + 0.01 * p_size, 0.8) else 0.0 end as a, case when p_retailprice > 1200 then 0.6 when p_size > 40 then 0.5 else 0.0 end as b, case when p_brand like '%1' then 0.55 else 0.0 end as c from part),
v as (select p_partkey, (a > 0)::int + (b > 0)::int + (c > 0)::int as lenses, 1 - (1 - a) * (1 - b) * (1 - c) as s from l)
select p_partkey, lenses, cast(round(s, 4) as double) as support, case when lenses >= 2 and s >= 0.7 then 'EXTRACT_BOUNDARY' when lenses = 0 then 'INSUFFICIENT_EVIDENCE' else 'KEEP_TESTING' end as verdict from v""")
def q173(spark, sf):
    s = F.col("p_size")
    a = F.when(s > 25, F.least(0.5 + 0.01 * s, F.lit(0.8))).otherwise(0.0)
    b = F.when(F.col("p_retailprice") > 1200, 0.6).when(s > 40, 0.5).otherwise(0.0)
    c = F.when(F.col("p_brand").endswith("1"), 0.55).otherwise(0.0)
    v = table(spark, sf, "part").select("p_partkey", F.array(a, b, c).alias("l"))
    v = v.select("p_partkey", F.size(F.filter("l", lambda x: x > 0)).alias("lenses"), noisy_or(F.col("l")).alias("s"))
    verdict = F.when((F.col("lenses") >= 2) & (F.col("s") >= 0.7), "EXTRACT_BOUNDARY").when(F.col("lenses") == 0, "INSUFFICIENT_EVIDENCE").otherwise("KEEP_TESTING")
    return v.select("p_partkey", "lenses", F.round("s", 4).alias("support"), verdict.alias("verdict"))


@query("q174_constraint_proposals", f"""with {FINDINGS}, s as (select run, row_number() over (order by run desc) as back from (select distinct run from f)), g as (select channel, file, count(distinct run) as recent from f join s using (run) where back <= 5 group by all)
select channel, file, recent, round(recent / 5.0, 2) as confidence from g where recent >= 3 and channel <> 'view'""")
def q174(spark, sf):
    """What recurs in the last five runs and is not a rule yet."""
    f = findings(spark, sf)
    s = f.select("run").distinct().withColumn("back", F.row_number().over(W.orderBy(F.desc("run")))).where("back <= 5")
    g = f.join(F.broadcast(s), "run").groupBy("channel", "file").agg(F.countDistinct("run").alias("recent"))
    return g.where("recent >= 3 and channel <> 'view'").withColumn("confidence", F.round(F.col("recent") / 5.0, 2))


@query("q175_test_rebuild", """select p_partkey, case when p_size < 3 then 'exclude' when p_retailprice > 1500 then 'preserve' when p_size > 40 then 'decompose' when p_brand like '%2' then 'auto' when p_type like '%BRASS' then 'integration' else 'manual' end as plan from part""")
def q175(spark, sf):
    plan = F.coalesce(
        F.when(F.col("p_size") < 3, "exclude"), F.when(F.col("p_retailprice") > 1500, "preserve"), F.when(F.col("p_size") > 40, "decompose"),
        F.when(F.col("p_brand").endswith("2"), "auto"), F.when(F.col("p_type").endswith("BRASS"), "integration"), F.lit("manual"),
    )
    return table(spark, sf, "part").select("p_partkey", plan.alias("plan"))


@query("q176_optimisation_gate", """with h as (select p_partkey, p_size / 50.0 as level, unnest(string_split(p_type, ' ')) as hint from part), t as (select * from (values ('STEEL', 0.6), ('BRASS', 0.4), ('SMALL', 0.2)) x(hint, need))
select p_partkey, coalesce(max(need), 0.0)::double as required, round(greatest(max(coalesce(need, 0.0)::double - level), 0.0), 4) as delta, coalesce(max(need), 0.0) <= any_value(level) as passed from h left join t using (hint) group by 1""")
def q176(spark, sf):
    """Hints with their thresholds against the level reached."""
    t = spark.createDataFrame([("STEEL", 0.6), ("BRASS", 0.4), ("SMALL", 0.2)], "hint string, need double")
    h = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("level"), F.explode(F.split("p_type", " ")).alias("hint")).join(F.broadcast(t), "hint", "left")
    g = h.groupBy("p_partkey").agg(F.coalesce(F.max("need"), F.lit(0.0)).alias("required"), F.first("level").alias("level"))
    return g.select("p_partkey", "required", F.round(F.greatest(F.col("required") - F.col("level"), F.lit(0.0)), 4).alias("delta"), (F.col("required") <= F.col("level")).alias("passed"))


@query("q177_halting", """with d as (select c_nationkey, cast(o_orderdate as date) as day, sum(o_totalprice) as v from orders join customer on o_custkey = c_custkey group by all), r as (select *, v - lag(v) over (partition by c_nationkey order by day) as delta, row_number() over (partition by c_nationkey order by day desc) as rn from d)
select c_nationkey, case when sum(v) > 70000000 then 'threshold' when count(*) > 600 then 'max_iterations' when max(abs(delta)) filter (rn <= 3) < 50000 then 'stall' else 'iterate' end as halt from r group by 1""")
def q177(spark, sf):
    """The first reason to stop, in order."""
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    w = W.partitionBy("c_nationkey")
    r = d.withColumn("delta", F.col("v") - F.lag("v").over(w.orderBy("day"))).withColumn("rn", F.row_number().over(w.orderBy(F.desc("day"))))
    g = r.groupBy("c_nationkey").agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.max(F.when(F.col("rn") <= 3, F.abs("delta"))).alias("m"))
    return g.select("c_nationkey", F.when(F.col("s") > 70000000, "threshold").when(F.col("n") > 600, "max_iterations").when(F.col("m") < 50000, "stall").otherwise("iterate").alias("halt"))
