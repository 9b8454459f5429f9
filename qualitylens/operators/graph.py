"""Graph operators: reachability, layers, cycles, components, set cover.

The iterations write each round to the shared folder; only counts reach the
driver. Graphs are edge tables (src, dst).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.operators.relational import running
from qualitylens.session import Scratch, arrow_batches


def _gathered(parts: list[DataFrame], scratch: Scratch) -> list[DataFrame]:
    """Now and then the rounds' tables become one, so that plans stay small."""
    if len(parts) < 16:
        return parts
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    saved = scratch.save(whole)
    for part in parts:
        scratch.drop(part)
    return [saved]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, hops: all that the seeds (node) reach, with the fewest hops, until
    nothing is new. Each round follows edges from the newest nodes only."""
    scratch = Scratch(edges.sparkSession)
    edges = scratch.save(edges.select("src", "dst").distinct())
    parts = [scratch.save(seeds.select("node").distinct().withColumn("hops", F.lit(0)))]
    front, hop = parts[0], 0
    while True:
        hop += 1
        new = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = scratch.save(new.join(_union(parts), "node", "left_anti").withColumn("hops", F.lit(hop)))
        if not front.limit(1).count():
            return _union(parts)
        parts.append(front)
        if len(parts) >= 16:
            parts = _gathered(parts, scratch)
            front = parts[0].where(F.col("hops") == hop)


#: Rounds of ``closure`` that do not yet compare what is new with what was known.
FREE_ROUNDS = 8


def closure(edges: DataFrame) -> DataFrame:
    """src, dst: all pairs of nodes with a path from the one to the other.

    Each round puts an edge before the newest paths only, and only an edge whose
    end had paths of the length before, so an edge that leads to nodes without
    edges is read once. Paths of different lengths between the same nodes meet
    once, at the end; a graph that goes on after ``FREE_ROUNDS`` may have cycles,
    and from there on what is known is taken off each round. The rounds are as
    many as the longest of the shortest paths has edges."""
    scratch = Scratch(edges.sparkSession)
    new = scratch.save(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    parts, lead, rounds = [new], new, 0
    while True:
        rounds += 1
        lead = scratch.save(lead.join(lead.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        longer = lead.select("src", F.col("dst").alias("mid")).join(new.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        if rounds >= FREE_ROUNDS:
            longer = longer.join(_union(parts), ["src", "dst"], "left_anti")
        new = scratch.save(longer)
        if not new.limit(1).count():
            return _union(parts).distinct()
        parts = [*_gathered(parts, scratch), new]


def layers(edges: DataFrame) -> DataFrame:
    """node, tier: the longest path from a source; members of cycles, and what
    only they lead to, have tier null.

    Rounds take off the nodes that point nowhere, with the edges to them, until
    there are none; what cycles keep is dealt from its sources on. Then the
    nodes taken off last come first: all edges to a node went together, so its
    tier is one join with what is known of their starts and one maximum. Each
    edge is so moved a few times, whatever the number of rounds."""
    scratch = Scratch(edges.sparkSession)
    left = scratch.save(edges.where("src <> dst").select("src", "dst").distinct())
    peeled: list[DataFrame] = []
    while left.limit(1).count():
        split = left.join(left.select(F.col("src").alias("dst")).distinct().withColumn("on", F.lit(True)), "dst", "left")
        split = scratch.save(split.select("src", "dst", F.col("on").isNotNull().alias("on")))
        scratch.drop(left)
        left = split.where("on").select("src", "dst")
        off = split.where("not on").select("src", "dst")
        if not off.limit(1).count():
            break
        peeled.append(off)
    tier = F.lit(None).cast("int")
    parts = [scratch.save(_from_sources(left, scratch)) if left.limit(1).count() else scratch.save(left.where("false").select(F.col("src").alias("node"), tier.alias("tier")))]
    starts: list[DataFrame] = []
    for off in reversed(peeled):
        known = _union(parts).select(F.col("node").alias("src"), F.struct("tier").alias("known"))
        met = scratch.save(off.join(known, "src", "left"))
        # what nothing points to is not known: a source
        starts.append(met.where("known is null").select("src").distinct())
        above = F.when(F.col("known").isNull(), 0).otherwise(F.col("known.tier"))
        new = met.groupBy(F.col("dst").alias("node")).agg(F.when(F.count(above) == F.count("*"), F.max(above) + 1).alias("tier"))
        parts = _gathered([*parts, scratch.save(new)], scratch)
    found = _union(parts)
    if starts:
        found = found.union(_union(starts).distinct().select("src", F.lit(0)))
    alone = edges.where("not coalesce(src <> dst, false)").select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    return found.union(alone.join(found, "node", "left_anti").select("node", F.lit(0)))


def _from_sources(left: DataFrame, scratch: Scratch) -> DataFrame:
    """Tiers of a graph without loops on a node, by rounds that take off the
    nodes that nothing left points to."""
    nodes = scratch.save(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    parts, tier = [], 0
    while True:
        free = scratch.save(nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("tier", F.lit(tier)))
        if not free.limit(1).count():
            return _union([*parts, nodes.withColumn("tier", F.lit(None).cast("int"))])
        rest = scratch.save(nodes.join(free, "node", "left_anti"))
        after = scratch.save(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        scratch.drop(nodes)
        scratch.drop(left)
        nodes, left, tier = rest, after, tier + 1
        parts = _gathered([*parts, free], scratch)


def strong_components(edges: DataFrame) -> DataFrame:
    """node, root: the strongly connected component of every node of ``edges``,
    named by its least node; a node on no cycle is its own.

    Edges that cannot be on a cycle are trimmed: those from nodes that nothing
    points to, and those to nodes that point nowhere. Then the least node that
    reaches it colours each node, and what leads back to a colour's own node
    within the colour is a component. Edges between colours, and those of the
    components found, go, until none are left. One flag a round reaches the driver."""
    scratch = Scratch(edges.sparkSession)
    nodes = scratch.save(edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct())
    left = scratch.save(edges.where("src <> dst").select("src", "dst").distinct())
    parts: list[DataFrame] = []
    while left.limit(1).count():
        trimmed = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        trimmed = scratch.save(trimmed.select("src", "dst"))
        scratch.drop(left)
        colour = scratch.save(trimmed.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")).withColumn("new", F.lit(True)))
        while colour.where("new").limit(1).count():
            came = trimmed.join(colour.where("new").select(F.col("node").alias("src"), F.col("c").alias("least")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("least").alias("least"))
            after = colour.join(came, "node", "left").select("node", F.least("c", "least").alias("c"), F.coalesce(F.col("least") < F.col("c"), F.lit(False)).alias("new"))
            after = scratch.save(after)
            scratch.drop(colour)
            colour = after
        ends = lambda n: colour.select(F.col("node").alias(n), F.col("c").alias(f"c_{n}"))  # noqa: E731, B023
        same = scratch.save(trimmed.join(ends("src"), "src").join(ends("dst"), "dst").where("c_src = c_dst").select("src", "dst"))
        back = reachable(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = c").select("node"))
        found = scratch.save(back.select("node").join(colour.select("node", F.col("c").alias("root")), "node"))
        parts = _gathered([*parts, found], scratch)
        out = found.select("node")
        left = scratch.save(same.join(out.withColumnRenamed("node", "src"), "src", "left_anti").join(out.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if not parts:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(_union(parts), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def cycles(edges: DataFrame, longest: int = 3) -> DataFrame:
    """All simple cycles of up to ``longest`` nodes, as arrays from their least
    node.

    Edges from nodes that nothing points to, and to nodes that point nowhere, are
    on no cycle and go, ``longest`` times. Then paths grow by a join a step, from
    the node of a cycle that has most edges and over nodes of fewer, so that no
    path leads through a hub. The last step is a join on both its ends. The
    rounds are as many as a cycle has nodes, whatever the graph."""
    scratch = Scratch(edges.sparkSession)
    e = scratch.save(edges.where("src <> dst").select("src", "dst").distinct())
    for _ in range(longest):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = scratch.save(e.select("src", "dst"))
    degree = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    rank = lambda n, to: degree.select(F.col("node").alias(n), F.struct("n", "node").alias(to))
    e = scratch.save(e.join(rank("src", "a"), "src").join(rank("dst", "b"), "dst"))
    paths = e.where("a > b").select(F.array("src", "dst").alias("path"), F.col("a").alias("top"), F.col("dst").alias("last"), F.col("src").alias("first"))
    closing = e.select(F.col("src").alias("last"), F.col("dst").alias("first"))
    out = None
    for n in range(2, longest + 1):
        closed = paths.join(closing, ["last", "first"]).select("path")
        out = closed if out is None else out.union(closed)
        if n < longest:
            step = paths.join(e.select(F.col("src").alias("last"), F.col("dst").alias("next"), "b"), "last").where((F.col("b") < F.col("top")) & ~F.array_contains("path", F.col("next")))
            paths = scratch.save(step.select(F.concat("path", F.array("next")).alias("path"), "top", F.col("next").alias("last"), "first"))
    at = F.array_position("path", F.array_min("path")).cast("int")
    return out.select(F.concat(F.slice("path", at, F.size("path")), F.slice("path", F.lit(1), at - 1)).alias("path"))


#: Pairs of test and mutant that one task may hold.
COVER_PAIRS = 4_000_000
#: Mutants of a test that travel in one row.
COVER_ROW = 1024


def _covered(rows: pa.Table) -> pa.Table:
    """The mutants that greedy's steps take among the tests of a batch (each test
    with some of its mutants a row), until a test outside (``edge_n``,
    ``edge_test``: the first of them) could come before."""
    t = rows["test"].combine_chunks().dictionary_encode()
    by = pc.sort_indices(t.dictionary)
    tests = t.dictionary.take(by)
    rank = np.empty(len(by), np.int64)
    rank[by.to_numpy()] = np.arange(len(by))
    t = rank[t.indices.to_numpy()]
    by = np.argsort(t, kind="stable")
    lists = rows["mutants"].take(pa.array(by)).combine_chunks()
    n = np.zeros(len(tests), np.int64)
    np.add.at(n, t[by], lists.value_lengths().to_numpy())
    m = lists.flatten().dictionary_encode()
    del lists
    mutants, of_test = m.dictionary, m.indices.to_numpy()
    at_test = np.concatenate([[0], np.cumsum(n)])
    of_mutant = np.repeat(np.arange(len(tests), dtype=np.int32), n)[np.argsort(of_test, kind="stable")]
    at_mutant = np.concatenate([[0], np.cumsum(np.bincount(of_test))])
    alive = np.ones(len(mutants), bool)
    edge = rows["edge_n"][0].as_py()
    if edge is not None:
        edge = (-edge, pc.sum(pc.less(tests, rows["edge_test"][0])).as_py())
    heap = [(-int(c), k) for k, c in enumerate(n)]
    heapq.heapify(heap)
    steps, hits = [], []
    while heap:
        c, k = heap[0]
        if -c != n[k]:  # mutants have gone since
            heapq.heapreplace(heap, (-int(n[k]), k)) if n[k] else heapq.heappop(heap)
            continue
        if edge is not None and (c, k) >= edge:
            break
        heapq.heappop(heap)
        hit = of_test[at_test[k] : at_test[k + 1]]
        hit = hit[alive[hit]]
        alive[hit] = False
        np.subtract.at(n, np.concatenate([of_mutant[at_mutant[x] : at_mutant[x + 1]] for x in hit]), 1)
        steps.append(np.full(len(hit), k))
        hits.append(hit)
    none = [np.zeros(0, np.int64)]
    return pa.table({"test": tests.take(pa.array(np.concatenate(steps or none))), "mutant": mutants.take(pa.array(np.concatenate(hits or none)))})


def _shared(kills: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs (mutant, test), and of each test its component and how
    many mutants it kills (test, root, n).

    A test takes the least test of all that it shares a mutant with; links are
    needed only where those that a mutant's tests took differ."""
    pairs = kills.where("mutant is not null and test is not null").select("mutant", "test").distinct()
    pairs = scratch.save(pairs.withColumn("least", F.min("test").over(W.partitionBy("mutant"))))  # a mutant has as many rows as tests at most
    tests = scratch.save(pairs.groupBy("test").agg(F.min("least").alias("a"), F.count("*").alias("n")))
    links = pairs.join(tests.select("test", "a"), "test").join(tests.select(F.col("test").alias("least"), F.col("a").alias("b")), "least")
    roots = components(links.where("a <> b").select("a", "b").distinct(), scratch).withColumnRenamed("node", "a")
    tests = tests.join(roots, "a", "left").select("test", F.coalesce("root", "a").alias("root"), "n")
    return pairs, scratch.save(tests)


def set_cover(kills: DataFrame, most: int = COVER_PAIRS) -> DataFrame:
    """Greedy cover: each step takes the test (least id of equals) that kills
    most of the mutants left. Returns step, test, new.

    Components that share no mutant do not touch each other, and as a step's
    count never rises, the order of all steps is that of new and then id. A
    round takes, of each component, the tests that come first by mutants left
    and then id, up to ``most`` pairs, and greedy goes on among them within a
    task until a test that stayed outside could come before; counts only fall, so
    no other can. A component of up to ``most`` pairs is done in one round; a
    first test with more pairs than that is the next step by itself. A round
    reads the pairs, for the tests it takes and for what the others lose; they
    are written anew once a quarter is gone. One sum a round reaches the driver.
    """
    scratch = Scratch(kills.sparkSession)
    arrow_batches(kills.sparkSession)
    left, counts = _shared(kills, scratch)
    kind, of = (left.schema[c].dataType.simpleString() for c in ("test", "mutant"))
    parts = [scratch.save(left.where("false").select("test", "mutant"))]
    gone: list[DataFrame] = []  # mutants taken since the pairs were written
    alive = lambda rows: rows.join(_union(gone), "mutant", "left_anti") if gone else rows
    written = pairs = counts.agg(F.sum("n")).first()[0]
    while pairs:
        # components of the first tests of all: whole, or cut at the last test that still fits
        tests = scratch.save(counts.join(counts.groupBy("root").agg((F.sum("n") <= most).alias("whole")), "root"))
        batch = tests.where("whole").select("root", "test", "n", F.lit(None).cast("long").alias("edge_n"), F.lit(None).cast(kind).alias("edge_test"))
        more = tests.where("not whole").limit(1).count()
        if more:
            large = running(tests.where("not whole").withColumn("less", -F.col("n")), ["root", "less"], ["test"], upto=F.col("n"))
            start = large.groupBy("root").agg(F.min("upto").alias("start"))
            large = scratch.save(large.join(start, "root").withColumn("upto", F.col("upto") - F.col("start") + F.col("n")).select("root", "test", "n", "less", "upto"))
            edge = large.where(F.col("upto") > most).groupBy("root").agg(F.min(F.struct("less", "test")).alias("edge"))
            inside = large.where(F.col("upto") <= most).join(edge, "root")
            batch = scratch.save(batch.union(inside.select("root", "test", "n", (-F.col("edge.less")).alias("edge_n"), F.col("edge.test").alias("edge_test"))))
        share = F.pmod(F.xxhash64("mutant"), F.ceil(F.col("n") / COVER_ROW)).alias("share")
        rows = alive(left.join(batch, "test")).groupBy("root", "test", "edge_n", "edge_test", share).agg(F.collect_list("mutant").alias("mutants"))
        taken = rows.drop("share").groupBy("root").applyInArrow(_covered, f"test {kind}, mutant {of}")
        if more:
            alone = large.where((F.col("upto") > most) & (F.col("upto") == F.col("n"))).select("test")
            taken = taken.union(alive(left.join(alone, "test")).select("test", "mutant"))
        taken = scratch.save(taken)
        parts.append(taken)
        if not more:
            break
        gone.append(taken.select("mutant"))
        lost = left.join(gone[-1], "mutant").groupBy("test").agg(F.count("*").alias("lost"))
        less = tests.join(lost, "test", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).where("n > 0").select("test", "root", "n")
        scratch.drop(counts)
        counts = scratch.save(less)
        pairs = counts.agg(F.sum("n")).first()[0]
        for old in (tests, large, batch):
            scratch.drop(old)
        if pairs and 4 * pairs <= 3 * written:
            after = scratch.save(alive(left).select("mutant", "test"))
            scratch.drop(left)
            left, written, gone = after, pairs, []
            parts = _gathered(parts, scratch)
    steps = _union(parts).groupBy("test").agg(F.count("*").alias("new")).withColumn("first", -F.col("new"))
    return running(steps, ["first"], ["test"], step=F.lit(1)).select((F.col("step") + 1).alias("step"), "test", "new")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of a link table (a, b: one comparable type, either
    order, repeats and loops allowed), by repeated hooking and shortcuts.

    Returns node, root, the smallest node that a node reaches. Every round
    costs a fixed number of joins and aggregations over narrow rows and about
    halves the depth of the trees, so long chains take a logarithmic number of
    rounds. Every round's table is written to the shared folder, and nothing
    but one count reaches the driver. Links with a null end are ignored; an
    empty table gives no rows.
    """
    scratch = scratch or Scratch(links.sparkSession)
    both = links.where("a is not null and b is not null").select("a", "b")
    both = scratch.save(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # f: node, its parent, its parent's parent
    f = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).withColumnRenamed("a", "node"))
    f = scratch.save(_grand(f))
    while True:
        seen = both.join(f.select(F.col("node").alias("b"), "gp"), "b").groupBy("a").agg(F.min("gp").alias("m"))
        seen = f.join(seen.withColumnRenamed("a", "node"), "node")
        hooks = seen.groupBy(F.col("p").alias("node")).agg(F.min("m").alias("m"))
        own = seen.select("node", F.least("m", "gp").alias("m"))
        new = own.union(hooks).groupBy("node").agg(F.min("m").alias("p"))
        new = scratch.save(new)
        g = scratch.save(_grand(new))
        changed = g.join(f.select("node", F.col("gp").alias("was")), "node").where("gp <> was or gp <> p").limit(1).count()
        scratch.drop(f)
        f = g
        if not changed:
            return f.select("node", F.col("gp").alias("root"))


def _grand(f: DataFrame) -> DataFrame:
    return f.join(f.select(F.col("node").alias("p"), F.col("p").alias("gp")), "p").select("node", "p", "gp")
