"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors are first made one class; vectors of unlike length are spaces of
their own. Centroids from a bounded sample deal the classes into shards that
overlap: each class enters its ``overlap`` nearest. Every shard builds a graph
whose lists are pruned robustly: a neighbour stays unless a kept one is much
nearer to it. The shards' adjacency lists are united per class. Then each
class is searched in each of its shards, over the united lists among the
shard's classes: greedily from the shard's medoid, with a beam, until
something within range is found, and from there the search expands over all
that is within range. Hits are verified by the cosine in double precision, so
no link is false. A pair is found for both if either finds the other, and it
is counted in the first shard that both are in, so links are symmetrical.

While it runs, recall is audited against brute force for a bounded sample of
classes, by number of links. A result that falls short is redone with more
overlap and a wider beam, ``RETRIES`` times, and then with all pairs of blocks,
each width one shard, instead of the graph. ``measured_recall`` is the whole
measurement: it asks every vector whose id is divisible by 100.

A shard above ``MAX_SHARD`` classes is dealt into blocks, and each pair of
blocks is a task of its own, so a hot region costs more tasks, not a larger
one. Hits leave a task as sums and as links to the least class of each local
component, never as pairs.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.llm.common import arrow_batches
from qualitylens.operators.graph import components
from qualitylens.session import Scratch

THRESHOLD = 0.95
#: Bounds: values in the sample that centroids are fitted on, clusters, audited classes of either kind.
SAMPLE_VALUES, MAX_CLUSTERS, AUDIT = 4_000_000, 16_384, 300
TARGET, MAX_SHARD = 1000, 4096
DEGREE, NEAREST, FAR, ALPHA = 16, 32, 8, 1.2
BEAM = 12
#: The search expands nodes somewhat out of range too, as paths may leave it.
SLACK = 0.05
RECALL = 0.95
#: Searches by the graph with double overlap and beam before all pairs are compared.
RETRIES = 3
#: Every how many ids one is asked, queries and classes of a task of ``measured_recall``.
EVERY, ASKED, AGAINST = 100, 1024, 16_384
#: Queries that a task searches together, and pairs that it scores at a time.
TOGETHER, PAIRS = 512, 100_000

log = logging.getLogger(__name__)


def units(column: pd.Series) -> np.ndarray:
    """Rows of unit length, in double precision."""
    x = np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, far: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE) -> np.ndarray:
    """Which of each node's candidates (a row of them, nearest first) are its
    neighbours: each kept one drops those that are ``alpha`` times nearer to it
    than to the node. Candidates that are ``far`` do not count toward the degree."""
    c = x[candidates]
    d = 2 - 2 * np.einsum("nkd,nd->nk", c, x[nodes])
    between = 2 - 2 * (c @ c.transpose(0, 2, 1))
    alive = candidates != nodes[:, None]
    # a candidate that stands twice counts once
    order = np.argsort(candidates, axis=1, kind="stable")
    sorted_ = np.take_along_axis(candidates, order, axis=1)
    again = np.zeros(candidates.shape, bool)
    np.put_along_axis(again, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
    alive &= ~again
    kept, count = np.zeros(candidates.shape, bool), np.zeros(len(nodes), np.int64)
    for k in range(candidates.shape[1]):
        chosen = alive[:, k] & (far[:, k] | (count < degree))
        kept[:, k] = chosen
        count += chosen & ~far[:, k]
        alive &= ~(chosen[:, None] & (alpha * alpha * between[:, k] <= d))
    return kept


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned lists and, of the edges that lead to a node, the nearest
    up to twice ``DEGREE`` in all, so that a hub's list stays short."""
    n = len(x)
    small, edges = x.astype(np.float32), [np.zeros((0, 2), np.int64)]
    top = min(NEAREST, n - 1)
    for a in range(0, n if top else 0, 256):
        nodes = np.arange(a, min(a + 256, n))
        s = small[nodes] @ small.T
        s[np.arange(len(nodes)), nodes] = -2
        near = np.argpartition(-s, top - 1, axis=1)[:, :top]
        far = np.random.default_rng(a).integers(0, n, (len(nodes), FAR))  # from all over the shard
        some = np.concatenate([near, far], axis=1)
        order = np.argsort(-np.take_along_axis(s, some, axis=1), axis=1, kind="stable")
        some = np.take_along_axis(some, order, axis=1)
        i, k = np.nonzero(robust_prune(small, nodes, some, order >= top))
        edges.append(np.column_stack([nodes[i], some[i, k]]))
    e = np.concatenate(edges)
    both, back = np.concatenate([e, e[:, ::-1]]), np.arange(2 * len(e)) >= len(e)
    score = np.tile(np.einsum("kd,kd->k", small[e[:, 0]], small[e[:, 1]]), 2)
    order = np.lexsort((-score, back, both[:, 0]))
    both = both[order]
    nth = np.arange(len(both)) - np.searchsorted(both[:, 0], both[:, 0])
    both = np.unique(both[nth < 2 * DEGREE], axis=0)
    return np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, n)))


class Graph:
    """The united lists among the classes of a task."""

    def __init__(self, x: np.ndarray, lists: list[np.ndarray]):
        self.x = x
        size = max([1, *map(len, lists)])
        #: A row of neighbours per node, filled up with a node that is nowhere.
        self.near = np.full((len(x), size), len(x), np.int64)
        for k, v in enumerate(lists):
            self.near[k, : len(v)] = v
        self.medoid = int((x @ x.mean(axis=0)).argmax())
        #: Nodes that the greedy phase and the range phase have expanded.
        self.greedy = self.ranged = 0

    def _scores(self, q: np.ndarray, at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        if 8 * len(at) > len(q) * len(self.x):  # most of them: one product
            return (q @ self.x.T)[at, nodes]
        out = np.empty(len(at))
        for a in range(0, len(at), PAIRS):
            out[a : a + PAIRS] = np.einsum("kd,kd->k", q[at[a : a + PAIRS]], self.x[nodes[a : a + PAIRS]])
        return out

    def search(self, q: np.ndarray, threshold: float, beam: int = BEAM) -> np.ndarray:
        """For every row of q, whether each node was found within range."""
        out = np.zeros((len(q), len(self.x)), bool)
        for a in range(0, len(q), TOGETHER):
            out[a : a + TOGETHER] = self._search(q[a : a + TOGETHER], threshold, beam)
        return out

    def _search(self, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
        n, m = len(self.x), len(q)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        found, wide = np.zeros((m, n), bool), np.zeros((m, n), bool)

        def meet(at, nodes):
            """Score nodes that a query has not seen."""
            s = self._scores(q, at, nodes)
            found[at, nodes] = s >= threshold
            wide[at, nodes] = s >= threshold - SLACK
            return s

        # greedy: from the medoid, always to the nearest of the beam that is not expanded
        node = np.full((m, beam), n)
        score = np.full((m, beam), -3.0)
        done = np.ones((m, beam), bool)
        node[:, 0], done[:, 0], seen[:, self.medoid] = self.medoid, False, True
        score[:, 0] = meet(np.arange(m), np.full(m, self.medoid))
        at = np.arange(m)
        while True:
            k = np.where(done[at], -4.0, score[at]).argmax(axis=1)
            go = ~done[at, k] & (score[at, k] < threshold - SLACK)
            at, k = at[go], k[go]
            if not len(at):
                break
            self.greedy += len(at)
            done[at, k] = True
            around = self.near[node[at, k]]
            i, j = np.nonzero(~seen[at[:, None], around])
            new = around[i, j]
            seen[at[i], new] = True
            fresh = np.full(around.shape, -3.0)
            fresh[i, j] = meet(at[i], new)
            all_score = np.concatenate([score[at], fresh], axis=1)
            best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            score[at] = np.take_along_axis(all_score, best, axis=1)
            node[at] = np.take_along_axis(np.concatenate([node[at], around], axis=1), best, axis=1)
            done[at] = np.take_along_axis(np.concatenate([done[at], fresh == -3.0], axis=1), best, axis=1)
        # range expansion: from all that is about in range
        at, nodes = np.nonzero(wide)
        while len(at):
            self.ranged += len(at)
            met = []
            for a in range(0, len(at), PAIRS):
                who, around = at[a : a + PAIRS], self.near[nodes[a : a + PAIRS]]
                i, j = np.nonzero(~seen[who[:, None], around])
                new = np.unique(who[i] * (n + 1) + around[i, j])
                who, new = new // (n + 1), new % (n + 1)
                seen[who, new] = True
                meet(who, new)
                go = wide[who, new]
                met.append((who[go], new[go]))
            at, nodes = (np.concatenate(v) for v in zip(*met, strict=True))
        return found


def exact(x: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """What ``Graph.search`` would find at best."""
    return q @ x.T >= threshold


def least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row the least value that two rows share."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a >= 0)  # -1: no further shard
    return np.where(same, a, np.iinfo(np.int64).max).min(axis=1)


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the pairs a, b."""
    label = np.arange(n)
    while True:
        low, old = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == old).all():
            return label


def search_task(shard: int, frame: pd.DataFrame, threshold: float, beam: int, graph: bool) -> pd.DataFrame:
    """Links and local components of one task, a pair of blocks or one block.

    ``frame``: cid, vec, m (rows of the class), shards, nbrs, block. Returns
    cid, hits (rows within range that are counted in this shard, without the
    class's own) and least, the least class of its local component."""
    frame = frame.sort_values("cid", ignore_index=True)
    cid, m, block = frame["cid"].to_numpy(), frame["m"].to_numpy(), frame["block"].to_numpy()
    x, shards = units(frame["vec"]), np.stack(frame["shards"].tolist()).astype(np.int64)
    sides = [np.flatnonzero(block == k) for k in np.unique(block)]
    place = np.full(len(frame), -1)
    graphs = []
    for side in sides:
        place[side] = np.arange(len(side))
        lists = []
        for v in frame["nbrs"].iloc[side] if graph else []:
            v = np.asarray(v, np.int64)
            at = np.minimum(np.searchsorted(cid[side], v), len(side) - 1)
            lists.append(at[cid[side][at] == v])
        graphs.append(Graph(x[side], lists) if graph else None)
    one, other = sides[0], sides[-1]
    look = lambda g, to, q: g.search(x[q], threshold, beam) if g else exact(x[to], x[q], threshold)
    found = look(graphs[-1], other, one)
    found |= found.T if len(sides) == 1 else look(graphs[0], one, other).T
    a, b = np.nonzero(found)
    a, b = one[a], other[b]
    if len(sides) == 1:
        a, b = a[a < b], b[a < b]
    mine = np.concatenate([least_common(shards[a[k : k + PAIRS]], shards[b[k : k + PAIRS]]) == shard for k in range(0, len(a), PAIRS)] or [np.zeros(0, bool)])
    a, b = a[mine], b[mine]
    hits = np.bincount(a, weights=m[b], minlength=len(frame)) + np.bincount(b, weights=m[a], minlength=len(frame))
    label = local_labels(len(frame), a, b)
    out = pd.DataFrame({"cid": cid, "hits": hits.astype(np.int64), "least": cid[label]})
    return out[hits > 0]


def _classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """cid, vec, rep (least vec_id), m (rows), width of every distinct vector
    that can link. The cid is a vector's place in the order of its hash, from
    totals over 4,096 ranges of hashes, so reruns agree."""
    ok = F.col("e").isNotNull() & (F.size("e") > 0)
    ok &= F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    grouped = rows.where(ok).groupBy("e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    h = F.xxhash64("e")
    grouped = scratch.save(grouped.select(h.alias("h"), F.shiftright(h, 52).alias("range"), F.col("e").alias("vec"), "rep", "m", F.size("e").alias("width")))
    starts = grouped.groupBy("range").agg(F.count("*").alias("n"))  # at most 4,096 rows
    starts = starts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("start"))
    inside = F.row_number().over(W.partitionBy("range").orderBy("h", "vec"))
    numbered = grouped.withColumn("nth", inside).join(F.broadcast(starts), "range")
    return scratch.save(numbered.select((F.col("start") + F.col("nth")).alias("cid"), "vec", "rep", "m", "width"))


def _centroids(classes: DataFrame) -> dict[int, np.ndarray]:
    """Per width its centroids, from one bounded sample over all widths; a
    width that the sample lacks has one."""
    counts = {r.width: r.n for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()}
    bound = max(64, SAMPLE_VALUES // max(counts))
    sample = classes.orderBy(F.xxhash64("cid", F.lit(1)), "cid").limit(bound).select("width", "vec").toPandas()
    out = {w: np.zeros((1, w), np.float32) for w in counts}
    for w, frame in sample.groupby("width"):
        k = min(-(-counts[w] // TARGET), max(1, MAX_CLUSTERS * len(frame) // len(sample)), len(frame))
        out[w] = fit_centroids(units(frame["vec"]), k).astype(np.float32)
    return out


def _search(classes: DataFrame, centroids, ways: int, threshold: float, beam: int, by_graph: bool, scratch: Scratch) -> DataFrame:
    """cid, hits, least of every task. Without the graph each width is one
    shard, so a class is copied once for each block of its width."""

    def assign(frames):
        for frame in frames:
            for w, f in frame.groupby("width"):
                c = centroids.value[w]
                near = np.argsort(-(units(f["vec"]).astype(np.float32) @ c.T), axis=1, kind="stable")[:, :ways]
                near = near.astype(np.int64) + (int(w) << 32)
                full = np.full((len(f), ways), -1, np.int64)  # a width may have fewer clusters
                full[:, : near.shape[1]] = near
                at = np.repeat(np.arange(len(f)), near.shape[1])
                yield pd.DataFrame({"shard": near.ravel(), "shards": list(full[at]), "cid": f["cid"].to_numpy()[at], "vec": f["vec"].iloc[at].to_numpy(), "m": f["m"].to_numpy()[at]})

    if by_graph:
        dealt = classes.select("cid", "vec", "m", "width").mapInPandas(assign, "shard long, shards array<long>, cid long, vec array<double>, m long")
    else:
        shard = F.shiftleft(F.col("width").cast("long"), 32)
        dealt = classes.select(shard.alias("shard"), F.array(shard).alias("shards"), "cid", "vec", "m")
    dealt = scratch.save(dealt)
    sizes = dealt.groupBy("shard").count().select("shard", F.ceil(F.col("count") / MAX_SHARD).alias("blocks"))
    dealt = dealt.join(scratch.save(sizes), "shard").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))

    def graph(key, f: pd.DataFrame) -> pd.DataFrame:
        cid = f["cid"].to_numpy()
        return pd.DataFrame({"cid": cid, "nbrs": [cid[v].tolist() for v in build_graph(units(f["vec"]))]})

    if by_graph:
        lists = dealt.select("shard", "block", "cid", "vec").groupBy("shard", "block").applyInPandas(graph, "cid long, nbrs array<long>")
        united = lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))  # a list per shard of a class
        dealt = dealt.join(united, "cid")
    else:
        dealt = dealt.withColumn("nbrs", F.array().cast("array<long>"))
    # a block meets every block of its shard, itself among them, in one task each
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    tasks = dealt.select("shard", F.explode(met).alias("pair"), "block", "cid", "vec", "m", "shards", "nbrs").select("shard", "pair.i", "pair.j", "block", "cid", "vec", "m", "shards", "nbrs")
    return tasks.groupBy("shard", "i", "j").applyInPandas(lambda key, f: search_task(key[0], f, threshold, beam, by_graph), "cid long, hits long, least long")


def audit(classes: DataFrame, hits: DataFrame, threshold: float = THRESHOLD, n: int = AUDIT) -> float:
    """Recall of ``hits`` (cid, hits): of the ``n`` classes of least hash, and
    of the ``n`` of those that have hits, each compared with every class of its
    width in blocks. The share of its links that a class has is averaged over
    the classes with up to 3, up to 30 and more links, and over all; the least
    of these means counts, bands of fewer than 10 classes aside."""
    order = [F.xxhash64("cid", F.lit(2)), F.col("cid")]
    known = classes.join(hits, "cid", "left").select("cid", "vec", "m", "width", F.coalesce("hits", F.lit(0)).alias("hits"))
    asked = known.orderBy(*order).limit(n).union(known.where("hits > 0").orderBy(*order).limit(n)).distinct().toPandas()
    by_width = {w: (f.index.to_numpy(), units(f["vec"])) for w, f in asked.groupby("width")}
    q = classes.sparkSession.sparkContext.broadcast(by_width)

    def count(frames):
        for frame in frames:
            for w, f in frame.groupby("width"):
                if w in q.value:
                    at, x = q.value[w]
                    yield pd.DataFrame({"k": at, "n": ((units(f["vec"]) @ x.T >= threshold) * f["m"].to_numpy()[:, None]).sum(axis=0)})

    true = classes.select("vec", "m", "width").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas().set_index("k")["n"]
    # what a class finds of itself is no merit
    want = true.reindex(np.arange(len(asked))).to_numpy() - asked["m"].to_numpy()
    share = np.minimum(asked["hits"].to_numpy(), want) / np.maximum(want, 1)
    bands = [(want > 0) & (want <= 3), (want > 3) & (want <= 30), want > 30]
    means = [share[b].mean() for b in bands if b.sum() >= 10]
    return float(min([*means, share[want > 0].mean()])) if (want > 0).any() else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = 2, recall: float = RECALL) -> DataFrame:
    """Links and groups of near-duplicate vectors.

    ``vectors``: vec_id, embedding (array of numbers); other columns, labels
    among them, are ignored. Returns a row per row: vec_id, n_links (other rows
    linked directly), component_id (least vec_id reachable), kept.

    Null, empty and zero vectors, and vectors with a null or non-finite
    component, link with nothing. Vectors of unlike length link with their own
    kind only. Rows that repeat are rows of their own, and equal vectors link;
    a null vec_id is larger than any other. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 2000)
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    classes = _classes(rows, scratch)
    if not classes.limit(1).count():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = _centroids(classes)
    most = max(map(len, found.values()))
    centroids = spark.sparkContext.broadcast(found)  # bounded by MAX_CLUSTERS, and one more per width
    beam, by_graph, tried = BEAM, True, 0
    while True:
        tasks = scratch.save(_search(classes, centroids, min(overlap, most), threshold, beam, by_graph, scratch))
        hits = scratch.save(tasks.groupBy("cid").agg(F.sum("hits").alias("hits")))
        reached = audit(classes, hits, threshold)
        log.info("recall %.4f with overlap %d, beam %d, %s", reached, min(overlap, most), beam, "graph" if by_graph else "all pairs")
        if reached >= recall or not by_graph:
            break
        tried += 1
        by_graph = tried <= RETRIES and overlap < most
        overlap, beam = 2 * overlap, 2 * beam
        scratch.drop(tasks)
        scratch.drop(hits)
    links = tasks.where("cid <> least").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    groups = components(links, scratch)
    labels = classes.select("cid", "vec", "rep", "m").join(groups.withColumnRenamed("node", "cid"), "cid", "left").join(hits, "cid", "left")
    labels = scratch.save(labels.select("vec", "rep", "m", F.coalesce("root", "cid").alias("root"), F.coalesce("hits", F.lit(0)).alias("hits")))
    least = labels.groupBy("root").agg(F.min("rep").alias("component"))
    labels = scratch.save(labels.join(least, "root").select(F.col("vec").alias("e"), (F.col("hits") + F.col("m") - 1).alias("n_links"), "component"))
    out = rows.join(labels, "e", "left")
    known = F.col("n_links").isNotNull()
    component = F.when(known, F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def measured_recall(vectors: DataFrame, found: DataFrame, threshold: float = THRESHOLD, every: int = EVERY) -> DataFrame:
    """How many of the true links of every vector whose id is divisible by
    ``every`` the rows ``found`` (what ``near_duplicates`` gave) count.

    Returns at most four rows: band (``1-3``, ``4-30``, ``31+`` links, and
    ``all``), queries (that have links), links (true ones), met (of them
    counted), recall (met / links) and least_recall, the worst of its vectors.
    Queries without a link are in no row; no link at all gives no rows. Ids
    that repeat are summed up as one query, null ids are not asked.

    Each task compares at most about ``ASKED`` queries with ``AGAINST``
    classes, so nothing is collected or broadcast; the comparisons grow as
    rows x rows / ``every``, so this is a measurement of its own and no part
    of the operator.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 2000)
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    classes = _classes(rows, scratch)
    asked = rows.where(F.col("vec_id") % every == 0).join(classes.select(F.col("vec").alias("e"), "cid", "width"), "e")
    asked = scratch.save(asked.select(F.monotonically_increasing_id().alias("q"), "vec_id", "cid", "width", F.col("e").alias("vec")))
    # one row a width: the numbers of blocks on either side
    parts = lambda df, size: df.groupBy("width").agg(F.ceil(F.count("*") / size).alias("n"))
    grid = scratch.save(parts(asked, ASKED).withColumnRenamed("n", "across").join(parts(classes, AGAINST).withColumnRenamed("n", "down"), "width"))
    dealt = lambda df, key, own, other: df.join(grid, "width").withColumn("own", F.pmod(F.xxhash64(key), F.col(own))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    none = F.lit(None).cast("long")
    one = dealt(asked, "q", "across", "down").select("width", F.col("own").alias("i"), F.col("other").alias("j"), "q", "vec", F.lit(1).cast("long").alias("m"))
    two = dealt(classes, "cid", "down", "across").select("width", F.col("other").alias("i"), F.col("own").alias("j"), none.alias("q"), "vec", "m")

    def count(key, f: pd.DataFrame) -> pd.DataFrame:
        mine = f["q"].notna().to_numpy()
        x, q, m = units(f["vec"][~mine]), units(f["vec"][mine]), f["m"].to_numpy()[~mine]
        n = np.zeros(len(q), np.int64)
        for a in range(0, len(q), 256):
            n[a : a + 256] = (q[a : a + 256] @ x.T >= threshold) @ m if len(x) else 0
        return pd.DataFrame({"q": f["q"][mine].astype(np.int64), "n": n})

    true = one.union(two).groupBy("width", "i", "j").applyInPandas(count, "q long, n long").groupBy("q").agg((F.sum("n") - 1).alias("n"))
    true = asked.select("q", "vec_id").join(true, "q").groupBy("vec_id").agg(F.sum("n").alias("links"))
    got = found.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.sum("n_links").alias("met"))
    both = true.join(got, "vec_id", "left").where("links > 0").select("links", F.least("links", F.coalesce("met", F.lit(0))).alias("met"))
    own = F.when(F.col("links") <= 3, "1-3").when(F.col("links") <= 30, "4-30").otherwise("31+")
    both = both.withColumn("band", F.explode(F.array(own, F.lit("all"))))
    out = both.groupBy("band").agg(F.count("*").alias("queries"), F.sum("links").alias("links"), F.sum("met").alias("met"), F.min(F.col("met") / F.col("links")).alias("least_recall"))
    return out.select("band", "queries", "links", "met", (F.col("met") / F.col("links")).alias("recall"), "least_recall")
