"""SimHash near-duplicates by multi-index hashing.

A text's shingles are hashed in Arrow batches, and the majority of each bit
over all shingles, repeats included, makes the fingerprint. Distinct
fingerprints are then linked when they differ in at most two bits.

The index has a table per 32-bit segment, from a segment's value to the
fingerprints that have it. Of two fingerprints that differ in at most two bits
either the first segments are equal, or the second ones differ in at most one
bit. So the first table is probed with the segment itself and the second with
its Hamming ball of radius one, of which only the members with a bit more are
listed, since of two neighbours one has it. Matches are fetched by a join and
verified by the complete distance.

A segment value that more than ``HOT`` fingerprints share would pair them all.
All that belong to such a value or probe it are split by the other segment
too: each is listed under every value of both segments at most one bit away.
Two that differ in two bits meet at the value between them, a bucket holds at
most 65 fingerprints whatever the corpus, and all of them are within two bits
of each other, so a bucket links its members to its least.

Over five-word shingles, texts of a Jaccard similarity of 0.8 differ in about
10 of 64 bits, more than small Hamming balls reach. ``near_duplicates`` with a
``similarity`` so also takes links from a second index, whose keys are bands of
least hashes of a text's distinct shingles, and verifies them by the exact
similarity of the shingle sets. Where a band gathers many texts, those still
apart are joined by their rarest shingles, which misses none.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualitylens.llm.common import arrow_batches
from qualitylens.llm.ngrams import TextBatch, joined, parts
from qualitylens.operators.graph import components
from qualitylens.session import Scratch

SEED = 42
RADIUS = 2
SHINGLE = 3
#: The second index: words in a shingle, least similarity, bands and least hashes in each.
#: A pair at 0.8 meets in a band with probability 0.998.
SET_SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
#: Classes in a bucket that are all paired; larger buckets go by their rarest shingles.
SMALL = 8
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = (1 << 63) - 1
#: Fingerprints that share a segment's value and are all paired; more go by both segments.
HOT = 64

#: Per byte the bits that are set, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, words_in: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_in:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words_in - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    if not len(hashes):
        return 0
    by = hashes.view(np.uint8).reshape(-1, 8) if hashes.dtype.byteorder != ">" else hashes.byteswap().view(np.uint8).reshape(-1, 8)
    set_ = np.concatenate([np.bincount(by[:, k], minlength=256) @ BITS for k in range(8)])
    return sum(1 << int(b) for b in np.flatnonzero(set_ * 2 > len(hashes)))


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Per text its distinct shingles of ``SET_SHINGLE`` words, hashed and in order."""
    out = []
    for a, e in parts(texts):
        b = TextBatch(texts[a:e], lower=True)
        h = joined(b.words(), SET_SHINGLE)
        low = np.minimum(b.word_low, len(h))
        high = np.maximum(np.minimum(b.word_high - SET_SHINGLE + 1, len(h)), low)
        out += [np.unique(h[i:j]) for i, j in zip(low.tolist(), high.tolist(), strict=True)]
    return out


def set_key(grams: np.ndarray) -> int:
    """One signed hash of a set of shingles."""
    with np.errstate(over="ignore"):
        return int(((grams ^ grams >> np.uint64(33)) * _MULTIPLIERS[0]).sum(dtype=np.uint64).astype(np.int64))


def band_keys(sets: list[np.ndarray]) -> list[list[int]]:
    """Per set a key for each band, from the least hashes of ``ROWS`` orders; none for an empty set."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    out: list[list[int]] = [[] for _ in sets]
    if len(full):
        flat, start = np.concatenate(sets), (np.cumsum(size) - size)[full]
        mixed = (flat ^ flat >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        keys = np.zeros((len(full), BANDS), np.uint64)
        for k, m in enumerate(_MULTIPLIERS):
            least = np.minimum.reduceat((mixed ^ mixed >> np.uint64(29)) * m, start)
            band = k // ROWS
            keys[:, band] = (keys[:, band] ^ keys[:, band] >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) + least + np.uint64(band)
        for i, row in zip(full.tolist(), keys.view(np.int64).tolist(), strict=True):
            out[i] = row
    return out


def similar_links(docs: DataFrame, rows: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Links a, b among the fingerprints of ``rows`` (see ``fingerprints``)
    whose texts have a Jaccard similarity of ``similarity`` or more, enough of
    them to connect all that share a band.

    Equal shingle sets are one class. A bucket of up to ``SMALL`` classes pairs
    all of them. A larger one first pairs them with its least and greatest,
    and what that leaves apart is joined exactly (see ``rare_pairs``). Pairs
    too unlike in size go, and the others are verified by their sets.
    """
    texts = rows.where(F.size("keys") > 0).groupBy("set", "fp").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = scratch.save(texts)
    sets = scratch.save(texts.groupBy("set").agg(F.min(F.struct("id", "fp")).alias("m"), F.first("n").alias("n"), F.first("keys").alias("keys")).select("set", "m.id", "m.fp", "n", "keys"))
    same = texts.select("set", F.col("fp").alias("b")).join(sets.select("set", F.col("fp").alias("a")), "set").where("a <> b").select("a", "b")

    entries = scratch.save(sets.select("set", "n", F.explode("keys").alias("key")))
    heads = entries.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("set", "n")).alias("low"), F.max(F.struct("set", "n")).alias("high"))
    heads = scratch.save(heads.where(F.col("size") > 1))
    hot = scratch.save(entries.join(heads.where(F.col("size") > SMALL), "key").select("set", "n", "low", "high"))
    few = entries.join(heads.where(F.col("size") <= SMALL).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("set", "n")).alias("all"))
    met = few.select(F.explode("all").alias("one"), "all").select("one.set", "one.n", F.explode("all").alias("head"))
    met = met.union(hot.select("set", "n", F.explode(F.array("low", "high")).alias("head")))
    met = met.where((F.col("set") != F.col("head.set")) & (F.least("n", "head.n") >= similarity * F.greatest("n", "head.n")))
    pairs = scratch.save(met.select(F.least("set", "head.set").alias("x"), F.greatest("set", "head.set").alias("y")).distinct())

    asked = pairs.select(F.col("x").alias("set")).union(pairs.select("y")).union(hot.select("set")).distinct()
    asked = scratch.save(asked.join(sets.select("set", "id", "fp"), "set"))

    def grams(batches):
        for b in batches:
            found = shingle_sets(b.column(2).to_pylist())
            keep = [i for i, (g, s) in enumerate(zip(found, b.column(0).to_pylist(), strict=True)) if set_key(g) == s]
            values = pa.array([found[i].view(np.int64) for i in keep], pa.list_(pa.int64()))
            yield pa.record_batch({"set": b.column(0).take(pa.array(keep, pa.int64())), "fp": b.column(1).take(pa.array(keep, pa.int64())), "grams": values})

    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), "text").join(asked, "id").select("set", "fp", "text")
    whole = scratch.save(whole.mapInArrow(grams, "set long, fp long, grams array<long>"))
    whole = whole.dropDuplicates(["set"])

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(whole.select(F.col("set").alias("x"), F.col("fp").alias("a"), F.col("grams").alias("ga")), "x")
        both = both.join(whole.select(F.col("set").alias("y"), F.col("fp").alias("b"), F.col("grams").alias("gb")), "y")
        common = F.size(F.array_intersect("ga", "gb"))
        return both.where(common >= similarity * (F.size("ga") + F.size("gb") - common) - 1e-9).select("x", "y", "a", "b")

    alike = verified(pairs)
    if hot.limit(1).count():
        alike = scratch.save(alike)
        groups = components(alike.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch).withColumnRenamed("node", "set")
        apart = hot.select("set").distinct().join(whole.select("set", "grams"), "set").join(groups, "set", "left")
        apart = scratch.save(apart.select("set", F.coalesce("root", "set").alias("root"), F.size("grams").alias("n"), "grams"))
        alike = alike.union(verified(rare_pairs(apart, similarity, scratch)))
    return same.union(alike.where("a <> b").select("a", "b"))


def rare_pairs(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs x, y of ``sets`` (set, root, n, grams) of different roots, among
    them all whose similarity is ``similarity`` or more.

    Every set orders its grams from the rarest on. Two that are alike enough
    share a gram that both have early: from their first common one on, each
    must still have as many as they have to share, so a passage that many texts
    share brings only those together of which it is nearly all.
    """
    grams = scratch.save(sets.select("set", F.explode("grams").alias("gram")))
    counts = scratch.save(grams.groupBy("gram").agg(F.count("*").alias("texts")).where(F.col("texts") > 1))
    common = scratch.save(grams.join(counts, "gram"))
    order = Window.partitionBy("set").orderBy("texts", "gram")
    common = common.select("set", "gram", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("set")).alias("of"))
    # left: the grams from this one on, those that no other text has come first
    common = common.select("set", "gram", (F.col("of") - F.col("k") + 1).alias("left"))
    early = common.join(sets.select("set", "root", "n"), "set").where(F.col("left") >= similarity * F.col("n") - 1e-9)
    early = scratch.save(early)
    # of two roots one is not the gram's most frequent root, whose members so never meet each other
    roots = early.groupBy("gram", "root").agg(F.count("*").alias("k")).groupBy("gram").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("top"))
    shared = early.join(roots.where(F.col("roots") > 1).select("gram", F.col("top.root").alias("top")), "gram")
    shared = scratch.save(shared)
    x, y = shared.where("root <> top").alias("x"), shared.alias("y")
    least = similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9
    met = x.join(y, "gram").where("x.root <> y.root").where((F.col("x.left") >= least) & (F.col("y.left") >= least))
    return scratch.save(met.select(F.least("x.set", "y.set").alias("x"), F.greatest("x.set", "y.set").alias("y")).distinct())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, sketch: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, h, the text's hash, and fp,
    the fingerprint as a signed long. Null and wordless texts have fingerprint
    zero. With ``sketch`` also set, n and keys: the hash, size and band keys of
    the shingle set."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([majority(shingle_hashes(t.as_py(), shingle)) for t in b.column(2)], np.uint64)
            out = {"doc_id": b.column(0), "h": b.column(1), "fp": pa.array(fps.view(np.int64), pa.int64())}
            if sketch:
                sets = shingle_sets(b.column(2).to_pylist())
                out |= {"set": pa.array([set_key(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "keys": pa.array(band_keys(sets), pa.list_(pa.int64()))}
            yield pa.record_batch(out)

    more = ", set long, n long, keys array<long>" if sketch else ""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long" + more)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """Links among distinct fingerprints (fp): a, b that differ in 1 to
    ``radius`` (1 or 2) bits, enough of them to connect all that are so linked."""
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    scratch = scratch or Scratch(fps.sparkSession)
    first, second = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    segments = [(0, first), (1, second)]
    entries = scratch.save(fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in segments])).alias("at")).select("at.k", "at.v", "fp"))
    # the ball of the second segment: itself and, for radius two, its members with a bit more
    bits = F.filter(F.array(*[F.lit(1 << b) for b in range(32)]), lambda x: F.col("v").bitwiseAND(x) == 0)
    ball = F.when(F.col("k") == radius - 1, F.concat(F.array("v"), F.transform(bits, lambda x: F.col("v").bitwiseOR(x)))) if radius == 2 else F.array("v")
    probes = entries.select("k", "fp", F.explode(F.coalesce(ball, F.array("v"))).alias("v"))
    crowded = scratch.save(entries.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k", "v"))
    cold = entries.join(crowded, ["k", "v"], "left_anti").withColumnRenamed("fp", "b")
    met = probes.withColumnRenamed("fp", "a").join(cold, ["k", "v"]).select("a", "b")

    busy = scratch.save(probes.join(crowded, ["k", "v"], "left_semi").select("fp").union(entries.join(crowded, ["k", "v"], "left_semi").select("fp")).distinct())
    flips = F.array(*[F.lit(_signed(v)) for v in (0, *[1 << k for k in range(64)])])
    around = busy.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("key"))
    buckets = around.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    if radius == 2:
        met = met.union(buckets.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")))
    else:  # the key is one end
        met = met.union(buckets.where(F.array_contains("fps", F.col("key"))).select(F.col("key").alias("a"), F.explode("fps").alias("b")))
    return met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def _grouped(docs: DataFrame, shingle: int, radius: int, similarity: float | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of ``fingerprints``, and fp, root of every fingerprint."""
    fps = scratch.save(fingerprints(docs, shingle, similarity is not None))
    distinct = scratch.save(fps.select("fp").distinct())
    near = links(distinct, radius, scratch=scratch)
    if similarity is not None:
        near = near.union(similar_links(docs, fps, similarity, scratch))
    found = components(near, scratch)
    roots = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return fps, scratch.save(roots.select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """Groups of near-duplicate documents.

    ``docs``: doc_id, text; other columns are ignored. Returns a row per row of
    ``docs``: doc_id, fp, component_id, the smallest doc_id among all whose
    fingerprints are linked directly or through others. With ``similarity``,
    texts of such a Jaccard similarity over five-word shingles are linked too
    (a text of fewer words has no shingles there). Null and wordless texts
    share fingerprint zero and link like any other; a null doc_id is larger
    than any other; rows that repeat an id are each a row. An empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession)
    fps, roots = _grouped(docs, shingle, radius, similarity, scratch)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    ids = roots.join(least, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    of = roots.join(ids, "root").select("fp", "component_id")
    return fps.select("doc_id", "fp").join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """One row of each group of ``near_duplicates``, with the columns of
    ``docs``: the group's smallest doc_id, or a null one if it has no other. Of
    texts that repeat that id the one with the least hash stays, and of rows
    that repeat both the one whose other columns have the least hash. Groups
    of different texts without an id each keep a row."""
    scratch = Scratch(docs.sparkSession)
    fps, roots = _grouped(docs, shingle, radius, similarity, scratch)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    own = fps.groupBy("fp").agg(F.min(first).alias("first")).join(roots, "fp")
    key = lambda i, h: [i.isNull().alias("none"), F.coalesce(i, F.lit(0)).alias("id"), h.alias("h")]
    kept = own.groupBy("root").agg(F.min("first").alias("first")).select(*key(F.col("first.doc_id"), F.col("first.h")))
    # the row travels as one column, so no name of its own can clash
    others = [F.col(f"`{n}`") for n in docs.columns if n not in ("doc_id", "text")]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    rows = docs.select(*key(F.col("doc_id").cast("long"), F.xxhash64("text")), order.alias("order"), F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"))
    # dealt once by these keys, for the join and the choice among rows that repeat them
    rows = rows.join(kept, ["none", "id", "h"])
    return rows.groupBy("none", "id", "h").agg(F.min_by("row", "order").alias("row")).select("row.*")
