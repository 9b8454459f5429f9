"""URL filters: rules by host and path, gradient-boosted trees for the rest.

All is DataFrame expressions and Spark's own tree learner. A rule such as
``example.org/en/`` fits its host and all subdomains where the path starts
with the rule's; the longest rule that fits decides. URLs that rules decide
are the labelled ones: boosted trees learn from a bounded sample of them, on
lexical features and on statistics of host suffixes over all URLs, and judge
the URLs that no rule fits.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylens.session import Scratch

#: The rules of the query.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Bound on the labelled URLs that the trees learn from, those with the least hash.
MAX_TRAIN = 20_000
#: Parts of the labelled URLs for the out-of-fold suffix statistic.
FOLDS = 5
FEATURES = [
    "f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_host_length", "f_labels",
    "f_host_digits", "f_hyphens", "f_secure", "f_fragment", "f_suffix_share", "f_suffix_block",
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty for null or without it."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, path).otherwise(F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct (n, rule, verdict), or null; of
    equally long ones the greatest."""
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        ok = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty one."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def features(pages: DataFrame) -> DataFrame:
    """Lexical features of (page_id, url, host, path); null urls count as empty."""
    url, n = F.coalesce("url", F.lit("")), F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    columns = {
        "f_length": F.length(url),
        "f_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "f_digits": _digits(url) / n,
        "f_entropy": entropy(url),
        "f_params": F.when(query == "", F.lit(0)).otherwise(_count(query, "&") + 1),
        "f_host_length": F.length("host"),
        "f_labels": F.size(F.split("host", r"\.")),
        "f_host_digits": _digits(F.col("host")),
        "f_hyphens": _count(F.col("host"), "-"),
        "f_secure": url.startswith("https://").cast("int"),
        "f_fragment": url.contains("#").cast("int"),
        # the last label of the host with the first step of the path
        "suffix": F.concat(F.substring_index("host", ".", -1), F.lit("/"), F.element_at(F.split(F.concat("path", F.lit("//")), "/"), 2)),
    }
    return pages.select("*", *[(v if k == "suffix" else v.cast("double")).alias(k) for k, v in columns.items()])


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, max_train: int = MAX_TRAIN, trees: int = 20, seed: int = 1, teach: Column | None = None) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages`` (page_id, url;
    other columns are ignored).

    Returns page_id, host, path, rule (or null), verdict, p_block (the trees'
    probability, whoever decides). ``teach`` limits the labelled rows that the
    trees and statistics learn from, to hold some out. Null urls and urls without ``://`` have an empty host and
    path and so fit no rule; urls of any length count whole; a null page_id
    stays null; rows that repeat are each judged. Without labelled urls of
    both kinds all that no rule fits is allowed. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    label = (F.col("best.verdict") == "block").cast("double")
    rows = rows.withColumn("label", label if teach is None else F.when(teach, label))
    rows = scratch.save(features(rows))

    # A suffix's share of blocked urls. A labelled url's own fold is left out, so that the
    # statistic never holds the label that it helps to learn; equal urls share a fold.
    fold = F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64(F.lower(F.coalesce("url", F.lit("")))), F.lit(FOLDS)).cast("int")).otherwise(FOLDS)
    rows = rows.withColumn("fold", fold)
    by_fold = rows.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked"))
    by_fold = scratch.save(by_fold)
    whole = by_fold.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "known", "blocked")])
    total = by_fold.agg(F.sum("n").alias("rows"), F.sum("known").alias("labels"), F.sum("blocked").alias("blocks"))
    prior = (F.col("blocks") + 1) / (F.col("labels") + 2)
    others = lambda c: F.col(f"all_{c}") - F.when(F.col("fold") == FOLDS, 0).otherwise(F.col(c))
    # one row of totals; suffixes are few next to the urls, and the planner picks the join by their size
    stats = by_fold.join(whole, "suffix").crossJoin(F.broadcast(total)).select(
        "suffix",
        "fold",
        (F.col("all_n") / F.col("rows")).alias("f_suffix_share"),
        ((others("blocked") + 10 * prior) / (others("known") + 10)).alias("f_suffix_block"),
    )
    rows = scratch.save(rows.join(scratch.save(stats), ["suffix", "fold"]))

    decided = rows.where("label is not null")
    sample = decided.orderBy(F.xxhash64("url", "page_id"), "page_id").limit(max_train).select("label", *FEATURES)
    sample = scratch.save(sample)
    kinds = sample.agg(F.sum("label"), F.count("label")).first()
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if kinds[1] and 0 < kinds[0] < kinds[1]:
        model = GBTClassifier(maxIter=trees, maxDepth=4, stepSize=0.3, subsamplingRate=0.8, maxBins=32, seed=seed).fit(assemble.transform(sample))
        rows = model.transform(assemble.transform(rows)).withColumn("p", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("p", F.lit(0.0))
    guess = F.when(F.col("p") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", guess).alias("verdict"),
        F.col("p").alias("p_block"),
    )
