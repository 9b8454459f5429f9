"""Joins with pattern tables: glob rules by their literals, and one pass of
an automaton for many literal patterns."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitylens.session import Scratch, arrow_batches

_PARSED = "head string, head_n int, middle string, middle_n int, tail string, tail_n int, regex string"
#: Heads of a shape that names are looked up in before they are keyed.
HEADS = 64


def _class(body: str) -> str:
    """What ``[body]`` of a file-name pattern takes, as a regular expression."""
    none, body, parts, k = body[0] == "!", body.removeprefix("!"), [], 0
    esc = lambda c: c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}"
    while k < len(body):
        if k + 2 < len(body) and body[k + 1] == "-":
            if body[k] <= body[k + 2]:
                parts.append(f"{esc(body[k])}-{esc(body[k + 2])}")
            elif not none and not parts and body[k + 3 :]:  # as if the empty range were not there
                return _class(body[k + 3 :])
            k += 3
        else:
            parts.append(esc(body[k]))
            k += 1
    if not parts:
        return "." if none else "(?!)"
    return f"[{'^' if none else ''}{''.join(parts)}]"


def _glob(pattern: str) -> tuple:
    """A file-name pattern (``*``, ``?``, ``[abc]``, ``[!abc]``) as ``_PARSED``:
    the literals it begins and ends with, the longest one between, and the
    regular expression of the whole."""
    items, k = [], 0  # literals, stars, and what takes one character
    while k < len(pattern):
        c, k = pattern[k], k + 1
        end = pattern.find("]", k + (pattern[k : k + 1] == "!") + 1) if c == "[" else -1
        if end > 0:
            items.append(("one", _class(pattern[k:end])))
            k = end + 1
        elif c == "*":
            items += [("star", "")] if not items or items[-1][0] != "star" else []
        elif c == "?":
            items.append(("one", "."))
        elif items and items[-1][0] == "text":
            items[-1] = ("text", items[-1][1] + c)
        else:
            items.append(("text", c))
    quoted = lambda t: "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in t)
    runs = [[]]
    for kind, x in items:
        if kind == "star":
            runs.append([])
        else:
            runs[-1].append(quoted(x) if kind == "text" else x)
    runs = ["".join(r) for r in runs]
    # the first place of a stretch between two stars is as good as any, so nothing is tried twice
    regex = runs[0] + "".join(f"(?>.*?{r})" for r in runs[1:-1]) + (f".*{runs[-1]}" if len(runs) > 1 else "")
    head = items[0][1] if items and items[0][0] == "text" else ""
    tail = items[-1][1] if len(items) > 1 and items[-1][0] == "text" else ""
    between = [x for kind, x in items[bool(head) : len(items) - bool(tail)] if kind == "text"]
    middle = max(between, key=len, default="")
    return head, len(head), middle, len(middle), tail, len(tail), rf"(?s)\A{regex}\z"


def first_rule(rows: DataFrame, rules: DataFrame, name: str, pattern: str, order: str, match: str = "rule") -> DataFrame:
    """``rows`` with ``match``: the rule, as a struct, that decides about each
    row's ``name``; null if none does. A rule without ``*`` is a whole name and
    comes before all patterns, the last by ``order`` if it stands there twice; of
    patterns the first by ``order`` counts. Null names and null patterns match
    nothing; a column ``match`` of the rows is replaced.

    Names and patterns meet where all literals of a pattern that are its
    beginning, its end and the longest between agree with the name: an equality
    join on the few shapes (three lengths) that occur, verified by the pattern's
    regular expression. A name has a key for each place where a shape's middle
    can stand. Only patterns of wildcards alone meet every name, as they must."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{name}`").alias("name"))
    p = F.col("p")
    rule = F.struct(*[F.col(f"`{c}`") for c in rules.columns])
    known = rules.select(rule.alias("rule"), F.col(f"`{pattern}`").alias("p"), F.col(f"`{order}`").alias("o")).where("p is not null")
    exact = known.where(~p.contains("*")).groupBy("p").agg(F.max_by("rule", "o").alias("whole")).withColumnRenamed("p", "name")

    @F.pandas_udf(_PARSED)
    def parsed(patterns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_glob(x) for x in patterns], columns=[c.split()[0] for c in _PARSED.split(", ")])

    shape = ["head_n", "middle_n", "tail_n"]
    globs = Scratch(rows.sparkSession).save(known.where(p.contains("*")).select("rule", "o", parsed(p).alias("g")).select("rule", "o", "g.*"))
    # what a middle begins with, and the heads if they are few: names without them have no key
    begin = F.substring("middle", 1, 2)
    sets = lambda c, n: F.slice(F.collect_set(c), 1, n)
    shapes = globs.groupBy(*shape).agg(sets("head", HEADS + 1).alias("heads"), sets(begin, HEADS + 1).alias("begins")).collect()  # lengths of patterns
    names = packed.select("name").where("name is not null").distinct()

    def keys(s) -> Column:
        head, tail = F.substring("name", 1, s.head_n), F.right("name", F.lit(s.tail_n)) if s.tail_n else F.lit("")
        key = lambda middle: F.struct(*[F.lit(s[c]).alias(c) for c in shape], head.alias("head"), middle.alias("middle"), tail.alias("tail"))
        fits = F.length("name") >= s.head_n + s.middle_n + s.tail_n
        if s.head_n and len(s.heads) <= HEADS:
            fits &= head.isin(s.heads)
        if not s.middle_n:
            return F.when(fits, F.array(key(F.lit(""))))
        at = F.sequence(F.lit(s.head_n + 1), F.length("name") - s.tail_n - s.middle_n + 1)
        if len(s.begins) <= HEADS:
            at = F.filter(at, lambda k: F.substr("name", k, F.lit(min(s.middle_n, 2))).isin(s.begins))
        return F.when(fits, F.transform(F.array_distinct(F.transform(at, lambda k: F.substr("name", k, F.lit(s.middle_n)))), key))

    found = packed.select("name").where("false").select("name", F.lit(None).cast(known.schema["rule"].dataType).alias("glob"))
    if shapes:
        each = names.select("name", F.explode(F.flatten(F.array_compact(F.array(*[keys(s) for s in shapes])))).alias("key")).select("name", "key.*")
        met = each.join(globs, [*shape, "head", "middle", "tail"]).where(F.expr("name rlike regex"))
        found = met.groupBy("name").agg(F.min_by("rule", "o").alias("glob"))
    out = packed.join(exact, "name", "left").join(found, "name", "left")
    return out.select(F.col("row").withField(match, F.coalesce("whole", "glob")).alias("row")).select("row.*")


def exempted(rows: DataFrame, rules: DataFrame, linter: str, kind: str, file: str, aliases: dict[str, tuple[str, ...]], name: str = "exempt") -> DataFrame:
    """``rows`` with ``name``: whether an exemption covers each row.

    ``rules``: section, file, codes (array). The sections of a row are its
    linter, the linter's aliases and its kind, in that order; the first one that
    knows the file, by its base name before its whole path, decides: all kinds
    are exempt if it states no codes, else those it states. Entries that repeat
    count together. Rows without a file are not exempt; null names match nothing.

    Each distinct (linter, kind, file) is decided once, by equality joins."""
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{linter}`").alias("linter"), F.col(f"`{kind}`").alias("kind"), F.col(f"`{file}`").alias("file"))
    also = F.array().cast("array<string>")
    for key, names in aliases.items():
        also = F.when(F.col("linter") == key, F.array(*[F.lit(n) for n in names])).otherwise(also)
    sections = F.array_distinct(F.array_compact(F.concat(F.array("linter"), also, F.array("kind"))))
    asked = packed.select("linter", "kind", "file").where("file <> ''").distinct()
    asked = asked.select("*", F.posexplode(sections).alias("at", "section"))
    asked = asked.select("*", F.posexplode(F.array(F.substring_index("file", "/", -1), F.col("file"))).alias("by", "named"))
    known = rules.select("section", F.col("file").alias("named"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))
    known = known.groupBy("section", "named").agg(F.bool_or(F.size("codes") == 0).alias("whole"), F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
    first = asked.join(known, ["section", "named"]).groupBy("linter", "kind", "file").agg(F.min_by(F.struct("whole", "codes"), F.struct("at", "by")).alias("rule"))
    verdict = first.select(F.col("linter").alias("l"), F.col("kind").alias("k"), F.col("file").alias("f"), (F.col("rule.whole") | F.coalesce(F.array_contains("rule.codes", F.col("kind")), F.lit(False))).alias("yes"))
    out = packed.join(verdict, F.col("linter").eqNullSafe(F.col("l")) & F.col("kind").eqNullSafe(F.col("k")) & (F.col("file") == F.col("f")), "left")
    return out.select(F.col("row").withField(name, F.coalesce("yes", F.lit(False))).alias("row")).select("row.*")


#: Characters of all patterns together that an automaton may hold: it is sent to every task.
MAX_CHARS = 5_000_000


def pattern_hits(rows: DataFrame, text: str, patterns: DataFrame, pattern: str, name: str = "hits") -> DataFrame:
    """``rows`` with ``name``: an array of (pattern, n, first), the patterns that
    each row's ``text`` holds, how often (overlaps included) and where first, by
    pattern. Null texts hold nothing; null and empty patterns are left out.

    All patterns are one automaton, made once a task and run once over each
    text; what it finds goes into Arrow columns text by text. It is bounded: more
    than ``MAX_CHARS`` characters of patterns are an error."""
    import ahocorasick

    known = patterns.select(F.col(f"`{pattern}`").alias("p")).where("p <> ''").distinct()
    size = known.agg(F.sum(F.length("p")).alias("n")).first().n or 0
    if size > MAX_CHARS:
        raise ValueError(f"{size} characters of patterns; an automaton holds {MAX_CHARS}")
    spark = rows.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(sorted(r.p for r in known.collect()))  # bounded above
    kind = "array<struct<pattern: string, n: long, first: long>>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto, words = ahocorasick.Automaton(), pa.array(shared.value, pa.string())
        for k, p in enumerate(shared.value):
            auto.add_word(p, (k, len(p) - 1))
        auto.make_automaton()
        for texts in batches:
            ends, which, ns, firsts = array("i", [0]), array("i"), array("q"), array("q")
            for text in texts:
                t, seen = text.as_py(), {}
                for end, (k, before) in auto.iter(t) if t and len(auto) else ():
                    if k in seen:
                        seen[k][0] += 1
                    else:
                        seen[k] = [1, end - before]
                for k in sorted(seen):
                    which.append(k)
                    ns.append(seen[k][0])
                    firsts.append(seen[k][1])
                ends.append(len(which))
            columns = [words.take(pa.array(which, pa.int32())), pa.array(ns, pa.int64()), pa.array(firsts, pa.int64())]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["pattern", "n", "first"]))

    return rows.withColumn(name, run(F.col(f"`{text}`")))
