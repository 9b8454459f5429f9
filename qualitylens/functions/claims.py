"""Claims: sentences that state, justify or delimit a theory, scored by facet.

A sentence scores the weights of the patterns that it matches: those of every
facet and those of its own. One or more makes it a likely claim.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

FACETS = ("core_theory", "problem_solving", "alignment", "architecture", "anti_patterns", "abstractions")
#: What counts as white space, in Java's regex and in RE2 alike.
BLANK = r"[\t\n\x0B\f\r ]"
_COST = r"(?i)\b(?:O\(n|quadratic|exponential|vectori[sz]|batch|performance|latency|throughput)\b"

# Facet (None: all), weight, pattern.
RULES = (
    (None, 1, r"(?i)\b(?:because|since|therefore|thus|hence|so that)\b"),
    (None, 1, r"(?i)\b(?:rather than|instead of|not by|unlike)\b"),
    (None, 1, r"(?i)\b(?:key|core|fundamental|central|critical|essential)\b"),
    (None, 1, r"(?i)\b(?:emerges?|enables?|ensures?|provides?|demonstrates?)\b"),
    ("core_theory", 2, r"(?i)\b(?:is defined as|we define|the definition)\b"),
    ("core_theory", 1, r"(?i)\b(?:theory|principle|axiom|invariant|postulate)\b"),
    ("core_theory", 2, r"(?i)\b(?:we hypothesize|hypothesis|conjecture|research question)\b"),
    ("core_theory", 1, r"(?i)this (?:work|project|research) (?:address|test|investigat|explor)"),
    ("problem_solving", 2, r"(?i)\b(?:easier|better|tractable|efficient|guided)\b.*\b(?:than|over|compared)\b"),
    ("problem_solving", 1, r"(?i)\btransform.*(?:into|to)\b"),
    ("problem_solving", 1, r"(?i)\b(?:scan|parse|split|classif|extract|deduplicat|score|report)\w*\b"),
    ("problem_solving", 1, r"(?i)\b(?:step|phase|pipeline|workflow|process)\b"),
    ("problem_solving", 1, r"(?i)\b(?:first|then|next|finally)\b"),
    ("problem_solving", 2, r"\*\*Lesson"),
    ("problem_solving", 1, r"(?i)the (?:fix|solution|workaround) was"),
    ("alignment", 2, r"(?i)\b(?:ruin|break|destroy|undermine|bypass)\b"),
    ("alignment", 1, r"(?i)\b(?:proper|correct|aligned|right way)\b"),
    ("alignment", 1, r"(?i)\b(?:goal|purpose|point) is\b"),
    ("alignment", 2, r"(?i)\b(?:non[- ]?goal|not a goal|out of scope)\b"),
    ("alignment", 1, r"(?i)\b(?:primary|secondary) objective\b"),
    ("architecture", 2, r"(?i)\bwhy\b.*\b(?:not|over|instead|rather)\b"),
    ("architecture", 1, r"(?i)\b(?:design|chose|decided|tradeoff|trade-off)\b"),
    ("architecture", 2, r"\*\*Rationale\*\*"),
    ("architecture", 1, r"(?i)\b(?:decompos|modular|separation of concerns|drop[- ]?in)\b"),
    ("architecture", 1, _COST),
    ("anti_patterns", 2, r"(?i)\b(?:will|would|can|could)\s+(?:ruin|break|destroy|fail)\b"),
    ("anti_patterns", 1, r"(?i)\b(?:black.?box|monolith|hard.?cod|ad.?hoc|hack|workaround)\b"),
    ("anti_patterns", 1, r"(?i)\b(?:trying harder|premature|overfitting|scope creep)\b"),
    ("anti_patterns", -2, r"(?i)provides|channel|linter|tier|analysis"),
    ("anti_patterns", -1, r"(?i)\b(?:provides|returns|supports|contains|includes)\b"),
    ("abstractions", 2, r"(?i)\b(?:we (?:call|define|term)|is called|known as|refers to)\b"),
    ("abstractions", 1, r"\*\*\w+(?:\s+\w+){0,3}\*\*"),
)

#: For each rule, by its place: words in lower case of which a sentence that matches has one at least,
#: at a word's start if the pattern begins with one.
NEEDS = (
    ("because", "since", "therefore", "thus", "hence", "so that"),
    ("rather than", "instead of", "not by", "unlike"),
    ("key", "core", "fundamental", "central", "critical", "essential"),
    ("emerge", "enable", "ensure", "provide", "demonstrate"),
    ("is defined as", "we define", "the definition"),
    ("theory", "principle", "axiom", "invariant", "postulate"),
    ("hypothes", "conjecture", "research question"),
    ("this work", "this project", "this research"),
    ("easier", "better", "tractable", "efficient", "guided"),
    ("transform",),
    ("scan", "parse", "split", "classif", "extract", "deduplicat", "score", "report"),
    ("step", "phase", "pipeline", "workflow", "process"),
    ("first", "then", "next", "finally"),
    ("**lesson",),
    ("the fix was", "the solution was", "the workaround was"),
    ("ruin", "break", "destroy", "undermine", "bypass"),
    ("proper", "correct", "aligned", "right way"),
    ("goal is", "purpose is", "point is"),
    ("nongoal", "non-goal", "non goal", "not a goal", "out of scope"),
    ("primary objective", "secondary objective"),
    ("why",),
    ("design", "chose", "decided", "tradeoff", "trade-off"),
    ("**rationale**",),
    ("decompos", "modular", "separation of concerns", "drop"),
    ("o(n", "quadratic", "exponential", "vectori", "batch", "performance", "latency", "throughput"),
    ("ruin", "break", "destroy", "fail"),
    ("black", "monolith", "hard", "ad", "hack", "workaround"),
    ("trying harder", "premature", "overfitting", "scope creep"),
    ("provides", "channel", "linter", "tier", "analysis"),
    ("provides", "returns", "supports", "contains", "includes"),
    ("we call", "we define", "we term", "is called", "known as", "refers to"),
    ("**",),
)


def _any(bound: bool) -> str:
    """A pattern of the needs of rules that add to a score, dealt by first
    letter: of those whose patterns begin at a word's start, or of the others."""
    needs = sorted({w for (_, n, p), words in zip(RULES, NEEDS, strict=True) if n > 0 and p.startswith(r"(?i)\b") == bound for w in words})
    letters = {re.escape(c): "|".join(re.escape(w[1:]) for w in words) for c, words in groupby(needs, key=lambda w: w[0])}
    return r"(?i)" + (r"\b" if bound else "") + f"(?=[{''.join(letters)}])(?:" + "|".join(f"{c}(?:{rest})" for c, rest in letters.items()) + ")"


def may_claim(sentence: Column) -> Column:
    """False only for sentences that no rule adds to, whose scores are 0 or
    less: two patterns in place of all."""
    return sentence.rlike(_any(True)) | sentence.rlike(_any(False))


def sentences(text: Column) -> Column:
    """The sentences of a text: paragraphs, but for tables and checklists, cut
    after ``.``, ``!`` or ``?`` before a capital A to Z. Single line ends are
    spaces. A null text has null, an empty one none."""
    joined = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    paragraphs = F.transform(F.split(joined, rf"\n{BLANK}*\n"), lambda p: F.btrim(p, F.lit("\t\n\x0b\f\r ")))
    kept = F.filter(paragraphs, lambda p: (p != "") & ~p.startswith("|") & ~p.startswith("- ["))
    return F.flatten(F.transform(kept, lambda p: F.split(p, rf"(?<=[.!?]){BLANK}+(?=[A-Z])")))


def claim_scores(sentence: Column) -> Column:
    """An array of (facet, score), one for each of ``FACETS``: the weights of
    the patterns that a sentence matches, summed; each pattern is tried once,
    and only on a sentence that has a word of its ``NEEDS``. A null sentence
    scores 0."""

    def hits(low: Column) -> Column:
        has = lambda words: reduce(or_, [low.contains(w) for w in words])
        return F.array(*[F.when(has(words) & sentence.rlike(pattern), weight).otherwise(0) for (_, weight, pattern), words in zip(RULES, NEEDS, strict=True)])

    def of(h: Column) -> Column:
        total = lambda f: sum((h[k] for k, (of, _, _) in enumerate(RULES) if of in (None, f)), F.lit(0))
        return F.array(*[F.struct(F.lit(f).alias("facet"), total(f).alias("score")) for f in FACETS])

    return F.transform(F.transform(F.array(F.lower(sentence)), hits), of)[0]
