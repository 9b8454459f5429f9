"""Version specifiers as PEP 440 defines them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = re.compile(
    r"\s*v?(?:(?P<epoch>\d+)!)?(?P<release>\d+(?:\.\d+)*)(?:[-_.]?(?P<pre>alpha|beta|preview|pre|a|b|c|rc)[-_.]?(?P<pre_n>\d*))?"
    r"(?:-(?P<post_0>\d+)|[-_.]?(?P<post>post|rev|r)[-_.]?(?P<post_n>\d*))?(?:[-_.]?(?P<dev>dev)[-_.]?(?P<dev_n>\d*))?(?:\+(?P<local>[a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*",
    re.IGNORECASE,
)
_CLAUSE = re.compile(r"\s*(===|==|!=|<=|>=|~=|<|>)\s*(.*?)\s*", re.DOTALL)
_PRE = {"alpha": "a", "beta": "b", "c": "rc", "pre": "rc", "preview": "rc"}
_LAST = (9,)


class Version:
    """The parts of a version, and a key that orders versions."""

    def __init__(self, text: str):
        m = _VERSION.fullmatch(text)
        if not m:
            raise ValueError(text)
        number = lambda s: int(s or 0)
        self.release = tuple(map(int, m["release"].split(".")))
        self.epoch = number(m["epoch"])
        self.pre = (_PRE.get(p := m["pre"].lower(), p), number(m["pre_n"])) if m["pre"] else None
        self.post = number(m["post_0"] or m["post_n"]) if m["post"] or m["post_0"] else None
        self.dev = number(m["dev_n"]) if m["dev"] else None
        self.local = tuple((1, int(p), "") if p.isdigit() else (0, 0, p.lower()) for p in re.split("[-_.]", m["local"])) if m["local"] else ()

    def padded(self, n: int) -> tuple:
        return (self.epoch, *self.release, *[0] * (n - len(self.release)))

    @property
    def public(self) -> tuple:
        release = self.release
        while len(release) > 1 and not release[-1]:
            release = release[:-1]
        # a development release of a final one comes before its pre-releases
        pre = (0, *self.pre) if self.pre else ((-1,) if self.post is None and self.dev is not None else _LAST)
        return (self.epoch, release, pre, -1 if self.post is None else self.post, (1, 0) if self.dev is None else (0, self.dev))

    @property
    def base(self) -> tuple:
        return Version(f"{self.epoch}!{'.'.join(map(str, self.release))}").public

    @property
    def early(self) -> bool:
        return self.pre is not None or self.dev is not None


def _prefixed(v: Version, prefix: str) -> bool:
    p = Version(prefix)
    n = len(p.release)
    if p.pre or p.post is not None:
        return v.padded(n)[: n + 1] == p.padded(n) and (v.pre, v.post if p.post is not None else None) == (p.pre, p.post)
    return v.padded(n)[: n + 1] == p.padded(n)


def _clause(v: Version, text: str, op: str, bound: str) -> bool:
    if op == "===":
        return text.strip().lower() == bound.lower()
    if op in ("==", "!=") and bound.endswith(".*"):
        return _prefixed(v, bound[:-2]) == (op == "==")
    b = Version(bound)
    if op in ("==", "!="):
        same = v.public == b.public and (not b.local or v.local == b.local)
        return same == (op == "==")
    if op == "~=":
        if len(b.release) < 2:
            raise ValueError(bound)
        return v.public >= b.public and _prefixed(v, f"{b.epoch}!{'.'.join(map(str, b.release[:-1]))}")
    if op in ("<=", ">="):
        return v.public <= b.public if op == "<=" else v.public >= b.public
    same = v.base == b.base
    if op == "<":  # not a pre-release of the bound itself
        own = same and (b.post is None or (v.pre, v.post) == (None, b.post))
        return v.public < b.public and (b.early or not v.early or not own)
    # not a post-release of the bound itself
    own = same and v.pre == b.pre and b.dev is None and b.post is None
    return v.public > b.public and (v.post is None or not own)


def fits(version: str | None, specifier: str, prereleases: bool = False) -> bool:
    """Whether a version is within all clauses; pre-releases only if wanted or
    named in a clause; an empty specifier takes all releases. What does not
    parse is not within."""
    try:
        clauses = [m.groups() for part in specifier.split(",") if part.strip() for m in [_CLAUSE.fullmatch(part)] if m or _raise(part)]
        named = any(op not in ("!=", "<", ">") and _VERSION.fullmatch(b.removesuffix(".*")) and Version(b.removesuffix(".*")).early for op, b in clauses)
        if all(op == "===" for op, _ in clauses) and clauses:
            return all(_clause(None, version, op, b) for op, b in clauses)
        v = Version(version)
        return (prereleases or named or not v.early) and all(_clause(v, version, op, b) for op, b in clauses)
    except (TypeError, ValueError, AttributeError):
        return False


def _raise(part: str):
    raise ValueError(part)


def satisfies(version: Column, specifier: str, prereleases: bool = False) -> Column:
    """``fits`` for a column, in Arrow batches; each distinct version once a batch."""

    @F.pandas_udf("boolean")
    def run(versions: pd.Series) -> pd.Series:
        known = {v: fits(v, specifier, prereleases) for v in versions.unique()}
        return versions.map(known).astype(bool)

    return run(version)
