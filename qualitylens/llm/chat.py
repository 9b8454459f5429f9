"""Chat formatting: roles by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines whose speakers are to be recovered. Its
rows hold one turn each or, where a transcript was pasted into a row, several.
The hidden states say of a line which role speaks and whether it begins a turn
or goes on with it. What a line shows is a few discrete features: the speaker
marker it starts with, its length, whether it ends in a question; and for a
row's first line those of the row: its length, its number of lines, its end,
whether it opens the transcript. A row begins a turn; within a row a new turn
is unlikely unless a line has a marker. The model's tables are counts over
labelled turns with add-one smoothing and a least probability for markers, so
fitting is one aggregation. Viterbi finds each transcript's likeliest states,
rows are split where a turn begins, and turns are rendered with their role.

A transcript is decoded in pieces of some ``PIECE`` rows, cut by turn number
and, where many rows share one, by their text. A piece first yields its best
score from each role it is entered with to each it is left with; passes over
the pieces, ``PIECE`` of them at a time, then fix the roles at their joints,
and each piece is decoded between them. The result is that of decoding it
whole, and no task holds a transcript of unbounded length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qualitylens.llm.common import SPACE_CHARS, word_count
from qualitylens.session import Scratch

ROLES = ("assistant", "system", "user")
PIECE = 1024
#: Probability that a line within a row begins a turn, and the least ones of a
#: marker: of the own role where a turn begins, of another, and within a turn.
SPLIT, OWN_MARKER, OTHER_MARKER, INNER_MARKER = 1e-3, 0.05, 1e-5, 1e-7

#: Markers that name a speaker at the start of a turn.
MARKERS = {
    "user": ("user", "human", "question", "q", "customer"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent"),
    "system": ("system", "instruction", "instructions"),
}
_MARKER = r"^[ \t\n\x0B\f\r]*[\[<(*#]*[ ]*([A-Za-z]+)[ ]*[\]>)*]*[ ]*[:>][ \t]*"

_STRIP = {role: rf"(?i)^[ \t\n\x0B\f\r]*[\[<(*#]*[ ]*(?:{'|'.join(names)})[ ]*[\]>)*]*[ ]*[:>][ \t]*" for role, names in MARKERS.items()}

#: Number of values of each feature of a line (marker, length, question) and
#: of a row (length, lines, question, first).
LINE, ROW = (4, 8, 2), (12, 4, 2, 2)
#: States: a role begins a turn, or goes on with it.
STATES = 2 * len(ROLES)
_OF = np.arange(STATES) % len(ROLES)
_BEGINS = np.arange(STATES) < len(ROLES)


def marker_of(text: Column) -> Column:
    """0 without a known marker at the start, else 1 more than the role's place."""
    name = F.lower(F.regexp_extract(text, _MARKER, 1))
    out = F.lit(0)
    for k, role in enumerate(ROLES):
        out = F.when(name.isin(*MARKERS[role]), F.lit(k + 1)).otherwise(out)
    return out


def _packed(features: list[Column], sizes: tuple) -> Column:
    out = F.lit(0)
    for f, n in zip(features, sizes, strict=True):
        out = out * n + f.cast("int")
    return out.cast("int")


def _logs(words: Column, n: int) -> Column:
    return F.least(F.floor(F.log2(words + 1)), F.lit(n - 1))


def observed(turns: DataFrame) -> DataFrame:
    """``turns`` with the packed features of the row and of each of its lines."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    row = [_logs(word_count(text), ROW[0]), F.least(F.size(lines) - 1, F.lit(ROW[1] - 1)), F.rtrim(text).endswith("?"), F.coalesce("turn", F.lit(0)) <= 0]
    line = lambda x: _packed([marker_of(x), _logs(word_count(x), LINE[1]), F.rtrim(x).endswith("?")], LINE)
    return turns.select("*", _packed(row, ROW).alias("f_row"), F.transform(lines, line).alias("f_lines"))


def _unpacked(code: np.ndarray, sizes: tuple) -> list[np.ndarray]:
    out = []
    for n in reversed(sizes):
        out.append(code % n)
        code = code // n
    return out[::-1]


class Model:
    """Logarithms of the probabilities, tables of a fixed size.

    ``start``, ``move``: of the roles. ``row``: of each feature of a row, by
    role. ``line``: of each feature of a line, by state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, row: list, line: list):
        share = lambda x: (x + 1) / (x + 1).sum(axis=-1, keepdims=True)
        roles = len(ROLES)
        self.start = np.where(_BEGINS, np.log(share(start))[_OF], -np.inf)
        to = np.log(share(move))
        # to a beginning from any state of a role; on from the same role alone
        self.move = np.where(_BEGINS[None, :], to[_OF][:, _OF], np.where(_OF[:, None] == _OF[None, :], 0.0, -np.inf))
        self.row = [np.log(share(x)) for x in row]
        marker = share(line[0])
        least = np.full(marker.shape, INNER_MARKER)
        least[:roles] = OTHER_MARKER
        least[np.arange(roles), 1 + np.arange(roles)] = OWN_MARKER
        marker[:, 1:] = np.where(line[0][:, 1:] > 0, np.maximum(marker, least)[:, 1:], least[:, 1:])
        self.line = [np.log(marker), *[np.log(share(x)) for x in line[1:]]]

    def scores(self, row: np.ndarray, line: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row per line, a column per state. ``row``: packed features of the
        rows, ``line``: of the lines, ``first``: whether a line is a row's first."""
        out = sum(e[:, f].T for e, f in zip(self.line, _unpacked(line, LINE), strict=True))
        of_row = sum(e[:, f].T for e, f in zip(self.row, _unpacked(row, ROW), strict=True))
        at = np.flatnonzero(first)
        out[at] += np.where(_BEGINS, of_row[:, _OF], -np.inf)
        out[~first] += np.where(_BEGINS, np.log(SPLIT), np.log1p(-SPLIT))
        return out


def train(turns: DataFrame) -> Model:
    """Count over all turns with a known role (conv_id, turn, role, text): a
    fixed number of cells reaches the driver. A turn's first line begins it and
    the others go on. A turn follows the turn numbered one less; of turns that
    repeat a number the least role counts."""
    roles = len(ROLES)
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) - 1
    known = observed(turns.where(F.col("role").isin(*ROLES)).select("conv_id", "turn", "text", role.cast("int").alias("r")))
    seen = known.select("r", F.lit(-1).alias("s"), F.col("f_row").alias("f")).union(
        known.select("r", F.posexplode("f_lines").alias("k", "f")).select("r", F.when(F.col("k") == 0, F.col("r")).otherwise(F.col("r") + roles), "f")
    )
    first = known.groupBy("conv_id", "turn").agg(F.min("r").alias("r"))
    before = first.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("r").alias("before"))
    moves = first.join(before, ["conv_id", "turn"], "left").groupBy("before", "r").count()
    start, move = np.zeros(roles), np.zeros((roles, roles))
    for x in moves.collect():
        if x.before is None:
            start[x.r] += x["count"]
        else:
            move[x.before, x.r] += x["count"]
    row, line = [np.zeros((roles, n)) for n in ROW], [np.zeros((STATES, n)) for n in LINE]
    for x in seen.groupBy("r", "s", "f").count().collect():
        for table, sizes, at in [(row, ROW, x.r)] if x.s < 0 else [(line, LINE, x.s)]:
            for t, v in zip(table, _unpacked(np.array([x.f]), sizes), strict=True):
                t[at, v[0]] += x["count"]
    return Model(start, move, row, line)


def viterbi(start: np.ndarray, move: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score of every state at the end, and each line's best predecessors;
    ``start``: scores of the first line's states before it is seen."""
    best, back = start + scores[0], np.zeros(scores.shape, np.int64)
    for t in range(1, len(scores)):
        step = best[:, None] + move
        back[t] = step.argmax(axis=0)
        best = step.max(axis=0) + scores[t]
    return best, back


def trace(back: np.ndarray, last: int) -> list[int]:
    """The states that lead to state ``last`` at the end."""
    out = [last]
    for t in range(len(back) - 1, 0, -1):
        out.append(int(back[t][out[-1]]))
    return out[::-1]


def chain(pieces: list[np.ndarray]) -> np.ndarray:
    """Max-plus product: best score through all pieces, from each state to each."""
    out = pieces[0]
    for m in pieces[1:]:
        out = (out[:, :, None] + m[None]).max(axis=1)
    return out


def joints(pieces: list[np.ndarray], before: np.ndarray, last: int) -> list[int]:
    """The last state of every piece. ``before``: a score per state before the
    first piece, ``last``: the state after the last one, or -1."""
    best, backs = before, []
    for m in pieces:
        step = best[:, None] + m
        backs.append(step.argmax(axis=0))
        best = step.max(axis=0)
    out = [int(best.argmax()) if last < 0 else last]
    for back in reversed(backs[1:]):
        out.append(int(back[out[-1]]))
    return out[::-1]


_NONE = -(1 << 63)


def _lines_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed features of rows and lines, and which lines are a row's first."""
    size = frame["f_lines"].map(len).to_numpy()
    line = np.concatenate(frame["f_lines"].tolist()).astype(np.int64)
    first = np.zeros(len(line), bool)
    first[np.cumsum(size) - size] = True
    return frame["f_row"].to_numpy().astype(np.int64), line, first


def through(model: Model, scores: np.ndarray) -> np.ndarray:
    """Best score of a piece by the state before it (row) and its last state;
    of a transcript's first piece the rows are all as at a start."""
    return np.stack([viterbi(model.move[s], model.move, scores)[0] for s in range(STATES)])


def decode_many(model: Model, scores: np.ndarray, start: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Viterbi over many pieces at once. ``scores``: a row per line, pieces one
    after the other from ``start``; ``before``, ``last``: the state before a
    piece and its last state, or -1. Pieces of like length go together."""
    size = np.diff(np.append(start, len(scores)))
    out = np.zeros(len(scores), np.int32)
    first = np.concatenate([model.move, model.start[None]])  # row -1: nothing before
    kind = np.ceil(np.log2(size))
    for bits in np.unique(kind):
        own = np.flatnonzero(kind == bits)
        own = own[np.argsort(-size[own], kind="stable")]
        n, longest = size[own], int(size[own].max())
        best = first[before[own]] + scores[start[own]]
        back = np.zeros((longest, len(own), STATES), np.int8)
        for t in range(1, longest):
            k = int(np.searchsorted(-n, -t, side="left"))  # pieces longer than t
            step = best[:k, :, None] + model.move[None]
            back[t, :k] = step.argmax(axis=1)
            best[:k] = step.max(axis=1) + scores[start[own[:k]] + t]
        state = np.where(last[own] >= 0, last[own], best.argmax(axis=1))
        for t in range(longest - 1, -1, -1):
            k = int(np.searchsorted(-n, -t, side="left"))
            out[start[own[:k]] + t] = state[:k]
            if t:
                state[:k] = back[t, np.arange(k), state[:k]]
    return out


def _joints(found: DataFrame, model, width: int, scratch: Scratch) -> DataFrame:
    """c, p, before, last of every piece (c, p, m: its ``through``), p counting
    from 0: ``width`` pieces at a time are one at the next level."""
    spark = found.sparkSession
    schema = "c long, p long, before int, last int"

    def fix(frame: pd.DataFrame, before: int, last: int) -> pd.DataFrame:
        frame = frame.sort_values("p")
        pieces = [np.array(x).reshape(STATES, STATES) for x in frame["m"]]
        m = model.value
        if before < 0:  # the first piece of all: as at a start
            entry = np.zeros(STATES)
        else:
            entry = np.where(np.arange(STATES) == before, 0.0, -np.inf)
        ends = joints(pieces, entry, last)
        return pd.DataFrame({"c": frame["c"].to_numpy(), "p": frame["p"].to_numpy(), "before": [before, *ends[:-1]], "last": ends})

    def together(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p")
        return pd.DataFrame({"c": [key[0]], "p": [key[1]], "m": [chain([np.array(x).reshape(STATES, STATES) for x in frame["m"]]).ravel().tolist()]})

    over = F.floor(F.col("p") / width).alias("up")
    if not found.where(F.col("p") >= width).limit(1).count():
        return found.groupBy("c").applyInPandas(lambda f: fix(f, -1, -1), schema)
    upper = scratch.save(found.select("*", over).groupBy("c", "up").applyInPandas(together, "c long, p long, m array<double>"))
    ends = _joints(upper, model, width, scratch).select("c", F.col("p").alias("up"), "before", "last")
    ends = scratch.save(ends)
    each = found.select("*", over).join(ends, ["c", "up"])
    return each.groupBy("c", "up").applyInPandas(lambda f: fix(f, int(f["before"].iloc[0]), int(f["last"].iloc[0])), schema)


def decode(turns: DataFrame, model: Model, piece: int = PIECE) -> DataFrame:
    """The recovered turns of every row, as they are rendered.

    ``turns``: conv_id, turn, text; other columns, a role among them, are
    ignored. Returns a row per recovered turn: conv_id, turn, part (its place
    in the row, from 0), recovered, rendered: the role's tag, the text without
    outer white space and without a marker of that role at its start, and an
    end tag. A marker of another role stays, so no text is lost.

    A null text is an empty line; null turn numbers come first; each row
    without a conv_id is a transcript of its own; rows that repeat a transcript,
    number and text are one turn and each get its answer; different texts of a
    number are ordered by their hash; long texts count whole; an empty table
    gives no rows.
    """
    scratch = Scratch(turns.sparkSession)
    shared = turns.sparkSession.sparkContext.broadcast(model)  # a fixed number of cells
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    # nulls travel as flags, since numbers with nulls would turn into floats
    flags = conv.isNull().cast("int") + 2 * turn.isNull().cast("int")
    key = ["nulls", "c", "t", "h"]
    keys = [flags.alias("nulls"), F.coalesce(conv, F.lit(_NONE)).alias("c"), F.coalesce(turn, F.lit(_NONE)).alias("t"), F.xxhash64("text").alias("h")]
    seen = observed(turns.select(*keys, turn.alias("turn"), "text"))
    seen = seen.groupBy(*key).agg(F.first("f_row").alias("f_row"), F.first("f_lines").alias("f_lines")).withColumn("a", F.floor(F.col("t") / piece))
    seen = scratch.save(seen)
    # A piece is a block of turn numbers. In a block with too many rows each number is a
    # piece of its own, and a number with too many is cut into ranges of hashes.
    numbers = seen.where("nulls % 2 = 0").groupBy("c", "a", "t").agg(F.count("*").alias("n"))
    crowded = numbers.groupBy("c", "a").agg(F.sum("n").alias("all")).where(F.col("all") > piece).select("c", "a")
    cuts = scratch.save(numbers.join(crowded, ["c", "a"]).select("c", "a", "t", F.ceil(F.col("n") / piece).alias("cuts")))
    high = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(_NONE)), 33)  # of 31 bits, in the order of h
    alone = F.col("nulls") % 2 == 1
    rows = seen.join(cuts, ["c", "a", "t"], "left").select(
        *key, "f_row", "f_lines", "a",
        F.when(F.col("cuts").isNotNull(), F.col("t")).otherwise(F.lit(_NONE)).alias("b"),
        F.when(alone, F.col("h")).otherwise(F.shiftright(high * F.coalesce("cuts", F.lit(1)), 31)).alias("s"),
    )
    rows = scratch.save(rows)
    by, order = ["c", "a", "b", "s"], ["t", "h"]
    pieces = rows.where(~alone).select(*by).distinct()
    several = pieces.groupBy("c").count().where("count > 1").select("c")
    numbered = pieces.join(several, "c").withColumn("p", F.row_number().over(W.partitionBy("c").orderBy("a", "b", "s")).cast("long") - 1)
    numbered = scratch.save(numbered)

    def matrices(key, frame: pd.DataFrame) -> pd.DataFrame:
        m, s = shared.value, shared.value.scores(*_lines_of(frame.sort_values(order)))
        table = through(m, s) if key[1] else np.tile(viterbi(m.start, m.move, s)[0], (STATES, 1))
        return pd.DataFrame({"c": [key[0]], "p": [key[1]], "m": [table.ravel().tolist()]})

    split = rows.where(~alone).join(numbered, by).select("c", "p", *order, "f_row", "f_lines")
    found = scratch.save(split.groupBy("c", "p").applyInPandas(matrices, "c long, p long, m array<double>"))
    joint = numbered.join(_joints(found, shared, max(4, piece), scratch), ["c", "p"]).select(*by, "before", "last")
    joint = scratch.save(joint)

    def states(frames):
        """Whole pieces, many at a time; a batch's last piece waits for the next batch."""
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            last = (f[by] == f[by].iloc[-1]).all(axis=1)
            f, rest = f[~last], f[last]
            if len(f):
                yield decoded(f)
        if rest is not None and len(rest):
            yield decoded(rest)

    def decoded(f: pd.DataFrame) -> pd.DataFrame:
        k = f[by].to_numpy()
        fresh = np.r_[True, (k[1:] != k[:-1]).any(axis=1)] | (f["nulls"].to_numpy() % 2 == 1)
        row, line, first = _lines_of(f)
        at = np.flatnonzero(first)
        path = decode_many(shared.value, shared.value.scores(row, line, first), at[fresh], f["before"].to_numpy()[fresh], f["last"].to_numpy()[fresh])
        return pd.DataFrame({**{c: f[c].to_numpy() for c in key}, "states": np.split(path, at[1:])})

    whole = rows.join(joint, by, "left").na.fill(-1, ["before", "last"])
    whole = whole.repartition(*by).sortWithinPartitions(*by, *order)
    out = whole.mapInPandas(states, "nulls int, c long, t long, h long, states array<int>")
    out = turns.select(*keys, "text").join(out, key)

    begins = F.filter(F.sequence(F.lit(0), F.size("states") - 1), lambda k: F.get("states", k) < len(ROLES))
    out = out.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n")).withColumn("at", begins)
    ends = F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("lines")))
    out = out.select("nulls", "c", "t", "lines", "states", F.posexplode(F.arrays_zip(F.col("at").alias("low"), ends.alias("high"))).alias("part", "span"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.get("states", F.col("span.low")) + 1)
    text = F.array_join(F.slice("lines", F.col("span.low") + 1, F.col("span.high") - F.col("span.low")), "\n")
    body = F.lit(None).cast("string")
    for r in ROLES:
        body = F.when(F.col("recovered") == r, F.regexp_replace(F.col("body"), _STRIP[r], "")).otherwise(body)
    out = out.select("nulls", "c", "t", "part", role.alias("recovered"), text.alias("body"))
    rendered = F.concat(F.lit("<|"), F.col("recovered"), F.lit("|>\n"), F.btrim(body, F.lit(SPACE_CHARS)), F.lit("\n<|end|>"))
    return out.select(
        F.when(F.col("nulls") % 2 == 0, F.col("c")).alias("conv_id"), F.when(F.col("nulls") < 2, F.col("t")).alias("turn"), "part", "recovered", rendered.alias("rendered")
    )
