"""Signatures of shell commands and of error texts, and what a command intends."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Commands that only start others.
WRAPPERS = ["uv run", "python -m", "python3 -m", "env", "sudo", "nohup", "time", "nice"]
#: What looks like a secret (whatever its case), and an absolute path
#: of three parts or more, of which the last one counts.
SECRET = r"[A-Za-z0-9+/]{40,}|[0-9a-f]{32,}|(?:sk|pk|token|key|secret|password|auth)[_-]?\w{8,}"
PATH = r"/(?:[\p{L}\p{N}_.-]+/){2,}([\p{L}\p{N}_.-]+)"
#: Lines that say no more than a status, and times to leave out.
STATUS = r"(?i)^(?:exit(?:[_ ]?(?:code|status))?|status)\s*[:=]?\s*[0-9]+\s*$"
TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[.0-9]*\s*"
MARK = r"\[[0-9]+[:.][0-9]+\]\s*"
#: The intent of a signature, else of a binary.
SIGNATURE_INTENTS = """
git:status inspect, git:log inspect, git:diff verify, git:show inspect, git:branch inspect, git:add modify, git:commit modify,
git:push execute, git:pull execute, git:checkout modify, git:merge execute, git:rebase execute, python:test verify, python:pytest verify,
hfsplus:ls inspect, hfsplus:cat inspect, hfsplus:rootfs inspect"""
BINARY_INTENTS = """
pytest verify, python execute, ruff verify, mypy verify, flake8 verify, black modify, isort modify, cat inspect, ls inspect, head inspect,
tail inspect, wc inspect, file inspect, stat inspect, diff verify, md5sum verify, sha256sum verify, xxd inspect, hexdump inspect,
strings inspect, find inspect, du inspect, readlink inspect, which inspect, type inspect, command inspect, test verify, echo inspect,
mkdir modify, cp modify, mv modify, rm modify, touch modify, chmod modify, chown modify, sed modify, awk modify, tee modify,
pip execute, uv execute, npm execute, yarn execute, make execute, docker execute, curl execute, wget execute, git meta"""

_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"
_SECRET = re.compile(SECRET, re.IGNORECASE)
_PATH = re.compile(r"/(?:[\w.-]+/){2,}([\w.-]+)")
_PREFIXES = [w.split() for w in WRAPPERS]


def signature_of(command: str | None) -> str:
    """binary:argument of one command line."""
    try:
        words = shlex.split(command or "")
    except ValueError:  # an open quote
        words = command.split()
    while prefix := next((p for p in _PREFIXES if words[: len(p)] == p), None):
        words = words[len(prefix) :]
        while prefix == ["env"] and words and "=" in words[0]:
            words = words[1:]
    if not words:
        return "unknown:unknown"
    plain = (_PATH.sub(r"\1", w) for w in words[1:] if not w.startswith("-") and not _SECRET.search(w))
    stems = (w.rpartition(".")[0] if "." in w else w for w in plain)
    return f"{words[0].rpartition('/')[2][:30]}:{next(filter(None, stems), 'default')[:30]}"


def command_signature(command: Column) -> Column:
    """binary:argument of each command: quotes are read as a shell reads them;
    wrappers, flags, secrets, folders and extensions are left out. In Arrow batches."""

    @F.pandas_udf("string")
    def run(commands: pd.Series) -> pd.Series:
        return commands.map(signature_of)

    return run(command)


def intent(signature: Column) -> Column:
    """What a signature is for: by the whole of it, else by its binary, else ``execute``."""
    known = lambda text: F.create_map(*[F.lit(x) for pair in text.split(",") for x in pair.split()])
    binary = F.split(signature, ":")[0]
    return F.coalesce(known(SIGNATURE_INTENTS)[signature], known(BINARY_INTENTS)[binary], F.lit("execute"))


def error_signature(text: Column) -> Column:
    """The last line that says something, without folders and times, at most 200
    characters; empty if there is none. Built-in functions only."""
    strip = lambda x: F.regexp_replace(x, f"^{_BLANK}|{_BLANK}$", "")
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), strip)
    says = F.filter(lines, lambda x: ~x.rlike("^[-=_*#]*$") & ~x.rlike(STATUS))
    line = F.coalesce(F.try_element_at(says, F.lit(-1)), F.lit(""))
    for pattern, by in ((PATH, "$1"), (TIME, ""), (MARK, "")):
        line = F.regexp_replace(line, pattern, by)
    return F.substring(line, 1, 200)


def error_key(signature: Column) -> Column:
    """Sixteen hex digits of what is the same but for case and white space; empty of an empty one."""
    plain = F.trim(F.regexp_replace(F.lower(signature), _BLANK, " "))
    return F.when(plain == "", "").otherwise(F.substring(F.sha2(plain, 256), 1, 16))
