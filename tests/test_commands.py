import pytest
from pyspark.sql import functions as F

from qualitylens.functions import commands as C


@pytest.mark.parametrize(("command", "signature"), [
    ("uv run python -m pytest tests/test_foo.py -v", "pytest:tests/test_foo"), ("", "unknown:unknown"), ("   ", "unknown:unknown"), (None, "unknown:unknown"),
    ("/usr/bin/env python script.py", "env:python"), ("sudo env", "unknown:unknown"), ("/home/user/.local/bin/ruff check .", "ruff:check"), ("git status", "git:status"),
    ("cat /usr/local/lib/foo.py", "cat:foo"), ("curl sk_abcdefgh12345 x", "curl:x"), ("'my:tool' a", "my:tool:a"), ("git\tlog", "git:log"), ("env A=1 B=2 make", "make:default"),
    ("echo 'unclosed", "echo:'unclosed"), ("ls .hidden b", "ls:b"), ("x" * 50 + " " + "y" * 39, "x" * 30 + ":" + "y" * 30),
])
def test_signatures(command, signature):
    assert C.signature_of(command) == signature


def test_intents_and_errors(spark):
    df = spark.createDataFrame([("git:status",), ("git:stash",), ("pytest:tests",), ("nothing:known",), ("unknown:unknown",)], "s string")
    assert [r.i for r in df.select(C.intent(F.col("s")).alias("i")).collect()] == ["inspect", "meta", "verify", "execute", "execute"]
    cases = {
        None: "", "   ": "", "Traceback:\n  File ...\nValueError: bad input\n": "ValueError: bad input", "Error occurred\n========\n": "Error occurred",
        "Something failed\nexit code: 1\n": "Something failed", "Error in /home/user/project/src/module.py: syntax error": "Error in module.py: syntax error",
        "2026-02-22T10:30:00.123 FATAL: crash": "FATAL: crash", "[12:34] Connection refused": "Connection refused", "E" * 500: "E" * 200,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select(C.error_signature(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == list(cases.values())
    keys = spark.createDataFrame([("A  b",), (" a B ",), ("",)], "s string").select(C.error_key(F.col("s")).alias("k")).collect()
    assert keys[0].k == keys[1].k != "" == keys[2].k
