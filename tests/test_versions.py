import itertools
import random

import pytest
from pyspark.sql import functions as F

from qualitylens.functions.versions import Version, fits, satisfies

ORDER = ["1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.post1.dev3", "1.0.post1", "1.0.1", "1.1", "1.10", "2", "1!0.1"]


def test_order_and_clauses():
    for (i, a), (j, b) in itertools.product(enumerate(ORDER), repeat=2):
        assert (Version(a).public < Version(b).public) == (i < j)
    yes = ["2.0.post1 >=1.0", "1.0 ==1", "1.0+abc ==1.0", "1.4.5 ~=1.4.2", "1.5 ~=1.4", "1.4.9 ==1.4.*", "1.0 ===1.0", "1.0 ", "2.0a1 >=2.0a0", "1!1.0 >2", "1.0.post2 >1.0.post1", "1.0.0.0.0.0.0.0.1 >1.0.0.0.0.0.0.0.0", "1 !=1.1.*", "1-1 ==1.post1", "v1.2 ==1.2", "1.5 >=1,<2,!=1.4"]
    no = ["1.0.post1 >1.0", "2.0rc1 <2.0", "2.0a1 >=1.0", "1.0.0.0.0.0.0.0.5 <=1.0.0.0.0.0.0.0.1", "1.0 ==1.0+abc", "1.5 ~=1.4.2", "x >=1", "1.0 >=new", "1.0 =1", "1.0+l >1.0", "1.0 ===1", "2 ~=1"]
    for x in yes + no:
        version, _, spec = x.partition(" ")
        assert fits(version, spec) == (x in yes), x
    assert fits("2.0a1", ">=1.0", True) and not fits(None, "") and not fits("1.0", ">=1,nonsense")


def test_against_a_reference_implementation():
    specifiers = pytest.importorskip("packaging.specifiers")
    r = random.Random(2)
    number = lambda: str(r.choice([0, 0, 1, 2, 10]))
    version = lambda: r.choice(["", "", "1!"]) + ".".join(number() for _ in range(r.randint(1, 3))) + r.choice(["", "", "", "a1", "rc2"]) + r.choice(["", "", ".post1"]) + r.choice(["", "", "", ".dev1"])
    for _ in range(4000):
        v, op = version(), r.choice(["==", "!=", "<=", ">=", "<", ">"])
        spec = f"{op}{version()}"
        assert fits(v, spec, True) == specifiers.SpecifierSet(spec).contains(v, prereleases=True), (v, spec)


def test_column(spark):
    df = spark.createDataFrame([("1.2",), ("3",), (None,), ("bad",)], "v string")
    assert [x.ok for x in df.select(satisfies(F.col("v"), ">=1,<2").alias("ok")).collect()] == [True, False, False, False]
    assert df.where("false").select(satisfies(F.col("v"), "").alias("ok")).count() == 0
