"""Every query of the core against its SQL in DuckDB."""

import math

import duckdb
import pytest

from qualitylens.plans import catalog
from qualitylens.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return list(v) if isinstance(v, (list, tuple)) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_set_cover_is_greedy(spark):
    from qualitylens.plans.adapters import kills

    left = {}
    for r in kills(spark, SF).collect():
        left.setdefault(r.test, set()).add(r.mutant)
    want = []
    while any(left.values()):
        best = min(left, key=lambda t: (-len(left[t]), t))
        want.append((best, len(left[best])))
        hit = left.pop(best)
        left = {t: m - hit for t, m in left.items()}
    assert [(r.test, r.new) for r in catalog.QUERIES["q135_greedy_set_cover"](spark, SF).orderBy("step").collect()] == want


def test_signals_by_hand(spark):
    """Every session's last fifty actions walked from the newest on."""
    import json

    users, want = {}, set()
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        users.setdefault(r.user_id, []).append((r.ts.timestamp(), r.event_type, json.loads(r.props)["k"] % 12))
    for user, acts in users.items():
        acts = acts[-50:][::-1]
        kinds = [k for _, k, _ in acts]
        within = lambda days: [a for a in acts if acts[0][0] - a[0] <= days * 86_400]
        sigs = lambda *k: {s for _, kind, s in acts if kind in k}
        before = lambda *k: next((i for i, kind in enumerate(kinds) if kind in k), len(kinds))
        repeats = lambda some: max((some.count(x) for x in some), default=0)
        edits = kinds[: before("purchase")].count("signup")
        runs = [k for k in kinds[:10] if k in ("click", "error")]
        fired = {
            "approach_cycling": len({s for _, k, s in within(2) if k == "error"}) >= 3,
            "failure_amnesia": repeats([s for _, k, s in acts[:30] if k == "error"]) >= 2,
            "brute_force_escalation": len(sigs("click", "error")) > len(sigs("purchase")),
            "integration_verification_debt": edits >= 5 or (edits > 0 and kinds[0] == "click"),
            "premature_action": len(runs) > 3 * max(kinds[:10].count("view"), 1) and 2 * runs.count("error") > len(runs),
            "tool_repetition": repeats([(k, s) for _, k, s in within(3)]) >= 4,
            "serial_discovery": len(sigs("error")) >= 3 and "purchase" not in kinds[:10],
            "verification_debt": before("view", "purchase") >= 8,
            "mass_delegation": [k for _, k, _ in within(1)].count("signup") >= 3,
            "redundant_planning": "signup" in kinds and "purchase" in kinds[kinds.index("signup") :],
            "consecutive_failures": kinds[: before("click")].count("error") >= 3,
        }
        want |= {(user, name) for name, yes in fired.items() if yes}
    assert {(r.user_id, r.signal) for r in catalog.QUERIES["q172_signal_detectors"](spark, SF).collect()} == want


def test_flagship_and_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
