import hashlib

import pytest

from factgate.operators.digest import set_digest
from factgate.operators.invariants import violations

H = [hashlib.sha256(bytes([k])).hexdigest() for k in range(6)]
FIELDS, BUNDLE = {"a": "int", "t": "bigint"}, {"ns": "day0"}


def relation(spark, **changed):
    """Two rows: a field with a base fact, and a derived one bound to its witness."""
    tables = {
        "rows": ("row_key string", [("r1",), ("r2",)]),
        "cells": ("row_key string, field string, type string, value string, expression string", [("r1", "a", "int", "i:1", "a"), ("r1", "t", "bigint", "i:5", "sum(a)"), ("r2", "a", "int", "null", "a"), ("r2", "t", "bigint", "i:0", "sum(a)")]),
        "support": ("row_key string, field string, fact_hash string, kind string, namespace string, snapshot string", [("r1", "", H[0], "base-row", "ns", "day0"), ("r1", "a", H[1], "base-cell", "ns", "day0"), ("r1", "t", H[1], "base-cell", "ns", "day0"), ("r1", "t", H[2], "base-cell", "ns", "day0")]),
        "witness": ("row_key string, field string, fact_hash string, n long", [("r1", "", H[0], 1), ("r1", "a", H[1], 1), ("r1", "t", H[1], 2), ("r1", "t", H[2], 3)]),
    }
    tables |= {k: (tables[k][0], v(list(tables[k][1]))) for k, v in changed.items() if k in tables}
    frames = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in tables.items()}
    mark = set_digest(spark.createDataFrame([(H[1], 2), (H[2], 3)], "fact_hash string, n long"), "fact_hash", [], "n").first()["digest"]
    releases = [("r1", "a", H[1], "base-cell", "int", "i:1", "a", None), ("r1", "t", H[5], "derived", "bigint", "i:5", "sum(a)", mark)]
    releases = changed["releases"](releases) if "releases" in changed else releases
    frames["releases"] = spark.createDataFrame(releases, "row_key string, field string, fact_hash string, kind string, type string, value string, expression string, commitment string")
    return sorted((r.rule, r.row_key, r.field) for r in violations(**frames, fields=FIELDS, bundle=BUNDLE).collect())


def test_a_sound_relation(spark):
    assert relation(spark) == []


@pytest.mark.parametrize(
    "table, change, rule",
    [
        ("rows", lambda r: [*r, ("r1",)], "row twice"),
        ("cells", lambda c: [*c, ("r2", "a", "int", "null", "a")], "cell twice"),
        ("cells", lambda c: [*c, ("r2", "z", "int", "null", "a")], "unknown field"),
        ("support", lambda s: [*s, ("r9", "a", H[3], "base-cell", "ns", "day0")], "support of nothing"),
        ("support", lambda s: [*s, ("r2", "a", "XYZ", "base-cell", "ns", "day0")], "not a base fact"),
        ("support", lambda s: [*s, ("r2", "a", H[3], "base-cell", "other", "day0")], "another snapshot"),
        ("witness", lambda w: [*w, w[0]], "fact twice"),
        ("witness", lambda w: [*w[:3], ("r1", "t", H[2], 0)], "no multiplicity"),
        ("witness", lambda w: [*w[:3], ("r1", "t", H[2], 4)], "another commitment"),
        ("releases", lambda x: [*x, x[0]], "release twice"),
        ("releases", lambda x: [(*x[0][:3], "outcome", *x[0][4:])], "release of another kind"),
        ("releases", lambda x: [("r1", "q", *x[0][2:])], "release of nothing"),
        ("releases", lambda x: [(*x[0][:5], "i:2", *x[0][6:])], "release of another value"),
        ("releases", lambda x: [x[0], (*x[1][:6], "sum(b)", x[1][7])], "release of another expression"),
        ("releases", lambda x: [x[0], (*x[1][:7], "0" * 64)], "another commitment"),
        ("releases", lambda x: [("r1", "a", H[2], *x[0][3:]), x[1]], "release without support"),
    ],
)
def test_each_rule_is_found(spark, table, change, rule):
    assert rule in {r for r, _, _ in relation(spark, **{table: change})}
