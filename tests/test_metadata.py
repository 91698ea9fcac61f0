"""Filters on free-form metadata against the rule in Python."""

import json

import pytest
from lodestream.operators.metadata import FieldFilter, as_variant, passing

METAS = [
    {"k": 1, "s": "alpha", "a": {"b": 2.5, "c d": "x"}, "tags": ["x", "y", 3], "ok": True},
    {"k": 2.0, "s": "beta", "a": {"b": "2.5"}, "tags": [], "ok": False},
    {"k": "1", "s": None, "a": {}, "tags": "xyz"},
    {"k": 9007199254740993, "s": "alphabet", "a": 5, "tags": [True]},
    {},
    None,
]
FILTERS = [
    ("k", "eq", 1), ("k", "neq", 1), ("k", "gt", 1), ("k", "gte", 2), ("k", "lt", 2), ("k", "lte", 1), ("k", "in", [1, "1"]), ("k", "not_in", [1, 2]), ("k", "eq", "1"), ("k", "eq", 9007199254740993),
    ("s", "eq", "alpha"), ("s", "contains", "alpha"), ("s", "neq", "beta"), ("s", "gt", "alpha"), ("a.b", "eq", 2.5), ("a.b", "gt", 2), ("a.b", "not_in", [2.5]), ("a.c d", "eq", "x"),
    ("tags", "contains", "x"), ("tags", "contains", 3), ("tags", "contains", True), ("ok", "eq", True), ("ok", "neq", False), ("none", "in", ["x"]), ("none", "not_in", ["x"]), ("k", "in", []), ("k", "not_in", []),
]


def rule(meta, field, op, target):
    value = meta
    for part in field.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    if value is None:
        return op in ("neq", "not_in")
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    like = lambda a, b: number(a) == number(b) and (number(a) or type(a) is type(b))
    same = lambda a, b: like(a, b) and a == b
    if op in ("gt", "gte", "lt", "lte"):
        return like(value, target) and {"gt": value > target, "gte": value >= target, "lt": value < target, "lte": value <= target}[op]
    if op == "contains":
        return any(same(x, target) for x in value) if isinstance(value, list) else isinstance(value, str) and isinstance(target, str) and target in value
    hit = any(same(value, t) for t in (target if isinstance(target, list) else [target]))
    return hit if op in ("eq", "in") else not hit


def test_all_operators_on_nested_fields(spark, tmp_path):
    df = spark.createDataFrame([(i, None if m is None else json.dumps(m)) for i, m in enumerate(METAS)] + [(99, "no json")], "id long, j string")
    as_variant(df, "j").drop("j").write.parquet(f"{tmp_path}/v")
    rows = spark.read.parquet(f"{tmp_path}/v")
    for f in FILTERS:
        got = {r.id for r in passing(rows, [FieldFilter(*f)]).collect()}
        want = {i for i, m in enumerate(METAS) if rule(m, *f)} | ({99} if f[1] in ("neq", "not_in") else set())
        assert got == want, f
    both = passing(rows, [FieldFilter("k", "gte", 1), FieldFilter("s", "contains", "alpha")])
    assert {r.id for r in both.collect()} == {0, 3}


def test_unknown_operators_and_kinds_raise():
    for f in (FieldFilter("k", "like", 1), FieldFilter("k", "eq", object())):
        with pytest.raises(ValueError):
            f.column()
