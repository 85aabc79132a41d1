"""Nested archives against a plain recursive comparison."""

import json

import pytest

from panelforge.functions import archives


def plain(a, b, path=""):
    """(path, what) of every deviation of two values."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in sorted(a.keys() | b.keys()):
            if k not in archives.VOLATILE:
                out += [(f"{path}/{k}", "added")] if k not in a else [(f"{path}/{k}", "missing")] if k not in b else plain(a[k], b[k], f"{path}/{k}")
        return out
    if isinstance(a, list) and isinstance(b, list):
        return [(path, "length")] if len(a) != len(b) else [d for i, (x, y) in enumerate(zip(a, b, strict=True)) for d in plain(x, y, f"{path}[{i}]")]
    kind = lambda x: "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else type(x).__name__
    return [] if kind(a) == kind(b) and a == b else [(path, "value" if kind(a) == kind(b) else "kind")]


OLD = {
    "same": {"n": 3, "x": [1.5, {"a": None, "b": "x"}], "deep": [[[[1]], []]]},
    "values": {"n": 1, "list": [1, 2.5, "a", True, None], "text": 'say "[{" \\', "big": 1e300, "zero": 0},
    "kinds": {"a": {"b": 1}, "c": [1], "d": None, "e": 1, "f": True, "g": {}, "h": []},
    "keys": {"gone": {"x": [1, 2]}, "stays": 1, "list": [{"a": 1, "b": {"c": 2}}]},
    "lengths": {"x": [[1, 2], [3]], "y": [1, 2, 3], "z": []},
    "volatile": {"generated_at": 1, "git": {"sha": "a"}, "in": [{"runtime_seconds": 2.5, "kept": 1}]},
    "only old": {"a": 1},
    "bare": 5,
}
NEW = {
    "same": {"x": [1.5, {"b": "x", "a": None}], "n": 3.0, "deep": [[[[1]], []]]},
    "values": {"n": 2, "list": [1, 2.25, "b", False, 0], "text": 'say "[{" ', "big": 1e299, "zero": 0.0},
    "kinds": {"a": [1], "c": {"0": 1}, "d": 0, "e": "1", "f": "true", "g": [], "h": {}},
    "keys": {"stays": 1, "came": {"y": {"z": 1}}, "list": [{"a": 1, "b": {"c": 2, "d": []}}]},
    "lengths": {"x": [[1, 5, 6], [4]], "y": [], "z": [{"a": 1}]},
    "volatile": {"generated_at": {"now": 1}, "git": None, "in": [{"runtime_seconds": 9, "kept": 2}]},
    "only new": [1],
    "bare": 6,
}


def table(spark, records):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [("null", None)], "record string, body string")


def test_every_deviation_of_nested_records(spark):
    got = archives.verified(table(spark, OLD), table(spark, NEW)).collect()
    want = [(k, path, what) for k in OLD.keys() & NEW.keys() for path, what in plain(OLD[k], NEW[k])]
    want += [("only old", "", "missing"), ("only new", "", "added")]
    assert sorted((r.record, r.path, r.difference) for r in got) == sorted(want)
    by = {(r.record, r.path): r for r in got}
    assert (by["values", "/list[1]"].old_number, by["values", "/list[1]"].new_number) == (2.5, 2.25)
    assert (by["values", "/text"].old_text, by["values", "/list[3]"].new_text) == ('say "[{" \\', "false")
    assert (by["lengths", "/y"].old_number, by["lengths", "/y"].new_number) == (3.0, 0.0)


def test_an_archive_equals_itself_and_near_numbers_may_be_allowed(spark):
    a = table(spark, OLD)
    assert archives.verified(a, a).isEmpty()
    b = spark.createDataFrame([("r", '{"x": [1.0, 2.0]}')], "record string, body string")
    c = spark.createDataFrame([("r", '{"x": [1.0000001, 2.1]}')], "record string, body string")
    assert [r.path for r in archives.verified(b, c, tolerance=1e-6).collect()] == ["/x[1]"]


def test_depth_and_bad_records(spark, monkeypatch):
    deep = "[" * 9 + "1" + "]" * 9
    assert archives.depth(spark.createDataFrame([("r", deep), ("s", '"[[[[[[[[[[[[[["')], "record string, body string")) == 9
    assert archives.verified(table(spark, {}), table(spark, {})).isEmpty()
    monkeypatch.setattr(archives, "MAX_DEPTH", 8)
    with pytest.raises(ValueError, match="9 levels"):
        archives.nodes(spark.createDataFrame([("r", deep)], "record string, body string"))
