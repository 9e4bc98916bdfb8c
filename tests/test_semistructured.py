"""JSON specifications by literal cases, and faceted filters against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from pricelore.operators import semistructured as op

TEXTS = ['{"a": 1, "b": null, "c": [1, "x"], "d": {"e": "f"}}', "[1, 2, 3]", '"text"', "12.5", "true", "null", "{broken", "", None, "{}", "[]"]


def each(spark, column, texts=TEXTS):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_keys(spark):
    assert each(spark, lambda t: op.has_key(t, "b")) == [True, *[False] * 10]
    assert each(spark, lambda t: op.has_any_key(t, ["z", "d"])) == [True, *[False] * 10]
    assert each(spark, lambda t: op.has_any_key(t, [])) == [False] * 11


def test_kinds_and_lengths(spark):
    assert each(spark, op.kind) == ["object", "array", "string", "number", "boolean", "null", None, None, None, "object", "array"]
    assert [each(spark, lambda t, p=p: op.kind(t, p))[0] for p in ("a", "b", "c", "d", "d.e", "z", "d.z")] == ["number", "null", "array", "object", "string", None, None]
    assert each(spark, op.length) == [None, 3, *[None] * 8, 0]
    assert each(spark, lambda t: op.length(t, "c"))[0] == 2


def test_merging(spark):
    cases = [('{"a": 1, "b": {"x": 1}}', '{"b": {"y": 2}, "c": null}', {"a": 1, "b": {"y": 2}, "c": None}), ("{}", "{}", {}), ("[1]", "[2, 3]", [1, 2, 3]), ('{"a": 1}', "[2]", [{"a": 1}, 2]), ("1", '"x"', [1, "x"]), ("{", "{}", None), (None, "{}", None), ("{}", None, None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", op.merged(F.col("a"), F.col("b")).alias("m")).orderBy("i")
    assert [r.m and json.loads(r.m) for r in rows.collect()] == [w for *_, w in cases]


def test_allowed_keys(spark):
    got = each(spark, lambda t: op.allowed(t, ["a", "b", "c", "z"]))
    assert json.loads(got[0]) == {"a": 1, "c": [1, "x"]} and got[9] == "{}" and got[1:9] == [None] * 8


def plain(row, filters):
    """Whether a row (brand, specs as text) passes a filter."""
    brand, text = row
    try:
        specs = json.loads(text) if text is not None else {}
    except ValueError:
        specs = {}
    specs = specs if isinstance(specs, dict) else {}

    def said(key):
        v = specs.get(key)
        return None if v is None else v if isinstance(v, str) else json.dumps(v)

    for key, given in filters.items():
        values = [v for v in (given if isinstance(given, list) else [given]) if v is not None and v != ""]
        if not re.fullmatch("[a-z][a-z0-9_]{0,40}", key) or not values:
            continue
        own = said(key)
        if key == "brand":
            hit = (brand or "").lower() in {str(v).lower() for v in values}
        elif all(isinstance(v, bool) for v in values):
            hit = own is not None and own.lower() in {str(v).lower() for v in values}
        elif all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            hit = own is not None and re.fullmatch(r"[0-9]+(\.[0-9]+)?", own) is not None and float(own) in {float(v) for v in values}
        else:
            hit = (own or "").lower() in {str(v).lower() for v in values}
        if not hit:
            return False
    return True


def test_random_filters(spark):
    rng = random.Random(6)
    pool = [1, 2, 16, 2.5, "1", "16", "x", "X", "True", "2.5", True, False, None, "", "-3", -3]
    rows = [(rng.choice(["Acer", "LG", None, ""]), rng.choice([None, "{", "[]", *[json.dumps({k: rng.choice(pool) for k in rng.sample(["ram", "size", "oled", "kind"], rng.randrange(5))}) for _ in range(20)]])) for _ in range(150)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, brand string, specs string").cache()
    for _ in range(25):
        filters = {k: rng.choice(pool) if rng.random() < 0.4 else [rng.choice(pool) for _ in range(rng.randrange(4))] for k in rng.sample(["ram", "size", "oled", "kind", "Bad", "a-b"], rng.randrange(3))}
        if rng.random() < 0.4:
            filters["brand"] = rng.choice(["lg", ["ACER", None], ["x", ""]])
        assert sorted(r.i for r in df.where(op.facet_filter(filters)).collect()) == [i for i, r in enumerate(rows) if plain(r, filters)], filters


def test_optional(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [df.where(op.optional("x", v)).count() for v in (None, "a", "z")] == [3, 1, 0]


def test_depth_snapshot(spark):
    rows = [("p", '{"purpose": "w", "completion": "saturated", "cursor": {"last_page": 9, "new_ids": "4"}}'), ("p", '{"purpose": "w", "cursor": 3}'), ("q", '{"purpose": "v"}'), ("q", "{"), ("q", None)]
    df = spark.createDataFrame(rows, "platform string, metadata string")
    assert [tuple(r) for r in op.depth_snapshot(df, "w").collect()] == [("p", 2, 1, 1, 9, 4)]
    assert op.depth_snapshot(df.where("false"), "w").collect() == []
