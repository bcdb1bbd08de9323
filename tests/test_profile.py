import json
import random
import struct

import pytest
from conftest import bodies, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom import session
from paperloom.functions.json_walk import walk as walk_text
from paperloom.functions.numbers import fits_float32, is_integral
from paperloom.operators import profile
from paperloom.plans import jobs
from paperloom.sources import documents


def leaves(spark, docs, depth=None):
    return profile.flatten_json(documents.drop_malformed(bodies(spark, docs)).select("doc"), depth)


def fields(spark, docs, **kw):
    found, values, _ = jobs.profile_json(bodies(spark, docs), **kw)
    return {(r.path, r.kind): r for r in found.collect()}, values


def test_paths(spark):
    got = leaves(spark, [{"a": [[1, 2], [3]], "e": [], "o": {}, "s": ["", "[]", "{}"], "n": None, "b": {"c.d": True}}])
    assert rows(got.groupBy("path", "kind").count()) == [
        (".a[][]", "number", 3), (".b.c.d", "bool", 1), (".n", "null", 1), (".s[]", "string", 3),
    ]


def walk(path, v):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(f"{path}.{k}", x)
    elif isinstance(v, list):
        for x in v:
            yield from walk(path + "[]", x)
    else:
        kind = {bool: "bool", str: "string", type(None): "null"}.get(type(v), "number")
        yield path, kind, float(v) if kind == "number" else None, v if kind == "string" else None


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.floats(-1e6, 1e6, width=32)
    | st.text("ab\"\\[]{}é", max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("xyz", max_size=2), inner, max_size=3),
    max_leaves=12,
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dictionaries(st.text("abc", max_size=2), json_values, max_size=3), min_size=20, max_size=60))
def test_flatten_is_a_walk_of_the_tree(spark, docs):
    got = leaves(spark, docs).select("path", "kind", "num", "str").collect()
    want = [leaf for d in docs for leaf in walk("", d)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, ((p, k, n if n is None else n + 0.0, s) for p, k, n, s in want)))


def test_too_deep_is_kept_and_marked(spark):
    doc = {"a": {"b": {"c": 1}}, "x": 2}
    got = rows(leaves(spark, [doc], 2).select("path", "kind", "str"))
    assert got == [(".a.b", "truncated", '{"c":1}'), (".x", "number", None)]
    with pytest.raises(Exception, match="too deep"):
        fields(spark, [doc], max_depth=2, strict=True)[0]


def test_enum_limit(spark):
    docs = [{"a": f"v{i % 20}", "b": f"v{i % 21}", "n": i % 20, "m": i % 21, "big": i} for i in range(400)]
    found, values = fields(spark, docs)
    assert found[".a", "string"].storage_type == "enum" and found[".a", "string"].n_distinct == 20
    assert found[".b", "string"].storage_type == "string" and found[".b", "string"].n_distinct is None
    assert found[".n", "number"].n_distinct == 20 and found[".m", "number"].n_distinct is None
    listed = values.groupBy("path").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    assert rows(listed) == [(".a", 400, 20), (".n", 400, 20)]


def test_many_few_valued_paths_take_the_shuffled_way(spark, monkeypatch):
    docs = [{f"key{i}": i % 2, "s": "x" * (i % 3)} for i in range(200)]
    direct = rows(fields(spark, docs)[1])
    monkeypatch.setattr(session, "MAX_BROADCAST", 0)
    assert rows(fields(spark, docs)[1]) == direct and len(direct) == 203


def test_nulls_and_conflicts(spark):
    docs = [{"a": "x", "b": None, "c": 1}, {"a": 1, "b": None, "c": None}]
    found, _ = fields(spark, docs)
    assert set(found) == {(".a", "string"), (".a", "number"), (".b", "null"), (".c", "number")}
    assert found[".a", "number"].conflict and not found[".c", "number"].conflict
    assert found[".c", "number"].n_null == 1 and found[".b", "null"].n_null == 2
    for bad in ([{"a": "x"}, {"a": 1}], [{"a": None}], [{"a": 1}, {"a": None}]):
        with pytest.raises(Exception, match="null, mixed"):
            fields(spark, bad, strict=True)[0]


@pytest.mark.parametrize(
    "numbers,want",
    [([-1000, 5], "int16"), ([0, 255], "uint8"), ([0, 256], "uint16"), ([0, 65536], "uint32"),
     ([0, 2**32], "uint64"), ([-128, 127], "int8"), ([-1, 128], "int16"), ([-1, 2**31], "int64"),
     ([0.5, 1], "float32"), ([0.1], "float64"), ([0.5, 16777217], "float64"), ([-0.0], "uint8"), ([1.0, 2e0], "uint8")],
)
def test_storage_type(spark, numbers, want):
    found, _ = fields(spark, [{"x": n} for n in numbers])
    assert found[".x", "number"].storage_type == want


def low_bits_clear(x: float) -> bool:
    return struct.unpack("<Q", struct.pack("<d", x))[0] & ((1 << 29) - 1) == 0


def test_float32_rule_on_bits(spark):
    xs = [0.0, 0.5, 0.1, 16777216.0, 16777217.0, 2.0**200, 1.5 * 2.0**-1022, 2.0**-1074, 2.0**-1045, 3 * 2.0**-1046,
          1.7976931348623157e308, 2.0**1023, 3.4e38, 1 / 3, -0.25, 1 + 2.0**-23, 1 + 2.0**-24, 2 - 2.0**-52, 1e-310]
    xs += [float(f"{m}e{e}") for m in (1, 1.5, 3.25) for e in range(-300, 300, 25)]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    got = df.select("x", fits_float32(F.col("x")), is_integral(F.col("x"))).collect()
    assert [(x, a) for x, a, _ in got] == [(x, low_bits_clear(x)) for x in xs]
    assert [b for _, _, b in got] == [x == int(x) for x in xs]


def test_report(spark):
    docs = [{"t": True, "s": "b", "n": 1, "f": 0.5, "w": f"w{i}", "k": i} for i in range(25)] + [{"s": "a", "n": -3}]
    found, values, _ = jobs.profile_json(bodies(spark, docs))
    lines = [r.line for r in profile.profile_report(found, values).collect()]
    assert lines == [
        ".f;float32;0.500000;0.500000;0.500000:25",
        ".k;uint8;0;24",
        ".n;int8;-3;1;-3:1;1:25",
        ".s;enum;2;a:1;b:25",
        ".t;true:25;false:0",
        ".w;string",
    ]


def random_value(rng, depth):
    pick = rng.random()
    if depth and pick < 0.3:
        return {rng.choice(["a", "b", "é", "a b", ""]): random_value(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and pick < 0.5:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 1, -2.5, 0, -0.0, 1e300, "", "x", 'q"\\\n', "😀", 12345678901234567890])


def test_walk_gives_the_leaves_that_the_engine_gives(spark):
    rng = random.Random(8)
    docs = [{"k": random_value(rng, 6), "l": random_value(rng, 3)} for _ in range(150)]
    texts = [json.dumps(d, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, d in enumerate(docs)]
    texts += ['{"a": 1, "a": {"b": 2}}', '{"a": [1, {"b": 2}], "c": 0, "a": "last"}', ' {"a" : [ ] , "b" : { } } ', "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_pos INT, body STRING")
    for depth in (None, 2):
        want = profile.flatten_json(documents.drop_malformed(df).select("line_pos", "doc"), depth)
        got = profile.flatten_large(df, depth)
        cut = lambda r: (r.line_pos, r.path, r.kind, r.num, None if r.kind == "truncated" else r.str, r.flag)
        assert sorted(map(str, map(cut, got.collect()))) == sorted(map(str, map(cut, want.collect())))


@pytest.mark.parametrize(
    "text", ["", " ", "[1]", "1", "{", "{}{}", "{} x", '{"a"}', '{"a":}', '{"a":1,}', '{"a":[1,]}', '{"a":[1}', '{"a":01}', '{"a":1e400}', '{"a":NaN}', "{'a':1}", '{"a":"x', '{"a":tru}', '{"a" 1}']
)
def test_walk_refuses_what_is_not_an_object(text):
    with pytest.raises(ValueError):
        walk_text(text)


def test_large_documents_are_profiled_and_refused_ones_returned(spark):
    deep = '{"a":' * 1500 + "7" + "}" * 1500
    texts = ['{"v": 1}', '{"v": 2, "s": "' + "x" * 25_000_000 + '"}', deep, deep[:-1], "not JSON"]
    found, values, rejects = jobs.profile_json(bodies(spark, texts))
    got = {r.path: (r.kind, r.n, r.min, r.max) for r in found.collect()}
    assert got == {".v": ("number", 2, 1.0, 2.0), ".s": ("string", 1, None, None), ".a" * 1500: ("number", 1, 7.0, 7.0)}
    assert sorted(len(r.body) for r in rejects.collect()) == sorted([len(deep) - 1, 8])
    assert {len(r.value) for r in values.where("path = '.s'").collect()} == {25_000_000}
    with pytest.raises(ValueError, match="2 bodies"):
        jobs.profile_json(bodies(spark, texts), strict=True)


def test_values_stop_at_twenty_in_and_across_tasks(spark, monkeypatch):
    rows = [(f".p{k}", "number", float(i % k), None, None) for k in (1, 19, 20, 21, 300) for i in range(600)]
    rows += [(".s", "string", None, f"v{i % 20}", None) for i in range(600)] + [(".n", "null", None, None, None)] * 5
    leaves = spark.createDataFrame(rows, "path STRING, kind STRING, num DOUBLE, str STRING, flag BOOLEAN")
    for n in (1, 7):
        totals = profile.summarise(leaves.repartition(n))
        assert {r.path for r in totals.where("few").collect()} == {".p1", ".p19", ".p20", ".s"}
        got = {(r.path, r.value): (r.n, r.n_distinct) for r in profile.field_values(totals).collect()}
        assert len(got) == 1 + 19 + 20 + 20
        assert got[".p20", "3"] == (30, 20) and got[".s", "v7"] == (30, 20) and got[".p1", "0"] == (600, 1)
