"""Documents against schemas that are data."""

import json

import pandas as pd
from pyspark.sql import functions as F

from runlens.functions.published import FORMATS, PARTS, choice, keyed, kind, many, record, text
from runlens.operators import schemas


def breaches(spark, values, formats, parts=None, form="f"):
    rows = [(i, form, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id long, format string, json string")
    return sorted((r.doc_id, r.rule, r.path, r.detail) for r in schemas.check(docs, formats, parts or {}).collect())


def test_every_keyword(spark):
    form = record(
        "a b",
        a=text(3, 2, "^[a-z]*$"), b=many(kind("integer"), 2, 1), c=choice("x", "y"), d=kind("number", "null"),
        e=keyed("^k", kind("boolean")), f=record("g", g=text()),
    )
    values = [
        {"a": "ab", "b": [1, 2.0], "c": "x", "d": None, "e": {"k": True, "k.2": False}, "f": {"g": ""}},
        {"a": "a", "b": [], "c": "z", "d": "1", "e": {"m": 1}, "f": {}},
        {"a": "ABCD", "b": [1.5, True, "3"], "c": 1, "d": True, "z": {"deep": [1, {"a": 2}]}},
        {"a": "é🎉é", "b": {}},
        {"a": "ab\n", "b": [7]},
        [], "no json {", None, "", "NaN", "[" * 3000,
    ]
    assert breaches(spark, values, {"f": form}) == sorted([
        (1, "minLength", "a", "1"), (1, "minItems", "b", "0"), (1, "enum", "c", "z"), (1, "type", "d", "string"), (1, "names", "e.m", "name"),
        (1, "type", "e.m", "integer"), (1, "required", "f.g", "missing"),
        (2, "maxLength", "a", "4"), (2, "pattern", "a", "ABCD"), (2, "maxItems", "b", "3"), (2, "type", "b[0]", "number"), (2, "type", "b[1]", "boolean"),
        (2, "type", "b[2]", "string"), (2, "enum", "c", "1"), (2, "type", "d", "boolean"), (2, "closed", "z", "unknown field"),
        (3, "pattern", "a", "é🎉é"), (3, "type", "b", "object"),
        (4, "pattern", "a", "ab\n"),
        (5, "type", "", "array"), (6, "type", "", "not JSON"), (8, "type", "", "not JSON"), (9, "type", "", "number"), (10, "type", "", "not JSON"),
    ])


def test_recursive_parts_at_any_depth(spark):
    parts = {"node": record("id", id=text(like="^n"), children=many("node", 2))}
    deep = bad = {"id": "x"}
    for i in range(40):
        deep = {"id": f"n{i}", "children": [deep]}
    wide = {"id": "n", "children": [bad, {"children": [{"id": "n"}] * 3}]}
    got = breaches(spark, [deep, wide], {"f": record(tree="node")}, parts)
    assert got == [(0, "closed", p, "unknown field") for p in ("children", "id")] + [(1, "closed", p, "unknown field") for p in ("children", "id")]
    got = breaches(spark, [{"tree": deep}, {"tree": wide}], {"f": record(tree="node")}, parts)
    assert got == [
        (0, "pattern", "tree" + ".children[0]" * 40 + ".id", "x"),
        (1, "maxItems", "tree.children[1].children", "3"), (1, "pattern", "tree.children[0].id", "x"), (1, "required", "tree.children[1].id", "missing"),
    ]


def test_published_formats(spark):
    good = {"schema": "x.storyboard/1", "title": "T", "mode": "run", "scenes": [{"id": "a", "phase": "setup", "title": "one"}]}
    assert breaches(spark, [good], FORMATS, PARTS, "storyboard/1") == []
    assert breaches(spark, [{**good, "scenes": good["scenes"] * 61}], FORMATS, PARTS, "storyboard/1") == [(0, "maxItems", "scenes", "61")]
    walk = {"schema": "x.walkthrough/1", "title": "T", "explanations": {"a.py:3": {"title": "t", "text": "x" * 701}, "a": {"title": "t", "text": "x"}}}
    got = breaches(spark, [walk], FORMATS, PARTS, "walkthrough/1")
    assert got == [(0, "maxLength", "explanations.a.py:3.text", "701"), (0, "names", "explanations.a", "name")]
    assert breaches(spark, [walk], FORMATS, PARTS, "unknown") == [] and breaches(spark, [], FORMATS, PARTS) == []


def test_batches_are_bounded_by_their_texts(spark):
    text = F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 1 << 20), F.lit('"}'))
    docs = spark.range(0, 40, numPartitions=1).select("id", text.alias("json"))
    sizes = lambda batches: (pd.DataFrame({"n": [b["json"].str.len().sum()]}) for b in batches)
    assert docs.mapInPandas(sizes, "n long").agg(F.max("n")).first()[0] <= 16 << 20
    edges, _ = schemas.compiled({"f": {"properties": {"a": {"type": ["string"]}}}}, {})
    batch = pd.DataFrame({"doc_id": range(40), "format": "f", "json": '{"a":"' + "x" * (1 << 20) + '"}'})
    found = list(schemas._flat({(a, step): b for a, step, b in edges})(iter([batch])))
    assert max(f["text"].str.len().sum() for f in found) <= 2 * schemas.CHARS
    assert sorted(i for f in found for i in f["doc_id"]) == sorted([*range(40)] * 2)
