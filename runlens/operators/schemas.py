"""Documents against schemas that are data.

A schema becomes two small tables: ``edges`` (type, step, type below) and ``rules`` (type, keyword, value). A document becomes one row
per node at any depth. A node gets its type from that of the node above by the edges, so schemas may recurse; it then
meets the rules of its type in one broadcast join. No limit is in code, and there is one finding per breach.

Keywords: ``type``, ``enum``, ``pattern``, ``minLength``, ``maxLength``, ``minItems``, ``maxItems``, ``required``, ``closed`` (no other fields), ``names``
(how the names of fields look). ``others`` is the schema of fields that aren't listed. A schema given as a name is one of the
shared ``parts``. Text that isn't JSON breaks ``type`` at its root; null documents and documents of an
unknown format have no rules, nor have values below a field that isn't listed. Repeated documents give their findings each."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM, OTHER = "[]", "*"
NOT_JSON = "not JSON"
LIMITS = ("minLength", "maxLength", "minItems", "maxItems")


def compiled(formats: dict[str, dict], parts: dict[str, dict]) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """``edges`` and ``rules``; lists of words as JSON. As long as the schemas, not the documents."""
    edges: list[tuple[str, str, str]] = []
    rules: list[tuple[str, str, str]] = []
    known: set[str] = set()

    def declare(name: str, schema: dict) -> None:
        if name in known:
            return
        known.add(name)
        for keyword in ("type", "enum", "required"):
            if schema.get(keyword):
                rules.append((name, keyword, json.dumps(schema[keyword])))
        for keyword in LIMITS:
            if schema.get(keyword) is not None:
                rules.append((name, keyword, str(schema[keyword])))
        for keyword in ("pattern", "names"):
            if schema.get(keyword):
                rules.append((name, keyword, schema[keyword]))
        if schema.get("closed"):
            rules.append((name, "closed", json.dumps(list(schema.get("properties", {})))))
        below = list(schema.get("properties", {}).items())
        below += [(step, schema[key]) for step, key in ((ITEM, "items"), (OTHER, "others")) if key in schema]
        for step, child in below:
            target = child if isinstance(child, str) else f"{name}/{step}"
            edges.append((name, step, target))
            declare(target, parts[child] if isinstance(child, str) else child)

    for name, schema in formats.items():
        declare(name, schema)
    return edges, rules


KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}
#: rows and characters of text that a batch of nodes holds about at most, besides one document
ROWS, CHARS = 10_000, 4 << 20
NODE = "doc_id {id}, path string, type string, kind string, size long, text string, names array<string>"


def _nodes(value, root: str, edges: dict[tuple[str, str], str]) -> Iterator[tuple]:
    """Rows of a value and of everything below it that has a type."""
    waiting = [(value, "", root)]
    while waiting:
        value, path, at = waiting.pop()
        kind = KINDS[type(value)]
        if kind == "number" and value.is_integer():
            kind = "integer"
        size = len(value) if kind in ("object", "array", "string") else None
        text = value if kind == "string" else None if size is not None else json.dumps(value)
        yield path, at, kind, size, text, list(value) if kind == "object" else None
        below = []
        if kind == "object":
            below = [(v, f"{path}.{k}" if path else k, edges.get((at, k)) or edges.get((at, OTHER))) for k, v in value.items()]
        elif kind == "array":
            below = [(v, f"{path}[{i}]", edges.get((at, ITEM))) for i, v in enumerate(value)]
        waiting += [x for x in below if x[2]]


def _flat(table: dict[tuple[str, str], str]):
    """Batches of documents -> batches of their nodes, bounded by rows and by what the texts in them hold."""
    columns = ["doc_id", "path", "type", "kind", "size", "text", "names"]

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, chars = [], 0
            for doc_id, form, text in zip(batch["doc_id"], batch["format"], batch["json"]):
                try:
                    rows += [(doc_id, *node) for node in _nodes(json.loads(text), form, table)]
                except (ValueError, RecursionError):
                    rows.append((doc_id, "", form, NOT_JSON, None, None, None))
                chars += len(text)
                if len(rows) > ROWS or chars > CHARS:
                    yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})
                    rows, chars = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    return flat


def nodes(docs: DataFrame, edges: list[tuple[str, str, str]]) -> DataFrame:
    """``doc_id, format, json`` -> a row per typed node of each document: ``path``, ``type`` (the format for the root), ``kind``,
    ``size`` of texts and lists, ``text`` of plain values, ``names`` of fields."""
    flat = _flat({(a, step): b for a, step, b in edges})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "format", "json").filter("json is not null").mapInPandas(flat, NODE.format(id=kind))


def breaches() -> Column:
    """What a node breaks of one rule: an array of (name below it or null, detail)."""
    words, limit = F.col("words"), F.col("value").cast("long")
    own = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.coalesce("text", F.col("size").cast("string"), F.lit("")).alias("detail")))
    sized = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("size").cast("string").alias("detail")))
    other = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("kind").alias("detail")))
    none = F.array().cast(own_type())

    def below(names: Column, detail: str) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(detail).alias("detail")))

    keyword, is_object = F.col("keyword"), F.col("kind") == "object"
    pattern = F.col("value")
    kind_fits = F.array_contains(words, F.col("kind")) | ((F.col("kind") == "integer") & F.array_contains(words, F.lit("number")))
    list_limits, text_limits = F.col("kind") == "array", F.col("kind") == "string"
    return (
        F.when((keyword == "type") & ~kind_fits, other)
        .when((keyword == "enum") & ~((F.col("kind") == "string") & F.array_contains(words, F.col("text"))), own)
        .when((keyword == "pattern") & text_limits & ~F.rlike(F.col("text"), pattern), own)
        .when((keyword == "minLength") & text_limits & (F.col("size") < limit), sized)
        .when((keyword == "maxLength") & text_limits & (F.col("size") > limit), sized)
        .when((keyword == "minItems") & list_limits & (F.col("size") < limit), sized)
        .when((keyword == "maxItems") & list_limits & (F.col("size") > limit), sized)
        .when((keyword == "required") & is_object, below(F.array_except(words, F.col("names")), "missing"))
        .when((keyword == "closed") & is_object, below(F.array_except(F.col("names"), words), "unknown field"))
        .when((keyword == "names") & is_object, below(F.filter("names", lambda n: ~F.rlike(n, pattern)), "name"))
        .otherwise(none)
    )


def own_type() -> str:
    return "array<struct<name:string,detail:string>>"


def check(docs: DataFrame, formats: dict[str, dict], parts: dict[str, dict]) -> DataFrame:
    """``doc_id, severity, rule, path, detail`` of every breach; ``docs(doc_id, format, json)``, the format naming the schema."""
    edges, rules = compiled(formats, parts)
    rows = []
    for name, keyword, value in rules:
        words = json.loads(value) if keyword in ("type", "enum", "required", "closed") else None
        if keyword in ("pattern", "names") and value.endswith("$"):
            value = value[:-1] + r"\z"  # the very end of the text
        rows.append((name, keyword, value, words))
    table = docs.sparkSession.createDataFrame(rows, "type string, keyword string, value string, words array<string>")
    # the rules are as long as the schemas; a text that isn't JSON has the one kind that no type allows
    ruled = nodes(docs, edges).join(F.broadcast(table), "type")
    broken = ruled.select("doc_id", "path", F.col("keyword").alias("rule"), F.explode(breaches()).alias("b"))
    at = F.when(F.col("b.name").isNull(), F.col("path")).otherwise(
        F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), "b.name")
    )
    return broken.select("doc_id", F.lit("problem").alias("severity"), "rule", at.alias("path"), F.col("b.detail").alias("detail"))
