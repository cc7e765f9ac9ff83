"""Catalog documents as tables: JSON collections, message definitions in text form, and metrics in long form."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN = re.compile(r"^\s*(message|enum|oneof)\s+([\w.]+)\s*\{\s*(\}?)")
_FIELD = re.compile(r"^\s*(?:(required|optional|repeated)\s+)?([\w.]+|map<[^>]*>)\s+(\w+)\s*=\s*(-?\d+)\s*(?:\[(.*)\])?\s*;")
_VALUE = re.compile(r"^\s*(\w+)\s*=\s*(-?\d+)\s*;")


def collection(spark: SparkSession, path: str, name: str, domain: str) -> DataFrame:
    """(domain, collection, idx, key, item): the records of one collection of JSON documents, an array or a map of names; item is JSON text, in which absent and null stay different."""
    text = spark.read.text(path, wholetext=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for value in pdf["value"]:
                got = json.loads(value).get(name, [])
                pairs = got.items() if isinstance(got, dict) else ((None, x) for x in got)
                rows += [(domain, name, k, key, json.dumps(item, ensure_ascii=False, sort_keys=True)) for k, (key, item) in enumerate(pairs)]
            yield pd.DataFrame(rows, columns=["domain", "collection", "idx", "key", "item"])

    return text.mapInPandas(run, "domain string, collection string, idx long, key string, item string")


def name_set(records: DataFrame, field: str = "name") -> DataFrame:
    """(name): of the records of a collection in either form."""
    return records.select(F.coalesce("key", F.get_json_object("item", f"$.{field}")).alias("name")).filter("name IS NOT NULL").distinct()


def message_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(file, message, ord, field, number, label, type, oneof, options): fields of the messages of text files, nested names joined by dots; members of enums have the label "enum"."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def fields(source: str) -> Iterator[tuple]:
        stack: list[tuple[str, str]] = []
        count: dict[str, int] = {}
        for line in re.sub(r"/\*.*?\*/|//[^\n]*", "", source, flags=re.S).split("\n"):
            if m := _OPEN.match(line):
                if not m[3]:
                    stack.append((m[1], m[2]))
            elif stack and (m := (_VALUE if stack[-1][0] == "enum" else _FIELD).match(line)):
                owner = ".".join(n for k, n in stack if k != "oneof")
                k = count[owner] = count.get(owner, -1) + 1
                if stack[-1][0] == "enum":
                    yield owner, k, m[1], int(m[2]), "enum", "", None, None
                else:
                    yield owner, k, m[3], int(m[4]), m[1] or "", m[2], stack[-1][1] if stack[-1][0] == "oneof" else None, m[5]
            for _ in range(line.count("}") - line.count("{") * bool(not _OPEN.match(line) or line.count("}"))):
                if stack:
                    stack.pop()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(r.file, *f) for r in pdf.itertuples(index=False) for f in fields(r.value)]
            yield pd.DataFrame(rows, columns=["file", "message", "ord", "field", "number", "label", "type", "oneof", "options"])

    return text.mapInPandas(run, "file string, message string, ord int, field string, number long, label string, type string, oneof string, options string")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): all whole numbers of a JSON document under their pointers, as floors and ratchets take them."""
    text = spark.read.text(path, wholetext=True)

    def walk(value, at: str) -> Iterator[tuple[str, int]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")
        elif isinstance(value, int) and not isinstance(value, bool):
            yield at, value

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([x for v in pdf["value"] for x in walk(json.loads(v), "")], columns=["key", "value"])

    return text.mapInPandas(run, "key string, value long")
