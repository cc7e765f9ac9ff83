"""Catalog documents that are written here, read back as tables."""

import json

from corbel.operators import checks
from corbel.sources import documents


def test_collections_and_metrics(spark, tmp_path):
    doc = {"version": "v", "list": [{"name": "b", "x": None}, {"name": "a"}], "named": {"k": {"y": 1.0}}, "counts": {"a/b": 3, "on": True, "deep": {"n": 4}}}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=2))
    rows = documents.collection(spark, str(tmp_path / "d.json"), "list", "dom")
    assert [(r.idx, r.item) for r in rows.orderBy("idx").collect()] == [(0, '{"name": "b", "x": null}'), (1, '{"name": "a"}')]
    assert sorted(r.name for r in documents.name_set(rows).collect()) == ["a", "b"]
    named = documents.collection(spark, str(tmp_path / "d.json"), "named", "dom")
    assert [(r.key, r.item) for r in named.collect()] == [("k", '{"y": 1.0}')]
    got = documents.metrics(spark, str(tmp_path / "d.json"))
    assert {r.key: r.value for r in got.collect()} == {"/counts/a~1b": 3, "/counts/deep/n": 4}
    pinned = spark.createDataFrame([("/counts/a~1b", 3), ("/counts/deep/n", 5)], "key string, value long")
    assert [r.key for r in checks.exact_ratchet(got, pinned).collect()] == ["/counts/deep/n"]


def test_message_definitions(spark, tmp_path):
    text = 'syntax = "proto2";\nmessage A { // note\n  required string s = 1 [default = "x"];\n  message B {\n    repeated A.B kids = 2;\n  }\n  oneof pick {\n    uint32 n = 3;\n  }\n  enum K {\n    X = 0;\n    Y = -1;\n  }\n  map<string, B> m = 4;\n}\nmessage E {}\nmessage F {\n  optional bool f = 1;\n}\n'
    (tmp_path / "m.proto").write_text(text)
    rows = {(r.message, r.field): (r.ord, r.number, r.label, r.type, r.oneof, r.options) for r in documents.message_definitions(spark, str(tmp_path / "m.proto")).collect()}
    assert rows == {
        ("A", "s"): (0, 1, "required", "string", None, 'default = "x"'), ("A.B", "kids"): (0, 2, "repeated", "A.B", None, None), ("A", "n"): (1, 3, "", "uint32", "pick", None),
        ("A.K", "X"): (0, 0, "enum", "", None, None), ("A.K", "Y"): (1, -1, "enum", "", None, None), ("A", "m"): (2, 4, "", "map<string, B>", None, None), ("F", "f"): (0, 1, "optional", "bool", None, None),
    }
