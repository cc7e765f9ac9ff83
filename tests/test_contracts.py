"""Operators over request trees: rules that fire on a mutation only, inheritance, inlining and completions."""

import pytest
from pyspark.sql import functions as F

from corbel.operators import checks, contracts

ASSERTION = "owner int, path string, kind string, name string, value string, reference_path string"


@pytest.mark.parametrize(
    "good,bad",
    [
        (("reference", "a", None, "x/y"), ("reference", "a", "v", "x/y")), (("reference", "a", None, "x"), ("reference", "", None, "x")), (("reference", "a", None, "x"), ("reference", "a", None, "")),
        (("attr", "a", None, None), ("attr", None, "v", None)), (("const", "a", "", None), ("const", "a", None, None)), (("content", None, "t", None), ("content", None, None, None)),
        (("tag", "t", None, None), ("tag", None, None, None)), (("child", "c", None, None), ("child", "c", "v", None)), (("child", "c", None, None), ("child", None, None, None)),
    ],
)
def test_assertions(spark, good, bad):
    rows = lambda x: checks.failing(spark, contracts.assertion_rules(spark.createDataFrame([(1, "p", *x)], ASSERTION))).collect()
    assert not rows(good) and len(rows(bad)) == 1


def test_groups(spark):
    g = spark.createDataFrame([(1, "a", None, 0), (1, "b", True, 0), (1, "c", False, 2), (1, "d", None, None)], "owner int, path string, optional boolean, n_variants int")
    assert {r.key for r in checks.failing(spark, contracts.variant_group_rules(g)).collect()} == {"1|a", "1|d"}
    f = spark.createDataFrame([(1, "a", "xMixinGroup", "m", 0, 0), (1, "b", "xMixinGroup", "m", 0, 1), (1, "c", "x", "m", 0, 0), (1, "d", "xMixinGroup", None, 0, 0)], "owner int, path string, name string, method string, n_variants int, n_children int")
    assert {r.key for r in checks.failing(spark, contracts.mixin_group_rules(f)).collect()} == {"1|a"}


def test_presence_of_lists_in_lists(spark):
    rows = [("o", "a", 0), ("o", "a/[]", 0), ("o", "a/[]/[]", 1), ("o", "a/[]/[]/k", 0), ("p", "a", 2), ("p", "b", 1)]
    got = {r.op: (r.always, r.conditional, r.undetermined, r.all_always) for r in contracts.presence_counts(spark.createDataFrame(rows, "op string, path string, level int")).collect()}
    assert got == {"o": (2, 0, 0, False), "p": (0, 1, 1, False)}


def test_equal_sites_apart_stay(spark):
    """Sites are only compared with their neighbour in the order, which is coarser than equality."""
    site = lambda v, k: ("e", "m", [("f", v)], False, k)
    df = spark.createDataFrame([site("1", 0), site("2", 1), site("1", 2), site("1", 3)], "event string, module string, fields array<struct<name: string, value: string>>, partial boolean, ord int")
    assert tuple(contracts.call_site_totals(df).first()) == ("e", 3, 0, 3, 3, 1)


def test_inherited_arms(spark):
    arms = [("v", "outer", [], 429, "slow", None), ("v", "mid", ["outer"], None, "mid", None), ("v", "in", ["outer", "mid"], None, None, 1), ("v", "own", ["outer"], 7, "own", None), ("w", "outer", [], None, None, None)]
    pins = [("v", ["error", "error"], None, None, 9), ("v", ["error"], 207, None, None), ("w", ["error"], 500, None, None)]
    got, envelope = contracts.inherited_arms(spark.createDataFrame(arms, "variant string, arm string, trail array<string>, code long, text string, code_min long"), spark.createDataFrame(pins, "variant string, path array<string>, code long, text string, code_min long"), ("code", "text", "code_min"))
    assert {(r.variant, r.arm): (r.code, r.text, r.code_min) for r in got.collect()} == {("v", "in"): (429, "mid", 1), ("v", "own"): (7, "own", 9), ("w", "outer"): (500, None, None)}
    assert [tuple(r) for r in envelope.collect()] == [("v", 207, None, None)]


def test_inlining_ends_on_cycles(spark):
    nodes = spark.createDataFrame([(1, "r", "a", None), (2, "r", "none", None), (3, "r", None, "leaf")], "owner int, path string, helper string, tag string")
    helpers = spark.createDataFrame([("a", "", None, "top"), ("a", "x", "b", None), ("b", "y", "a", None), ("b", "z", None, "end")], "helper_name string, rel_path string, helper string, tag string")
    got = {(r.owner, r.path, r.helper, r.tag) for r in contracts.inlined(nodes, helpers).collect()}
    assert got == {(1, "r", None, "top"), (1, "r/x/z", None, "end"), (1, "r/x/y", "a", None), (2, "r", "none", None), (3, "r", None, "leaf")}


def test_constants_fill_open_content_only(spark):
    rows = [("t", True, None, None, None, None, None), ("t", False, None, None, None, None, None), ("t", True, "dynamic", None, None, 9, None), ("t", True, "dynamic", "v", None, None, None), ("t", True, "const", "v", None, None, None), ("u", True, None, None, None, None, None)]
    n = spark.createDataFrame(rows, "tag string, is_leaf boolean, kind string, value string, const_bytes string, byte_length int, value_source string")
    got = [tuple(r)[2:] for r in contracts.filled_constants(n, spark.createDataFrame([("t", 2, "M")], "tag string, zeros int, source string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("bytes", None, "0000", 2, "const:M"), (None,) * 5, ("bytes", None, "0000", 9, "const:M"), ("dynamic", "v", None, None, None), ("const", "v", None, None, None), (None,) * 5]))


def test_admission(spark):
    q = spark.createDataFrame([(1, "n", "n", "get", "get", "group_jid", "group_jid", "a", 1, 0)], "owner int, namespace string, request_namespace string, iq_type string, request_type string, target string, request_target string, target_arg_path string, n_outcomes int, n_root_groups int")
    n = spark.createDataFrame([(1, "p", "t", "required", False, None, None, None, 0)], "owner int, path string, tag string, presence string, repeats boolean, repeat_min int, repeat_max int, arg_path string, n_groups int")
    a = spark.createDataFrame([(1, "t", "x", "const", "v", None)], "owner int, tag string, name string, kind string, value string, arg_path string")
    c = spark.createDataFrame([(1, "t", "const", None)], "owner int, tag string, kind string, arg_path string")
    assert not contracts.request_gaps(q, n, a, c).collect()
    why = lambda *t: sorted(r.message for r in contracts.request_gaps(*t).collect())
    assert why(q.withColumns({"request_type": F.lit("set"), "target_arg_path": F.lit(None).cast("string")}), n, a, c) == ["request.envelope_disagreement", "request.target_argument_missing"]
    assert why(q, n.withColumn("repeats", F.lit(True)), a, c) == ["request.t.argument_missing", "request.t.repeat_bounds_missing", "request.t.repeat_validation_unemitted"]
    assert why(q, n, a.withColumn("kind", F.lit("string")), c.withColumn("kind", F.lit("bytes"))) == ["request.t.content_argument_missing", "request.t.x.fixed_value_validation_unemitted"]


FIELD = dict.fromkeys(("method", "n_children", "literal", "byte_length", "byte_length_source", "const_value", "value_source", "reference_path", "unknown_policy", "unions")) | {"owner": 1, "path": "p", "type": "integer"}
FIELDS = "owner int, path string, type string, method string, n_children int, literal string, byte_length int, byte_length_source string, const_value string, value_source string, reference_path string, unknown_policy string, unions array<string>"
ACTION = {"name": "n", "scope": "chat", "collection": "c", "value_field": "f", "value_type": "A.B", "chat_jid_index": 1, "index_kinds": ["literal", "jid"], "first_part": "n", "enum_paths": ["E"]}


def _fields(spark, rows):
    names = [c.strip().split(" ")[0] for c in FIELDS.split(",")]
    return spark.createDataFrame([tuple((FIELD | {"path": str(k)} | r)[n] for n in names) for k, r in enumerate(rows)], FIELDS)


def test_fields_hold_together(spark):
    good = [{"literal": "-12"}, {"type": "bytes", "literal": "00ff", "byte_length": 2}, {"method": "attrInt"}, {"type": "node", "n_children": 2}, {"type": "enum", "method": "maybeAttrEnum", "unknown_policy": "reject"}, {"method": "contentUint", "byte_length": 4, "byte_length_source": "x"}, {"type": "union", "unions": ["a", "b"]}, {"reference_path": "to"}, {"type": "string", "method": "attrOther"}]
    assert not checks.failing(spark, checks.content_rules(_fields(spark, good))).collect()
    bad = [
        ({"literal": "1_0"}, "integer literal"), ({"type": "bytes", "literal": "0F"}, "bytes literal"), ({"type": "bytes", "literal": "0f", "byte_length": 2}, "bytes literal length"), ({"literal": "1", "reference_path": "to"}, "literal and reference"),
        ({"reference_path": ""}, "reference path"), ({"type": "string", "method": "attrInt"}, "accessor type"), ({"method": "attrInt", "byte_length": 4}, "byte width"), ({"byte_length_source": "x"}, "width source"), ({"value_source": "x"}, "value source"),
        ({"n_children": 1}, "container"), ({"type": "node"}, "node"), ({"unknown_policy": "maybe"}, "policy"), ({"type": "union", "unions": ["a", ""]}, "union name"), ({"type": "union", "unions": ["foo_bar", "fooBar", "foo-Bar"]}, "union names"),
    ]
    got = {r.key: r.rule for r in checks.failing(spark, checks.content_rules(_fields(spark, [r for r, _ in bad]))).collect()}
    assert got == {f"1|{k}": rule for k, (_, rule) in enumerate(bad)}


def test_members(spark):
    m = "module string, name string, value_kind string, member string, value string"
    ok = [("m", "n", "int", "A", "1"), ("m", "n", "int", "B", "2"), ("t", "n", "string", "A", "x")]
    r = spark.createDataFrame([(1, "m")], "owner int, module string")
    assert not checks.failing(spark, checks.member_rules(spark.createDataFrame(ok, m), r)).collect()
    rules = lambda rows, refs=r: {x.rule for x in checks.failing(spark, checks.member_rules(spark.createDataFrame(rows, m), refs)).collect()}
    assert rules([*ok, ("m", "n", "int", "C", "x")]) == {"member kind"} and rules([*ok, ("m", "n", "int", "C", "2")]) == {"member value"}
    assert rules([*ok, ("m", "n", "int", "B", "3")]) == {"member twice"} and rules([*ok, ("m", "o", "int", "C", "9")]) == {"enum module"}
    assert rules(ok, spark.createDataFrame([(1, "gone")], "owner int, module string")) == {"enum module"}


def test_action_indexes(spark):
    schema = "name string, scope string, collection string, value_field string, value_type string, chat_jid_index long, index_kinds array<string>, first_part string, enum_paths array<string>"
    one = lambda rows, names: spark.createDataFrame([(x,) for x in rows], names)
    fields = spark.createDataFrame([("f", "B"), ("g", "C")], "field string, type string")

    def rules(change, collections=("c", "regular")):
        row = spark.createDataFrame([tuple((ACTION | change)[c.strip().split(" ")[0]] for c in schema.split(","))], schema)
        return {x.rule for x in checks.failing(spark, checks.action_index_rules(row, one(collections, "name string"), fields, one(["E"], "path string"))).collect()}

    assert rules({}) == set() and rules({"collection": None, "chat_jid_index": None}) == set()
    cases = {"action collection": {"collection": "x"}, "action value field": {"value_field": "z"}, "action value type": {"value_field": "g"}, "action enum": {"enum_paths": ["F"]}, "chat index": {"chat_jid_index": 2}, "chat index kind": {"index_kinds": ["literal", "string"]}, "index start": {"index_kinds": [], "chat_jid_index": None}, "index name": {"first_part": "o"}}
    assert {k: rules(v) for k, v in cases.items()} == {k: {k} for k in cases}
    assert rules({}, ("c", "c", "C", "regular")) == {"collection twice", "collection names"}
