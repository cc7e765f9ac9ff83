"""Catalogs of miniature sources that are written here: splitting, facts, which copy wins, and documents."""

import gzip
import io
import json
import lzma
import tarfile

import pytest
from pyspark.sql import functions as F

from corbel.operators import checks, dedup, sets
from corbel.plans import catalog, extract, programs
from corbel.sources import bundles as src
from corbel.sources import js


def define(name, deps, body):
    listed = ",".join(f'"{d}"' for d in deps)
    return f'__d("{name}",[{listed}],(function(t,n,r,o,a,i,l){{{body}}}),42);'


FLAGS = "var c={" + ",".join(f'flag_{k}:[{k},"{t}",{v}]' for k, (t, v) in enumerate([("bool", "!0"), ("int", "-5"), ("string", '"é"'), ("float", "1.5"), ("bool", "!1,!0")])) + ',bad:[9,"date",1]},small={a:[1,"int",2]};i.default=c;'
TOKENS = 'var s=["a","b"],d0=["x","y"],d1=["z"],v=3,ds=[d0,d1];i.SINGLE_BYTE_TOKEN=s;i.DICTIONARIES=ds;i.DICT_VERSION=v;'
EVENT = 'var e=o("WAWebWamCodegenUtils").defineEvents({Open:[7,{count:[1,o("WAWebWamCodegenUtils").TYPES.INTEGER],kind:[2,o("WAWebWamEnumKind").KIND],odd:[3,q]},[1,20,2000],"private",-1],Empty:[8,{},[1,1,1]]});i.OpenWamEvent=e;'
SITE = 'var x=new(o("MyWamEvent").OpenWamEvent)({count:3,extra:1,weight:5});var y=new(o("OtherWamEvent").Gone)();'
QUERY = 'var a=[{kind:"LocalArgument",name:"id"},{name:"size"}];var n={fragment:{argumentDefinitions:a},kind:"Request",params:{id:__ID__,name:"WAWebMexFetchThingJobQuery",operationKind:"query"}};'
PROTO = 'var s={},e={};s.internalSpec={name:[1,o("P").TYPES.STRING|o("P").FLAGS.REQUIRED],kids:[2,o("P").TYPES.MESSAGE|o("P").FLAGS.REPEATED,e],n:[3,o("P").TYPES.UINT32|o("P").FLAGS.REPEATED|o("P").FLAGS.PACKED],p:[4,o("P").TYPES.BOOL],__oneofs__:{pick:["p"]}};e.internalSpec={v:[1,o("P").TYPES.ENUM,k]};var k=o("$InternalEnum")({A:0,B:1});i.ThingSpec=s;i.Thing$KidSpec=e;i.KIND=k;'

ONE = [
    define("Flags.ABPropsConfigs", [], FLAGS).replace("Flags.ABPropsConfigs", "MyABPropsConfigs"),
    define("Tok", [], TOKENS),
    define("Enums", ["$InternalEnum"], 'var m=o("$InternalEnum")({UP:0,DOWN:1}),w=o("$InternalEnum")({A:"a",B:1});i.Dir=m;i.Mixed=w;i.Text=o("$InternalEnum")({A:"a"});'),
    define("WASmaxInThingEnums", [], "var e={NO:-1,YES:1},f={camel:1};i.ACK=e;i.LOOSE=f;"),
    define("User", ["Enums", "MyWamEvent"], 'var z=1<<o("Enums").Dir.UP;' + SITE),
    define("MyWamEvent", ["WAWebWamCodegenUtils"], EVENT),
    define("WAWasmLoader", ["bx", "WAWasmModuleCache"], 'var u=r("bx").getURL(r("bx")("338"));var f="my.wasm",g="data:x.wasm";r("bx")("abc");'),
    define("Q.graphql", [], QUERY.replace("__ID__", 'r("Q_facebookRelayOperation")')),
    define("Q_facebookRelayOperation", [], 'a.exports="12345";'),
    define("Caller", ["Q.graphql"], ""),
    define("Proto", [], PROTO),
    define("Build", ["WAWap"], 'var q=o("WAWap").wap("iq",{to:"s.net",id:o("WAWap").generateId(),n:o("WAWap").INT(e)},o("WAWap").wap("ping",null));'),
    define("Disp", [], 'switch(e.type){case"a":case"b":return o("HandleB").run(e);case"c":{break}default:return null}'),
    define("Reader", ["WADeprecatedWapParser"], 'var p=new(o("WADeprecatedWapParser"))("x",function(e){return{a:e.maybeAttrEnum("kind"),b:e.attrInt("n"),c:e.child("kid").contentBytes()}});'),
]
TWO = [
    define("Tok", [], TOKENS.replace('"a"', '"other"')),
    define("User", ["Enums"], SITE),
    define("Enums", ["$InternalEnum"], 'i.Dir=o("$InternalEnum")({LATER:5});i.Only=o("$InternalEnum")({ONE:1});'),
    '__d("NoFactory",[]);__d(name,[],f,1);__d("Dyn",deps,(function(){var s="}";/}"/.test(s);`${a?"}":b}`}),7);',
]


@pytest.fixture(scope="module")
def bundles(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("bundles")
    (d / "a.js").write_bytes("é;\n".encode() + "\n".join(ONE).encode() + b"\xff;\n")
    (d / "b.js").write_text("\n;\n".join(TWO))
    (d / "skip.txt").write_text("no")
    return src.scan(spark, str(d))


@pytest.fixture(scope="module")
def modules(bundles):
    return src.spread(src.split(bundles)).persist()


def test_scan_and_split(bundles, modules):
    assert [(r.bundle_ord, r.path.rsplit("/", 1)[1]) for r in bundles.orderBy("bundle_ord").collect()] == [(0, "a.js"), (1, "b.js")]
    rows = modules.orderBy("bundle_ord", "module_ord").collect()
    assert [r.name for r in rows if r.bundle_ord == 0] == [js.definitions(x)[0].name for x in ONE]
    assert [r.name for r in rows if r.bundle_ord == 1] == ["Tok", "User", "Enums", "Dyn"]
    body = {r.bundle_ord: bytes(r.content) for r in bundles.collect()}
    for r in rows:
        assert body[r.bundle_ord][r.start : r.end].decode() == r.slice
        assert r.start < r.factory_start < r.factory_end < r.end
    assert next(r for r in rows if r.name == "Dyn").deps == []
    index = src.source_index(bundles, modules, ["Tok"]).collect()
    assert len(index) == 2 and len({r.source_sha256 for r in index}) == 2


def test_strict_split_rejects_and_descends():
    inner = define("Inner", [], "")
    assert [d.name for d in js.definitions(define("Outer", [], inner))] == ["Outer"]
    assert [d.name for d in js.definitions(define("Outer", [], inner), strict=True)] == ["Outer", "Inner"]
    with pytest.raises(js.JsError):
        js.definitions("__d('a',[],(function(){)),1)", strict=True)
    with pytest.raises(js.JsError):
        js.definitions("var s='no end", strict=True)


def test_reader():
    r = js.Reader("a = b ? {x: [1, -2.5, 'q\\n\\u0041', !0, null,, ...z]} : (1, 2); f(g(`t`), /[/]/g.test(x) / 2, async (p) => p, class {})")
    name, value = next(r.declared())
    assert (name, value.kind) == ("a", "cond")
    items = js.as_array(js.entry(value.args[1], "x"))
    assert [js.as_number(items[0]), js.as_number(items[1]), js.as_str(items[2]), js.as_bool(items[3]), items[4].kind, items[5], items[6]] == [1, -2.5, "q\nA", True, "null", None, None]
    calls = list(r.calls())
    assert len(calls[0].args[1]) == 4
    assert js.as_number(js.Reader("0x1F").expression(0)) == 31 and js.as_int(js.Reader("1e3").expression(0)) == 1000


def test_tokens_flags_enums(bundles, modules):
    t = {(r.dictionary, r.position): r.token for r in catalog.tokens(modules).collect()}
    assert t == {(-1, 0): "", (-1, 1): "a", (-1, 2): "b", (0, 0): "x", (0, 1): "y", (1, 0): "z"}
    assert not checks.failing(modules.sparkSession, checks.token_rules(catalog.tokens(modules))).count()
    f = {r.name: (r.code, r.type, r.default_json, r.other_json) for r in catalog.flags(modules).collect()}
    assert f == {"flag_0": (0, "bool", "true", None), "flag_1": (1, "int", "-5", None), "flag_2": (2, "string", '"é"', None), "flag_3": (3, "float", "1.5", None), "flag_4": (4, "bool", "false", "true")}
    assert not checks.failing(modules.sparkSession, checks.flag_rules(catalog.flags(modules))).count()
    e = {(r.module, r.name): (r.kind, [tuple(v) for v in r.variants], r.bit_position) for r in catalog.enums(modules, bundles).collect()}
    assert e == {
        ("Enums", "Dir"): ("int", [("UP", "0"), ("DOWN", "1")], True), ("Enums", "Only"): ("int", [("ONE", "1")], False), ("Enums", "Text"): ("string", [("A", "a")], False),
        ("WASmaxInThingEnums", "ACK"): ("int", [("NO", "-1"), ("YES", "1")], False),
    }


def test_binaries_and_operations(modules):
    assert [(r.name, r.modules) for r in catalog.binaries(modules).collect()] == [("my.wasm", "WAWasmLoader")]
    assert [tuple(r) for r in catalog.resources(modules).collect()] == [("338", "WAWasmLoader", "moduleName,wasmBinaryLiteral,wasmModuleCacheDep")]
    ops = catalog.operations(modules).collect()
    assert [tuple(r) for r in ops] == [("FetchThing", "WAWebMexFetchThingJobQuery", "query", "12345", "sibling", "id,size", "Caller")]


def test_events_and_sites(modules):
    heads, fields = catalog.events(modules)
    assert {r.event: (r.code, r.export, r.channel, r.ps_id, list(r.weights), r.consumers) for r in heads.collect()} == {"Open": (7, "OpenWamEvent", "private", None, [1, 20, 2000], "User"), "Empty": (8, "OpenWamEvent", "regular", None, [1, 1, 1], "User")}
    assert {(r.field, r.field_id, r.field_type, r.enum_module) for r in fields.collect()} == {("count", 1, "integer", None), ("kind", 2, "enum", "WAWebWamEnumKind")}
    only = heads.filter("event = 'Open'")
    sites, writes = catalog.call_sites(modules, only, fields)
    got = {(r.event_module, r.export): (r.event, r.how, r.partial) for r in sites.collect()}
    assert got == {("MyWamEvent", "OpenWamEvent"): ("Open", "export", True), ("OtherWamEvent", "Gone"): (None, "unmatched", False)}
    assert {(r.field, r.state, r.value) for r in writes.collect()} == {("count", "field", '"3"'.strip('"') + ".0"), ("extra", "dropped", "1.0"), ("weight", "special", "5.0")} or {(r.field, r.state) for r in writes.collect()} == {("count", "field"), ("extra", "dropped"), ("weight", "special")}
    assert catalog.unmatched_sites(sites).first().n >= 1


def test_messages(modules):
    got = catalog.messages(modules)
    rows = {(r.message, r.field): (r.number, r.label, r.type, r.ref_name, r.packed, r.oneof) for r in got.collect()}
    assert rows["Thing", "name"] == (1, "required", "string", None, False, None)
    assert rows["Thing", "kids"] == (2, "repeated", "message", "Thing.Kid", False, None)
    assert rows["Thing", "n"][4] and rows["Thing", "p"][5] == "pick"
    assert rows["Thing.Kid", "v"][3] == "KIND" and rows["KIND", "A"][1] == "enum"
    assert not checks.failing(modules.sparkSession, catalog.message_errors(got)).count()
    text = {r.message: r.text for r in catalog.proto_text(got).collect()}
    assert text["Thing"] == "message Thing {\n  required string name = 1;\n  repeated Thing.Kid kids = 2;\n  repeated uint32 n = 3 [packed = true];\n  oneof pick {\n    bool p = 4;\n  }\n}"
    assert text["KIND"] == "enum KIND {\n  A = 0;\n  B = 1;\n}"


def test_builders_handlers_readers(modules):
    rows = {(r.path, r.attr): (r.tag, r.kind, r.literal) for r in catalog.stanzas(modules).collect()}
    assert rows == {("0", "to"): ("iq", "const", "s.net"), ("0", "id"): ("iq", "generated", None), ("0", "n"): ("iq", "int", None), ("0/0", None): ("ping", None, None)}
    got = {r.case: (r.handler_module, r.handler_name, r.sole) for r in catalog.handlers(modules).collect()}
    assert got["a"] == got["b"] == ("HandleB", "run", False) and got["c"][0] is None
    fields = {r.accessor: (r.argument, r.type, r.optional, r.policy) for r in catalog.read_fields(modules).collect()}
    assert fields["maybeAttrEnum"] == ("kind", "enum", True, "reject") and fields["attrInt"] == ("n", "integer", False, None) and fields["contentBytes"][1] == "bytes"


def test_order_of_rows_changes_nothing(spark, bundles, modules):
    mixed = src.split(bundles.orderBy(F.desc("bundle_ord"))).orderBy(F.rand(3))
    for f in (catalog.tokens, catalog.flags, catalog.enums, catalog.operations, catalog.messages):
        assert sorted(map(str, f(mixed).collect())) == sorted(map(str, f(modules).collect()))


def test_documents(spark, modules, tmp_path):
    cats = {"flags": (catalog.flags(modules), ["module", "name"]), "operations": (catalog.operations(modules), ["name"])}
    manifest = {r.name: (r.records, r.sha256) for r in catalog.write_documents(spark, str(tmp_path / "out"), "v1", cats).collect()}
    assert manifest["flags"][0] == 5
    doc = json.loads(spark.read.text(str(tmp_path / "out/flags")).first().value)
    assert [x["name"] for x in doc["flags"]] == [f"flag_{k}" for k in range(5)] and "other_json" not in doc["flags"][0]
    with pytest.raises(ValueError, match="no rows"):
        catalog.write_documents(spark, str(tmp_path / "none"), "v1", {"flags": (catalog.flags(modules).limit(0), ["module", "name"])})
    assert json.loads(catalog.schema_documents({"flags": cats["flags"][0]})["flags"])["type"] == "struct"


def _tar(files):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for name, body in files:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return buf.getvalue()


def test_archives_locks_and_cache(spark, tmp_path):
    files = [("x.js", b"one"), ("y.js", b"two")]
    raw = _tar(files)
    for data in (raw, gzip.compress(raw), lzma.compress(raw)):
        got = src.unpack(spark.createDataFrame([("a", bytearray(data))], "path string, content binary"))
        assert {(r.path, bytes(r.content)) for r in got.collect()} == set(files)
    for bad in (_tar([]), _tar([("../x", b"")]), _tar([("x", b""), ("x", b"")])):
        with pytest.raises(Exception, match="no files|not admitted"):
            src.unpack(spark.createDataFrame([("a", bytearray(bad))], "path string, content binary")).collect()
    got = src.unpack(spark.createDataFrame([("a", bytearray(raw))], "path string, content binary"))
    src.write_lock(got, str(tmp_path / "lock"), "v1")
    lock = src.read_lock(spark, str(tmp_path / "lock"))
    assert lock.count() == 2 and not src.lock_errors(lock).count()
    assert src.lock_errors(lock.withColumn("size", F.col("size") + 1)).count() == 1
    assert src.cached(spark, str(tmp_path / "cache"), "v1", lock) is None
    src.write_cache(got.select("path", "content"), str(tmp_path / "cache"), "v1")
    assert src.cached(spark, str(tmp_path / "cache"), "v1", lock).count() == 2
    assert src.cached(spark, str(tmp_path / "cache"), "v1", lock.limit(1)) is None


def test_discovery_and_fetching(spark, tmp_path):
    page = '<script src="/a.js?x=1&amp;y"></script><SCRIPT data-sjs>{"bx":{"77":{"uri":"https://s/x.wasm"}},"l":["https://s/b.js#z","no"]}</SCRIPT><script>"client_revision": 1234, </script><script type="application/json">{bad</script>'
    got = {(r.kind, r.value) for r in src.discover(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()}
    assert got == {("js", "/a.js?x=1&y"), ("bx", "77 https://s/x.wasm"), ("wasm", "https://s/x.wasm"), ("js", "https://s/b.js#z"), ("version", "2.3000.1234")}

    def get(url):
        if "bad" in url:
            raise OSError("gone")
        return url.encode()

    good, bad = src.fetched(spark.createDataFrame([("u1",), ("bad",), ("u1",)], "url string"), get, str(tmp_path / "f"), 2)
    assert [r.url for r in good.collect()] == ["u1"] and [r.why for r in bad.collect()] == ["OSError: gone"]
    got, current = src.from_folder_or_client(spark, None, spark.createDataFrame([("b",), ("a",)], "url string"), get, str(tmp_path / "g"))
    assert current and [(r.bundle_ord, r.path, bytes(r.content)) for r in got.orderBy("bundle_ord").collect()] == [(0, "a", b"a"), (1, "b", b"b")]
    with pytest.raises(ValueError, match="incomplete: bad"):
        src.from_folder_or_client(spark, None, spark.createDataFrame([("b",), ("bad",)], "url string"), get, str(tmp_path / "h"))
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "x.js").write_text("1")
    assert src.from_folder_or_client(spark, str(tmp_path / "dir"))[1] is False


def test_restored_archives_equal_their_lock(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, body in (("x.js", b"one"), ("y.js", b"two"), ("z.js", b"one")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    archives = spark.read.format("binaryFile").load(str(tmp_path / "a.tar.gz"))
    lock = src.unpack(archives).select("sha256", "size")
    assert src.restored(archives, lock).count() == 3
    for bad in (lock.distinct(), lock.unionAll(lock.limit(1))):
        with pytest.raises(ValueError, match="1 (extra|missing)"):
            src.restored(archives, bad)


def test_closure_with_paths(spark):
    e = spark.createDataFrame([("a", "b", ""), ("b", "c", "x"), ("a", "c", "y"), ("c", "a", "z"), ("p", "q", "m"), ("q", "r", "n")], "s string, d string, p string")
    got = {(r.s, r.d): r.p for r in sets.closure_with_paths(e, "s", "d", "p").collect()}
    assert got["p", "r"] == "m/n" and got["a", "b"] is None and got["a", "c"] is None and len(got) == 12
    assert sets.fixed_point(spark.createDataFrame([(1,)], "k int"), lambda k: k.select((F.col("k") * 2 % 11).alias("k")), ["k"]).count() == 10


def test_shape_merge(spark):
    from corbel.operators.aggregate import shape_merge

    df = spark.createDataFrame([("o", "a", "leaf"), ("o", "a", "object"), ("o", "a/b", "leaf"), ("o", "c", "leaf"), ("o", "c/d", "leaf")], "op string, path string, kind string")
    assert {(r.path, r.kind) for r in shape_merge(df, "op", "path", "kind").collect()} == {("a", "object"), ("a/b", "leaf"), ("c", "leaf")}


@pytest.mark.parametrize(
    "rules,good,bad",
    [
        (lambda s, v: checks.constant_rules(s.createDataFrame([("k", v, 2)], "key string, const_bytes string, byte_length int")), "00ff", "00FF"),
        (lambda s, v: checks.flag_rules(s.createDataFrame([("m", "n", 1, "float", v)], "module string, name string, code long, type string, default_json string")), "1.0", "1"),
        (lambda s, v: checks.shape_rules(s.createDataFrame([("o", "p")], "op string, path string"), s.createDataFrame([("o", v, 0)], "op string, path string, level int")), "p", "q"),
        (lambda s, v: checks.event_rules(s.createDataFrame([("m", "n", 1, v, None, [1, 2, 3])], "module string, name string, code long, channel string, ps_id long, weights array<int>"), s.createDataFrame([("m", "f", 1)], "module string, name string, id long")), "regular", "loud"),
        (lambda s, v: checks.child_rules(s.createDataFrame([("o", "n", True, 1, 1, v, False)], "owner string, name string, required boolean, min_count int, max_count int, arg_path string, is_list boolean")), "a/b", "/a"),
        (lambda s, v: checks.sync_action_rules(s.createDataFrame([("n", v, "M", ["i"])], "name string, collection string, message string, index_parts array<string>"), ["c"], s.createDataFrame([("M",)], "message string")), "c", "d"),
        (lambda s, v: checks.enum_rules(s.createDataFrame([("m", "n", "string", ["a"])], "module string, name string, value_kind string, members array<string>"), s.createDataFrame([("o", "m", "n", v)], "owner string, module string, name string, member string")), "a", "b"),
        (lambda s, v: checks.field_rules(s.createDataFrame([("o", "p", "integer", 1, v, None, None, None, None, None, None, None)], "owner string, path string, type string, int_min long, int_max long, byte_min long, byte_max long, byte_length long, literal string, enum_ref string, unknown_policy string, variants array<string>")), 2, 0),
    ],
)
def test_rules_fire_on_a_mutation_only(spark, rules, good, bad):
    assert not checks.failing(spark, rules(spark, good)).collect()
    assert len(checks.failing(spark, rules(spark, bad)).collect()) >= 1
    with pytest.raises(ValueError):
        checks.admit(spark, rules(spark, bad))


def test_reviews(spark):
    from corbel.operators import diff

    changes = spark.createDataFrame([("1", "/a/b"), ("2", "/c")], "id string, pointer string")
    ok = spark.createDataFrame([("1", "upstream-change")], "id string, classification string")
    got = diff.reviewed(changes, ok)
    assert {r.classification: r.n for r in diff.classification_counts(got).collect()} == {"upstream-change": 1, "unreviewed": 1}
    for bad in ([("9", "upstream-change")], [("1", "nice")], [("1", "upstream-change"), ("1", "upstream-change")]):
        with pytest.raises(ValueError):
            diff.reviewed(changes, spark.createDataFrame(bad, "id string, classification string"))
    own = spark.createDataFrame([("/a", "A"), ("", "root")], "prefix string, owner string")
    assert {r.id: r.owner for r in diff.owner_of_pointer(changes, own).collect()} == {"1": "A", "2": "root"}
    assert list(diff.tree_changes({"a": 1, "b": [1], "n": None}, {"a": 1.0, "b": [1, 2]})) == [("/a", "changed", "1", "1.0"), ("/b", "changed", "[1]", "[1,2]"), ("/n", "removed", "null", None)]


def test_programs(spark):
    arg = {"op": "argument", "index": 0}
    size = {"op": "field", "object": arg, "field": "n"}
    body = [
        {"op": "bind", "slot": 0, "value": size},
        {"op": "if", "condition": {"op": "nullish", "value": {"op": "slot", "index": 0}, "negate": False}, "yes": [{"op": "fatal", "metric": {"op": "metric", "name": "MISSING"}, "message": "no n"}], "no": []},
        {"op": "return", "value": {"op": "choose", "condition": {"op": "greater", "left": {"op": "slot", "index": 0}, "right": {"op": "integer", "value": 5}}, "yes": {"op": "map", "input": {"op": "field", "object": arg, "field": "xs"}, "body": [{"op": "return", "value": {"op": "object", "fields": [["x", {"op": "argument", "index": 1}]]}}]}, "no": {"op": "transform", "transform": "twice", "arguments": [size]}}},
    ]
    df = spark.createDataFrame([(1, '[{"n":9,"xs":[1,2]}]'), (2, '[{"n":2}]'), (3, "[{}]"), (4, "[null]")], "k int, args string")
    got = {r.k: (r.value, r.fatal, list(r.metrics)) for r in programs.evaluate(df, "k", "args", body, {"twice": lambda x: 2 * x}).collect()}
    assert got[1] == ('[{"x": 1}, {"x": 2}]', None, []) and got[2] == ("4", None, []) and got[3] == (None, "no n", ["MISSING"]) and got[4][1].startswith("TypeError")
    expr = {"op": "and", "left": {"op": "not", "value": {"op": "nullish", "value": {"op": "field", "object": arg, "field": "n"}}}, "right": {"op": "or", "left": {"op": "greater", "left": {"op": "field", "object": arg, "field": "n"}, "right": {"op": "integer", "value": 5}}, "right": {"op": "field", "object": arg, "field": "s"}}}
    rows = spark.createDataFrame([((9, ""),), ((1, "yes"),), ((1, ""),), ((None, "yes"),)], "a struct<n: int, s: string>")
    assert [r.v for r in rows.select(programs.compiled(expr, {0: F.col("a")}).alias("v")).collect()] == [True, True, False, False]
    with pytest.raises(ValueError):
        programs.compiled({"op": "map"}, {})
    table = spark.createDataFrame([("a", None, "x"), (None, None, "none")], "t string, u string, out string")
    out = programs.decided(spark.createDataFrame([("a", None), (None, None), ("b", None)], "t string, u string"), table, ["t", "u"], ["out"], {"out": "unknown"})
    assert sorted(r.out for r in out.collect()) == ["none", "unknown", "x"]
    parts = programs.separated(spark.createDataFrame([(0,), (1,), (7,), (None,)], "op int"), "op", 0, 1)
    assert [p.count() for p in parts] == [1, 1, 2]


def test_buffers(spark):
    e = spark.createDataFrame([(1, "private", 258, 2, 300, 1, "[]"), (1, "private", 258, 1, 7, 20, '[[1,true],[2,"ab"],[300,-200],[4,70000],[5,1.5],[6,0],[7,100]]')], "buffer_id int, channel string, seq int, ord int, code int, weight int, fields_json string")
    got = bytes(programs.buffers(e).first().bytes)
    want = b"WAM\x05\x01\x02\x01\x02" + b"\x31\x07\xec" + b"\x22\x01" + b"\x82\x02\x02ab" + b"\x4a\x2c\x01\x38\xff" + b"\x52\x04\x70\x11\x01\x00" + b"\x72\x05\x00\x00\x00\x00\x00\x00\xf8\x3f" + b"\x12\x06" + b"\x36\x07\x64" + b"\x3d\x2c\x01\xff"
    assert got == want
    assert programs.encoded(0, 1, "x" * 300)[:4] == b"\x90\x01\x2c\x01" and programs.encoded(0, 1, float("nan"))[0] == 0x70


def test_scalars(spark):
    from corbel.functions import scalars as s

    df = spark.createDataFrame([("fooBar_bazQUX", "https://u@h.x:8/a/b.js?q=1#f", "aé🙂b")], "n string, u string, t string")
    r = df.select(s.pascal_case(F.col("n")).alias("p"), s.snake_case(F.col("n")).alias("s"), s.host(F.col("u")).alias("h"), s.file_name(F.col("u")).alias("f"), s.resolved_url(F.col("u"), F.lit("c.js")).alias("r"), s.byte_truncated(F.col("t"), 4).alias("b"), s.stripped_operation(F.lit("WAWebMexFetchXJobQuery"), ("WAWebMex", "WAWeb"), ("JobQuery", "Query")).alias("o"), s.unescaped(F.lit("a\\/b&amp;c")).alias("e"), s.constant_case(F.lit("A_1")).alias("c")).first()
    assert tuple(r) == ("FooBarBazQUX", "foo_bar_baz_qux", "h.x", "b.js", "https://u@h.x:8/a/c.js", "aé", "FetchX", "a/b&c", True)


def test_dedup_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert sorted(r.v for r in dedup.first_wins(df, ["k"], ["v"]).collect()) == [1, 3]
    assert extract.facts is not None
