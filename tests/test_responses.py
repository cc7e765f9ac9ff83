"""Parsers of responses, outcomes of calls and what their errors accept, over miniature modules."""

import pytest

from corbel.plans import responses
from corbel.sources import bundles as src

from .test_catalog import define

U = 'o("WASmaxParseUtils")'


def check(name, call):
    return f"var {name}={call};if(!{name}.success)return {name};"


MIXIN = define("WASmaxInMBaseMixin", [], f'function e(e,t){{{check("n", U + chr(46) + "assertTag(e,%siq%s)" % (chr(34), chr(34)))}{check("r", "o(%sRef%s).attrStringFromReference(t,[%sto%s])" % ((chr(34),) * 4))}{check("a", U + ".literal(" + U + ".attrString,e,%sfrom%s,r.value)" % (chr(34), chr(34)))}{check("s", U + ".literal(" + U + ".attrString,e,%stype%s,%sresult%s)" % ((chr(34),) * 4))}return o("R").makeResult({{type:s.value}})}}l.parseBase=e')
SUCCESS = define(
    "WASmaxInThingResponseSuccess", [],
    f'function e(e,t){{var n={U}.flattenedChildWithTag(e,"thing");if(!n.success)return n;var g={U}.flattenedChildWithTag(e,"gate");if(!g.success)return g;'
    f'var a={U}.attrInt(n.value,"count"),b={U}.optional({U}.attrUserJid,e,"who"),c={U}.mapChildrenWithTag(n.value,"kid",1,5,o("WASmaxInKid").parseKid),m=o("WASmaxInMBaseMixin").parseBase(e,t);'
    f'var z=function(g){{return g.value}};return o("R").makeResult(babelHelpers.extends({{count:a.value,who:b.value,kids:c.value}},m.value))}}l.parseThingResponseSuccess=e',
)
FAILURE = define(
    "WASmaxInThingResponseError", [],
    f'function e(e,t){{var q={U}.assertAttr(e,"type","error"),x={U}.flattenedChildWithTag(e,"error"),c={U}.literal({U}.attrInt,x.value,"code",404),d={U}.literal({U}.attrString,x.value,"text","gone");return o("R").makeResult({{code:c.value,text:d.value}})}}l.parseThingResponseError=e',
)
RPC = define("WASmaxThingRPC", [], 'function e(){var a=o("WASmaxInThingResponseError").parseThingResponseError(r,n);if(a.success)return{name:"ThingResponseError",value:a.value};var i=o("WASmaxInThingResponseSuccess").parseThingResponseSuccess(r,n);if(i.success)return{name:"ThingResponseSuccess",value:i.value}}l.send=e')
ALONE = define("WASmaxInPingResponseSuccess", [], f'function e(e,t){{var n={U}.assertTag(e,"pong");return o("R").makeResult({{}})}}function f(e){{return o("R").makeResult({{}})}}l.parsePingResponseSuccess=e;l.parsePingResponseSuccessPayload=f')
ALIAS = define("Build", ["WASmaxJsx", "WAWap"], 'var n,w=o("WAWap"),x=(n=o("WASmaxJsx")).smax("iq",null);function y(){var w=o("WASmaxJsx");var z=o("Other")}')
QUERY = define("Q.graphql", [], 'var s={kind:"ScalarField",name:"is_ok"},a=[{alias:null,kind:"LinkedField",name:"items",plural:!0,selections:[{kind:"ScalarField",name:"item_count"},s]},{kind:"InlineFragment",selections:[{kind:"LinkedField",alias:"own",name:"x",plural:!1,selections:[s]},{kind:"ScalarField",name:"items"}]},{kind:"TypeDiscriminator"}];var n={fragment:{kind:"Fragment",name:"Q",selections:a},kind:"Request"};')


@pytest.fixture(scope="module")
def modules(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("responses")
    (d / "a.js").write_text("\n;\n".join([MIXIN, SUCCESS, FAILURE, RPC, ALONE, ALIAS, QUERY]))
    return src.split(src.scan(spark, str(d))).persist()


def test_steps_of_parsers(modules):
    every = responses.resolved(responses.parsers(modules))
    own = {(r.kind, r.name): r for r in responses.asserted(every).filter("module = 'WASmaxInThingResponseSuccess'").collect()}
    # What the mixin asserts of the same node holds here too; the child that nothing reads is a gate.
    assert set(own) == {("tag", "iq"), ("reference", "from"), ("attr", "type"), ("child", "gate")}
    assert own["reference", "from"].reference_path == "to" and own["attr", "type"].value == "result"
    got = {r.name: r for r in responses.fields(every).filter("module = 'WASmaxInThingResponseSuccess'").collect()}
    assert {n: (r.type, r.wire_name, r.source_path, r.optional) for n, r in got.items()} == {"count": ("integer", "count", "thing", False), "who": ("userJid", "who", None, True), "kids": ("list", "kid", "thing", False), "type": ("string", "type", None, False)}
    assert (got["kids"].low, got["kids"].high, got["type"].value) == (1, 5, "result")


def test_response_index(modules):
    out, arms = responses.response_index(modules)
    rows = {(r.operation, r.tag): (r.kind, r.primary, r.ord) for r in out.collect()}
    assert rows == {("Thing", "ThingResponseError"): ("client_error", False, 0), ("Thing", "ThingResponseSuccess"): ("success", True, 1), ("Ping", "PingResponseSuccess"): ("success", True, 0)}
    assert [tuple(r) for r in arms.collect()] == [("Thing", "ThingResponseError", 404, "gone", None, None)]


def test_aliases(modules):
    assert {(r.local, r.owner) for r in responses.aliases(modules).collect()} == {("n", "WASmaxJsx")}


def test_response_shapes(modules):
    got = {r.path: (r.kind, r.type) for r in responses.response_shapes(modules).collect()}
    assert got == {"items": ("array", "array"), "items/item_count": ("leaf", "number"), "items/is_ok": ("leaf", "boolean"), "own": ("object", "object"), "own/is_ok": ("leaf", "boolean"), "__typename": ("leaf", "string")}
