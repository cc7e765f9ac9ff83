"""Requests of miniature modules: merges, envelopes, bounds and names."""

import pytest
from pyspark.sql import functions as F

from corbel.plans import requests as rq
from corbel.sources import bundles as src

from .test_catalog import define

BODY = [
    define("WASmaxOutXSetRequest", ["WASmaxJsx"], 'function e(e){var t=o("BaseMixin").mergeBaseMixin(o("WASmaxJsx").smax("iq",null,o("WASmaxJsx").smax("go",{n:o("WAWap").INT(e)})),e);return t}l.makeSet=e;'),
    define("BaseMixin", ["WASmaxJsx"], 'function s(t){return o("RootMixin").mergeRootMixin(o("WASmaxJsx").smax("iq",{to:o("WAWap").GROUP_JID(t),xmlns:"w:g2"}),t)}l.mergeBaseMixin=s;l.LIMIT=s;'),
    define("RootMixin", ["WASmaxJsx"], 'function s(t){return o("BaseMixin").mergeBaseMixin(o("WASmaxJsx").smax("iq",{id:o("WAWap").generateId(),type:"set"}))}l.mergeRootMixin=s;'),
    define("WASmaxOutYRequest", ["WASmaxJsx"], 'var a=o("BaseMixin").mergeBaseMixin(o("WASmaxJsx").smax("iq",{xmlns:"other",to:"s.net"}));l.makeY=a;l.makeYError=a;l.makeYz=a;'),
    define("Rep", ["WAWap"], 'o("WASmaxChildren").REPEATED_CHILD(f,l,1,1/0);o("C").REPEATED_CHILD(f,l,0,5);o("C").REPEATED_CHILD(f,l,a,5);o("C").REPEATED_CHILD(f,l,2,m);'),
    define("Msg", ["WAWap"], 'o("WAWap").wap("message",{a:"1"});o("WAWap").wap("message",{a:"1"});o("WAWap").wap("ack",null);o("WAWap").wap("ack",null,o("WAWap").wap("x",null));'),
]


@pytest.fixture(scope="module")
def modules(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("requests")
    (d / "a.js").write_text("\n".join(BODY))
    return src.split(src.scan(spark, str(d))).persist()


def test_envelopes(modules):
    got = {r.module: (r.xmlns, r.type, r.target, r.reached) for r in rq.envelopes(modules).collect()}
    assert got["WASmaxOutXSetRequest"] == ("w:g2", "set", "group_jid", 2)
    assert got["WASmaxOutYRequest"] == (None, "set", "Unknown", 2)
    assert got["RootMixin"] == ("w:g2", "set", "group_jid", 1)


def test_bounds_exports_and_stanzas(modules):
    assert [(r.low, r.high, r.open_end) for r in rq.repeats(modules).orderBy("pos").collect()] == [(1, None, True), (0, 5, False), (None, None, False), (None, None, False)]
    found = rq.exports(modules)
    roots = {(r.module, r.export) for r in rq.root_exports(found).collect()}
    assert ("WASmaxOutYRequest", "makeY") in roots and ("WASmaxOutYRequest", "makeYz") in roots and ("WASmaxOutYRequest", "makeYError") not in roots
    per = found.groupBy("module").agg(F.collect_list("export").alias("x")).select("module", rq.fragment_exports(F.col("x")).alias("f"))
    assert {r.module for r in per.filter("f").collect()} == {"BaseMixin", "RootMixin"}
    assert sorted((r.tag, r.attrs.count(",")) for r in rq.stanza_definitions(modules, ("ack", "message")).collect()) == [("ack", 1), ("message", 0), ("message", 0)]


def test_names(spark):
    df = spark.createDataFrame([("WASmaxInXSetResponseSuccess", "result"), ("WASmaxInXSetResponseAlreadyExists", "result"), ("WASmaxInXSetResponseNack", None), ("WASmaxInXPushRequest", "error"), ("WASmaxXRPC", None)], "name string, t string")
    n = F.col("name")
    rows = df.select(rq.response_operation(n), rq.variant_kind(n, F.col("t")), rq.server_request(n), rq.acknowledgement(n)).collect()
    assert [tuple(r) for r in rows] == [("XSet", "success", False, True), ("XSet", "alternative", False, False), ("XSet", "error", False, False), ("", "error", True, False), ("", "success", True, True)]
    pairs = rq.responses_of_requests(spark.createDataFrame([("WASmaxOutXSetRequest",)], "module string"), df)
    assert pairs.count() == 3
