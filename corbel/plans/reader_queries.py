"""Queries of the readers of sources, over module text that is made of the supplied tables, and their SQL.

A module's text is put together from the rows that it stands for, so what a reader
finds can be told from those rows alone. Bundles hold a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import bundles as sources
from . import actions, catalog, flow, programs, responses, sync, telemetry
from .catalog_queries import _query


def _define(name: Column, deps: Column, body: Column, tail: Column) -> Column:
    """A module definition as bundles hold it; `deps` is the text of the list."""
    return F.concat(F.lit('__d("'), name, F.lit('",['), deps, F.lit("],(function(t,n,r,o,a,i,l){"), body, F.lit("}),"), tail.cast("string"), F.lit(");"))


def _bundles(modules: DataFrame, bundle: str, order: str, text: str) -> DataFrame:
    """(bundle_ord, content): texts of modules, one after the other; a bundle has a bounded number of them."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return modules.groupBy(F.col(bundle).cast("long").alias("bundle_ord")).agg(F.encode(F.array_join(listed, "\n;\n"), "UTF-8").alias("content"))


def _split(modules: DataFrame, bundle: str = "bundle", order: str = "ord", text: str = "text") -> DataFrame:
    return sources.spread(sources.split(_bundles(modules, bundle, order, text)))


def _joined(group: list[str], order: Column, text: Column) -> tuple:
    return group, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("x")))), lambda x: x["x"]), ",")


@_query("""WITH m AS (SELECT p_partkey // 100 AS b, p_partkey AS k, '__d("P' || p_partkey || '",["D' || p_size || '","é' || (p_partkey + 1) || '"],(function(t,n,r,o,a,i,l){var s="' || p_name || ' }é",c=/"}/;}),' || p_partkey || ');' AS x, p_size FROM part),
o AS (SELECT *, strlen(x) AS l, coalesce(sum(strlen(x) + 3) OVER (PARTITION BY b ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM m)
SELECT CAST(b AS BIGINT) AS bundle_ord, 'P' || k AS name, 'D' || p_size || ',é' || (k + 1) AS deps, CAST(s AS BIGINT) AS start, CAST(s + l - 1 AS BIGINT) AS "end", sha256(x[:length(x) - 1]) AS source FROM o""")
def module_split(t):
    """Modules of bundles with their byte offsets; quotes, braces and patterns within don't end them."""
    k = F.col("p_partkey")
    deps = F.concat(F.lit('"D'), F.col("p_size").cast("string"), F.lit('","é'), (k + 1).cast("string"), F.lit('"'))
    body = F.concat(F.lit('var s="'), F.col("p_name"), F.lit(' }é",c=/"}/;'))
    m = t("part").select(F.expr("p_partkey div 100").alias("bundle"), k.alias("ord"), _define(F.concat(F.lit("P"), k.cast("string")), deps, body, k).alias("text"))
    got = sources.split(_bundles(m, "bundle", "ord", "text"))
    return got.select("bundle_ord", "name", F.array_join("deps", ",").alias("deps"), "start", "end", F.sha2("slice", 256).alias("source"))


@_query("""WITH f AS (SELECT p_partkey // 50 AS b, p_partkey AS code, 'f_' || p_partkey AS name, ['bool', 'int', 'string', 'float'][p_size % 4 + 1] AS type,
CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END WHEN 1 THEN '-' || p_size WHEN 2 THEN '"' || p_brand || '"' ELSE p_size || '.5' END AS default_json FROM part)
SELECT 'M' || b || 'ABPropsConfigs' AS module, name, code, type, default_json FROM (SELECT *, count(*) OVER (PARTITION BY b) AS n FROM f) WHERE n >= 5""")
def flag_reader(t):
    """Flags of registry modules, with typed defaults."""
    value = F.expr("CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size > 20 THEN '!0' ELSE '!1' END WHEN 1 THEN '-' || p_size WHEN 2 THEN '\"' || p_brand || '\"' ELSE p_size || '.5' END")
    kind = F.element_at(F.array(*map(F.lit, ("bool", "int", "string", "float"))), F.col("p_size") % 4 + 1)
    entry = F.concat(F.lit("f_"), F.col("p_partkey").cast("string"), F.lit(":["), F.col("p_partkey").cast("string"), F.lit(',"'), kind, F.lit('",'), value, F.lit("]"))
    group, entries = _joined(["b"], F.col("p_partkey"), entry)
    m = t("part").withColumn("b", F.expr("p_partkey div 50")).groupBy(*group).agg(entries.alias("entries"))
    body = F.concat(F.lit("var c={"), F.col("entries"), F.lit('},small={a:[1,"int",2]};i.default=c;'))
    m = m.select(F.expr("b div 20").alias("bundle"), F.col("b").alias("ord"), _define(F.concat(F.lit("M"), F.col("b").cast("string"), F.lit("ABPropsConfigs")), F.lit(""), body, F.col("b")).alias("text"))
    return catalog.flags(_split(m)).select("module", "name", "code", "type", "default_json")


@_query("""WITH s AS (SELECT s_suppkey // 20 AS b, s_suppkey, s_nationkey FROM supplier), e AS (SELECT b, s_nationkey, string_agg('S' || s_suppkey || '=' || CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'v' || s_suppkey END, ',' ORDER BY s_suppkey) AS v FROM s GROUP BY 1, 2)
SELECT 'E' || b AS module, 'N' || s_nationkey AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'int' ELSE 'string' END AS kind, v AS variants FROM e""")
def enum_reader(t):
    """Enums of modules: texts or integers, each under its exported name, members in the order of the source."""
    value = F.expr("CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_suppkey AS STRING) ELSE '\"v' || s_suppkey || '\"' END")
    s = t("supplier").withColumns({"b": F.expr("s_suppkey div 20"), "m": F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(":"), value)})
    group, members = _joined(["b", "s_nationkey"], F.col("s_suppkey"), F.col("m"))
    one = s.groupBy(*group).agg(members.alias("members"))
    one = one.withColumn("x", F.concat(F.lit("i.N"), F.col("s_nationkey").cast("string"), F.lit('=o("$InternalEnum")({'), F.col("members"), F.lit("});")))
    mixed = F.lit('i.Mixed=o("$InternalEnum")({A:"a",B:1});')  # texts and integers together are no enum
    m = one.groupBy("b").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("body"))
    m = m.select(F.expr("b div 20").alias("bundle"), F.col("b").alias("ord"), _define(F.concat(F.lit("E"), F.col("b").cast("string")), F.lit('"$InternalEnum"'), F.concat("body", mixed), F.col("b")).alias("text"))
    return catalog.enums(_split(m)).select("module", "name", "kind", F.array_join(F.transform("variants", lambda v: F.concat_ws("=", v["name"], v["value"])), ",").alias("variants"))


@_query("""SELECT -1 AS dictionary, 0 AS position, '' AS token, 3 AS version UNION ALL SELECT -1, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER), n_name, 3 FROM nation
UNION ALL SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER), lower(n_name), 3 FROM nation WHERE n_regionkey < 4""")
def token_reader(t):
    """A token table: a reserved word, single-byte words, and dictionaries. The table is one module, of bounded size."""
    n = t("nation")
    words = lambda rows, text: rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", text.alias("w")))), lambda x: F.concat(F.lit('"'), x["w"], F.lit('"'))), ",").alias("w"))
    parts = [words(n, F.col("n_name")).select(F.concat(F.lit("var s=["), "w", F.lit("]")).alias("x"), F.lit(-1).alias("k"))]
    parts += [words(n.filter(F.col("n_regionkey") == d), F.lower("n_name")).select(F.concat(F.lit(f",d{d}=["), "w", F.lit("]")).alias("x"), F.lit(d).alias("k")) for d in range(4)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    body = every.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"]), "").alias("b"))
    text = _define(F.lit("Tok"), F.lit(""), F.concat("b", F.lit(",ds=[d0,d1,d2,d3],v=3;i.SINGLE_BYTE_TOKEN=s;i.DICTIONARIES=ds;i.DICT_VERSION=v;")), F.lit(1))
    return catalog.tokens(_split(body.select(F.lit(0).alias("bundle"), F.lit(0).alias("ord"), text.alias("text"))))


@_query("""SELECT 'file' || s_nationkey || '.wasm' AS what, string_agg('W' || s_suppkey, ',' ORDER BY 'W' || s_suppkey) AS modules, '' AS hints FROM supplier WHERE s_acctbal > 0 GROUP BY 1
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), string_agg('W' || s_suppkey, ',' ORDER BY 'W' || s_suppkey), CASE WHEN max(s_acctbal) > 0 THEN 'wasmBinaryLiteral' ELSE '' END FROM supplier GROUP BY 1""")
def binary_reader(t):
    """Binaries and resource handles, with the modules that use them and the evidence."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    body = F.concat(F.lit('r("bx").getURL(r("bx")("'), n, F.lit('"));r("bx")("x1");'), F.when(F.col("s_acctbal") > 0, F.concat(F.lit('var f="file'), n, F.lit('.wasm",g="data:a.wasm";'))).otherwise(""))
    m = _split(t("supplier").select(F.expr("s_suppkey div 50").alias("bundle"), F.col("s_suppkey").alias("ord"), _define(F.concat(F.lit("W"), k), F.lit('"bx"'), body, F.col("s_suppkey")).alias("text")))
    files = catalog.binaries(m).select(F.col("name").alias("what"), "modules", F.lit("").alias("hints"))
    return files.unionByName(catalog.resources(m).select(F.col("handle").alias("what"), F.col("consumers").alias("modules"), "hints"))


@_query("""SELECT page_id, 'js' AS kind, 'https://cdn.example.com/' || page_id || '.js?a=1&b=2' AS value FROM pages UNION ALL SELECT page_id, 'wasm', 'https://cdn.example.com/' || lower(md5(url)) || '.wasm' FROM pages
UNION ALL SELECT page_id, 'bx', page_id || ' https://cdn.example.com/img' FROM pages UNION ALL SELECT page_id, 'version', '2.3000.' || (1000 + page_id) FROM pages""")
def page_references(t):
    """What pages refer to: scripts, binaries and handles of their data, and the client's version."""
    k = F.col("page_id").cast("string")
    script = F.concat(F.lit('<script src="https://cdn.example.com/'), k, F.lit('.js?a=1&amp;b=2"></script>'))
    data = F.concat(F.lit('<script type="application/json" data-sjs>{"a":["https://cdn.example.com/'), F.md5("url"), F.lit('.wasm"],"bx":{"'), k, F.lit('":{"uri":"https://cdn.example.com/img"}},"client_revision":'), (1000 + F.col("page_id")).cast("string"), F.lit("}</script>"))
    pages = t("pages").select("page_id", F.concat("html", script, data, F.lit("<script>{broken")).alias("html"))
    return sources.discover(pages)


_PROGRAM = [
    {"op": "if", "condition": {"op": "nullish", "value": {"op": "argument", "index": 1}}, "yes": [{"op": "fatal", "metric": {"op": "string", "value": "m"}, "message": "no status"}], "no": []},
    {"op": "bind", "slot": 0, "value": {"op": "choose", "condition": {"op": "greater", "left": {"op": "argument", "index": 0}, "right": {"op": "integer", "value": 150000}}, "yes": {"op": "metric", "name": "large"}, "no": {"op": "string", "value": "small"}}},
    {"op": "if", "condition": {"op": "and", "left": {"op": "argument", "index": 2}, "right": {"op": "not", "value": {"op": "null"}}}, "yes": [{"op": "return", "value": {"op": "slot", "index": 0}}], "no": []},
    {"op": "return", "value": {"op": "argument", "index": 1}},
]


@_query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 2 = 1 THEN CASE WHEN o_totalprice > 150000 THEN '"large"' ELSE '"small"' END ELSE '"' || o_orderstatus || '"' END AS value,
CASE WHEN o_orderstatus = 'P' THEN 'no status' END AS fatal, CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 150000 THEN 'large' ELSE '' END AS metrics FROM orders""")
def validation_program(t):
    """A program of statements over rows: it stops, measures and returns."""
    status = F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus"))
    quoted = F.coalesce(F.concat(F.lit('"'), status, F.lit('"')), F.lit("null"))
    arguments = F.concat(F.lit("["), F.col("o_totalprice").cast("decimal(20,4)").cast("string"), F.lit(","), quoted, F.lit(","), (F.col("o_custkey") % 2).cast("string"), F.lit("]"))
    got = programs.evaluate(t("orders").select("o_orderkey", arguments.alias("arguments")), "o_orderkey", "arguments", _PROGRAM)
    return got.select("o_orderkey", "value", "fatal", F.array_join("metrics", ",").alias("metrics"))


@_query("""WITH d(s, p, r) AS (VALUES ('F', '1-URGENT', 'accept'), ('O', NULL, 'ask'), (NULL, '2-HIGH', 'drop'), (NULL, NULL, 'none')),
o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s, CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS p FROM orders)
SELECT o_orderkey, coalesce(d.r, 'default') AS r FROM o LEFT JOIN d ON d.s IS NOT DISTINCT FROM o.s AND d.p IS NOT DISTINCT FROM o.p""")
def decision_rows(t):
    """Rows of a decision table by null-safe equality of all inputs; without one, the default."""
    o = t("orders").select("o_orderkey", F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s"), F.expr("CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS p"))
    table = o.sparkSession.createDataFrame([("F", "1-URGENT", "accept"), ("O", None, "ask"), (None, "2-HIGH", "drop"), (None, None, "none")], "s string, p string, r string")
    return programs.decided(o, table, ["s", "p"], ["r"], {"r": "default"}).select("o_orderkey", "r")


@_query("""WITH s AS (SELECT s_suppkey, 'Op' || s_suppkey AS operation, s_acctbal > 0 AS called, s_nationkey AS c FROM supplier)
SELECT operation, 0 AS ord, operation || 'ResponseError' AS tag, CASE WHEN c BETWEEN 4 AND 4 THEN 'client_error' WHEN c = 5 THEN 'server_error' ELSE 'error' END AS kind, false AS primary, c * 100 + s_suppkey % 100 AS code FROM s WHERE called
UNION ALL SELECT operation, CASE WHEN called THEN 1 ELSE 0 END, operation || 'ResponseSuccess', 'success', true, NULL FROM s""")
def response_outcomes(t):
    """Outcomes of calls, with the sides at fault and codes of their errors; operations without a call have their success."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    op = F.concat(F.lit("Op"), k)
    util = 'o("WASmaxParseUtils")'
    success = F.concat(F.lit(f'function e(e,t){{var s={util}.literal({util}.attrString,e,"type","result");return o("R").makeResult({{type:s.value}})}}l.parse'), op, F.lit("ResponseSuccess=e;"))
    error = F.concat(F.lit(f'function e(e,t){{var q={util}.assertAttr(e,"type","error"),x={util}.flattenedChildWithTag(e,"error"),c={util}.literal({util}.attrInt,x.value,"code",'), (n * 100 + F.col("s_suppkey") % 100).cast("string"), F.lit(');return o("R").makeResult({code:c.value})}l.parse'), op, F.lit("ResponseError=e;"))
    arm = lambda v, kind: F.concat(F.lit(f'var {v}=o("WASmaxIn'), op, F.lit(f'Response{kind}").parse'), op, F.lit(f'Response{kind}(r,n);if({v}.success)return{{name:"'), op, F.lit(f'Response{kind}",value:{v}.value}};'))
    s = t("supplier")
    one = lambda prefix, suffix, body, where: s.filter(where).select(F.expr("s_suppkey div 50").alias("bundle"), F.concat(F.lit(suffix), k).alias("ord"), _define(F.concat(F.lit(prefix), op, F.lit(suffix)), F.lit(""), body, F.col("s_suppkey")).alias("text"))
    m = one("WASmaxIn", "ResponseSuccess", success, F.lit(True)).unionByName(one("WASmaxIn", "ResponseError", error, F.col("s_acctbal") > 0)).unionByName(one("WASmax", "RPC", F.concat(F.lit("function e(){"), arm("a", "Error"), arm("i", "Success"), F.lit("}l.send=e;")), F.col("s_acctbal") > 0))
    out, arms = responses.response_index(_split(m))
    return out.join(arms.select("operation", "tag", "code"), ["operation", "tag"], "left").select("operation", "ord", "tag", "kind", "primary", "code")


@_query("""SELECT 'Q' || n_nationkey || '.graphql' AS module, 'n' || n_regionkey || '_count' AS path, 'leaf' AS kind, 'number' AS type FROM nation
UNION ALL SELECT 'Q' || n_nationkey || '.graphql', 'list', CASE WHEN n_nationkey % 2 = 0 THEN 'array' ELSE 'object' END, CASE WHEN n_nationkey % 2 = 0 THEN 'array' ELSE 'object' END FROM nation UNION ALL SELECT 'Q' || n_nationkey || '.graphql', 'list/is_' || lower(replace(n_name, ' ', '_')), 'leaf', 'boolean' FROM nation""")
def response_shapes(t):
    """The shapes that persisted operations select; what a fragment adds as a leaf gives way to the container."""
    k = F.col("n_nationkey").cast("string")
    body = F.concat(
        F.lit('var s={kind:"ScalarField",name:"is_'), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit('"};var n={fragment:{kind:"Fragment",name:"Q",selections:[{kind:"ScalarField",name:"n'), F.col("n_regionkey").cast("string"),
        F.lit('_count"},{kind:"LinkedField",alias:"list",name:"x",plural:'), F.when(F.col("n_nationkey") % 2 == 0, "!0").otherwise("!1"), F.lit(',selections:[s]},{kind:"InlineFragment",selections:[{kind:"ScalarField",name:"list"}]}]}};'),
    )
    m = t("nation").select(F.lit(0).alias("bundle"), F.col("n_nationkey").alias("ord"), _define(F.concat(F.lit("Q"), k, F.lit(".graphql")), F.lit(""), body, F.col("n_nationkey")).alias("text"))
    return responses.response_shapes(_split(m))


_E = {"read": lambda m, n: {"expr": "read", "method": m, "name": n}, "local": lambda k: {"expr": "local", "local": k}, "text": lambda v: {"expr": "string", "value": v}}
_ENVELOPE = {
    "prefix": [
        {"op": "evaluate", "value": _E["read"]("assertTag", "order")},
        {"op": "bind", "local": 0, "value": _E["read"]("attrString", "status")},
        {"op": "bind", "local": 1, "value": {"expr": "null"}},
        {"op": "tryDiagnostic", "messageParts": ["no big: ", ""], "body": [{"op": "evaluate", "value": {"expr": "assign", "local": 1, "value": _E["read"]("attrString", "big")}}]},
        {"op": "evaluate", "value": {"expr": "logical", "operator": "and", "left": {"expr": "binary", "operator": "strictEqual", "left": _E["local"](0), "right": _E["text"]("P")}, "right": {"expr": "reject", "message": {"expr": "binary", "operator": "add", "left": _E["text"]("pending, big "), "right": _E["local"](1)}}}},
    ],
    "projection": {"expr": "object", "fields": [{"name": "s", "value": _E["local"](0)}, {"name": "b", "value": {"expr": "conditional", "condition": {"expr": "binary", "operator": "nullishNotEqual", "left": _E["local"](1), "right": {"expr": "null"}}, "thenValue": _E["local"](1), "elseValue": {"expr": "undefined"}}}, {"name": "m", "value": _E["read"]("maybeAttrString", "none")}]},
}


@_query("""WITH o AS (SELECT o_orderkey, o_custkey % 7 = 0 AS odd, o_orderstatus AS s, CASE WHEN o_totalprice > 150000 THEN o_orderpriority END AS b FROM orders)
SELECT o_orderkey, CASE WHEN odd OR s = 'P' THEN NULL ELSE '{"s": "' || s || '"' || CASE WHEN b IS NULL THEN '' ELSE ', "b": "' || b || '"' END || ', "m": null}' END AS value, CASE WHEN odd THEN 'expected tag order, found other' WHEN s = 'P' THEN 'pending, big ' || coalesce(b, 'null') END AS rejected,
CASE WHEN NOT odd AND b IS NULL THEN 'no big: missing attribute big' ELSE '' END AS diagnostics FROM o""")
def envelope_program(t):
    """A program of reads, bindings, refusals and a projection over nodes."""
    attrs = F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 150000, F.col("o_orderpriority")).alias("big"))
    node = F.to_json(F.struct(F.when(F.col("o_custkey") % 7 == 0, "other").otherwise("order").alias("tag"), attrs.alias("attrs")))
    got = programs.envelopes(t("orders").select("o_orderkey", node.alias("node")), "o_orderkey", "node", _ENVELOPE)
    return got.select("o_orderkey", "value", "rejected", F.array_join("diagnostics", ",").alias("diagnostics"))


@_query("""WITH s AS (SELECT s_suppkey, s_nationkey, ['account', 'chat', 'message', 'unknown'][s_suppkey % 4 + 1] AS scope, s_acctbal > 0 AS chat FROM supplier)
SELECT 'A' || s_suppkey AS action_key, 'act' || s_suppkey AS name, 'col' || s_nationkey AS collection, CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE s_nationkey END AS version, scope, 'f' || s_nationkey AS value_field,
'literal:act' || s_suppkey || CASE scope WHEN 'account' THEN '' WHEN 'message' THEN ',jid:remote,string:id,boolString:fromMe,jidOrZero:participant' WHEN 'chat' THEN CASE WHEN chat THEN ',jid:chatJid' ELSE ',string:key1' END ELSE CASE WHEN chat THEN ',jid:chatJid' ELSE ',string:key1' END || ',string:key2' END AS parts FROM s""")
def synced_actions(t):
    """Handlers of synced actions: names, collections and versions by constants, and the layout of their index."""
    s, n = t("supplier"), t("nation")
    k, nk = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    const = 'o("WAWebSyncdConst")'
    base = F.element_at(F.array(*map(F.lit, ("Account", "Chat", "Message", "Other"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    version = F.when(F.col("s_suppkey") % 3 == 0, F.lit(f"{const}.MAX")).otherwise(nk)
    body = F.concat(
        F.lit("var e=(function(e){function t(){var n;n=e.call.apply(e,[this]);n.collectionName=" + const + ".CollectionName.C"), nk, F.when(F.col("s_acctbal") > 0, ",n.chatJidIndex=1").otherwise(""), F.lit(";return n}t.getAction=function(){return " + const + ".Actions.A"), k,
        F.lit("};t.getVersion=function(){return "), version, F.lit("};t.run=function(x){"), F.when(F.col("s_suppkey") % 4 == 3, "var p=x.indexParts;p[2];").otherwise(""), F.lit('return o("U").buildPendingMutation({value:{f'), nk, F.lit(':1}})};return t})(o("WAWebSyncdAction").'), base, F.lit("SyncdActionBase);l.default=e;"),
    )
    handlers = s.select(F.expr("s_suppkey div 20").alias("bundle"), k.alias("ord"), _define(F.concat(F.lit("H"), k, F.lit("Sync")), F.lit(""), body, F.col("s_suppkey")).alias("text"))
    text = lambda rows, order, one: rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("x")))), lambda y: y["x"]), ",").alias("x"))
    named = text(s, "s_suppkey", F.concat(F.lit("A"), k, F.lit(':"act'), k, F.lit('"'))).select(F.lit("a").alias("o"), F.concat(F.lit('var g=o("$InternalEnum")({'), "x", F.lit("}),")).alias("y"))
    places = text(n, "n_nationkey", F.concat(F.lit("C"), F.col("n_nationkey").cast("string"), F.lit(':"col'), F.col("n_nationkey").cast("string"), F.lit('"'))).select(F.lit("b").alias("o"), F.concat(F.lit('h=o("$InternalEnum")({'), "x", F.lit("});l.Actions=g;l.CollectionName=h;l.MAX=7;")).alias("y"))
    constants = named.unionByName(places).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "y"))), lambda z: z["y"]), "").alias("body"))
    listed = text(s, "s_suppkey", F.concat(F.lit('"H'), k, F.lit('Sync"')))
    extra = constants.select(_define(F.lit("WAWebSyncdConst"), F.lit('"$InternalEnum"'), F.col("body"), F.lit(1)).alias("text")).unionByName(listed.select(_define(F.lit("WAWebCollectionHandlerActions"), F.col("x"), F.lit(""), F.lit(2)).alias("text")))
    m = handlers.unionByName(extra.select(F.lit(-1).cast("long").alias("bundle"), F.md5("text").alias("ord"), "text"))
    got = sync.actions(_split(m))
    parts = F.array_join(F.transform("index_parts", lambda x: F.concat_ws(":", x["kind"], x["name"])), ",")
    return got.select("action_key", "name", "collection", "version", "scope", "value_field", parts.alias("parts"))


@_query("""SELECT 'global' AS what, 'g' || s_suppkey AS name, s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'regular' WHEN 1 THEN 'private,realtime' END AS detail FROM supplier WHERE s_suppkey % 3 < 2
UNION ALL SELECT 'group', n_name, n_nationkey, CAST(n_regionkey - 1 AS VARCHAR) FROM nation UNION ALL SELECT 'group', 'late', 99, '-1' UNION ALL SELECT 'constant', r_name, r_regionkey, '' FROM region
UNION ALL SELECT 'gap', 'global with an unreadable channel list', count(*), '' FROM supplier WHERE s_suppkey % 3 = 2""")
def telemetry_buffers(t):
    """Globals with their channels, private groups of the table and further ones, and constants."""
    s, n, r = t("supplier"), t("nation"), t("region")
    k = F.col("s_suppkey").cast("string")
    text = lambda rows, order, one: rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("x")))), lambda y: y["x"]), ",").alias("x"))
    channels = F.element_at(F.array(*map(F.lit, ("", ',["private","realtime"]', ",[q]"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    one = F.concat(F.lit("g"), k, F.lit(":["), k, F.lit(',o("WAWebWamCodegenUtils").TYPES.INTEGER'), channels, F.lit("]"))
    chunk = s.withColumn("b", F.expr("s_suppkey div 20")).groupBy("b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("x")))), lambda y: y["x"]), ",").alias("x"))
    codegen = F.lit('"WAWebWamCodegenUtils"')
    globals_ = chunk.select(F.col("b").alias("bundle"), F.concat(F.lit("G"), F.col("b").cast("string")).alias("ord"), _define(F.concat(F.lit("G"), F.col("b").cast("string")), codegen, F.concat(F.lit('var v=o("WAWebWamCodegenUtils").defineGlobal({'), "x", F.lit("});")), F.lit(1)).alias("text"))
    groups = text(n, "n_nationkey", F.concat(F.lit('{key:"'), "n_name", F.lit('",keyHashInt:'), F.col("n_nationkey").cast("string"), F.lit(",rotationPeriodDays:"), (F.col("n_regionkey") - 1).cast("string"), F.lit("}")))
    table = groups.select(_define(F.lit("Tab"), codegen, F.concat(F.lit("var defineGlobal=1,p=["), "x", F.lit("];l.PrivateStatsAllIds=p;")), F.lit(1)).alias("text"))
    late = r.sparkSession.createDataFrame([("",)], "x string").select(_define(F.lit("Late"), F.lit(""), F.lit('var a=o("Tab").PrivateStatsAllIds;h.late=99;d.late={rotationPeriodDays:-1};h.same=3;d.same={rotationPeriodDays:5};'), F.lit(1)).alias("text"))
    constants = text(r, "r_regionkey", F.concat(F.lit("l."), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("="), F.col("r_regionkey").cast("string"))).select(_define(F.lit("WAWebWamConstants"), F.lit(""), F.concat(F.replace("x", F.lit(","), F.lit(";")), F.lit(";")), F.lit(1)).alias("text"))
    rest = table.unionByName(late).unionByName(constants).select(F.lit(-1).cast("long").alias("bundle"), F.md5("text").alias("ord"), "text")
    g, p, c, gaps = telemetry.buffer_catalog(_split(globals_.unionByName(rest)))
    row = lambda df, what, name, at, detail: df.select(F.lit(what).alias("what"), name.alias("name"), at.alias("id"), detail.alias("detail"))
    out = row(g, "global", F.col("name"), F.col("id"), F.array_join("channels", ",")).unionByName(row(p, "group", F.col("key"), F.col("id"), F.col("days").cast("string")))
    out = out.unionByName(row(c, "constant", F.replace("name", F.lit("_"), F.lit(" ")), F.col("value"), F.lit("")))
    return out.unionByName(row(gaps, "gap", F.col("reason"), F.col("n"), F.lit("")))


@_query("""WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, s_acctbal > 0 AS big FROM supplier)
SELECT 'H' || n AS module, 'tag' || k AS wire_tag, 'type' || n AS action_type, 'subject' AS name, 'attrString' AS accessor, 'subject' AS wire_name, 'string' AS type, true AS required FROM s
UNION ALL SELECT 'H' || n, 'tag' || k, 'type' || n, 'duration', 'attrInt', 'expiration', 'integer', false FROM s WHERE big UNION ALL SELECT 'H' || n, 'tag' || k, 'type' || n, 'who', 'maybeAttrUserJid', 'who', 'userJid', false FROM s
UNION ALL SELECT 'H' || n, 'tag' || k, 'type' || n, 'fixed', NULL, NULL, 'v' || n, NULL FROM s""")
def notification_actions(t):
    """Arms of handlers: two branches each, folded; a name that they read differently goes, one that only one has isn't required."""
    s, n = t("supplier"), t("nation")
    k, nk = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    kind, common = 'actionType:o("Consts").KIND.K', 'subject:e.attrString("subject"),who:e.maybeAttrUserJid("who"),fixed:"v'
    arm = F.concat(
        F.lit('case o("Consts").TAG.T'), k, F.lit(":if(e.hasChild(\"x\"))return{" + kind), nk, F.lit("," + common), nk, F.lit('",odd:e.attrInt("a")'), F.when(F.col("s_acctbal") > 0, ',duration:e.attrInt("expiration")').otherwise(""),
        F.lit("};return{" + kind), nk, F.lit("," + common), nk, F.lit('",odd:e.attrInt("b"),gone:f(e)};'),
    )
    chunk = s.groupBy(F.col("s_nationkey").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", arm.alias("x")))), lambda y: y["x"]), "").alias("x"))
    handlers = chunk.select(F.expr("n div 10").alias("bundle"), F.col("n").cast("string").alias("ord"), _define(F.concat(F.lit("H"), F.col("n").cast("string")), F.lit('"Consts"'), F.concat(F.lit("function h(e){switch(e.tag()){"), "x", F.lit("default:return null}}l.handle=h;")), F.lit(1)).alias("text"))
    text = lambda rows, order, one: rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("x")))), lambda y: y["x"]), ",").alias("x"))
    tags = text(s, "s_suppkey", F.concat(F.lit("T"), k, F.lit(':"tag'), k, F.lit('"'))).select(F.lit("a").alias("o"), F.concat(F.lit("l.TAG=Object.freeze({"), "x", F.lit("});")).alias("y"))
    kinds = text(n, "n_nationkey", F.concat(F.lit("K"), F.col("n_nationkey").cast("string"), F.lit(':"type'), F.col("n_nationkey").cast("string"), F.lit('"'))).select(F.lit("b").alias("o"), F.concat(F.lit("var q={"), "x", F.lit("};l.KIND=q;")).alias("y"))
    consts = tags.unionByName(kinds).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "y"))), lambda z: z["y"]), "").alias("body"))
    m = handlers.unionByName(consts.select(F.lit(-1).cast("int").alias("bundle"), F.lit("c").alias("ord"), _define(F.lit("Consts"), F.lit(""), F.col("body"), F.lit(1)).alias("text")))
    fields, fixed, _ = actions.actions(_split(m))
    none = F.lit(None).cast("string")
    return fields.unionByName(fixed.select("module", "wire_tag", "action_type", "name", none.alias("accessor"), none.alias("wire_name"), F.col("value").alias("type"), F.lit(None).cast("boolean").alias("required")))


@_query("""SELECT 'M' || s_suppkey AS module, unnest(['a', 'b', 'c']) AS local, 'N' || s_nationkey AS owner FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT 'M' || s_suppkey, 'a', 'N' || s_nationkey FROM supplier WHERE s_suppkey % 3 = 0""")
def alias_owners(t):
    """Names that stand for modules over chains of names; one that is given something else too stands for none."""
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit('var a=o("N'), F.col("s_nationkey").cast("string"), F.lit('"),b=a,c=b,d=e,f=1;'), F.when(F.col("s_suppkey") % 3 == 0, "b=g();").otherwise("c=a;"))
    m = t("supplier").select(F.expr("s_suppkey div 50").alias("bundle"), F.col("s_suppkey").alias("ord"), _define(F.concat(F.lit("M"), k), F.lit('"x"'), body, F.col("s_suppkey")).alias("text"))
    return flow.owners(_split(m))


@_query("""WITH RECURSIVE w AS (SELECT s_suppkey AS k, 1 AS steps FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT s_suppkey, 2 FROM supplier JOIN w ON s_suppkey = k + 1 WHERE s_suppkey % 4 > 1) SELECT 'M' || k AS module, 'send' AS function, steps FROM w""")
def transport_wrappers(t):
    """Functions that hand their first parameter to the transport, directly or through others; those that hand it to two, or elsewhere, don't count."""
    k = F.col("s_suppkey")
    target = F.when(k % 4 == 1, F.lit('o("Transport").send(e,t)')).when(k % 4 == 0, F.lit('o("Transport").send(t,e)')).otherwise(F.concat(F.lit('o("M'), (k - 1).cast("string"), F.lit('").send(e)')))
    body = F.concat(F.lit("function f(e,t){return "), target, F.lit('}function g(e){o("Transport").send(e);o("Log").write(e)}l.send=f;l.both=g;'))
    m = t("supplier").select(F.expr("s_suppkey div 50").alias("bundle"), k.alias("ord"), _define(F.concat(F.lit("M"), k.cast("string")), F.lit('"Transport"'), body, k).alias("text"))
    return flow.wrappers(_split(m), "Transport", "send")


@_query("""WITH m AS (SELECT n_nationkey AS k, strlen('__d("M' || n_nationkey || '",[],(function(t,n,r,o,a,i,l){') AS h, strlen(n_name) AS l FROM nation)
SELECT 'M' || k AS module, 'retry' AS word, h + 4 AS start FROM m UNION ALL SELECT 'M' || k, 'retry', h + 4 + 5 + strlen(';var s="é') + l + strlen(' retry";') FROM m""")
def word_inventory(t):
    """Places of a word in code, in bytes; within texts it doesn't count."""
    k = F.col("n_nationkey")
    body = F.concat(F.lit('var retry;var s="é'), F.col("n_name"), F.lit(' retry";retry=1;/retry/.test(s);'))
    m = t("nation").select(F.lit(0).alias("bundle"), k.alias("ord"), _define(F.concat(F.lit("M"), k.cast("string")), F.lit(""), body, k).alias("text"))
    return flow.inventory(_split(m), ["retry"])
