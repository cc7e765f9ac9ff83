"""Queries of the operators over request trees, rules of contracts and naming, and their SQL.

The supplied tables stand for trees: line items for nodes, orders for attributes,
parts for contents, suppliers and nations for enclosing ones. Whole tables are read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregate, checks, contracts, lookup
from . import catalog
from .catalog_queries import _query, _says

# Trees, as columns alike in both languages.

_NODE = {
    "owner": "l_orderkey", "path": "'n' || l_linenumber || '-' || l_partkey", "tag": "CASE WHEN l_shipdate IS NOT NULL AND l_tax > 0.01 THEN 't' || l_linenumber ELSE '' END",
    "presence": "CASE l_returnflag WHEN 'A' THEN 'optional' WHEN 'R' THEN 'presence_flag' ELSE 'required' END", "repeats": "l_linestatus = 'O' AND l_quantity > 30",
    "repeat_min": "CASE WHEN l_tax > 0.04 THEN 1 END", "repeat_max": "CASE WHEN l_discount > 0.04 THEN 9 END", "arg_path": "CASE WHEN l_extendedprice > 20000 THEN 'a.b' END", "n_groups": "CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END",
}
_ATTR = {"owner": "o_orderkey", "tag": "o_orderstatus", "name": "'at' || o_custkey", "kind": "CASE o_orderstatus WHEN 'F' THEN 'const' WHEN 'P' THEN 'generated_id' ELSE 'string' END", "value": "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END", "arg_path": "CASE WHEN o_totalprice > 150000 THEN 'x' END"}
_CONTENT = {"owner": "p_partkey", "tag": "p_brand", "kind": "CASE WHEN p_size > 40 THEN 'const' WHEN p_size > 20 THEN 'dynamic' ELSE 'bytes' END", "arg_path": "CASE WHEN p_retailprice > 1000 THEN 'y' END"}
_REQUEST = {
    "owner": "c_custkey", "namespace": "c_mktsegment", "request_namespace": "CASE WHEN c_acctbal > -500 THEN c_mktsegment END", "iq_type": "'get'", "request_type": "'get'",
    "target": "CASE c_mktsegment WHEN 'BUILDING' THEN 'unset' WHEN 'MACHINERY' THEN 'unknown' WHEN 'FURNITURE' THEN 'group_jid' ELSE 'server' END",
    "request_target": "CASE c_mktsegment WHEN 'BUILDING' THEN 'unset' WHEN 'MACHINERY' THEN 'unknown' WHEN 'FURNITURE' THEN 'group_jid' ELSE 'server' END",
    "target_arg_path": "CASE WHEN c_acctbal > 0 THEN 'to' END", "n_outcomes": "CASE WHEN c_acctbal > 9000 THEN 0 ELSE 2 END", "n_root_groups": "CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END",
}


def _cols(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}"


def _table(t, columns: dict[str, str], table: str):
    return t(table).select(*[F.expr(e).alias(n) for n, e in columns.items()])


_TREE = f"WITH n AS ({_cols(_NODE, 'lineitem')}), a AS ({_cols(_ATTR, 'orders')}), c AS ({_cols(_CONTENT, 'part')}), q AS ({_cols(_REQUEST, 'customer')})"
_READS = "kind NOT IN ('const', 'generated_id') AND value IS NULL"
_FED = "(repeats OR presence <> 'required')"


def _tree(t):
    return _table(t, _NODE, "lineitem"), _table(t, _ATTR, "orders"), _table(t, _CONTENT, "part"), _table(t, _REQUEST, "customer")


def _count(key: str, table: str, test: str) -> str:
    return f"SELECT '{key}' AS key, count(*) FILTER ({test}) AS value FROM {table}"


@_query(
    f"{_TREE} "
    + " UNION ALL ".join(
        [
            _count("attributes with address", "a", f"{_READS} AND arg_path IS NOT NULL"), _count("attributes without", "a", f"{_READS} AND arg_path IS NULL"),
            _count("contents", "c", "true"), _count("contents with address", "c", "kind <> 'const' AND arg_path IS NOT NULL"), _count("contents without", "c", "kind <> 'const' AND arg_path IS NULL"),
            _count("children with address", "n", f"{_FED} AND arg_path IS NOT NULL"), _count("children without", "n", f"{_FED} AND arg_path IS NULL"),
            _count("optional children", "n", "presence = 'optional'"), _count("flagged children", "n", "presence = 'presence_flag'"), _count("repeat bounds", "n", "repeats AND (repeat_min IS NOT NULL OR repeat_max IS NOT NULL)"),
        ]
    )
)
def builder_counts(t):
    n, a, c, _ = _tree(t)
    return contracts.builder_counts(n, a, c)


@_query(f"{_TREE} " + " UNION ALL ".join([_count("unset addressee", "q", "target = 'unset'"), _count("unknown addressee", "q", "target = 'unknown'"), _count("runtime addressee without address", "q", "target IN ('group_jid', 'unknown') AND target_arg_path IS NULL")]))
def target_counts(t):
    return contracts.target_counts(_tree(t)[3])


@_query("""WITH d AS (SELECT 'unread argument: ' || event_type AS reason, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1)
SELECT 'unread argument' AS key, CAST(coalesce(sum(n), 0) AS BIGINT) AS value FROM d WHERE starts_with(reason, 'unread argument') UNION ALL SELECT k, CAST(coalesce((SELECT sum(n) FROM d WHERE reason = k), 0) AS BIGINT) FROM (VALUES ('error'), ('never')) AS v(k)""")
def construction_gaps(t):
    reason = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("unread argument: "), F.col("event_type"))).otherwise(F.col("event_type"))
    return contracts.construction_gaps(t("events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n")), "unread argument", ["error", "never"])


_PRESENCE = "SELECT l_suppkey AS op, CASE WHEN l_linenumber > 4 THEN l_returnflag || '/[]' ELSE l_returnflag || '/' || l_partkey END AS path, max(CASE WHEN l_quantity > 45 THEN 2 WHEN l_quantity > 30 THEN 1 ELSE 0 END) AS level FROM lineitem GROUP BY 1, 2"


@_query(f"SELECT op, count(*) FILTER (level = 0 AND path NOT LIKE '%[]') AS always, count(*) FILTER (level = 1 AND path NOT LIKE '%[]') AS conditional, count(*) FILTER (level = 2 AND path NOT LIKE '%[]') AS undetermined, bool_and(level = 0) AS all_always FROM ({_PRESENCE}) GROUP BY 1")
def presence_counts(t):
    path = F.expr("CASE WHEN l_linenumber > 4 THEN l_returnflag || '/[]' ELSE l_returnflag || '/' || l_partkey END")
    level = F.expr("max(CASE WHEN l_quantity > 45 THEN 2 WHEN l_quantity > 30 THEN 1 ELSE 0 END)")
    return contracts.presence_counts(t("lineitem").groupBy(F.col("l_suppkey").alias("op"), path.alias("path")).agg(level.alias("level")))


@_query("""WITH s AS (SELECT o_custkey AS event, o_orderpriority AS module, o_orderkey AS ord, o_orderstatus = 'P' AS partial, o_orderstatus AS name, CASE WHEN o_totalprice > 200000 THEN 'big' END AS value FROM orders),
w AS (SELECT *, lag(module) OVER p AS m, lag(name) OVER p AS n, lag(value) OVER p AS v, lag(partial) OVER p AS q, row_number() OVER p AS r FROM s WINDOW p AS (PARTITION BY event ORDER BY module, name, partial, ord)),
a AS (SELECT *, r > 1 AND m = module AND n = name AND q = partial AND v IS NOT DISTINCT FROM value AS again FROM w)
SELECT event, count(*) FILTER (NOT again) AS call_sites, count(*) FILTER (NOT again AND partial) AS partial, count(*) FILTER (NOT again) AS fields, count(*) FILTER (NOT again AND value IS NOT NULL) AS field_values, count(*) FILTER (again) AS duplicates FROM a GROUP BY 1""")
def call_site_totals(t):
    value = F.expr("CASE WHEN o_totalprice > 200000 THEN 'big' END").alias("value")
    fields = F.array(F.struct(F.col("o_orderstatus").alias("name"), value))
    sites = t("orders").select(F.col("o_custkey").alias("event"), F.col("o_orderpriority").alias("module"), fields.alias("fields"), (F.col("o_orderstatus") == "P").alias("partial"), F.col("o_orderkey").alias("ord"))
    return contracts.call_site_totals(sites)


@_query("SELECT 'namespaces' AS key, count(DISTINCT split_part(url, '/', 3)) AS value FROM pages")
def namespace_count(t):
    return contracts.namespaces(t("pages").withColumn("ns", F.split_part("url", F.lit("/"), F.lit(3))), "ns")


@_query("""WITH f AS (SELECT p_brand AS trail, p_type AS method, CASE WHEN p_size > 10 THEN 'enum' ELSE 'string' END AS type, CASE WHEN p_retailprice > 1500 THEN 'ref' END AS enum_ref, CASE WHEN p_size > 45 THEN 2 ELSE 0 END AS n_keys, split_part(p_name, ' ', 1) AS proto_enum FROM part)
SELECT trail || '|' || method AS key, count(*) AS value FROM f WHERE type = 'enum' AND enum_ref IS NULL AND n_keys = 0 AND proto_enum NOT IN (SELECT split_part(p_name, ' ', 1) FROM part WHERE p_retailprice > 1500) GROUP BY 1""")
def unresolved_enums(t):
    proto = F.split_part("p_name", F.lit(" "), F.lit(1)).alias("proto_enum")
    f = t("part").select(F.col("p_brand").alias("trail"), F.col("p_type").alias("method"), F.expr("CASE WHEN p_size > 10 THEN 'enum' ELSE 'string' END AS type"), F.expr("CASE WHEN p_retailprice > 1500 THEN 'ref' END AS enum_ref"), F.expr("CASE WHEN p_size > 45 THEN 2 ELSE 0 END AS n_keys"), proto)
    return contracts.unresolved_enums(f, f.filter("enum_ref IS NOT NULL").select("proto_enum"))


_ASSERT = {"owner": "event_id", "path": "user_id", "kind": "CASE event_type WHEN 'click' THEN 'reference' WHEN 'view' THEN 'attr' WHEN 'signup' THEN 'child' WHEN 'error' THEN 'content' ELSE 'tag' END", "name": "CASE WHEN value < 60 THEN 'n' END", "value": "CASE WHEN value > 20 THEN 'v' END", "reference_path": "CASE WHEN value > 40 THEN 'p' END"}


def _rule(rule: str, table: str, test: str, message: str) -> str:
    return f"SELECT {_says(rule, chr(39).join(['owner || ', '|', ' || path']), chr(39) + message + chr(39))} FROM {table} WHERE {test}"


@_query(
    f"WITH s AS ({_cols(_ASSERT, 'events')}), n AS ({_cols(_NODE, 'lineitem')}) "
    + " UNION ALL ".join(
        [
            _rule("assertion reference path", "s", "kind = 'reference' AND reference_path IS NULL", "a reference without the path it refers to"), _rule("assertion reference name", "s", "kind = 'reference' AND name IS NULL", "a reference without the attribute it is about"),
            _rule("assertion reference value", "s", "kind = 'reference' AND value IS NOT NULL", "a reference that also fixes a value"), _rule("assertion attribute name", "s", "kind = 'attr' AND name IS NULL", "no attribute name"),
            _rule("assertion content value", "s", "kind = 'content' AND value IS NULL", "no content to match"), _rule("assertion tag name", "s", "kind = 'tag' AND name IS NULL", "no tag"),
            _rule("assertion child name", "s", "kind = 'child' AND name IS NULL", "no child''s tag"), _rule("assertion child value", "s", "kind = 'child' AND (value IS NOT NULL OR reference_path IS NOT NULL)", "a child that fixes a value"),
            _rule("required group", "n", "presence = 'required' AND n_groups < 1", "offers no alternative"), _rule("mixin group", "n", "tag = 't7' AND n_groups < 1 AND NOT repeats", "no alternatives and no children"),
        ]
    )
)
def contract_rules(t):
    """Rules of assertions, of groups of alternatives and of fields that are named as unions."""
    s, n = _table(t, _ASSERT, "events"), _table(t, _NODE, "lineitem")
    groups = n.select("owner", "path", (F.col("presence") != "required").alias("optional"), F.col("n_groups").alias("n_variants"))
    fields = n.select("owner", "path", F.expr("CASE WHEN tag = 't7' THEN 'xMixinGroup' ELSE tag END AS name"), F.lit("m").alias("method"), F.col("n_groups").alias("n_variants"), F.expr("CASE WHEN repeats THEN 1 ELSE 0 END AS n_children"))
    return checks.failing(s.sparkSession, [*contracts.assertion_rules(s), *contracts.variant_group_rules(groups), *contracts.mixin_group_rules(fields)])


@_query(f"""WITH g AS (SELECT n_name AS name, n_nationkey % 20 AS id, CASE WHEN n_regionkey = 0 THEN [] WHEN n_regionkey = 1 THEN ['regular', 'odd'] ELSE ['private'] END AS channels FROM nation),
p AS (SELECT r_name AS key, r_regionkey // 2 AS id, r_regionkey - 1 AS days FROM region), e AS (SELECT s_suppkey AS name, CASE WHEN s_acctbal > 0 THEN 'private' ELSE 'regular' END AS channel, CASE WHEN s_acctbal > 2000 THEN s_nationkey % 4 END AS pid FROM supplier),
w AS (SELECT l_suppkey AS event, l_orderkey AS module, CASE WHEN l_quantity > 49 THEN 'gone' ELSE l_returnflag END AS name, CASE WHEN l_tax > 0.07 THEN 'E' || l_linenumber END AS em, l_linestatus AS ek FROM lineitem),
m(em, ek) AS (VALUES ('E1', 'O'), ('E2', 'F'), ('E3', 'O'), ('E3', 'F'))
SELECT {_says('global channels', 'name', "'nowhere to be written'")} FROM g WHERE len(channels) = 0 UNION ALL SELECT {_says('global channel', 'name', "'unknown channel'")} FROM g WHERE list_contains(channels, 'odd')
UNION ALL SELECT {_says('global id', 'id', "n || ' rows'")} FROM (SELECT id, count(*) AS n FROM g GROUP BY 1) WHERE n > 1 UNION ALL SELECT {_says('private group id', 'id', "n || ' rows'")} FROM (SELECT id, count(*) AS n FROM p GROUP BY 1) WHERE n > 1
UNION ALL SELECT {_says('private group rotation', 'key', "'neither a period nor -1'")} FROM p WHERE days <> -1 AND days <= 0 UNION ALL SELECT {_says('private event', 'name', "'names no private group'")} FROM e WHERE channel = 'private' AND pid IS NULL
UNION ALL SELECT {_says('private event group', 'name', "'unresolved: ' || pid")} FROM e WHERE pid IS NOT NULL AND pid NOT IN (SELECT id FROM p) UNION ALL SELECT {_says('written field', "module || '|' || event", "'unresolved: ' || event || '|' || name")} FROM w WHERE name = 'gone'
UNION ALL SELECT {_says('written enum', "module || '|' || event", "'unresolved: ' || em")} FROM w WHERE em IS NOT NULL AND em NOT IN (SELECT em FROM m)
UNION ALL SELECT {_says('written member', "module || '|' || event", "'unresolved: ' || em || '|' || ek")} FROM w WHERE em IN (SELECT em FROM m) AND (em, ek) NOT IN (SELECT em, ek FROM m)""")
def buffer_rules(t):
    globals_ = t("nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 20).alias("id"), F.expr("CASE WHEN n_regionkey = 0 THEN array() WHEN n_regionkey = 1 THEN array('regular', 'odd') ELSE array('private') END AS channels"))
    groups = t("region").select(F.col("r_name").alias("key"), F.expr("r_regionkey div 2 AS id"), (F.col("r_regionkey") - 1).alias("days"))
    events = t("supplier").select(F.col("s_suppkey").alias("name"), F.expr("CASE WHEN s_acctbal > 0 THEN 'private' ELSE 'regular' END AS channel"), F.expr("CASE WHEN s_acctbal > 2000 THEN s_nationkey % 4 END AS private_id"))
    li = t("lineitem")
    writes = li.select(F.col("l_suppkey").alias("event"), F.col("l_orderkey").alias("module"), F.expr("CASE WHEN l_quantity > 49 THEN 'gone' ELSE l_returnflag END AS name"), F.expr("CASE WHEN l_tax > 0.07 THEN 'E' || l_linenumber END AS enum_module"), F.col("l_linestatus").alias("enum_key"))
    fields = li.select(F.col("l_suppkey").alias("event"), F.explode(F.array(*map(F.lit, "ANR"))).alias("name")).distinct()
    members = li.sparkSession.createDataFrame([("E1", "O"), ("E2", "F"), ("E3", "O"), ("E3", "F")], "enum_module string, enum_key string")
    return checks.failing(li.sparkSession, contracts.buffer_rules(globals_, groups, events, fields, writes, members))


def _gap(table: str, test: str, message: str) -> str:
    return f"SELECT {_says('admission', 'owner', message)} FROM {table} WHERE {test}"


@_query(
    f"{_TREE} "
    + " UNION ALL ".join(
        [
            _gap("q", "n_outcomes < 1", "'response.rpc_outcomes_missing'"), _gap("q", "request_namespace IS DISTINCT FROM namespace", "'request.envelope_disagreement'"), _gap("q", "target IN ('unset', 'unknown')", "'request.target_unresolved'"),
            _gap("q", "target = 'group_jid' AND target_arg_path IS NULL", "'request.target_argument_missing'"), _gap("q", "n_root_groups > 0", "'request.root_disjunction_validation_unqualified'"),
            _gap("n", "tag = ''", "'request.tag_missing'"), _gap("n", f"{_FED} AND arg_path IS NULL", "'request.' || tag || '.argument_missing'"), _gap("n", "repeats AND (repeat_min IS NULL OR repeat_max IS NULL)", "'request.' || tag || '.repeat_bounds_missing'"),
            _gap("n", "repeats", "'request.' || tag || '.repeat_validation_unemitted'"), _gap("n", "n_groups > 0", "'request.' || tag || '.disjunction_validation_unqualified'"),
            _gap("a", "value IS NOT NULL AND kind = 'string'", "'request.' || tag || '.' || name || '.fixed_value_validation_unemitted'"), _gap("a", f"{_READS} AND arg_path IS NULL", "'request.' || tag || '.' || name || '.argument_missing'"),
            _gap("c", "kind <> 'const' AND arg_path IS NULL", "'request.' || tag || '.content_argument_missing'"),
        ]
    )
)
def request_gaps(t):
    n, a, c, q = _tree(t)
    return contracts.request_gaps(q, n, a, c)


@_query("""SELECT 'a' || s_suppkey AS arm, s_nationkey AS variant, coalesce(CASE WHEN s_acctbal > 5000 THEN CAST(s_acctbal AS BIGINT) END, CASE WHEN n_nationkey > 12 THEN n_nationkey END, 400 + n_regionkey) AS code, coalesce(CASE WHEN s_acctbal < 0 THEN s_name END, 'in ' || n_regionkey) AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'outer', n_nationkey, CASE WHEN n_nationkey > 12 THEN n_nationkey ELSE 400 + n_regionkey END, 'in ' || n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def inherited_arms(t):
    """Suppliers are arms below their nation's, which takes part of its shape from pins."""
    both = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    none = F.array().cast("array<string>")
    inner = both.select(F.col("n_nationkey").alias("variant"), F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("arm"), F.array(F.lit("outer")).alias("trail"), F.expr("CASE WHEN s_acctbal > 5000 THEN bround(s_acctbal) END").cast("long").alias("code"), F.expr("CASE WHEN s_acctbal < 0 THEN s_name END AS text"))
    outer = t("nation").select(F.col("n_nationkey").alias("variant"), F.lit("outer").alias("arm"), none.alias("trail"), F.expr("CASE WHEN n_nationkey > 12 THEN n_nationkey END").cast("long").alias("code"), F.lit(None).cast("string").alias("text"))
    pin = lambda path, code, text: t("nation").select(F.col("n_nationkey").alias("variant"), path.alias("path"), code.cast("long").alias("code"), text.alias("text"))
    pins = pin(F.array(F.lit("error"), F.lit("error")), 400 + F.col("n_regionkey"), F.lit(None).cast("string")).unionByName(pin(F.array(F.lit("error"), F.lit("other")), F.lit(None), F.concat(F.lit("in "), F.col("n_regionkey").cast("string")))).unionByName(pin(F.array(F.lit("error")), F.lit(207), F.lit(None).cast("string")))
    return contracts.inherited_arms(inner.unionByName(outer), pins, ("code", "text"))[0]


@_query("""WITH n AS (SELECT p_partkey, p_brand AS tag, p_size > 25 AS is_leaf, CASE WHEN p_size > 40 THEN 'const' WHEN p_size > 30 THEN 'dynamic' END AS kind FROM part), c AS (SELECT p_brand AS tag, min(p_size) % 5 AS zeros, min(p_name) AS source FROM part GROUP BY 1 HAVING min(p_size) % 2 = 1)
SELECT p_partkey, CASE WHEN f THEN 'bytes' ELSE kind END AS kind, CASE WHEN f THEN repeat('00', CAST(zeros AS BIGINT)) END AS const_bytes, CASE WHEN f THEN 'const:' || source END AS value_source FROM (SELECT n.*, zeros, source, c.tag IS NOT NULL AND CASE WHEN kind IS NULL THEN is_leaf ELSE kind = 'dynamic' END AS f FROM n LEFT JOIN c ON c.tag = n.tag)""")
def filled_constants(t):
    p, none = t("part"), F.lit(None).cast("string")
    n = p.select("p_partkey", F.col("p_brand").alias("tag"), (F.col("p_size") > 25).alias("is_leaf"), F.expr("CASE WHEN p_size > 40 THEN 'const' WHEN p_size > 30 THEN 'dynamic' END AS kind"), none.alias("value"), none.alias("const_bytes"), F.lit(None).cast("int").alias("byte_length"), none.alias("value_source"))
    c = p.groupBy(F.col("p_brand").alias("tag")).agg(F.min("p_size").alias("z"), F.min("p_name").alias("source")).filter("z % 2 = 1").select("tag", (F.col("z") % 5).alias("zeros"), "source")
    return contracts.filled_constants(n, c).select("p_partkey", "kind", "const_bytes", "value_source")


@_query("""SELECT s_suppkey AS owner, 'root/' || n_name || '/' || r_name AS path, r_name AS tag FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 0 AND n_nationkey > 9
UNION ALL SELECT s_suppkey, 'root/' || n_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0 AND n_nationkey <= 9 UNION ALL SELECT s_suppkey, 'root', s_name FROM supplier WHERE s_acctbal <= 0""")
def inlined_helpers(t):
    """Suppliers call their nation's helper, and that of some nations its region's."""
    n = t("supplier").select(F.col("s_suppkey").alias("owner"), F.lit("root").alias("path"), F.expr("CASE WHEN s_acctbal > 0 THEN 'n' || s_nationkey END AS helper"), F.col("s_name").alias("tag"))
    h = t("nation").select(F.expr("'n' || n_nationkey AS helper_name"), F.col("n_name").alias("rel_path"), F.expr("CASE WHEN n_nationkey > 9 THEN 'r' || n_regionkey END AS helper"), F.col("n_name").alias("tag"))
    r = t("region").select(F.expr("'r' || r_regionkey AS helper_name"), F.col("r_name").alias("rel_path"), F.lit(None).cast("string").alias("helper"), F.col("r_name").alias("tag"))
    return contracts.inlined(n, h.unionByName(r)).select("owner", "path", "tag")


@_query("""WITH x AS (SELECT o_custkey AS k, o_orderpriority AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT k, name FROM x WHERE r = 1 AND k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def appended_entries(t):
    have = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return contracts.appended(have, t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("name"), "o_orderkey"), "k", ["o_orderkey"])


@_query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def referenced_entries(t):
    return contracts.referenced(t("part"), "p_partkey", t("lineitem").filter("l_returnflag = 'R'"), "l_partkey").select("p_partkey", "p_name")


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce('s' || s_nationkey, 'm' || l_suppkey) AS owner, n_name AS value FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = l_linenumber % 5""")
def resolved_members(t):
    uses = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("'m' || l_suppkey AS module"), F.lit("a").alias("alias"), (F.col("l_linenumber") % 5).cast("int").alias("member"))
    imports = t("supplier").filter("s_acctbal > 0").select(F.expr("'m' || s_suppkey AS module"), F.lit("a").alias("alias"), F.expr("'s' || s_nationkey AS owner"))
    constants = t("nation").select(F.expr("'s' || n_nationkey AS owner"), F.col("n_regionkey").alias("member"), F.col("n_name").alias("value"))
    return contracts.resolved_members(uses, imports, constants).select("l_orderkey", "l_linenumber", "l_partkey", "owner", "value")


@_query("""SELECT o_orderkey, r_name AS value, CASE WHEN c_custkey IS NULL THEN 'customer' WHEN n_nationkey IS NULL THEN 'nation' WHEN r_regionkey IS NULL THEN 'region' END AS stopped_at FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > -500 LEFT JOIN nation ON n_nationkey = c_nationkey AND n_name > 'C' LEFT JOIN region ON r_regionkey = n_regionkey AND r_name < 'M'""")
def chained_lookups(t):
    steps = [("customer", t("customer").filter("c_acctbal > -500"), "c_custkey", "c_nationkey"), ("nation", t("nation").filter("n_name > 'C'"), "n_nationkey", "n_regionkey"), ("region", t("region").filter("r_name < 'M'"), "r_regionkey", "r_name")]
    return contracts.chained(t("orders").withColumn("start", F.col("o_custkey")), steps).select("o_orderkey", "value", "stopped_at")


@_query("""SELECT p_brand, arg_min(p_type, p_partkey) AS first, CASE WHEN count(DISTINCT p_size % 2) = 1 THEN min(p_size % 2) END AS agreed FROM part GROUP BY 1""")
def bindings(t):
    """Two rules for names that are bound again: the first one counts, or all must agree."""
    p = t("part").withColumn("parity", F.col("p_size") % 2)
    first = contracts.first_bindings(p, ["p_brand"], ["p_partkey"]).select("p_brand", F.col("p_type").alias("first"))
    agreed = contracts.agreed_bindings(p.select("p_brand", "parity"), ["p_brand"], "parity").select(F.col("p_brand").alias("b"), F.col("parity").alias("agreed"))
    return first.join(agreed, F.col("p_brand") == F.col("b"), "left").select("p_brand", "first", "agreed")


@_query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_id, CAST(NULL AS BIGINT) AS n_left FROM r WHERE n <= 3 UNION ALL SELECT user_id, NULL, count(*) - 3 FROM r GROUP BY 1 HAVING count(*) > 3""")
def capped_fan_out(t):
    top, left = contracts.capped_fan_out(t("events"), ["user_id"], ["ts", "event_id"], 3)
    return top.select("user_id", "event_id", F.lit(None).cast("long").alias("n_left")).unionByName(left.select("user_id", F.lit(None).cast("long").alias("event_id"), "n_left"))


@_query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS site, o_totalprice AS place, CAST(NULL AS VARCHAR) AS message FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' UNION ALL SELECT CAST(l_orderkey AS VARCHAR), NULL, 'not in the index' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def located_sites(t):
    sites = t("lineitem").select(F.col("l_orderkey").alias("module"))
    index = t("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("module"), F.col("o_totalprice").alias("place"))
    found, missing = contracts.located(sites, index, ["module"])
    return found.select(F.col("module").cast("string").alias("site"), "place", F.lit(None).cast("string").alias("message")).unionByName(missing.select(F.col("key").alias("site"), F.lit(None).cast("double").alias("place"), "message"))


@_query("""SELECT DISTINCT l_suppkey AS id, l_returnflag AS key, l_linestatus AS days FROM lineitem""")
def distinct_full_rows(t):
    """Rows that are equal in all columns are one; those of one id and key with other days stay apart."""
    return t("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("days")).distinct()


@_query("""SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'lidUserJid' WHEN 'error' THEN 'client_error' WHEN 'view' THEN 'group_jid' ELSE event_type END AS name, event_type = 'click' AS jid, event_type = 'error' AS error, event_type = 'view' AS grp FROM events""")
def derived_predicates(t):
    name = F.expr("CASE event_type WHEN 'click' THEN 'lidUserJid' WHEN 'error' THEN 'client_error' WHEN 'view' THEN 'group_jid' ELSE event_type END")
    e = t("events").select("user_id", "event_id", name.alias("name"))
    return e.withColumns({"jid": contracts.is_jid(F.col("name")), "error": contracts.is_error(F.col("name")), "grp": contracts.is_group(F.col("name"))})


@_query("""SELECT s_suppkey, CASE WHEN s_nationkey < 9 AND s_acctbal > 0 THEN 'globals' WHEN s_nationkey = 10 THEN 'constants' WHEN s_acctbal > 5000 THEN 'private' END AS kind, s_nationkey <> 3 AS published FROM supplier""")
def module_kinds(t):
    s = t("supplier").select("s_suppkey", F.expr("CASE WHEN s_nationkey = 10 THEN 'Constants' ELSE s_name END AS name"), F.expr("CASE WHEN s_nationkey < 9 THEN array('Codegen') ELSE array('Other') END AS deps"), F.expr("CASE WHEN s_acctbal > 5000 THEN 'x defineGlobal Table' WHEN s_acctbal > 0 THEN 'defineGlobal' ELSE '' END AS source"), F.expr("CASE WHEN s_nationkey = 3 THEN 'a.rs' ELSE 'a.json' END AS path"))
    return s.select("s_suppkey", contracts.module_kind(F.col("name"), F.col("deps"), F.col("source"), "Codegen", "Constants", "Table").alias("kind"), contracts.published(F.col("path")).alias("published"))


# Naming and encodings.

_NAME = "CASE p_size % 5 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN 'self' WHEN 2 THEN 'type' WHEN 3 THEN p_size || p_name ELSE replace(p_type, ' ', 'Xy') END"


@_query(f"""WITH n AS (SELECT p_partkey, {_NAME} AS n FROM part), w AS (SELECT *, array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN regexp_split_to_array(regexp_replace(n, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+') IF x <> ''], '') AS p FROM n)
SELECT p_partkey, n AS name, CASE WHEN n = 'self' THEN 'self_' WHEN n = 'type' THEN 'r#type' WHEN regexp_matches(n, '^[0-9]') THEN '_' || n ELSE n END AS ident, CASE WHEN p = 'Self' THEN 'Self_' WHEN regexp_matches(p, '^[0-9]') THEN '_' || p ELSE p END AS pascal FROM w""")
def identifiers(t):
    n = t("part").select("p_partkey", F.expr(_NAME).alias("name"))
    return n.withColumns({"ident": scalars.identifier(F.col("name")), "pascal": scalars.telemetry_pascal(F.col("name"))})


@_query("""SELECT c_custkey, '"' || replace(replace(replace(t, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"' AS literal, replace(replace(url_encode(t), '%2C', ','), '+', '%20') AS url, CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) END AS whole, hex(unhex(h)) AS bytes
FROM (SELECT c_custkey, c_acctbal, c_name || '"\\' || chr(10) || ', é~' || c_mktsegment AS t, CASE WHEN c_nationkey > 9 THEN substr(md5(c_name), 1, 8) END AS h FROM customer)""")
def encodings(t):
    c = t("customer").select("c_custkey", "c_acctbal", F.concat("c_name", F.lit('"\\\n, é~'), "c_mktsegment").alias("t"), F.expr("CASE WHEN c_nationkey > 9 THEN substr(md5(c_name), 1, 8) WHEN c_nationkey > 5 THEN 'abc' END AS h"))
    return c.select("c_custkey", scalars.quoted(F.col("t")).alias("literal"), scalars.percent_encoded(F.col("t")).alias("url"), scalars.integer_text(F.col("c_acctbal")).alias("whole"), F.hex(scalars.hex_bytes(F.col("h"))).alias("bytes"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || '.25' END AS text FROM part""")
def numeric_defaults(t):
    value = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") + 0.25)
    return t("part").select("p_partkey", scalars.default_text(value).alias("text"))


# Further aggregations and lookups.


@_query("""SELECT o_custkey, min(o_orderstatus) AS value, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS source FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders) GROUP BY 1 HAVING count(DISTINCT s) = 1 AND NOT bool_or(o_totalprice > 300000)""".replace("min(o_orderstatus) AS value", "min(s) AS value"))
def veto_with_source(t):
    """One status of a customer's orders, unless a large one vetoes; the source is the first order that has a status."""
    o = t("orders").withColumn("s", F.expr("nullif(o_orderstatus, 'P')"))
    return aggregate.unanimous_with_veto(o, ["o_custkey"], "s", F.col("o_totalprice") > 300000, "o_orderpriority", ["o_orderdate", "o_orderkey"])


@_query("""WITH f AS (SELECT l_linenumber > 3 AS of_outcome, l_returnflag = 'A' AS has, CASE WHEN l_quantity > 40 THEN 'x' END AS lit, CASE WHEN l_tax > 0.06 THEN 'p' END AS ref, CASE WHEN l_discount > 0.08 THEN 'e' END AS en, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS k FROM lineitem), g AS (SELECT * FROM f WHERE NOT has OR of_outcome),
a AS (SELECT o_custkey, o_orderstatus AS tag, CASE WHEN o_totalprice > 100000 THEN o_orderpriority END AS text, o_totalprice > 300000 AS env FROM orders)
SELECT 'references' AS key, (SELECT count(*) FROM g WHERE ref IS NOT NULL) + (SELECT count(*) FROM events WHERE event_type = 'click') AS value UNION ALL SELECT 'literals', count(*) FILTER (lit IS NOT NULL) FROM g UNION ALL SELECT 'enums', count(*) FILTER (en IS NOT NULL OR k > 0) FROM g
UNION ALL SELECT 'typed errors', count(*) FILTER (event_type IN ('view', 'error')) FROM events UNION ALL SELECT 'error texts', count(*) FROM (SELECT DISTINCT o_custkey, tag, text FROM a WHERE text IS NOT NULL) UNION ALL SELECT 'error arms', count(*) FILTER (NOT env) FROM a""")
def constraint_counts(t):
    f = t("lineitem").select(F.col("l_orderkey").alias("owner"), (F.col("l_linenumber") > 3).alias("of_outcome"), (F.col("l_returnflag") == "A").alias("has_outcomes"), F.expr("CASE WHEN l_quantity > 40 THEN 'x' END AS literal"), F.expr("CASE WHEN l_tax > 0.06 THEN 'p' END AS reference_path"), F.expr("CASE WHEN l_discount > 0.08 THEN 'e' END AS enum_ref"), F.expr("CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS n_keys"))
    e = t("events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("tag"), F.expr("CASE event_type WHEN 'click' THEN 'reference' WHEN 'view' THEN 'client_error' WHEN 'error' THEN 'server_error' ELSE event_type END AS kind"))
    a = t("orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("tag"), F.lit(None).cast("string").alias("name"), F.expr("CASE WHEN o_totalprice > 100000 THEN o_orderpriority END AS text"), (F.col("o_totalprice") > 300000).alias("envelope"))
    return contracts.constraint_counts(f, e, e, a)


@_query("""SELECT b.p AS start, p_partkey FROM (SELECT DISTINCT substring(p_type, 1, 5) AS p FROM part) b JOIN part ON starts_with(p_type, b.p) AND length(p_type) > length(b.p)""")
def names_that_begin(t):
    p = t("part")
    return lookup.begins_with(p.select(F.substring("p_type", 1, 5).alias("start")).distinct(), "start", p.select("p_partkey", "p_type"), "p_type").select("start", "p_partkey")


@_query("""SELECT reason, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_linenumber, CASE WHEN c.r_regionkey IS NULL THEN 'missing' WHEN c.r_name > 'B' THEN 'not text' WHEN l_returnflag <> 'R' THEN 'guard' END AS reason FROM lineitem LEFT JOIN region c ON c.r_regionkey = l_linenumber - 1) WHERE reason IS NOT NULL GROUP BY 1""")
def dropped_links(t):
    """Links that don't resolve, by reason; a place counts once."""
    c = t("region").select(F.col("r_regionkey").alias("k"), F.array(F.lit("R")).alias("v"), (F.col("r_name") <= "B").alias("ok"))
    a = t("lineitem").select("l_suppkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("k"), F.col("l_returnflag").alias("g"))
    return lookup.drop_counts(lookup.resolved_enum(a, c, ["k"], "g", "v", "ok"), ["l_suppkey", "l_linenumber"])


@_query("""WITH f AS (SELECT s_suppkey, s_nationkey, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS x1, 'get' AS y1, CASE WHEN r_regionkey > 1 THEN r_name END AS x2, CASE WHEN r_regionkey = 2 THEN 'set' ELSE 'get' END AS y2, CASE WHEN n_nationkey < 12 THEN 'user' END AS t1, CASE WHEN r_regionkey < 2 THEN 'group' END AS t2 FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT 's' || s_suppkey AS module, CASE WHEN x1 IS NULL OR x2 IS NULL THEN coalesce(x1, x2) END AS xmlns, CASE WHEN y1 = y2 THEN y1 END AS type, CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN 'Unknown' ELSE coalesce(t1, t2) END AS target, CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN NULL WHEN t1 IS NOT NULL THEN 'n/to' WHEN t2 IS NOT NULL THEN 'n/r/jid' END AS target_path FROM f
UNION ALL SELECT 'n' || n_nationkey, CASE WHEN r_regionkey > 1 THEN r_name END, CASE WHEN r_regionkey = 2 THEN 'set' ELSE 'get' END, CASE WHEN r_regionkey < 2 THEN 'group' END, CASE WHEN r_regionkey < 2 THEN 'r/jid' END FROM nation JOIN region ON r_regionkey = n_regionkey""")
def inherited_envelopes(t):
    """Suppliers reach their nation's fragment and its region's; what they inherit, with composed paths."""
    s, n, r = t("supplier"), t("nation"), t("region")
    edges = s.select(F.expr("'s' || s_suppkey AS module"), F.expr("'n' || s_nationkey AS callee"), F.lit("n").alias("path")).unionByName(n.select(F.expr("'n' || n_nationkey AS module"), F.expr("'r' || n_regionkey AS callee"), F.lit("r").alias("path")))
    fn = n.select(F.expr("'n' || n_nationkey AS callee"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS xmlns"), F.lit("get").alias("type"), F.expr("CASE WHEN n_nationkey < 12 THEN 'user' END AS target"), F.expr("CASE WHEN n_nationkey < 12 THEN 'to' END AS target_path"))
    fr = r.select(F.expr("'r' || r_regionkey AS callee"), F.expr("CASE WHEN r_regionkey > 1 THEN r_name END AS xmlns"), F.expr("CASE WHEN r_regionkey = 2 THEN 'set' ELSE 'get' END AS type"), F.expr("CASE WHEN r_regionkey < 2 THEN 'group' END AS target"), F.expr("CASE WHEN r_regionkey < 2 THEN 'jid' END AS target_path"))
    return contracts.contributions(edges, fn.unionByName(fr))


@_query("""WITH d AS (SELECT c_mktsegment AS g, 'removed' AS side, c_name AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_mktsegment, 'added', c_name FROM customer WHERE c_acctbal >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY g, side ORDER BY n) AS k, count(*) OVER (PARTITION BY g, side) AS m FROM d),
l AS (SELECT g, side, 0 AS last, n AS x, CASE side WHEN 'added' THEN '+ ' ELSE '- ' END || n AS line FROM r WHERE k <= 40 UNION ALL SELECT DISTINCT g, side, 1, '', CASE side WHEN 'added' THEN '+ ' ELSE '- ' END || 'and ' || (m - 40) || ' more' FROM r WHERE m > 40 UNION ALL SELECT DISTINCT g, NULL, -1, '', g || ':' FROM d)
SELECT CAST(row_number() OVER (ORDER BY g, side NULLS FIRST, last, x) AS INTEGER) AS ord, line FROM l""")
def report_lines(t):
    """A report of names that came and went, capped for each side."""
    c = t("customer").select(F.col("c_mktsegment").alias("g"), F.expr("CASE WHEN c_acctbal < 0 THEN 'removed' ELSE 'added' END AS side"), F.col("c_name").alias("n"))
    return catalog.diff_report(c, "g", "n")


@_query(f"""WITH f AS (SELECT l_orderkey AS owner, 'n' || l_linenumber || '-' || l_partkey AS path, CASE WHEN l_returnflag = 'A' THEN 'integer' WHEN l_returnflag = 'N' THEN 'bytes' ELSE 'node' END AS type, CASE WHEN l_linestatus = 'O' THEN 'contentUint' END AS method, l_linenumber % 3 AS kids, CASE WHEN l_quantity > 25 THEN '0' || l_linenumber END AS lit, CASE WHEN l_tax > 0.05 THEN 1 END AS w, CASE WHEN l_discount > 0.07 THEN 'x' END AS src FROM lineitem)
SELECT {_says('integer literal', "owner || '|' || path", "'not a decimal integer'")} FROM f WHERE type = 'integer' AND lit IS NOT NULL UNION ALL SELECT {_says('accessor type', "owner || '|' || path", "'a type that its accessor doesn''t give'")} FROM f WHERE method IS NOT NULL AND type <> 'integer'
UNION ALL SELECT {_says('width source', "owner || '|' || path", "'a source without the value'")} FROM f WHERE src IS NOT NULL AND w IS NULL UNION ALL SELECT {_says('container', "owner || '|' || path", "'children under a scalar type'")} FROM f WHERE method IS NULL AND kids > 0 AND type <> 'node'
UNION ALL SELECT {_says('node', "owner || '|' || path", "'a node reads nothing itself and has children'")} FROM f WHERE type = 'node' AND (method IS NOT NULL OR kids < 1)""")
def content_rules(t):
    """What fields say of themselves, over all nodes."""
    none = F.lit(None).cast("string")
    f = t("lineitem").select(
        F.col("l_orderkey").alias("owner"), F.expr("'n' || l_linenumber || '-' || l_partkey AS path"), F.expr("CASE WHEN l_returnflag = 'A' THEN 'integer' WHEN l_returnflag = 'N' THEN 'bytes' ELSE 'node' END AS type"), F.expr("CASE WHEN l_linestatus = 'O' THEN 'contentUint' END AS method"),
        (F.col("l_linenumber") % 3).alias("n_children"), F.expr("CASE WHEN l_quantity > 25 THEN '0' || l_linenumber END AS literal"), F.expr("CASE WHEN l_tax > 0.05 THEN 1 END AS byte_length"), F.expr("CASE WHEN l_discount > 0.07 THEN 'x' END AS byte_length_source"),
        none.alias("const_value"), none.alias("value_source"), none.alias("reference_path"), none.alias("unknown_policy"), F.lit(None).cast("array<string>").alias("unions"),
    )
    return checks.failing(f.sparkSession, checks.content_rules(f))
