"""Queries of the catalog operators over the supplied tables, and their SQL.

Each query reads whole tables; lists come out as joined text, so that results
can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregate, checks, dedup, diff, lookup, sets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers f(t), t(name) being a table."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Aggregations.


@_query("SELECT o_custkey, o_orderstatus, min(o_orderpriority) AS value, min(o_orderkey) AS source FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) = 1")
def unanimous_priority(t):
    """A customer's orders of a status, if all have one priority."""
    return aggregate.unanimous(t("orders"), ["o_custkey", "o_orderstatus"], "o_orderpriority", "o_orderkey")


@_query("""SELECT o_custkey, min(v) AS value, arg_min(s, o_orderstatus) AS source FROM (SELECT o_orderstatus, o_custkey, min(o_orderpriority) AS v, max(o_orderpriority) AS w, min(o_orderkey) AS s FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2) GROUP BY 1 HAVING min(v) = max(w)""")
def unanimous_rollup(t):
    return aggregate.unanimous_rollup(t("orders"), "o_orderstatus", "o_custkey", "o_orderpriority", "o_orderkey")


@_query("SELECT o_custkey, min(o_orderstatus) AS value FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1 AND NOT bool_or(o_totalprice > 300000)")
def unanimous_with_veto(t):
    return aggregate.unanimous_with_veto(t("orders"), ["o_custkey"], "o_orderstatus", F.col("o_totalprice") > 300000)


@_query("SELECT l_partkey, l_returnflag, min(l_linestatus) AS value, min(l_orderkey) AS source FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) = 1")
def single_status_parts(t):
    return aggregate.unanimous(t("lineitem"), ["l_partkey", "l_returnflag"], "l_linestatus", "l_orderkey")


@_query("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus,
CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'Unknown' ELSE min(o_orderpriority) END AS o_orderpriority,
CASE WHEN count(DISTINCT o_orderpriority) <= 1 AND count(DISTINCT year(o_orderdate)) = 1 THEN CAST(min(year(o_orderdate)) AS INTEGER) END AS order_year FROM orders GROUP BY 1""")
def conflict_merge_priority(t):
    o = t("orders").withColumn("order_year", F.year("o_orderdate"))
    return aggregate.conflict_merge(o, ["o_custkey"], ["o_orderstatus"], "o_orderpriority", "order_year")


@_query("""WITH o AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS site, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS l FROM orders),
a AS (SELECT o_custkey, count(DISTINCT site) AS n FROM o GROUP BY 1), p AS (SELECT o_custkey, o_orderpriority, max(l) AS l, count(DISTINCT site) AS m FROM o GROUP BY 1, 2)
SELECT p.o_custkey, o_orderpriority, CAST(CASE WHEN m < n THEN greatest(l, 1) ELSE l END AS INTEGER) AS level FROM p JOIN a ON a.o_custkey = p.o_custkey""")
def lattice_max_status(t):
    level = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = t("orders").withColumns({"site": F.year("o_orderdate"), "l": level})
    return aggregate.lattice_max(o, "o_custkey", "o_orderpriority", "site", "l")


@_query("""WITH l AS (SELECT o_custkey AS op, o_orderstatus AS path, max(CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END) AS lev FROM orders GROUP BY 1, 2),
d AS (SELECT DISTINCT c_custkey AS op, f AS path, c_acctbal < 0 AS unread, c_mktsegment = 'BUILDING' AS opaque FROM customer, (VALUES ('F'), ('O'), ('P'), ('X')) AS v(f)), k AS (SELECT DISTINCT op FROM l)
SELECT d.op, d.path, CAST(CASE WHEN unread OR k.op IS NULL THEN 2 WHEN lev IS NULL THEN CASE WHEN opaque THEN 2 ELSE 1 END ELSE lev END AS INTEGER) AS level
FROM d LEFT JOIN l ON l.op = d.op AND l.path = d.path LEFT JOIN k ON k.op = d.op""")
def presence_rules(t):
    """Final presence levels: unreadable sites, undeclared writes, opaque spreads."""
    level = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("level")
    levels = t("orders").groupBy(F.col("o_custkey").alias("op"), F.col("o_orderstatus").alias("path")).agg(level)
    c = t("customer").withColumnRenamed("c_custkey", "op")
    declared = c.select("op", F.explode(F.array(*map(F.lit, "FOPX"))).alias("path"))
    return aggregate.withdrawn(levels, "op", "path", c.filter("c_acctbal < 0").select("op"), declared, c.filter("c_mktsegment = 'BUILDING'").select("op"))


@_query("""WITH e AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), v AS (SELECT user_id, event_type, CASE WHEN k % 3 > 0 THEN k // 50 END AS v FROM e)
SELECT user_id, event_type, CASE WHEN count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) = 1 THEN min(v) END AS value, bool_or(v = 1) AS any_flag FROM v GROUP BY 1, 2""")
def value_if_all_equal(t):
    k = F.get_json_object("props", "$.k").cast("int")
    e = t("events").select("user_id", "event_type", F.when(k % 3 > 0, F.floor(k / 50).cast("int")).alias("v"))
    return aggregate.value_if_all_equal(e, ["user_id", "event_type"], "v", F.col("v") == 1)


@_query("""SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS event_type, arg_min(value, (ts, event_id)) FILTER (event_type <> 'view') AS value FROM events GROUP BY 1""")
def first_known_pair(t):
    """The first event that isn't a view, with its value, of each user."""
    seen = F.col("event_type") != "view"
    e = t("events").select("user_id", "ts", "event_id", F.when(seen, F.col("event_type")).alias("event_type"), F.when(seen, F.col("value")).alias("value"))
    return aggregate.first_known(e, ["user_id"], ["event_type", "value"], ["ts", "event_id"])


@_query("""WITH b AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1),
p AS (SELECT l_partkey, l_linenumber, count(DISTINCT l_returnflag) AS m, bool_and(l_quantity > 3) AS req, min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY 1, 2)
SELECT p.l_partkey, l_linenumber, lo AS l_linestatus, req AND m = n AS required FROM p JOIN b ON b.l_partkey = p.l_partkey WHERE lo = hi""")
def branch_fold(t):
    li = t("lineitem").withColumn("req", F.col("l_quantity") > 3)
    return aggregate.branch_fold(li, ["l_partkey"], "l_linenumber", "l_returnflag", ["l_linestatus"], "req")


@_query("""WITH b AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1)
SELECT c.l_partkey, c.l_linestatus, c.l_linenumber FROM (SELECT l_partkey, l_linestatus, l_linenumber, count(DISTINCT l_returnflag) AS m FROM lineitem GROUP BY 1, 2, 3) c JOIN b ON b.l_partkey = c.l_partkey WHERE m = n""")
def constants_in_every_branch(t):
    return aggregate.in_every_branch(t("lineitem"), ["l_partkey"], "l_returnflag", ["l_linestatus", "l_linenumber"])


@_query("""SELECT s_nationkey, sha256(string_agg(s_suppkey || ':' || s_name, chr(10) ORDER BY s_suppkey || ':' || s_name)) AS set_hash FROM supplier GROUP BY 1""")
def set_hash_per_group(t):
    return aggregate.set_hash(t("supplier"), ["s_nationkey"], ["s_suppkey", "s_name"])


@_query("SELECT p_brand, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes FROM part GROUP BY 1")
def members_per_key(t):
    return aggregate.members(t("part"), ["p_brand"], "p_size", "sizes")


@_query("SELECT md5(text) AS digest, count(*) AS copies, count(DISTINCT lang || '|' || source) AS versions FROM documents GROUP BY 1")
def agreeing_copies(t):
    """Copies of a text, and in how many languages and sources they are told to be."""
    return aggregate.agreeing_copies(t("documents").withColumn("digest", F.md5("text")), ["digest"], ["lang", "source"])


@_query("SELECT event_type, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def drop_reason_histogram(t):
    reason = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high")
    return aggregate.histogram(t("events").withColumn("reason", reason), ["event_type", "reason"])


@_query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL) AS other FROM orders GROUP BY 1")
def target_distribution(t):
    return aggregate.distribution(t("orders"), ["o_orderstatus"], "o_orderpriority", {"urgent": "1-URGENT", "high": "2-HIGH"})


@_query("SELECT l_returnflag, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_linenumber, l_linestatus FROM lineitem) GROUP BY 1")
def distinct_four_part_key(t):
    return aggregate.distinct_key_count(t("lineitem"), ["l_returnflag"], ["l_returnflag", "l_suppkey", "l_linenumber", "l_linestatus"])


@_query("""SELECT o_custkey, CASE WHEN min(c) >= 400 AND max(c) <= 499 THEN 'client_error' WHEN min(c) >= 500 AND max(c) <= 599 THEN 'server_error' ELSE 'error' END AS kind
FROM (SELECT o_custkey, unnest([CAST(390 + o_orderkey % 190 AS INTEGER), CASE WHEN o_orderstatus = 'F' THEN CAST(400 + o_custkey % 150 AS INTEGER) END]) AS c FROM orders) GROUP BY 1""")
def error_kinds(t):
    o = t("orders").select("o_custkey", (390 + F.col("o_orderkey") % 190).cast("int").alias("code"), F.when(F.col("o_orderstatus") == "F", (400 + F.col("o_custkey") % 150).cast("int")).alias("low"), F.lit(None).cast("int").alias("high"))
    return aggregate.error_kind(o, ["o_custkey"], "code", "low", "high")


@_query("""WITH e AS (SELECT p_brand AS k, p_partkey % 97 AS a, p_partkey % 97 + p_size AS b FROM part WHERE p_partkey % 2 = 0),
o AS (SELECT k, a, b, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e),
i AS (SELECT k, a, b, sum(CASE WHEN r IS NULL OR a > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o),
s AS (SELECT k, g, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2)
SELECT p_brand, p_partkey, p_partkey % 89 AS lo, p_partkey % 89 + p_size AS hi FROM part WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE k = p_brand AND a <= p_partkey % 89 AND b >= p_partkey % 89 + p_size)""")
def uncovered_bands(t):
    p = t("part")
    band = lambda df, m: df.select("p_brand", "p_partkey", (F.col("p_partkey") % m).alias("lo"), (F.col("p_partkey") % m + F.col("p_size")).alias("hi"))
    return aggregate.uncovered(band(p.filter("p_partkey % 2 = 0"), 97), band(p.filter("p_partkey % 2 = 1"), 89), ["p_brand"], "lo", "hi")


@_query("""SELECT o.o_custkey, n - coalesce(m, 0) AS "left" FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o LEFT JOIN (SELECT o_custkey, count(*) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.o_custkey = o.o_custkey WHERE n - coalesce(m, 0) <> 0""")
def gap_subtraction(t):
    return aggregate.gap_subtraction(t("orders"), t("orders").filter("o_orderstatus = 'F'"), "o_custkey")


@_query("""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<h([1-6])', 1)) AS m FROM pages), c AS (SELECT CAST(n_nationkey AS VARCHAR) AS m, n_regionkey FROM nation)
SELECT c.m AS member, n_regionkey > 0 AND u.m IS NOT NULL AS bit_position FROM c LEFT JOIN u ON u.m = c.m""")
def bit_position_any(t):
    """Which entries are used in a certain form anywhere in the sources."""
    uses = t("pages").select(F.explode(F.regexp_extract_all("html", F.lit("<h([1-6])"), 1)).alias("member"))
    catalog = t("nation").select(F.col("n_nationkey").cast("string").alias("member"), "n_regionkey")
    return aggregate.bit_positions(catalog, uses, ["member"], F.col("n_regionkey") > 0).select("member", "bit_position")


# Deduplication and order.


@_query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_order_per_customer(t):
    return dedup.first_wins(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@_query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'P') WHERE n = 1")
def first_matching_order(t):
    return dedup.filter_then_first(t("orders"), F.col("o_orderstatus") == "P", ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@_query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1 AND o_orderstatus = 'P'")
def first_order_if_matching(t):
    return dedup.first_then_filter(t("orders"), F.col("o_orderstatus") == "P", ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@_query("SELECT p_brand, p_type, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1, 2")
def sorted_dedup_part(t):
    return dedup.first_wins(t("part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_brand", "p_type", "p_partkey", "p_name")


@_query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR b IS DISTINCT FROM event_type""")
def adjacent_dedup_events(t):
    return dedup.adjacent_dedup(t("events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@_query("""WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS s, CAST(floor(value) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) AS e FROM events)
SELECT event_id, user_id, s, e FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e) WHERE r IS NULL OR s >= r""")
def outermost_intervals(t):
    s = F.floor("value").cast("long")
    e = t("events").select("event_id", "user_id", s.alias("s"), (s + F.get_json_object("props", "$.k").cast("long")).alias("e"))
    return dedup.outermost_intervals(e, ["user_id"], "s", "e", ["event_id"])


@_query("""SELECT s_nationkey, s_suppkey, n FROM (SELECT s_nationkey, s_suppkey, n, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, s_suppkey) AS r FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey) WHERE r = 1""")
def largest_group_pick(t):
    n = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    both = n.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return dedup.largest(both, ["s_nationkey"], "n", ["s_suppkey"]).select("s_nationkey", "s_suppkey", "n")


@_query("""SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, nullif(o_orderpriority, '3-MEDIUM') NULLS FIRST, o_orderkey) AS INTEGER) AS rank FROM orders""")
def canonical_sort_rank(t):
    """By ordinal of the status, then priority with nulls first."""
    o = t("orders").withColumn("p", F.expr("nullif(o_orderpriority, '3-MEDIUM')"))
    order = [dedup.ordinal(F.col("o_orderstatus"), ["P", "O", "F"]), F.col("p").asc_nulls_first(), "o_orderkey"]
    return dedup.canonical_rank(o, ["o_custkey"], order).select("o_orderkey", "o_custkey", "rank")


@_query("""WITH a AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS k, p_brand, row_number() OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY p_partkey) AS n FROM part),
b AS (SELECT p_partkey, CASE WHEN n > 1 THEN k || p_brand ELSE k END AS name, n > 1 AS again FROM a)
SELECT name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY again, p_partkey) AS r FROM b) WHERE r = 1""")
def renamed_on_collision(t):
    p = t("part").withColumn("k", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return dedup.renamed_on_collision(p, "k", "p_brand", ["p_partkey"]).select("name", "p_partkey")


@_query("""SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || n END AS unique_name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)""")
def unique_suffixes(t):
    return dedup.unique_suffix(t("part"), "p_type", ["p_partkey"]).select("p_partkey", "unique_name")


@_query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def capped_report(t):
    """The first 40 of a report in a total order."""
    return dedup.capped(t("customer"), [F.desc("c_acctbal"), "c_custkey"], 40)[0].select("c_custkey", "c_name")


# Lookups.


@_query("""SELECT l_partkey AS module, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS consumers FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1""")
def reverse_deps_consumers(t):
    return lookup.dependents(t("lineitem"), "l_suppkey", "l_partkey")


@_query("""WITH a AS (SELECT o_custkey, o_orderstatus, min(o_orderpriority) AS v FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) = 1),
b AS (SELECT o_custkey, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1)
SELECT o.o_orderkey, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'exact' WHEN b.v IS NOT NULL THEN 'tag' END AS tier FROM orders o LEFT JOIN a ON a.o_custkey = o.o_custkey AND a.o_orderstatus = o.o_orderstatus LEFT JOIN b ON b.o_custkey = o.o_custkey""")
def two_tier_lookup(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    exact = aggregate.unanimous(o, ["o_custkey", "o_orderstatus"], "o_orderpriority", "o_orderkey")
    tag = aggregate.unanimous(o.filter("o_orderstatus = 'F'"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    return lookup.two_tier_lookup(o, exact, tag, ["o_custkey", "o_orderstatus"], "o_custkey").select("o_orderkey", "value", "tier")


@_query("""WITH o AS (SELECT *, o_orderstatus = 'P' AS p, count(*) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, c_name AS value FROM o LEFT JOIN customer ON p AND n = 1 AND c_custkey = o_custkey""")
def sole_member_guard(t):
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return lookup.sole_member(t("orders"), ["o_custkey"], F.col("o_orderstatus") == "P", c, "o_custkey", "c_name").select("o_orderkey", "value")


@_query("""WITH e AS (SELECT n_nationkey % 9 AS module, CASE WHEN n_nationkey % 9 < 6 THEN n_name END AS export, n_nationkey AS event FROM nation WHERE n_nationkey < 9 OR n_nationkey % 9 < 3),
s AS (SELECT s_suppkey, s_nationkey % 9 AS module, CASE WHEN s_suppkey % 4 > 0 THEN n_name END AS export FROM supplier JOIN nation ON n_nationkey = s_nationkey),
o AS (SELECT module, count(*) AS n, count(export) AS x, min(event) AS event FROM e GROUP BY 1 HAVING count(*) = 1 AND count(export) = 0)
SELECT s_suppkey, coalesce(e.event, o.event) AS event, CASE WHEN e.event IS NOT NULL THEN 'export' WHEN o.event IS NOT NULL THEN 'sole' ELSE 'unmatched' END AS how FROM s LEFT JOIN e ON e.module = s.module AND e.export = s.export LEFT JOIN o ON o.module = s.module""")
def site_to_event_fallback(t):
    n = t("nation")
    events = n.filter("n_nationkey < 9 OR n_nationkey % 9 < 3").select((F.col("n_nationkey") % 9).alias("module"), F.expr("CASE WHEN n_nationkey % 9 < 6 THEN n_name END").alias("export"), F.col("n_nationkey").alias("event"))
    sites = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", (F.col("s_nationkey") % 9).alias("module"), F.expr("CASE WHEN s_suppkey % 4 > 0 THEN n_name END").alias("export"))
    return lookup.site_to_event(sites, events, "module", "export", "event").select("s_suppkey", "event", "how")


@_query("""WITH f AS (SELECT DISTINCT p_partkey, p_brand FROM part WHERE p_size > 10)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN f.p_partkey IS NOT NULL THEN 'field' WHEN l.b = 'Brand#11' THEN 'special' ELSE 'dropped' END AS state
FROM (SELECT *, 'Brand#' || (11 + l_suppkey % 15) AS b FROM lineitem) l LEFT JOIN f ON f.p_partkey = l_partkey AND f.p_brand = l.b""")
def written_key_semi_anti(t):
    w = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("owner"), F.concat(F.lit("Brand#"), (11 + F.col("l_suppkey") % 15).cast("string")).alias("name"))
    f = t("part").filter("p_size > 10").select(F.col("p_partkey").alias("owner"), F.col("p_brand").alias("name"))
    return lookup.written_keys(w, f, "owner", "name", "Brand#11").select("l_orderkey", "l_linenumber", F.col("owner").alias("l_partkey"), "state")


@_query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS value, CASE WHEN c_acctbal > 5000 AND c_mktsegment IS NOT NULL THEN 'inline' WHEN n_nationkey % 2 = 0 AND n_name IS NOT NULL THEN 'sibling' WHEN r_name IS NOT NULL THEN 'name' END AS value_origin
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def provenance_coalesce(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    options = [("inline", F.expr("CASE WHEN c_acctbal > 5000 THEN c_mktsegment END")), ("sibling", F.expr("CASE WHEN n_nationkey % 2 = 0 THEN n_name END")), ("name", F.col("r_name"))]
    return lookup.coalesced_with_origin(c, options, "value").select("c_custkey", "value", "value_origin")


@_query("""SELECT n_nationkey, n_name, CAST(coalesce(n, 2) AS BIGINT) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey % 3 > 0 GROUP BY 1) ON s_nationkey = n_nationkey""")
def shape_aligned_defaults(t):
    facts = t("supplier").filter("s_nationkey % 3 > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return lookup.aligned(t("nation").select("n_nationkey", "n_name"), facts, ["n_nationkey"], "n", F.lit(2).cast("long"))


@_query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 7 > 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 6 > 0)
SELECT coalesce(a.k, b.k) AS k, a.v AS old_value, b.v AS new_value, CASE WHEN b.k IS NULL THEN 'stale' WHEN a.k IS NULL THEN 'unused' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_status(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = c.filter("k % 6 > 0").withColumn("v", F.when(F.col("k") % 5 == 0, "OTHER").otherwise(F.col("v")))
    return lookup.reconciled(c.filter("k % 7 > 0"), new, "k", "v")


@_query("""WITH b AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.p_brand <> b.p_brand AND starts_with(b.p_brand, o.p_brand) AND regexp_matches(substring(b.p_brand, length(o.p_brand) + 1, 1), '^[0-9]$'))""")
def name_prefix_anti(t):
    return lookup.root_names(t("part").select("p_brand").distinct(), [], "p_brand", "[0-9]")


@_query("""WITH h AS (SELECT DISTINCT array_to_string(string_split(url, '/')[1:4], '/') AS p FROM pages WHERE page_id % 3 = 0), o AS (SELECT p, length(p) AS owner FROM h UNION SELECT DISTINCT array_to_string(string_split(url, '/')[1:3], '/'), 0 FROM pages),
c AS (SELECT page_id, unnest([array_to_string(string_split(url, '/')[1:k], '/') FOR k IN range(1, len(string_split(url, '/')) + 1)]) AS p FROM pages)
SELECT page_id, url, owner FROM pages LEFT JOIN (SELECT page_id AS i, arg_max(o.owner, length(o.p)) AS owner FROM c JOIN o ON o.p = c.p GROUP BY 1) ON i = page_id""")
def longest_prefix_owner(t):
    parts = F.split("url", "/")
    start = lambda k: F.array_join(F.slice(parts, 1, k), "/")
    own = t("pages").filter("page_id % 3 = 0").select(start(4).alias("p")).distinct().select("p", F.length("p").cast("long").alias("owner"))
    own = own.union(t("pages").select(start(3), F.lit(0).cast("long")).distinct()).groupBy("p").agg(F.max("owner").alias("owner"))
    return lookup.longest_prefix(t("pages").select("page_id", "url"), "url", own, "p", "owner")


@_query("""WITH c AS (SELECT n_regionkey AS r, list(n_name ORDER BY n_name) AS v, n_regionkey <> 3 AS ok FROM nation WHERE n_regionkey < 4 GROUP BY 1)
SELECT s_suppkey, CASE WHEN w IS NULL THEN array_to_string(v, ',') END AS members, w AS drop_reason FROM (SELECT s_suppkey, c.v, CASE WHEN c.r IS NULL THEN 'missing' WHEN NOT c.ok THEN 'not text' WHEN len(c.v) < 1 THEN 'empty' WHEN g IS NOT NULL AND NOT list_contains(c.v, g) THEN 'guard' END AS w
FROM (SELECT s_suppkey, s_suppkey % 5 AS r, CASE WHEN s_suppkey % 4 > 0 THEN n_name END AS g FROM supplier JOIN nation ON n_nationkey = s_nationkey) s LEFT JOIN c ON c.r = s.r)""")
def resolved_enum_links(t):
    n = t("nation")
    catalog = n.filter("n_regionkey < 4").groupBy(F.col("n_regionkey").cast("long").alias("r")).agg(F.array_sort(F.collect_list("n_name")).alias("v")).withColumn("ok", F.col("r") != 3)
    attrs = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", (F.col("s_suppkey") % 5).alias("r"), F.expr("CASE WHEN s_suppkey % 4 > 0 THEN n_name END").alias("g"))
    return lookup.resolved_enum(attrs, catalog, ["r"], "g", "v", "ok").select("s_suppkey", F.array_join("v", ",").alias("members"), "drop_reason")


@_query("""WITH p AS (SELECT DISTINCT s_suppkey AS a, s_nationkey % 4 AS k, s_nationkey AS v FROM supplier)
SELECT DISTINCT x.a, y.a AS b FROM p x JOIN p y ON x.k = y.k AND x.a < y.a AND x.v <> y.v""")
def conflicting_variants(t):
    s = t("supplier").withColumn("k", F.col("s_nationkey") % 4)
    return lookup.conflicting_variants(s, "s_suppkey", "k", "s_nationkey")


@_query("""WITH s AS (SELECT DISTINCT p_brand AS a, p_size % 12 AS i FROM part WHERE p_size < 20), n AS (SELECT a, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT x.a, y.a AS b, count(*) AS m FROM s x JOIN s y ON x.i = y.i AND x.a <> y.a GROUP BY 1, 2), p AS (SELECT DISTINCT p_brand AS a, p_size % 3 AS k, p_size AS v FROM part WHERE p_size < 4),
c AS (SELECT DISTINCT x.a, y.a AS b FROM p x JOIN p y ON x.k = y.k AND x.v <> y.v)
SELECT h.a, h.b FROM h JOIN n ON n.a = h.a WHERE m = n AND NOT EXISTS (SELECT 1 FROM c WHERE c.a = h.a AND c.b = h.b)""")
def indistinct_variants(t):
    p = t("part")
    sig = p.filter("p_size < 20").withColumn("i", F.col("p_size") % 12)
    pins = p.filter("p_size < 4").withColumn("k", F.col("p_size") % 3)
    return lookup.indistinct_variants(sig, pins, "p_brand", "i", "k", "p_size")


@_query("""WITH e AS (SELECT o_custkey AS o, o_orderpriority AS k, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS v FROM orders WHERE year(o_orderdate) < 1995), l AS (SELECT o_custkey AS o, o_orderpriority AS k, o_orderstatus AS v FROM orders WHERE year(o_orderdate) >= 1995)
SELECT DISTINCT o AS o_custkey FROM l WHERE o NOT IN (SELECT e.o FROM e WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.o = e.o AND x.k = e.k AND (e.v IS NULL OR e.v = x.v)))""")
def implied_assertions(t):
    o = t("orders").withColumn("y", F.year("o_orderdate"))
    early = o.filter("y < 1995").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    return lookup.implied(early, o.filter("y >= 1995"), "o_custkey", "o_orderpriority", "o_orderstatus")


# Sets, closures, components.


@_query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'removed' ELSE 'added' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def name_set_diff(t):
    return sets.set_difference(t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), ["k"])


@_query("""SELECT l_partkey, l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS n_left, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2 HAVING n_left <> n_right""")
def multiset_diff(t):
    li = t("lineitem")
    return sets.multiset_diff(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), ["l_partkey", "l_linenumber"])


@_query("""WITH d AS (SELECT CAST(k AS VARCHAR) AS s, k, sum(l) AS l, sum(r) AS r FROM (SELECT l_suppkey AS k, 1 AS l, 0 AS r FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, 0, 1 FROM lineitem WHERE l_returnflag = 'R') GROUP BY 2 HAVING sum(l) <> sum(r))
SELECT count(*) = 0 AS equal, CAST(coalesce(sum(greatest(l - r, 0)), 0) AS BIGINT) AS missing, CAST(coalesce(sum(greatest(r - l, 0)), 0) AS BIGINT) AS extra,
coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT s FROM d WHERE l > r ORDER BY k LIMIT 3)), '') AS missing_sample, coalesce((SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT s FROM d WHERE l <= r ORDER BY k LIMIT 3)), '') AS extra_sample FROM d""")
def multiset_report(t):
    li = t("lineitem")
    return sets.multiset_report(li.filter("l_returnflag = 'A'").select("l_suppkey"), li.filter("l_returnflag = 'R'").select("l_suppkey"), "l_suppkey")


@_query("SELECT c_custkey AS k, 'both' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'no order' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_except_intersect(t):
    c, o = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).withColumn("side", F.lit("both")).unionByName(c.subtract(o).withColumn("side", F.lit("no order")))


_EDGES = "SELECT DISTINCT s_suppkey AS a, s_suppkey // 3 AS b FROM supplier UNION SELECT -1 - n_nationkey, -1 - (n_nationkey * 7 + 3) % 25 FROM nation"


def _edges(t) -> DataFrame:
    """A tree of all suppliers, and cycles of all nations."""
    tree = t("supplier").select(F.col("s_suppkey").alias("a"), F.expr("s_suppkey div 3").alias("b"))
    return tree.union(t("nation").select((-1 - F.col("n_nationkey")).cast("long"), (-1 - (F.col("n_nationkey") * 7 + 3) % 25).cast("long"))).distinct()


@_query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a, b FROM r")
def transitive_closure(t):
    return sets.closure(_edges(t), "a", "b")


@_query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT a, b, 1 AS d FROM e UNION SELECT r.a, e.b, d + 1 FROM r JOIN e ON e.a = r.b WHERE d < 3) SELECT DISTINCT a, b FROM r")
def bounded_closure(t):
    return sets.closure(_edges(t), "a", "b", 3)


@_query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - CASE WHEN c_custkey % 10 > 0 THEN 1 ELSE 0 END AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS node, min(b) AS component FROM r GROUP BY 1""")
def connected_components(t):
    """Chains of ten over all customers."""
    c = F.col("c_custkey")
    return sets.components(t("customer").select(c.alias("a"), (c - F.when(c % 10 > 0, 1).otherwise(0)).alias("b")), "a", "b")


@_query("SELECT 0 AS part, count(*) AS n FROM customer UNION ALL SELECT 1, count(*) FROM supplier")
def union_in_order(t):
    u = sets.union_in_order([t("customer").select(F.col("c_custkey").alias("k")), t("supplier").select(F.col("s_suppkey").alias("k"))])
    return u.groupBy("part").agg(F.count("*").alias("n"))


@_query("""SELECT k, arg_max(v, r) AS v FROM (SELECT c_custkey AS k, c_name AS v, 0 AS r FROM customer UNION ALL SELECT c_custkey, 'later', 1 FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1""")
def accumulated_rounds(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return sets.accumulated([c, c.filter("k % 3 = 0").withColumn("v", F.lit("later"))], ["k"])


# Checks.

_RULE = "CAST({0} AS VARCHAR) AS rule, CAST({1} AS VARCHAR) AS key, CAST({2} AS VARCHAR) AS message"


def _says(rule: str, key: str, message: str) -> str:
    return _RULE.format(f"'{rule}'", key, message)


@_query(f"SELECT {_says('customer', 'o_orderkey', "'unresolved: ' || o_custkey")} FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT {_says('label', 'doc_id', "'unresolved: ' || doc_id")} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fk_violations(t):
    a = checks.fk_violations(t("orders"), "customer", ["o_orderkey"], ["o_custkey"], t("customer").filter("c_acctbal > 0"), ["c_custkey"])
    return a.unionByName(checks.fk_violations(t("documents"), "label", ["doc_id"], ["doc_id"], t("labels"), ["doc_id"]))


@_query(f"SELECT {_says('text', 'd', "n || ' rows'")} FROM (SELECT md5(text) AS d, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)")
def duplicate_identities(t):
    return checks.duplicate_keys(t("documents").withColumn("d", F.md5("text")), "text", ["d"])


@_query(f"SELECT {_says('source', 'd', "n || ' versions'")} FROM (SELECT md5(text) AS d, count(DISTINCT source) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)")
def disagreeing_copies(t):
    return checks.disagreeing_copies(t("documents").withColumn("d", F.md5("text")), "source", ["d"], ["source"])


@_query(f"""SELECT {_says('disjoint', 'k', "'in ' || string_agg(n, ',' ORDER BY n)")} FROM (SELECT DISTINCT o_custkey AS k, 'customers' AS n FROM orders UNION SELECT l_suppkey, 'suppliers' FROM lineitem) GROUP BY k HAVING count(*) > 1""")
def key_disjointness(t):
    return checks.shared_keys({"customers": t("orders").select(F.col("o_custkey").alias("k")), "suppliers": t("lineitem").select(F.col("l_suppkey").alias("k"))}, "disjoint", ["k"])


@_query(f"""SELECT {_says('floor', 'a.k', "a.n || ' -> ' || coalesce(CAST(b.n AS VARCHAR), 'none')")} FROM (SELECT event_type AS k, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY 1) a LEFT JOIN (SELECT event_type AS k, count(*) AS n FROM events WHERE day(ts) > 15 AND event_type <> 'click' GROUP BY 1) b ON a.k = b.k
WHERE b.n IS NULL OR CASE WHEN a.k = 'error' THEN b.n > a.n ELSE b.n < a.n END""")
def floor_guard(t):
    e = t("events").withColumn("d", F.dayofmonth("ts"))
    n = lambda df: df.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("value"))
    prior = n(e.filter("d <= 15")).withColumn("direction", F.when(F.col("key") == "error", "down").otherwise("up"))
    return checks.floor_guard(prior, n(e.filter("d > 15 AND event_type <> 'click'")))


@_query(f"""WITH c AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1), p(k, n) AS (VALUES ('F', 0), ('O', 1), ('X', 5))
SELECT {_says('ratchet', 'coalesce(c.k, p.k)', "coalesce(CAST(c.n AS VARCHAR), 'none') || ', pinned ' || coalesce(CAST(p.n AS VARCHAR), 'none')")} FROM c FULL JOIN p ON c.k = p.k WHERE c.n IS DISTINCT FROM p.n""")
def exact_ratchet(t):
    c = t("orders").groupBy(F.col("o_orderstatus").alias("key")).agg(F.count("*").alias("value"))
    return checks.exact_ratchet(c, c.sparkSession.createDataFrame([("F", 0), ("O", 1), ("X", 5)], "key string, value long"))


@_query(f"SELECT {_says('name', 'd', 'names')} FROM (SELECT upper(substring(b, 1, 1)) || substring(b, 2) AS d, string_agg(b, ',' ORDER BY b) AS names, count(*) AS n FROM (SELECT DISTINCT replace(lower(p_type), ' ', '') AS b FROM part UNION SELECT DISTINCT upper(substring(replace(lower(p_type), ' ', ''), 1, 1)) || substring(replace(lower(p_type), ' ', ''), 2) FROM part) GROUP BY 1) WHERE n > 1")
def pascal_collisions(t):
    b = t("part").select(F.replace(F.lower("p_type"), F.lit(" "), F.lit("")).alias("b")).distinct()
    both = b.union(b.select(F.concat(F.upper(F.substring("b", 1, 1)), F.substring("b", 2, 100))))
    return checks.collides_after(both, "name", "b", scalars.pascal_case(F.col("b")))


@_query(f"""SELECT {_says('balance', 'c_custkey', "'below zero'")} FROM customer WHERE c_acctbal < 0 UNION ALL SELECT {_says('size', 'p_partkey', "'too large'")} FROM part WHERE p_size > 45 UNION ALL SELECT {_says('complete', 'o_custkey', "'missing'")} FROM (SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def rows_of_all_checks(t):
    """Several rules in one job; none hides another."""
    asked = t("customer").select(F.col("c_custkey").alias("o_custkey"))
    rules = [checks.row_rule(t("customer"), "balance", ["c_custkey"], F.col("c_acctbal") < 0, "below zero"), checks.row_rule(t("part"), "size", ["p_partkey"], F.col("p_size") > 45, "too large"), checks.incomplete(asked, t("orders"), "o_custkey")]
    return checks.failing(asked.sparkSession, rules)


@_query("""WITH a AS (SELECT c_custkey AS p, md5(c_name) AS d FROM customer), b AS (SELECT c_custkey AS p, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE md5(c_name) END AS d FROM customer WHERE c_custkey % 5 > 0)
SELECT a.p, CASE WHEN b.p IS NULL THEN 'missing' WHEN a.d = b.d THEN 'equal' ELSE 'differs' END AS state FROM a LEFT JOIN b ON a.p = b.p""")
def artifact_states(t):
    a = t("customer").select(F.col("c_custkey").alias("p"), F.md5("c_name").alias("d"))
    return checks.artifact_states(a, a.filter("p % 5 > 0").withColumn("d", F.when(F.col("p") % 4 == 0, "x").otherwise(F.col("d"))), "p", "d")


@_query("""WITH a AS (SELECT c_custkey AS k, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer WHERE c_custkey % 11 > 0),
b AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CAST(c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS c_nationkey FROM customer WHERE c_custkey % 13 > 0),
j AS (SELECT coalesce(a.k, b.k) AS c_custkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS kind, a.c_name AS n0, b.c_name AS n1, a.c_mktsegment AS m0, b.c_mktsegment AS m1, a.c_nationkey AS t0, b.c_nationkey AS t1 FROM a FULL JOIN b ON a.k = b.k)
SELECT c_custkey, kind, 'c_name' AS field, n0 AS before, n1 AS after FROM j WHERE n0 IS DISTINCT FROM n1 UNION ALL SELECT c_custkey, kind, 'c_mktsegment', m0, m1 FROM j WHERE m0 IS DISTINCT FROM m1 UNION ALL SELECT c_custkey, kind, 'c_nationkey', t0, t1 FROM j WHERE t0 IS DISTINCT FROM t1""")
def field_changes(t):
    c = t("customer")
    new = c.filter("c_custkey % 13 > 0").withColumns({"c_mktsegment": F.expr("CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END"), "c_nationkey": F.expr("c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END")})
    return diff.field_changes(c.filter("c_custkey % 11 > 0"), new, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@_query("""WITH a AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m, c_nationkey AS t FROM customer),
b AS (SELECT c_custkey AS k, c_name AS n, CASE WHEN c_acctbal > 500 THEN c_mktsegment END AS m, c_nationkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS t FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 1000000000 + s_suppkey, s_name, NULL, s_nationkey FROM supplier),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS ak, b.k AS bk, a.n AS an, a.m AS am, a.t AS t0, b.n AS bn, b.m AS bm, b.t AS t1 FROM a FULL JOIN b ON a.k = b.k),
x AS (SELECT k, '' AS pointer, 'removed' AS kind, '{"k":' || k || ',"m":' || to_json(am) || ',"n":' || to_json(an) || ',"t":' || t0 || '}' AS before, NULL AS after FROM j WHERE bk IS NULL
UNION ALL SELECT k, '', 'added', NULL, '{"k":' || k || ',"n":' || to_json(bn) || ',"t":' || t1 || '}' FROM j WHERE ak IS NULL UNION ALL SELECT k, '/m', 'removed', to_json(am), NULL FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND bm IS NULL
UNION ALL SELECT k, '/t', 'changed', CAST(t0 AS VARCHAR), CAST(t1 AS VARCHAR) FROM j WHERE t0 <> t1)
SELECT 'catalog' AS domain, 'customers' AS collection, CAST(k AS VARCHAR) AS identity, pointer, kind, CAST(before AS VARCHAR) AS before, CAST(after AS VARCHAR) AS after,
sha256('{"after":' || coalesce(CAST(to_json(CAST(after AS VARCHAR)) AS VARCHAR), 'null') || ',"before":' || coalesce(CAST(to_json(CAST(before AS VARCHAR)) AS VARCHAR), 'null') || ',"collection":"customers","domain":"catalog","identity":"' || k || '","kind":"' || kind || '","pointer":"' || pointer || '"}') AS id FROM x""")
def keyed_diff(t):
    """JSON items of two snapshots by identity, walked key by key, with change ids: customers before, and some of them after, with suppliers."""
    row = lambda df, k, n, m, at: df.select(k.alias("k"), n.alias("n"), m.cast("string").alias("m"), at.alias("t"))
    item = lambda df: df.select(F.lit("catalog").alias("domain"), F.lit("customers").alias("collection"), F.col("k").alias("idx"), F.to_json(F.struct("k", "n", "m", "t")).alias("item"))
    c, s = t("customer"), t("supplier")
    old = row(c, F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey"))
    new = row(c.filter("c_acctbal > 0"), F.col("c_custkey"), F.col("c_name"), F.expr("CASE WHEN c_acctbal > 500 THEN c_mktsegment END"), F.expr("c_nationkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END"))
    more = row(s, 1000000000 + F.col("s_suppkey"), F.col("s_name"), F.lit(None), F.col("s_nationkey"))
    return diff.keyed_diff(item(old), item(new.unionByName(more)), F.get_json_object("item", "$.k"))


@_query()
def snapshot_diff(t):
    """JSON items by identity, walked key by key, with change ids."""
    item = lambda df: df.select(F.lit("catalog").alias("domain"), F.lit("parts").alias("collection"), F.col("p_partkey").alias("idx"), F.to_json(F.struct("p_partkey", "p_brand", "p_size")).alias("item"))
    p = t("part")
    new = p.filter("p_partkey % 9 > 0").withColumn("p_size", F.expr("CASE WHEN p_partkey % 4 > 0 THEN p_size END"))
    return diff.keyed_diff(item(p.filter("p_partkey % 7 > 0")), item(new), F.get_json_object("item", "$.p_partkey"))


# Scalars.

_ACC = "CASE event_id % 8 WHEN 0 THEN 'attrInt' WHEN 1 THEN 'maybeAttrEnum' WHEN 2 THEN 'contentBytes' WHEN 3 THEN 'child' WHEN 4 THEN 'maybeChild' WHEN 5 THEN 'attrUserJid' WHEN 6 THEN 'attrEnumOrNullIfUnknown' ELSE 'hasAttr' END"


@_query(f"""SELECT event_id, n AS accessor, CASE n WHEN 'child' THEN 'child' WHEN 'maybeChild' THEN 'child' WHEN 'contentBytes' THEN 'content' ELSE 'attr' END AS kind, CASE n WHEN 'attrInt' THEN 'integer' WHEN 'maybeAttrEnum' THEN 'enum' WHEN 'contentBytes' THEN 'bytes' WHEN 'attrUserJid' THEN 'userJid' WHEN 'attrEnumOrNullIfUnknown' THEN 'enum' ELSE 'string' END AS type,
n IN ('maybeAttrEnum', 'maybeChild') AS optional, CASE n WHEN 'maybeAttrEnum' THEN 'reject' WHEN 'attrEnumOrNullIfUnknown' THEN 'null' END AS policy FROM (SELECT event_id, {_ACC} AS n FROM events)""")
def accessor_classification(t):
    n = F.col("accessor")
    return t("events").select("event_id", F.expr(_ACC).alias("accessor")).select("event_id", n, scalars.accessor_kind(n).alias("kind"), scalars.accessor_type(n).alias("type"), scalars.accessor_optional(n).alias("optional"), scalars.unknown_policy(n).alias("policy"))


@_query("SELECT n_regionkey, 'ENUM_' || array_to_string(list_sort(list(DISTINCT upper(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')))), '_') AS name FROM nation GROUP BY 1")
def synthetic_name(t):
    return t("nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("m")).select("n_regionkey", scalars.synthetic_enum_name(F.col("m")).alias("name"))


@_query("SELECT p_partkey, array_to_string([upper(w[1]) || w[2:] FOR w IN regexp_split_to_array(p_name, '[^A-Za-z0-9]+') IF w <> ''], '') AS name FROM part")
def pascal_case(t):
    return t("part").select("p_partkey", scalars.pascal_case(F.col("p_name")).alias("name"))


_NAMES = ("is_{}", "{}_count", "{}_enabled", "{}_jids", "enabled", "{}", "timestamp", "disable{}", "{}_ids", "{}_at")


@_query("""SELECT event_id, n AS name, CASE WHEN regexp_matches(n, '^(is_|disable)') OR ends_with(n, '_enabled') OR n = 'enabled' THEN 'boolean' WHEN ends_with(n, '_count') OR ends_with(n, '_at') OR n = 'timestamp' THEN 'number' ELSE 'string' END AS type,
CASE WHEN regexp_matches(n, '(_jids|_ids)$') THEN '[string]' WHEN regexp_matches(n, '^(is_|disable)') OR ends_with(n, '_enabled') OR n = 'enabled' THEN 'boolean' WHEN ends_with(n, '_count') OR ends_with(n, '_at') OR n = 'timestamp' THEN 'number' ELSE 'string' END AS variable
FROM (SELECT event_id, replace(['is_{}', '{}_count', '{}_enabled', '{}_jids', 'enabled', '{}', 'timestamp', 'disable{}', '{}_ids', '{}_at'][event_id % 10 + 1], '{}', event_type) AS n FROM events)""")
def heuristic_type(t):
    form = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 10 + 1).cast("int"))
    e = t("events").select("event_id", F.replace(form, F.lit("{}"), F.col("event_type")).alias("name"))
    return e.withColumns({"type": scalars.heuristic_type(F.col("name")), "variable": scalars.variable_type(F.col("name"))})


@_query("""SELECT event_id, '/' || replace(replace('k~' || event_type || '/x', '~', '~0'), '/', '~1') AS pointer, json_extract_string(props, '$.k') AS value FROM events""")
def json_pointer_walk(t):
    key = F.concat(F.lit("k~"), "event_type", F.lit("/x"))
    return t("events").select("event_id", F.concat(F.lit("/"), diff.pointer_escape(key)).alias("pointer"), F.get_json_object("props", "$.k").alias("value"))


@_query("""SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS segment, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)', 1) AS host,
regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || '/x.js' AS script FROM pages""")
def url_parts(t):
    u = F.col("url")
    return t("pages").select("page_id", scalars.last_segment(u).alias("segment"), scalars.origin(u).alias("origin"), scalars.host(u).alias("host"), scalars.resolved_url(u, F.lit("/x.js")).alias("script"))


@_query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<script[^>]*>')) AS INTEGER) AS scripts, CAST(len(regexp_extract_all(html, '(?i)\\ssrc=\"([^\"]*)\"', 1)) AS INTEGER) AS sources FROM pages")
def script_discovery(t):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), 0))
    return t("pages").select("page_id", n("(?i)<script[^>]*>").alias("scripts"), n('(?i)\\ssrc="([^"]*)"').alias("sources"))


@_query("SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 0 AND 62 THEN CAST(1 AS BIGINT) << n_nationkey END AS meaning, '2.3000.' || n_nationkey AS version FROM nation")
def bit_meanings(t):
    return t("nation").select("n_nationkey", scalars.bit_meaning(F.col("n_nationkey")).alias("meaning"), scalars.version_name(F.col("n_nationkey")).alias("version"))
