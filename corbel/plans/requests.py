"""Requests and what they inherit: merges between modules, envelopes over their closure, and the responses that belong to them.

A request's module merges fragments of other modules into its stanza, and those
merge further ones. The closure over merges says which fragments a request
reaches; the envelope takes from them what they agree on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, dedup, lookup, sets
from ..sources import js
from . import extract
from .catalog import ORDER, first_copies

#: Parts of response names that say that an outcome is an error.
ERROR_PARTS = (
    "Error", "InvalidRequest", "Nack", "Conflict", "Forbidden", "TooManyAttempts", "IncorrectNonce", "RecoveryRequired", "AlreadyExists", "Negative", "BadStanza", "NotAuthorized", "NotAcceptable", "NotExist", "ResourceLimit",
)


def server_request(name: Column) -> Column:
    """Whether a module's name is that of a request that a server begins."""
    return (name.startswith("WASmax") & name.endswith("RPC")) | (name.startswith("WASmaxIn") & name.endswith("Request") & ~name.contains("Response") & ~name.contains("Mixin"))


def acknowledgement(name: Column) -> Column:
    """Whether a module's name is that of a response that may acknowledge a stanza."""
    return (name.startswith("WASmax") & name.endswith("RPC")) | (name.startswith("WASmaxIn") & name.rlike("Response(?:Success|Negative)$") & ~name.contains("Mixin"))


def response_operation(name: Column) -> Column:
    """The operation that a response module answers: WASmaxIn<operation>Response<variant>; empty for other names."""
    return F.regexp_extract(name, "^WASmaxIn(.+?)Response", 1)


def request_operation(name: Column) -> Column:
    return F.regexp_extract(name, "^WASmaxOut(.+)Request$", 1)


def variant_kind(tag: Column, asserted_type: Column) -> Column:
    """error, alternative or success: the type that a response asserts comes before the parts of its name."""
    named = F.when(tag.rlike("|".join(ERROR_PARTS)), "error").otherwise("success")
    return F.when(asserted_type == "error", "error").when(asserted_type == "result", F.when(named == "error", "alternative").otherwise("success")).otherwise(named)


def fragment_exports(names: Column) -> Column:
    """Whether a module's exports are those of a fragment: one that merges a mixin, beside constants and a default."""
    real = F.filter(names, lambda x: (x != "default") & ~x.rlike("^[A-Z][A-Z0-9_]*$"))
    return F.exists(real, lambda x: x.startswith("merge") & x.contains("Mixin"))


def read_exports(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(export): the names that a module assigns to its exports object."""
    yield from ((x,) for x in dict.fromkeys(prop for _, prop, value in js.Reader(src).assigned() if value.kind in ("name", "function", "call")))


def exports(modules: DataFrame) -> DataFrame:
    return extract.facts(modules, F.lit(True), read_exports, "export string")


def root_exports(found: DataFrame) -> DataFrame:
    """Exports without those that continue another export of the module with a capital."""
    return lookup.root_names(found, ["module"], "export", "[A-Z]")


def read_merges(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(callee, function): merges of other modules' mixins."""
    seen = set()
    for call in js.Reader(src).calls():
        n = js.method(call)
        if n and n.startswith("merge") and "Mixin" in n and (m := js.required(call.args[0].args[0])) and (m, n) not in seen:
            seen.add((m, n))
            yield m, n


def merges(modules: DataFrame) -> DataFrame:
    return extract.facts(modules, F.col("slice").contains("merge"), read_merges, "callee string, function string")


def read_repeats(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(low, high, open_end): bounds of repeated children. Both are stated, or a low one with an infinite end; else neither."""

    def infinite(node) -> bool:
        if node is None:
            return False
        if node.kind == "binary" and node.args[0] == "/":
            return js.as_number(node.args[1]) == 1 and js.as_number(node.args[2]) == 0
        return js.as_name(node) == "Infinity"

    for call in js.Reader(src).calls():
        args = call.args[1]
        if js.method(call) != "REPEATED_CHILD" or len(args) < 4:
            continue
        low, high = js.as_int(args[2]), js.as_int(args[3])
        if low is not None and low >= 0 and ((high is not None and high >= 0) or infinite(args[3])):
            yield low, high, high is None
        else:
            yield None, None, False


def repeats(modules: DataFrame) -> DataFrame:
    return extract.facts(modules, F.col("slice").contains("REPEATED_CHILD"), read_repeats, "low long, high long, open_end boolean")


def fragments(built: DataFrame) -> DataFrame:
    """(module, xmlns, type, target): what each module's own stanza roots say; `target` is the kind of the addressee, or its literal."""
    root = built.filter(~F.col("path").contains("/") & (F.col("tag") == "iq"))
    pick = lambda attr: F.min(F.when((F.col("attr") == attr) & (F.col("kind") == "const"), F.col("literal")))
    target = F.min(F.when(F.col("attr") == "to", F.coalesce("literal", "kind")))
    return root.groupBy("module").agg(pick("xmlns").alias("xmlns"), pick("type").alias("type"), target.alias("target"))


def envelopes(modules: DataFrame) -> DataFrame:
    """(module, xmlns, type, target, reached): for each module that builds a request, the attributes that its own fragment and all that it merges agree on.

    Different namespaces or types leave none; different addressees are Unknown.
    """
    first = first_copies(modules)
    own = fragments(extract.builders(first))
    edges = merges(first).select("module", "callee").distinct()
    reach = sets.closure(edges, "module", "callee").filter("module <> callee")
    start = own.select("module").union(edges.select("module")).distinct()
    every = start.select("module", F.col("module").alias("callee")).union(reach)
    facts = every.join(own.withColumnRenamed("module", "callee"), "callee", "left").withColumn("path", F.lit(None).cast("string"))
    merged = aggregate.conflict_merge(facts, ["module"], ["xmlns", "type"], "target", "path")
    n = reach.groupBy("module").agg(F.count("*").alias("reached"))
    return merged.join(n, "module", "left").select("module", "xmlns", "type", "target", F.coalesce("reached", F.lit(0)).alias("reached"))


def responses_of_requests(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request, response): requests(module) with the response modules (name) of their operation."""
    a = requests.select(F.col("module").alias("request"), request_operation(F.col("module")).alias("_op")).filter("_op <> ''")
    b = names.select(F.col("name").alias("response"), response_operation(F.col("name")).alias("_op")).filter("_op <> ''").distinct()
    return a.join(b, "_op").select("request", "response")


def stanza_definitions(modules: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(module, tag, attrs): built stanzas other than requests, of the first copy that builds any; a definition that equals an earlier one goes, and one without attributes and children too."""
    built = extract.builders(modules)
    win = dedup.first_wins(built.select(*ORDER, "module").distinct(), ["module"], ORDER)
    rows = built.join(win, [*ORDER, "module"], "left_semi").withColumn("root", F.split_part("path", F.lit("/"), F.lit(1)))
    body = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.concat_ws(".", "path", "tag", "attr"), F.concat_ws(":", "kind", "literal")))), ",")
    per = rows.groupBy(*ORDER, "module", "root").agg(F.min_by("tag", "path").alias("tag"), body.alias("attrs"), F.count("attr").alias("_n"), F.count_distinct("path").alias("_nodes"))
    kept = per.filter(F.col("tag").isin(*tags) & ((F.col("_n") > 0) | (F.col("_nodes") > 1)))
    order = [dedup.ordinal(F.col("tag"), tags), "module", *ORDER, "root"]
    return dedup.first_wins(kept, ["tag", "module", "attrs"], order).select("module", "tag", "attrs")
