"""Catalogs from facts: which copy wins, what refers to what, and what is left open.

All plans are DataFrames over the table of modules; `documents` writes them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..operators import aggregate, checks, contracts, dedup, lookup
from . import extract

ORDER = ["bundle_ord", "module_ord"]


def first_copies(modules: DataFrame) -> DataFrame:
    """The first definition of each module name."""
    return dedup.first_wins(modules, ["name"], ORDER)


def tokens(modules: DataFrame) -> DataFrame:
    """(dictionary, position, token, version) of the first module that reads as a token table."""
    got = extract.tokens(modules)
    first = got.agg(F.min(F.struct(*ORDER)).alias("f")).select("f.*")
    return got.join(F.broadcast(first), ORDER).select("dictionary", "position", "token", "version")  # one row


def binaries(modules: DataFrame) -> DataFrame:
    """(name, modules): binary files and the modules that name them."""
    return aggregate.members(extract.binaries(modules).filter("kind = 'binary'"), ["value"], "module", "modules").withColumnRenamed("value", "name")


def resources(modules: DataFrame) -> DataFrame:
    """(handle, consumers, hints): handles with their consumers and the evidence that they are binaries."""
    got = extract.binaries(modules).filter("kind = 'handle'")
    hints = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hints")))), ",")
    return got.groupBy(F.col("value").alias("handle")).agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("consumers"), hints.alias("hints"))


def resource_addresses(prior: DataFrame, found: DataFrame) -> DataFrame:
    """(handle, url): addresses of handles, a new one replacing the prior one; none is forgotten."""
    n = found.select(F.col("handle").alias("_h"), F.col("url").alias("_u"))
    both = prior.join(n, prior["handle"] == n["_h"], "full_outer")
    return both.select(F.coalesce("_h", "handle").alias("handle"), F.coalesce("_u", "url").alias("url"))


def flags(modules: DataFrame) -> DataFrame:
    """(module, name, code, type, default_json, other_json): of each flag module's first copy, the object with the most flags (the first among equals), each name once."""
    copies = modules.filter(F.col("name").endswith(extract.FLAG_MODULES))
    got = extract.flags(first_copies(copies))
    best = got.groupBy("module", "object").agg(F.count("*").alias("n"))
    best = dedup.largest(best, ["module"], "n", ["object"]).select(F.col("module").alias("_m"), F.col("object").alias("_o"))
    kept = got.join(best, (F.col("module") == F.col("_m")) & (F.col("object") == F.col("_o")))
    return dedup.first_wins(kept, ["module", "name"], ["pos"]).select("module", "name", "code", "type", "default_json", "other_json")


def enums(modules: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """(module, name, kind, variants, bit_position): every copy is read, the first of each (module, name) wins; integer enums that sources shift by are bit positions."""
    got = extract.enums(modules)
    per = got.groupBy(*ORDER, "module", "name", "kind").agg(F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "ord", "member", "value"))), lambda x: F.struct(x["member"].alias("name"), x["value"].alias("value"))).alias("variants"))
    first = dedup.first_wins(per, ["module", "name"], [*ORDER, "pos"]).select("module", "name", "kind", "variants")
    if bundles is None:
        return first.withColumn("bit_position", F.lit(False))
    used = extract.shifts(bundles.select(F.col("content").cast("string").alias("text")), "text")
    member = first.select("module", "name", F.explode("variants").alias("v")).select("module", "name", F.col("v.name").alias("member"))
    hit = member.join(used, ["module", "name", "member"], "left_semi").select("module", "name").distinct().withColumn("_bit", F.lit(True))
    return first.join(hit, ["module", "name"], "left").withColumn("bit_position", (F.col("kind") == "int") & F.coalesce("_bit", F.lit(False))).drop("_bit")


def promoted_enums(catalog: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog with the enums that only references carry, references of one name with different variants): refs(module, name, kind, variants)."""
    body = F.to_json("variants")
    per = refs.groupBy("module", "name").agg(F.count_distinct(body).alias("_n"), F.min(F.struct(body.alias("b"), F.struct("kind", "variants").alias("x"))).alias("_x"))
    new = per.filter("_n = 1").join(catalog, ["module", "name"], "left_anti").select("module", "name", "_x.x.kind", "_x.x.variants", F.lit(False).alias("bit_position"))
    return catalog.unionByName(new), per.filter("_n > 1").select("module", "name", F.col("_n").alias("versions"))


def events(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, fields): events(module, event, export, code, channel, ps_id, weights, consumers), the first of each (code, name); fields(module, event, code, field, field_id, field_type, enum_module)."""
    got = extract.events(modules)
    heads = got.groupBy(*ORDER, "module", "event", "export", "code", "channel", "ps_id", "weights").agg(F.min("pos").alias("pos"))
    heads = dedup.first_wins(heads, ["code", "event"], [*ORDER, "pos"])
    used = modules.select("name", F.explode("deps").alias("dep")).filter(F.col("dep").endswith("WamEvent"))
    by = lookup.dependents(used, "name", "dep").withColumnRenamed("module", "_m")
    fields = got.join(heads.select(*ORDER, "module", "event", "code"), [*ORDER, "module", "event", "code"], "left_semi").filter("field IS NOT NULL")
    out = heads.join(by, heads["module"] == by["_m"], "left").select("module", "event", "export", "code", "channel", "ps_id", "weights", F.coalesce("consumers", F.lit("")).alias("consumers"))
    return out, fields.select("module", "event", "code", "field", "field_id", "field_type", "enum_module")


def call_sites(modules: DataFrame, event_heads: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sites, writes): constructions with the event they make and how it was found; their written fields with the state of each and a value where all writes agree."""
    got = extract.sites(modules)
    # One construction per place of a module: further copies of the module repeat it.
    heads = got.groupBy("module", "event_module", "start").agg(F.min(F.struct(*ORDER, "export")).alias("x")).select("module", "event_module", "start", "x.export")
    named = event_heads.select(F.col("module").alias("event_module"), "export", "event")
    placed = lookup.site_to_event(heads, named, "event_module", "export", "event")
    first = got.join(got.groupBy("module", "event_module", "start").agg(F.min(F.struct(*ORDER)).alias("_f")), ["module", "event_module", "start"]).filter(F.struct(*ORDER) == F.col("_f")).filter("field IS NOT NULL")
    per = aggregate.value_if_all_equal(first, ["module", "event_module", "start", "field"], "value", F.col("write") == "constructor")
    owned = per.join(placed.select("module", "event_module", "start", "event"), ["module", "event_module", "start"])
    known = fields.select("event", "field")
    writes = lookup.written_keys(owned, known, "event", "field", "weight")
    partial = writes.filter("state = 'dropped'").select("module", "event_module", "start").distinct().withColumn("_partial", F.lit(True))
    sites = placed.join(partial, ["module", "event_module", "start"], "left").withColumn("partial", F.coalesce("_partial", F.lit(False))).drop("_partial")
    return sites, writes


def unmatched_sites(sites: DataFrame) -> DataFrame:
    """Gaps: constructions that no event was found for, by module."""
    return sites.filter("how = 'unmatched'").groupBy("module").agg(F.count("*").alias("n"))


#: Prefixes and endings of operation names, and parts of names of other products.
PREFIXES, ENDINGS = ("WAWebMex", "WAWeb"), (("JobMutation", "JobQuery"), ("Mutation", "Query"))
NOISE = (
    "bizad", "bizai", "bizcatalog", "bizpay", "bizbroadcast", "comet", "lwi", "mwchat", "mmlite", "bizmeta", "bizcommerce", "bizaccount", "bizdeli", "bizmass", "bizmcomm", "bizmessagetemplate",
    "bizorder", "bizplatform", "bizpostpaid", "bizsendoptin", "bizsetting", "bizshipping", "bizquickreplies", "bizlabel", "bizaway", "bizgreeting", "bizonboarding", "bizgroup", "bizhub", "bizinstall",
    "bizinterop", "bizlogin", "bizpnh", "bizqrcode", "bizquote", "bizrecurring", "bizrequest", "bizsubscribed", "bizupsell", "bizverify", "bizwa", "bizwam", "bizwelcome", "bizyou",
    "metaai", "metatransp", "saved", "telemetry", "subscribe", "galaxy", "hatch", "linkedaccounts", "provisioning", "rtcring", "xplatgen", "wallet", "transaction", "boost",
)


def operation_name(name):
    """An operation's name without its prefixes and endings, each group at most once."""
    out = name
    for p in PREFIXES:
        out = F.regexp_replace(out, f"^{p}", "")
    for group in ENDINGS:
        out = F.regexp_replace(out, f"(?:{'|'.join(group)})$", "")
    return out


def operations(modules: DataFrame) -> DataFrame:
    """(name, original_name, operation_kind, doc_id, doc_id_origin, variables, callers): the first copy of each operation; a name that is taken gets its kind, a second such one is dropped."""
    first = first_copies(modules.filter(F.col("name").endswith(".graphql")))
    got = extract.operations(first)
    ids = extract.exported_ids(first_copies(modules.filter(F.col("name").endswith(extract.ID_MODULES)))).select(F.col("module").alias("_m"), F.col("value").alias("_id"))
    low = F.lower("original_name")
    kept = got.filter(F.col("operation_kind").isNotNull() & ~F.coalesce(*[F.when(low.contains(n), True) for n in NOISE], F.lit(False)))
    kept = kept.join(ids, kept["doc_id_ref"] == ids["_m"], "left")
    kept = lookup.coalesced_with_origin(kept.withColumnRenamed("doc_id", "_inline"), [("inline", F.col("_inline")), ("sibling", F.col("_id")), ("name", F.col("original_name"))], "doc_id")
    kept = kept.withColumns({"key": operation_name(F.col("original_name")), "_kind": F.initcap("operation_kind")})
    named = dedup.renamed_on_collision(kept, "key", "_kind", ["original_name", "module"])
    callers = lookup.dependents(first_copies(modules).select("name", F.explode("deps").alias("dep")).filter(F.col("dep").endswith(".graphql")), "name", "dep").withColumnRenamed("module", "_c")
    out = named.join(callers, named["module"] == callers["_c"], "left")
    return out.select("name", "original_name", "operation_kind", "doc_id", "doc_id_origin", F.array_join("variables", ",").alias("variables"), F.coalesce("consumers", F.lit("")).alias("callers"))


def messages(modules: DataFrame) -> DataFrame:
    """(message, ord, field, number, label, type, ref_name, packed, oneof): of equal names the first in canonical order."""
    got = extract.messages(modules)
    body = F.to_json(F.array_sort(F.collect_list(F.struct("ord", "field", "number", "label", "type", "ref_name", "packed", "oneof"))))
    whole = got.groupBy(*ORDER, "module", "message").agg(body.alias("body"))
    win = dedup.first_wins(whole, ["message"], ["body", *ORDER]).select(*ORDER, "module", "message")
    return got.join(win, [*ORDER, "module", "message"], "left_semi").select("message", "ord", "field", "number", "label", "type", "ref_name", "packed", "oneof")


def message_errors(fields: DataFrame) -> list[DataFrame]:
    """Numbers or names used twice in a message, and types that no message has."""
    real = fields.filter("label <> 'enum'")
    return [checks.duplicate_keys(real, "field number", ["message", "number"]), checks.duplicate_keys(real, "field name", ["message", "field"]), checks.fk_violations(real, "field type", ["message", "field"], ["ref_name"], fields.select(F.col("message").alias("ref_name")), ["ref_name"])]


def proto_text(fields: DataFrame) -> DataFrame:
    """(message, text): each message or enum in the text format, ready to be ordered by name and joined by blank lines."""
    line = F.when(F.col("label") == "enum", F.concat_ws("", F.lit("  "), "field", F.lit(" = "), F.col("number").cast("string"), F.lit(";"))).otherwise(
        F.concat(F.lit("  "), F.when(F.col("oneof").isNotNull(), "  ").otherwise(F.concat("label", F.lit(" "))), F.coalesce("ref_name", "type"), F.lit(" "), "field", F.lit(" = "), F.col("number").cast("string"), F.when(F.col("packed"), " [packed = true]").otherwise(""), F.lit(";"))
    )
    rows = fields.withColumn("_line", line).withColumn("_oneof", F.coalesce("oneof", F.lit("")))
    parts = rows.groupBy("message", "_oneof").agg(F.min("ord").alias("_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_line"))), lambda x: x["_line"]), "\n").alias("_t"), F.min("label").alias("_k"))
    block = F.when(F.col("_oneof") == "", F.col("_t")).otherwise(F.concat(F.lit("  oneof "), "_oneof", F.lit(" {\n"), "_t", F.lit("\n  }")))
    whole = parts.groupBy("message").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("_oneof") != "").alias("last"), F.col("_at"), block.alias("b")))), lambda x: x["b"]), "\n").alias("_b"), F.min("_k").alias("_k"))
    kind = F.when(F.col("_k") == "enum", "enum").otherwise("message")
    return whole.select("message", F.concat(kind, F.lit(" "), "message", F.lit(" {\n"), "_b", F.lit("\n}")).alias("text"))


def stanzas(modules: DataFrame) -> DataFrame:
    """(module, path, tag, attr, kind, literal) of builders, of the first copy of each module that builds any."""
    got = extract.builders(modules)
    win = dedup.first_wins(got.select(*ORDER, "module").distinct(), ["module"], ORDER)
    return got.join(win, [*ORDER, "module"], "left_semi").select("module", "path", "tag", "attr", "kind", "literal")


def handlers(modules: DataFrame) -> DataFrame:
    """(case, handler_module, handler_name, sole): the first known handler of each case in order of module names, and whether its module serves one case only."""
    got = extract.cases(modules)
    first = aggregate.first_known(got, ["case"], ["handler_module", "handler_name"], ["module", *ORDER, "pos"])
    n = first.groupBy("handler_module").agg(F.count("*").alias("_n")).withColumnRenamed("handler_module", "_h")
    return first.join(n, first["handler_module"] == n["_h"], "left").select("case", "handler_module", "handler_name", (F.coalesce("_n", F.lit(0)) == 1).alias("sole"))


def read_fields(modules: DataFrame) -> DataFrame:
    """(module, accessor, argument, kind, type, optional, policy): what incoming readers read, classified."""
    got = extract.accessors(first_copies(modules))
    n = F.col("accessor")
    return got.select("module", n, "argument", scalars.accessor_kind(n).alias("kind"), scalars.accessor_type(n).alias("type"), scalars.accessor_optional(n).alias("optional"), scalars.unknown_policy(n).alias("policy")).distinct()


def json_document(df: DataFrame, order: list[str], name: str, version: str) -> DataFrame:
    """One row: a catalog as one JSON document, its records in a total order, nulls left out."""
    records = F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))
    return df.agg(F.to_json(F.struct(F.lit(version).alias("version"), records.alias(name))).alias("document"))


def write_documents(spark: SparkSession, path: str, version: str, catalogs: Mapping[str, tuple[DataFrame, list[str]]], diagnostics: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Writes each catalog under path/<name> and returns the manifest (name, records, sha256, file, schema, diagnostics); nothing is written if a catalog is empty.

    `diagnostics` are counts (key, value) of a catalog: what it has, and what was dropped and why.
    """
    docs = {n: json_document(df, order, n, version).persist() for n, (df, order) in catalogs.items()}
    counts = None
    for n, d in docs.items():
        size = F.size(F.from_json("document", f"version string, {n} array<string>")[n])
        one = d.select(F.lit(n).alias("key"), size.cast("long").alias("value"), F.sha2("document", 256).alias("sha256"))
        counts = one if counts is None else counts.unionByName(one)
    counts = counts.persist()
    checks.admit(spark, [checks.zero_counts(counts)])
    for n, d in docs.items():
        d.coalesce(1).write.mode("overwrite").text(f"{path}/{n}")
    told = spark.createDataFrame([], "_n string, diagnostics map<string, bigint>")
    for n, d in (diagnostics or {}).items():
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("value").cast("long")))))
        told = told.unionByName(d.agg(entries.alias("diagnostics")).select(F.lit(n).alias("_n"), "diagnostics"))
    schemas = schema_documents({n: df for n, (df, _) in catalogs.items()})
    named = F.create_map(*[x for n, doc in schemas.items() for x in (F.lit(n), F.sha2(F.lit(doc), 256))])
    manifest = counts.select(F.col("key").alias("name"), F.col("value").alias("records"), "sha256", F.col("key").alias("file"), named[F.col("key")].alias("schema"))
    manifest = manifest.join(told, F.col("name") == F.col("_n"), "left").drop("_n")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def _json_schema(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: _json_schema(f.dataType) for f in kind}, "required": [f.name for f in kind if not f.nullable], "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": _json_schema(kind.valueType)}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.IntegralType):
        return {"type": "integer"}
    return {"type": "number"} if isinstance(kind, T.NumericType) else {"type": "string"}


def schema_documents(catalogs: Mapping[str, DataFrame]) -> dict[str, str]:
    """The JSON Schema of each catalog's records; nulls are left out of documents, so what may be null isn't required."""
    head = {"$schema": "https://json-schema.org/draft/2020-12/schema"}
    return {n: json.dumps(head | {"title": n} | _json_schema(df.schema), indent=2, sort_keys=True) for n, df in catalogs.items()}


def diff_report(changes: DataFrame, group: str, name: str, side: str = "side", most: int = 40) -> DataFrame:
    """(ord, line): names that were added (+) and removed (-), by group, the first `most` of each, and how many more there are."""
    keys = [group, side]
    top, left = contracts.capped_fan_out(changes.select(*keys, name), keys, [name], most)
    mark = F.when(F.col(side) == "added", "+ ").otherwise("- ")
    lines = top.select(*keys, F.lit(0).alias("_last"), F.col(name).cast("string").alias("_x"), F.concat(mark, F.col(name).cast("string")).alias("line"))
    more = left.select(*keys, F.lit(1).alias("_last"), F.lit("").alias("_x"), F.concat(mark, F.lit("and "), F.col("n_left").cast("string"), F.lit(" more")).alias("line"))
    heads = changes.select(group).distinct().select(group, F.lit(None).cast("string").alias(side), F.lit(-1).alias("_last"), F.lit("").alias("_x"), F.concat(F.col(group).cast("string"), F.lit(":")).alias("line"))
    every = lines.unionByName(more).unionByName(heads)
    order = F.row_number().over(Window.orderBy(group, F.col(side).asc_nulls_first(), "_last", "_x"))  # a bounded number of lines a group
    return every.select(order.alias("ord"), "line")
