"""Data-quality rules as queries: each returns rows (rule, key, message), none where all is well.

`failing` runs any number of them in one job and reports all that fail.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(df: DataFrame, rule: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), message.cast("string").alias("message"))


def _key(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def row_rule(df: DataFrame, rule: str, key: Sequence[str], bad: Column, message: str) -> DataFrame:
    """Rows of which the predicate holds."""
    return _rows(df.filter(F.coalesce(bad, F.lit(False))), rule, _key(key), F.lit(message))


def fk_violations(df: DataFrame, rule: str, key: Sequence[str], ref: Sequence[str], catalog: DataFrame, catalog_key: Sequence[str]) -> DataFrame:
    """Rows whose reference is not null and doesn't resolve."""
    c = catalog.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(catalog_key)]).distinct()
    want = df.filter(F.coalesce(*[F.col(r).cast("string") for r in ref]).isNotNull())
    return _rows(want.join(c, [want[r] == c[f"_c{i}"] for i, r in enumerate(ref)], "left_anti"), rule, _key(key), F.concat(F.lit("unresolved: "), _key(ref)))


def duplicate_keys(df: DataFrame, rule: str, key: Sequence[str]) -> DataFrame:
    got = df.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
    return _rows(got, rule, _key(key), F.concat(F.col("_n").cast("string"), F.lit(" rows")))


def disagreeing_copies(df: DataFrame, rule: str, key: Sequence[str], parts: Sequence[str]) -> DataFrame:
    body = F.to_json(F.struct(*parts))
    got = df.groupBy(*key).agg(F.count_distinct(F.md5(body)).alias("_n")).filter("_n > 1")
    return _rows(got, rule, _key(key), F.concat(F.col("_n").cast("string"), F.lit(" versions")))


def shared_keys(named: Mapping[str, DataFrame], rule: str, key: Sequence[str]) -> DataFrame:
    """Keys that more than one of the tables has."""
    every = None
    for name, df in named.items():
        part = df.select(*key).distinct().withColumn("_table", F.lit(name))
        every = part if every is None else every.unionByName(part)
    got = every.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("_table")), ",").alias("_t"), F.count("*").alias("_n")).filter("_n > 1")
    return _rows(got, rule, _key(key), F.concat(F.lit("in "), F.col("_t")))


def unequal_keys(left: DataFrame, right: DataFrame, rule: str, key: Sequence[str]) -> DataFrame:
    """Keys that only one side has."""
    from .sets import set_difference

    return _rows(set_difference(left, right, key), rule, _key(key), F.col("side"))


def collides_after(df: DataFrame, rule: str, name: str, derived: Column) -> DataFrame:
    """Different names that become one."""
    got = df.select(name, derived.alias("_d")).distinct().groupBy("_d").agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("_names"), F.count("*").alias("_n")).filter("_n > 1")
    return _rows(got, rule, F.col("_d"), F.col("_names"))


def floor_guard(prior: DataFrame, new: DataFrame, rule: str = "floor") -> DataFrame:
    """Metrics (key, value, direction) that got worse: "up" ones must not fall, "down" ones must not rise; one that is gone fails."""
    n = new.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    both = prior.join(n, prior["key"] == n["_k"], "left")
    bad = F.col("_v").isNull() | F.when(F.col("direction") == "down", F.col("_v") > F.col("value")).otherwise(F.col("_v") < F.col("value"))
    return _rows(both.filter(bad), rule, F.col("key"), F.concat_ws(" -> ", F.col("value").cast("string"), F.coalesce(F.col("_v").cast("string"), F.lit("none"))))


def exact_ratchet(counts: DataFrame, pinned: DataFrame, rule: str = "ratchet") -> DataFrame:
    """Counts (key, value) that differ from the pinned ones, in either direction, or that only one side has."""
    p = pinned.select(F.col("key").alias("_k"), F.col("value").alias("_p"))
    both = counts.join(p, counts["key"] == p["_k"], "full_outer").filter(~F.col("value").eqNullSafe(F.col("_p")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return _rows(both, rule, F.coalesce("key", "_k"), F.concat(text("value"), F.lit(", pinned "), text("_p")))


def zero_counts(counts: DataFrame, rule: str = "empty") -> DataFrame:
    return _rows(counts.filter(F.coalesce("value", F.lit(0)) == 0), rule, F.col("key"), F.lit("no rows"))


def negative_gaps(left: DataFrame, key: str, value: str, rule: str = "gaps") -> DataFrame:
    """Keys of which more gaps were located than counted."""
    return _rows(left.filter(F.col(value) < 0), rule, F.col(key), F.col(value))


def incomplete(requested: DataFrame, obtained: DataFrame, key: str, rule: str = "complete") -> DataFrame:
    """What was asked for and isn't there."""
    return _rows(requested.join(obtained.select(key).distinct(), key, "left_anti"), rule, F.col(key), F.lit("missing"))


def artifact_states(built: DataFrame, stored: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, state): equal, differs or missing, for each built artifact."""
    s = stored.select(F.col(path).alias("_p"), F.col(digest).alias("_d"))
    both = built.join(s, built[path] == s["_p"], "left")
    return both.select(path, F.when(F.col("_p").isNull(), "missing").when(F.col(digest).eqNullSafe(F.col("_d")), "equal").otherwise("differs").alias("state"))


def failing(spark: SparkSession, rules: Sequence[DataFrame]) -> DataFrame:
    """The rows of all rules; all are evaluated before any fails."""
    out = spark.createDataFrame([], "rule string, key string, message string")
    for r in rules:
        out = out.unionByName(r)
    return out


def admit(spark: SparkSession, rules: Sequence[DataFrame], shown: int = 20) -> None:
    """Raises with the number of violations of each rule and the first of them, if there are any."""
    bad = failing(spark, rules)
    counts = bad.groupBy("rule").count().orderBy("rule").collect()  # a row for each rule
    if counts:
        first = bad.orderBy("rule", "key", "message").limit(shown).collect()
        raise ValueError("; ".join(f"{r['rule']}: {r['count']}" for r in counts) + "\n" + "\n".join(f"{r.rule} {r.key}: {r.message}" for r in first))


# Rules of the catalogs. Each takes the table that it names, with the columns that it uses.


def field_rules(fields: DataFrame) -> list[DataFrame]:
    """fields(owner, path, type, int_min, int_max, byte_min, byte_max, byte_length, literal, enum_ref, unknown_policy, variants array<string>)."""
    key = ["owner", "path"]
    has = lambda c: F.col(c).isNotNull()
    return [
        row_rule(fields, "half range", key, has("int_min") != has("int_max"), "one end of an integer range"),
        row_rule(fields, "half byte range", key, has("byte_min") != has("byte_max"), "one end of a byte range"),
        row_rule(fields, "range order", key, (F.col("int_min") > F.col("int_max")) | (F.col("byte_min") > F.col("byte_max")), "low end above high end"),
        row_rule(fields, "range type", key, has("int_min") & ~F.col("type").isin("integer", "timestamp"), "integer range on another type"),
        row_rule(fields, "byte range type", key, has("byte_min") & ~F.col("type").isin("bytes", "string"), "byte range on another type"),
        row_rule(fields, "byte length", key, (F.col("byte_length") < F.col("byte_min")) | (F.col("byte_length") > F.col("byte_max")), "length outside its range"),
        row_rule(fields, "literal and reference", key, has("literal") & has("enum_ref"), "both a literal and a reference"),
        row_rule(fields, "unknown policy", key, has("unknown_policy") != F.coalesce(F.col("type") == "enum", F.lit(False)), "a policy goes with an enum, and an enum with a policy"),
        row_rule(fields, "union arms", key, (F.col("type") == "union") & ((F.coalesce(F.size("variants"), F.lit(0)) < 2) | (F.size(F.array_distinct("variants")) != F.size("variants"))), "two arms at least, of different names"),
    ]


#: Accessors that give bytes of a known number, types that accessors may give, and what may happen to values outside an enum.
WIDTH_ACCESSORS = ("contentUint", "contentBytes", "contentBytesRange", "contentLiteralBytes")
POLICIES = ("null", "reject", "unclassified")


def content_rules(fields: DataFrame) -> list[DataFrame]:
    """fields(owner, path, type, method, n_children, literal, byte_length, byte_length_source, const_value, value_source, reference_path, unknown_policy, unions array<string>): what a field says of itself holds together."""
    key, has = ["owner", "path"], lambda c: F.col(c).isNotNull()
    from ..functions.scalars import accessor_type, pascal_case

    hex_ = F.col("literal").rlike("^(?:[0-9a-f]{2})*$")
    scalar = F.col("method").isNull() & (F.coalesce("n_children", F.lit(0)) > 0) & (F.col("type") != "node")
    node = (F.col("type") == "node") & (has("method") | (F.coalesce("n_children", F.lit(0)) < 1))
    named = F.filter("unions", lambda n: n != "")
    kinds = F.transform(named, lambda n: pascal_case(n))
    known = accessor_type(F.col("method"))
    return [
        row_rule(fields, "integer literal", key, (F.col("type") == "integer") & ~F.col("literal").rlike("^-?(?:0|[1-9][0-9]*)$"), "not a decimal integer"),
        row_rule(fields, "bytes literal", key, (F.col("type") == "bytes") & ~hex_, "not lower-case hex bytes"),
        row_rule(fields, "bytes literal length", key, (F.col("type") == "bytes") & hex_ & (F.length("literal") != 2 * F.col("byte_length")), "length differs from the field's"),
        row_rule(fields, "literal and reference", key, has("literal") & (F.coalesce("reference_path", F.lit("")) != ""), "fixed to a value and to the request"),
        row_rule(fields, "reference path", key, F.col("reference_path") == "", "an empty path"),
        row_rule(fields, "accessor type", key, has("method") & (known != "string") & (F.col("type") != known), "a type that its accessor doesn't give"),
        row_rule(fields, "byte width", key, has("byte_length") & has("method") & ~F.col("method").isin(*WIDTH_ACCESSORS), "a width on an accessor without one"),
        row_rule(fields, "width source", key, has("byte_length_source") & F.col("byte_length").isNull(), "a source without the value"),
        row_rule(fields, "value source", key, has("value_source") & F.col("const_value").isNull(), "a source without the value"),
        row_rule(fields, "container", key, scalar, "children under a scalar type"),
        row_rule(fields, "node", key, node, "a node reads nothing itself and has children"),
        row_rule(fields, "policy", key, has("unknown_policy") & ~F.col("unknown_policy").isin(*POLICIES), "not a known policy"),
        row_rule(fields, "union name", key, F.size(named) < F.size("unions"), "an alternative without a name"),
        row_rule(fields, "union names", key, F.size(F.array_distinct(kinds)) < F.size(kinds), "alternatives that become one"),
    ]


def member_rules(members: DataFrame, refs: DataFrame) -> list[DataFrame]:
    """members(module, name, value_kind, member, value), refs(owner, module): members have the kind of their enum and, of integers, a value each; a reference by module finds one definition, with members."""
    key = ["module", "name"]
    number = F.col("value").rlike("^-?[0-9]+$")
    per = members.filter("value_kind = 'int'").select(*key, "member", "value").distinct()
    defs = members.groupBy("module").agg(F.count_distinct("name").alias("_n"), F.count("member").alias("_m"))
    both = refs.join(defs, "module")
    return [
        row_rule(members, "member kind", [*key, "member"], (F.col("value_kind") == "int") & ~F.coalesce(number, F.lit(False)), "a value of another kind"),
        duplicate_keys(members, "member twice", [*key, "member"]),
        duplicate_keys(per, "member value", [*key, "value"]),
        fk_violations(refs, "enum module", ["owner"], ["module"], defs, ["module"]),
        row_rule(both, "enum module", ["owner"], F.col("_n") > 1, "several definitions"),
        row_rule(both, "enum module", ["owner"], F.col("_m") < 1, "no members"),
    ]


def action_index_rules(actions: DataFrame, collections: DataFrame, fields: DataFrame, proto_enums: DataFrame) -> list[DataFrame]:
    """actions(name, scope, collection, value_field, value_type, chat_jid_index, index_kinds array<string>, first_part, enum_paths array<string>), collections(name), fields(field, type), proto_enums(path)."""
    from ..functions.scalars import pascal_case

    last = lambda c: F.element_at(F.split(c, "[.]"), -1)
    at = F.coalesce("chat_jid_index", F.lit(0)).cast("int")
    inside = F.col("chat_jid_index").between(0, F.size("index_kinds") - 1)
    f = fields.select(F.col("field").alias("value_field"), F.col("type").alias("_type"))
    typed = actions.filter("value_field IS NOT NULL AND value_type IS NOT NULL")
    paths = actions.select("name", F.explode("enum_paths").alias("path"))
    return [
        duplicate_keys(collections, "collection twice", ["name"]),
        collides_after(collections.distinct(), "collection names", "name", pascal_case(F.col("name"))),
        collides_after(actions.select("scope").distinct(), "scope names", "scope", pascal_case(F.col("scope"))),
        fk_violations(actions.withColumn("collection", F.coalesce("collection", F.lit("regular"))), "action collection", ["name"], ["collection"], collections, ["name"]),
        fk_violations(typed, "action value field", ["name"], ["value_field"], f, ["value_field"]),
        row_rule(typed.join(f, "value_field"), "action value type", ["name"], last("_type") != last("value_type"), "declared with another type"),
        fk_violations(paths, "action enum", ["name"], ["path"], proto_enums, ["path"]),
        row_rule(actions, "chat index", ["name"], F.col("chat_jid_index").isNotNull() & ~inside, "not a position of the index"),
        row_rule(actions, "chat index kind", ["name"], inside & (F.get("index_kinds", at) != "jid"), "not an address"),
        row_rule(actions, "index start", ["name"], F.coalesce(F.get("index_kinds", F.lit(0)) != "literal", F.lit(True)), "begins without a literal"),
        row_rule(actions, "index name", ["name"], (F.get("index_kinds", F.lit(0)) == "literal") & (F.col("first_part") != F.col("name")), "begins with another name"),
    ]


def constant_rules(consts: DataFrame) -> list[DataFrame]:
    """consts(key, const_bytes, byte_length)."""
    good = F.col("const_bytes").rlike("^([0-9a-f]{2})*$")
    return [
        row_rule(consts, "constant hex", ["key"], ~good, "not lower-case hex bytes"),
        row_rule(consts, "constant length", ["key"], good & (F.length("const_bytes") != 2 * F.col("byte_length")), "length differs from the constant's"),
    ]


def enum_rules(enums: DataFrame, refs: DataFrame) -> list[DataFrame]:
    """enums(module, name, value_kind, members array<string>), refs(owner, module, name, member)."""
    key = ["module", "name"]
    flat = enums.select(*key, F.explode("members").alias("member"))
    return [
        duplicate_keys(enums, "enum identity", key),
        row_rule(enums, "enum members", key, F.coalesce(F.size("members"), F.lit(0)) < 1, "no members"),
        row_rule(enums, "enum member twice", key, F.size(F.array_distinct("members")) != F.size("members"), "a member twice"),
        row_rule(enums, "enum kind", key, ~F.col("value_kind").isin("string", "int"), "neither text nor integers"),
        fk_violations(refs, "enum reference", ["owner"], key, enums, key),
        fk_violations(refs.filter("member IS NOT NULL"), "enum member reference", ["owner"], [*key, "member"], flat, [*key, "member"]),
    ]


def event_rules(events: DataFrame, fields: DataFrame) -> list[DataFrame]:
    """events(module, name, code, channel, ps_id, weights array<int>), fields(module, name, id)."""
    return [
        duplicate_keys(events, "event code", ["code"]),
        row_rule(events, "event code range", ["name"], ~F.col("code").between(0, 65535), "not 16 bits"),
        row_rule(events, "event channel", ["name"], ~F.col("channel").isin("regular", "realtime", "private"), "unknown channel"),
        row_rule(events, "event private id", ["name"], F.col("ps_id").isNotNull() & (F.col("channel") != "private"), "a private id on another channel"),
        row_rule(events, "event weights", ["name"], F.size("weights") != 3, "not three weights"),
        duplicate_keys(fields, "event field id", ["module", "id"]),
        duplicate_keys(fields, "event field name", ["module", "name"]),
        row_rule(fields, "event field range", ["module", "name"], ~F.col("id").between(0, 65535), "not 16 bits"),
    ]


def flag_rules(flags: DataFrame) -> list[DataFrame]:
    """flags(module, name, code, type, default_json): keys and codes are unique, and a default has the flag's type: 1 is no float and true no integer."""
    d = F.col("default_json")
    good = F.when(F.col("type") == "bool", d.isin("true", "false")).when(F.col("type") == "int", d.rlike(r"^-?\d+$")).when(F.col("type") == "float", d.rlike(r"^-?\d+\.\d+(e-?\d+)?$")).when(F.col("type") == "string", d.rlike('^".*"$')).otherwise(F.lit(False))
    return [duplicate_keys(flags, "flag key", ["module", "name"]), duplicate_keys(flags, "flag code", ["module", "code"]), row_rule(flags, "flag default", ["module", "name"], ~good, "a default of another type")]


def token_rules(tokens: DataFrame) -> list[DataFrame]:
    """tokens(dictionary, position, token); dictionary -1 is the single-byte one."""
    size = tokens.groupBy("dictionary").agg(F.count("*").alias("n"), F.max("position").alias("last"))
    dicts = tokens.filter("dictionary >= 0").agg(F.count_distinct("dictionary").alias("n"))
    return [
        row_rule(tokens.filter("dictionary = -1 AND position = 0"), "token reserved", ["position"], F.col("token") != "", "slot 0 is reserved"),
        row_rule(size, "token dictionary size", ["dictionary"], F.col("n") > 256, "more than 256 tokens"),
        row_rule(dicts, "token dictionaries", ["n"], F.col("n") > 4, "more than 4 dictionaries"),
        duplicate_keys(tokens, "token position", ["dictionary", "position"]),
    ]


def shape_rules(shape: DataFrame, presence: DataFrame) -> list[DataFrame]:
    """shape(op, path), presence(op, path, level): both have the same paths at every level, and an element of a list is always there."""
    return [unequal_keys(shape, presence, "shape and presence", ["op", "path"]), row_rule(presence.filter(F.col("path").endswith("[]")), "list element", ["op", "path"], F.col("level") != 0, "an element that isn't always there")]


def child_rules(children: DataFrame) -> list[DataFrame]:
    """children(owner, name, required, min_count, max_count, arg_path, is_list)."""
    key = ["owner", "name"]
    return [
        row_rule(children, "child requiredness", key, F.col("required").isNull(), "must say whether it is required"),
        row_rule(children, "child counts", key, (F.col("min_count") > F.col("max_count")) | (F.col("required") & (F.col("max_count") == 0)) | (~F.col("required") & (F.col("min_count") > 0)), "contradicting counts"),
        row_rule(children, "child list marker", key, F.col("arg_path").isNotNull() & (F.col("is_list") != F.coalesce(F.col("max_count") > 1, F.lit(True))), "a list marker goes with what repeats"),
        row_rule(children, "child address", key, F.col("arg_path").rlike(r"(^$|^/|/$|//)"), "not an address"),
    ]


def sync_action_rules(actions: DataFrame, collections: Sequence[str], messages: DataFrame) -> list[DataFrame]:
    """actions(name, collection, scope, message, index_parts array<string>), messages(message)."""
    return [
        row_rule(actions, "action collection", ["name"], ~F.col("collection").isin(*collections), "undeclared collection"),
        row_rule(actions, "action index", ["name"], F.coalesce(F.size("index_parts"), F.lit(0)) < 1, "no first part"),
        fk_violations(actions, "action message", ["name"], ["message"], messages, ["message"]),
        duplicate_keys(actions, "action name", ["name"]),
    ]
