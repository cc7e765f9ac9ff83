"""Counts, rules and completions of request and response trees.

A tree is a table with one row for each node: `owner` (the request or response),
`path` (its place, "/"-joined, so a parent's path starts its children's) and the
node's own columns; attributes, contents, alternatives and assertions are tables
that hang on (owner, path). So what recursion does over a document is one
aggregation or join here, however deep trees are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import _key, _rows, duplicate_keys, fk_violations, row_rule

#: Types that are addresses, outcomes that are errors, addressees that are groups or unresolved.
JID_TYPES = ("jid", "userJid", "lidUserJid", "deviceJid", "lidDeviceJid", "groupJid", "newsletterJid", "callJid", "broadcastJid", "statusJid", "jidTyped")
ERROR_KINDS = ("error", "client_error", "server_error")
GROUP_TARGETS = ("group_server", "group_jid")
UNRESOLVED_TARGETS = ("unset", "unknown")
RUNTIME_TARGETS = ("group_jid", "unknown")
CHANNELS = ("regular", "realtime", "private")


# What a node says of itself.


def reads_argument(kind: Column, value: Column) -> Column:
    """Whether an attribute's value comes from the caller: not a constant, not a generated id, and no fixed value is recorded."""
    return ~F.coalesce(kind, F.lit("")).isin("const", "generated_id") & value.isNull()


def content_reads_argument(kind: Column) -> Column:
    return F.coalesce(kind != "const", F.lit(True))


def combinator_fed(repeats: Column, presence: Column) -> Column:
    """Whether a child has an argument of its own: it repeats, or isn't always there."""
    return F.coalesce(repeats, F.lit(False)) | (F.coalesce(presence, F.lit("required")) != "required")


def is_jid(kind: Column) -> Column:
    return F.coalesce(kind.isin(*JID_TYPES), F.lit(False))


def is_error(kind: Column) -> Column:
    return F.coalesce(kind.isin(*ERROR_KINDS), F.lit(False))


def is_group(target: Column) -> Column:
    return F.coalesce(target.isin(*GROUP_TARGETS), F.lit(False))


def published(path: Column) -> Column:
    """Whether an artifact is compared; generated code is for reference only."""
    return ~path.endswith(".rs")


def module_kind(name: Column, deps: Column, source: Column, codegen: str, constants: str, table: str) -> Column:
    """What a telemetry module holds, beside events: globals (and the table of private groups), constants, or further private groups."""
    defines = F.array_contains(deps, codegen) & F.contains(source, F.lit("defineGlobal"))
    return F.when(defines, "globals").when(name == constants, "constants").when(F.contains(source, F.lit(table)), "private")


# Counts. Each gives rows (key, value).


def _counted(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(counts.values())])
    pairs = [F.struct(F.lit(k).alias("key"), F.col(f"c{i}").alias("value")) for i, k in enumerate(counts)]
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def builder_counts(nodes: DataFrame, attrs: DataFrame, contents: DataFrame) -> DataFrame:
    """What of a builder's arguments has an address. nodes(presence, repeats, repeat_min, repeat_max, arg_path), attrs(kind, value, arg_path), contents(kind, arg_path)."""
    has = F.col("arg_path").isNotNull()
    attr, text = reads_argument(F.col("kind"), F.col("value")), content_reads_argument(F.col("kind"))
    fed = combinator_fed(F.col("repeats"), F.col("presence"))
    a = _counted(attrs, {"attributes with address": attr & has, "attributes without": attr & ~has})
    c = _counted(contents, {"contents": F.lit(True), "contents with address": text & has, "contents without": text & ~has})
    n = {"children with address": fed & has, "children without": fed & ~has, "optional children": F.col("presence") == "optional", "flagged children": F.col("presence") == "presence_flag"}
    return a.unionByName(c).unionByName(_counted(nodes, n | {"repeat bounds": F.col("repeats") & (F.col("repeat_min").isNotNull() | F.col("repeat_max").isNotNull())}))


def target_counts(requests: DataFrame) -> DataFrame:
    """Requests (target, target_arg_path) without a known addressee, a count for each state, and those whose addressee is known at run time only and has no address."""
    states = {f"{s} addressee": F.col("target") == s for s in UNRESOLVED_TARGETS}
    return _counted(requests, states | {"runtime addressee without address": F.col("target").isin(*RUNTIME_TARGETS) & F.col("target_arg_path").isNull()})


def construction_gaps(drops: DataFrame, prefix: str, named: Sequence[str]) -> DataFrame:
    """Of drops (reason, n): those whose reason starts with `prefix` as one, and each of the named ones, 0 where it is absent."""
    one = drops.agg(F.coalesce(F.sum(F.when(F.col("reason").startswith(prefix), F.col("n"))), F.lit(0)).alias("c"), *[F.coalesce(F.sum(F.when(F.col("reason") == k, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, k in enumerate(named)])
    pairs = [F.struct(F.lit(prefix).alias("key"), F.col("c").cast("long").alias("value"))] + [F.struct(F.lit(k).alias("key"), F.col(f"c{i}").cast("long").alias("value")) for i, k in enumerate(named)]
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def presence_counts(presence: DataFrame) -> DataFrame:
    """(op, always, conditional, undetermined, all_always) of presence(op, path, level): keys at every depth; an element of a list is no key, what is below it is, but all of them must be always there."""
    key = ~F.col("path").endswith("[]")
    at = lambda level: F.count_if(key & (F.col("level") == level))
    return presence.groupBy("op").agg(at(0).alias("always"), at(1).alias("conditional"), at(2).alias("undetermined"), F.bool_and(F.col("level") == 0).alias("all_always"))


def call_site_totals(sites: DataFrame) -> DataFrame:
    """One row for each event of sites(event, module, fields array<struct<name, value>>, partial, ord): sites that stay, partial ones, their fields and values, and repeats that went.

    Sites are sorted by module, names of fields and partial; a site that equals the one before it goes.
    """
    names = F.transform("fields", lambda x: x["name"])
    order = Window.partitionBy("event").orderBy("module", names, "partial", "ord")
    body = F.to_json(F.struct("module", "fields", "partial"))
    kept = sites.withColumn("_body", body).withColumn("_again", F.coalesce(F.lag("_body").over(order) == F.col("_body"), F.lit(False)))
    on = lambda c: F.when(~F.col("_again"), c).otherwise(F.lit(0))
    values = F.size(F.filter("fields", lambda x: x["value"].isNotNull()))
    total = lambda c, name: F.sum(on(c)).cast("long").alias(name)
    return kept.groupBy("event").agg(total(F.lit(1), "call_sites"), total(F.col("partial").cast("int"), "partial"), total(F.size("fields"), "fields"), total(values, "field_values"), F.sum(F.col("_again").cast("int")).cast("long").alias("duplicates"))


def constraint_counts(fields: DataFrame, assertions: DataFrame, outcomes: DataFrame, arms: DataFrame) -> DataFrame:
    """What responses constrain, as (key, value).

    fields(owner, of_outcome, has_outcomes, literal, reference_path, enum_ref, n_keys): those of an owner that has outcomes count
    where they are an outcome's, as its own repeat the first one's; assertions(owner, kind), outcomes(owner, tag, kind),
    arms(owner, tag, name, text, envelope): texts count once for each place that fixes them, envelopes are no arms.
    """
    f = fields.filter(~F.coalesce("has_outcomes", F.lit(False)) | F.coalesce("of_outcome", F.lit(False)))
    enum = F.col("enum_ref").isNotNull() | (F.coalesce("n_keys", F.lit(0)) > 0)
    parts = [
        _counted(f.select(F.col("reference_path").isNotNull().alias("x")).unionByName(assertions.select((F.col("kind") == "reference").alias("x"))), {"references": F.col("x")}),
        _counted(f, {"literals": F.col("literal").isNotNull(), "enums": enum}),
        _counted(outcomes, {"typed errors": F.col("kind").isin("client_error", "server_error")}),
        arms.filter("text IS NOT NULL").agg(F.count_distinct(F.struct("owner", "tag", F.coalesce("name", F.lit("")), "text")).alias("value")).select(F.lit("error texts").alias("key"), "value"),
        _counted(arms, {"error arms": ~F.coalesce("envelope", F.lit(False))}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def namespaces(df: DataFrame, namespace: str) -> DataFrame:
    """How many namespaces there are, as (key, value)."""
    return df.agg(F.count_distinct(namespace).alias("value")).select(F.lit("namespaces").alias("key"), "value")


def unresolved_enums(fields: DataFrame, known: DataFrame) -> DataFrame:
    """(key, value): enum fields that nothing resolves, by their trail. fields(trail, method, type, enum_ref, n_keys, proto_enum), known(proto_enum)."""
    open_ = fields.filter((F.col("type") == "enum") & F.col("enum_ref").isNull() & (F.coalesce("n_keys", F.lit(0)) == 0))
    names = known.select("proto_enum").distinct()
    return open_.join(names, "proto_enum", "left_anti").groupBy(F.concat_ws("|", "trail", F.coalesce("method", F.lit(""))).alias("key")).agg(F.count("*").alias("value"))


# Rules. Each gives rows (rule, key, message).


def variant_group_rules(groups: DataFrame) -> list[DataFrame]:
    """groups(owner, path, optional, n_variants): a choice that must be made has something to choose."""
    empty = ~F.coalesce("optional", F.lit(False)) & (F.coalesce("n_variants", F.lit(0)) < 1)
    return [row_rule(groups, "required group", ["owner", "path"], empty, "offers no alternative")]


def mixin_group_rules(fields: DataFrame, suffix: str = "MixinGroup") -> list[DataFrame]:
    """fields(owner, path, name, method, n_variants, n_children): a response field that is named as a union of fragments has alternatives or children."""
    bare = F.col("method").isNotNull() & F.col("name").endswith(suffix) & (F.coalesce("n_variants", F.lit(0)) < 1) & (F.coalesce("n_children", F.lit(0)) < 1)
    return [row_rule(fields, "mixin group", ["owner", "path"], bare, "no alternatives and no children")]


def assertion_rules(assertions: DataFrame) -> list[DataFrame]:
    """assertions(owner, path, kind, name, value, reference_path): each kind has what it needs to be applied, and nothing that would contradict it."""
    kind = lambda k: F.col("kind") == k
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "reference path": (kind("reference") & none("reference_path"), "a reference without the path it refers to"),
        "reference name": (kind("reference") & none("name"), "a reference without the attribute it is about"),
        "reference value": (kind("reference") & F.col("value").isNotNull(), "a reference that also fixes a value"),
        "attribute name": (kind("attr") & none("name"), "no attribute name"),
        "constant value": (kind("const") & F.col("value").isNull(), "a constant without a value"),
        "content value": (kind("content") & F.col("value").isNull(), "no content to match"),
        "tag name": (kind("tag") & none("name"), "no tag"),
        "child name": (kind("child") & none("name"), "no child's tag"),
        "child value": (kind("child") & (F.col("value").isNotNull() | F.col("reference_path").isNotNull()), "a child that fixes a value"),
    }
    return [row_rule(assertions, f"assertion {k}", ["owner", "path"], bad, message) for k, (bad, message) in rules.items()]


def buffer_rules(globals_: DataFrame, groups: DataFrame, events: DataFrame, fields: DataFrame, writes: DataFrame, members: DataFrame) -> list[DataFrame]:
    """What a telemetry buffer needs.

    globals_(name, id, channels array), groups(key, id, days), events(name, channel, private_id), fields(event, name),
    writes(event, module, name, enum_module, enum_key), members(enum_module, enum_key).
    """
    size = F.coalesce(F.size("channels"), F.lit(0))
    other = F.size(F.array_except("channels", F.array(*map(F.lit, CHANNELS)))) > 0
    private = events.filter("private_id IS NOT NULL")
    modules = members.select("enum_module").distinct()
    in_enum = writes.filter("enum_module IS NOT NULL")
    return [
        row_rule(globals_, "global channels", ["name"], size < 1, "nowhere to be written"),
        row_rule(globals_, "global channel", ["name"], other, "unknown channel"),
        row_rule(globals_, "global id range", ["name"], ~F.col("id").between(0, 65535), "not 16 bits"),
        duplicate_keys(globals_, "global id", ["id"]),
        duplicate_keys(groups, "private group id", ["id"]),
        row_rule(groups, "private group rotation", ["key"], (F.col("days") != -1) & (F.col("days") <= 0), "neither a period nor -1"),
        row_rule(events, "private event", ["name"], (F.col("channel") == "private") & F.col("private_id").isNull(), "names no private group"),
        fk_violations(private, "private event group", ["name"], ["private_id"], groups, ["id"]),
        fk_violations(writes, "written field", ["module", "event"], ["event", "name"], fields, ["event", "name"]),
        fk_violations(in_enum, "written enum", ["module", "event"], ["enum_module"], modules, ["enum_module"]),
        fk_violations(in_enum.join(modules, "enum_module", "left_semi"), "written member", ["module", "event"], ["enum_module", "enum_key"], members, ["enum_module", "enum_key"]),
    ]


def request_gaps(requests: DataFrame, nodes: DataFrame, attrs: DataFrame, contents: DataFrame) -> DataFrame:
    """(rule, key, message): what keeps a request from being generated with all its checks.

    requests(owner, namespace, request_namespace, iq_type, request_type, target, request_target, target_arg_path, n_outcomes, n_root_groups),
    nodes(owner, path, tag, presence, repeats, repeat_min, repeat_max, arg_path, n_groups), attrs(owner, tag, name, kind, value, arg_path), contents(owner, tag, kind, arg_path).
    """
    bare = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    says = lambda df, bad, message: _rows(df.filter(F.coalesce(bad, F.lit(False))), "admission", F.col("owner"), message)
    at = lambda tail: F.concat(F.lit("request."), F.coalesce("tag", F.lit("")), F.lit(f".{tail}"))
    of = lambda tail: F.concat_ws(".", F.lit("request"), F.coalesce("tag", F.lit("")), F.col("name"), F.lit(tail))
    same = F.col("namespace").eqNullSafe(F.col("request_namespace")) & F.col("iq_type").eqNullSafe(F.col("request_type")) & F.col("target").eqNullSafe(F.col("request_target"))
    rules = [
        says(requests, F.coalesce("n_outcomes", F.lit(0)) < 1, F.lit("response.rpc_outcomes_missing")),
        says(requests, ~same, F.lit("request.envelope_disagreement")),
        says(requests, F.col("target").isin(*UNRESOLVED_TARGETS), F.lit("request.target_unresolved")),
        says(requests, (F.col("target") == "group_jid") & bare("target_arg_path"), F.lit("request.target_argument_missing")),
        says(requests, F.col("n_root_groups") > 0, F.lit("request.root_disjunction_validation_unqualified")),
        says(nodes, bare("tag"), F.lit("request.tag_missing")),
        says(nodes, combinator_fed(F.col("repeats"), F.col("presence")) & bare("arg_path"), at("argument_missing")),
        says(nodes, F.col("repeats") & (F.col("repeat_min").isNull() | F.col("repeat_max").isNull()), at("repeat_bounds_missing")),
        says(nodes, F.col("repeats"), at("repeat_validation_unemitted")),
        says(nodes, F.col("n_groups") > 0, at("disjunction_validation_unqualified")),
        says(attrs, F.col("value").isNotNull() & ~F.col("kind").isin("const", "generated_id"), of("fixed_value_validation_unemitted")),
        says(attrs, reads_argument(F.col("kind"), F.col("value")) & bare("arg_path"), of("argument_missing")),
        says(contents, content_reads_argument(F.col("kind")) & bare("arg_path"), at("content_argument_missing")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


# Completions.


def inherited_arms(arms: DataFrame, pins: DataFrame, values: Sequence[str] = ("code", "text", "code_min", "code_max")) -> tuple[DataFrame, DataFrame]:
    """(arms, envelopes): the accepted shapes of an error with what they inherit, and what encloses them.

    arms(variant, arm, trail array<string>, values): `trail` names the enclosing alternatives of an arm, the outermost
    first; an arm takes what it doesn't fix itself from the nearest of them that does. pins(variant, path array<string>,
    values) are fixed outside the alternatives: those at the variant's deepest path bind each arm, after its own and its
    trail's; of shallower ones, the first in the order of paths make the envelope.
    """
    key = ["variant", "arm"]
    outer = arms.select(F.col("variant").alias("_v"), F.col("arm").alias("_a"), *[F.col(v).alias(f"_{v}") for v in values])
    steps = arms.select(*key, F.posexplode("trail").alias("_pos", "_name")).join(outer, (F.col("variant") == F.col("_v")) & (F.col("_name") == F.col("_a")))
    near = steps.groupBy(*[F.col(k).alias(f"k_{k}") for k in key]).agg(*[F.max_by(f"_{v}", F.when(F.col(f"_{v}").isNotNull(), F.col("_pos"))).alias(f"n_{v}") for v in values])
    depth = pins.groupBy(F.col("variant").alias("_v")).agg(F.max(F.size("path")).alias("_deepest"))
    placed = pins.join(depth, F.col("variant") == F.col("_v")).withColumn("_inner", F.size("path") == F.col("_deepest"))
    first = lambda df, mark: df.groupBy(F.col("variant").alias(f"{mark}_variant")).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col("path"))).alias(f"{mark}_{v}") for v in values])
    shared, envelope = first(placed.filter("_inner"), "s"), first(placed.filter("NOT _inner"), "e")
    full = arms.join(near, [F.col(k) == F.col(f"k_{k}") for k in key], "left").join(shared, F.col("variant") == F.col("s_variant"), "left")
    outer = arms.select(F.col("variant").alias("_v"), F.explode("trail").alias("_encloses")).distinct()
    full = full.join(outer, (F.col("variant") == F.col("_v")) & (F.col("arm") == F.col("_encloses")), "left_anti")  # an alternative with alternatives is no arm itself
    done = full.select(*key, *[F.coalesce(v, f"n_{v}", f"s_{v}").alias(v) for v in values])
    return done, envelope.select(F.col("e_variant").alias("variant"), *[F.col(f"e_{v}").alias(v) for v in values]).filter(F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull())


def filled_constants(nodes: DataFrame, constants: DataFrame) -> DataFrame:
    """Contents filled by tag: nodes(tag, is_leaf, kind, value, const_bytes, byte_length, value_source), constants(tag, zeros, source). Only content that is open is filled, and a leaf without content gets one."""
    c = constants.select(F.col("tag").alias("_tag"), "zeros", "source")
    both = nodes.join(c, F.col("tag") == F.col("_tag"), "left")
    open_ = F.when(F.col("kind").isNull(), F.col("is_leaf")).otherwise((F.col("kind") == "dynamic") & F.col("value").isNull() & F.col("const_bytes").isNull())
    fill = F.col("_tag").isNotNull() & F.coalesce(open_, F.lit(False))
    new = {"kind": F.lit("bytes"), "const_bytes": F.repeat(F.lit("00"), F.col("zeros").cast("int")), "byte_length": F.coalesce("byte_length", F.col("zeros")), "value_source": F.concat(F.lit("const:"), F.col("source"))}
    return both.select(*[F.when(fill, new[x].cast(nodes.schema[x].dataType)).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in nodes.columns])


def inlined(nodes: DataFrame, helpers: DataFrame, most: int = 16) -> DataFrame:
    """Calls replaced by the trees of their helpers: nodes(owner, path, helper, ...), helpers(helper_name, rel_path, helper, ...) with the same further columns.

    A node whose `helper` isn't null stands for that helper's nodes, re-rooted at its path; a helper may call others, `most`
    levels deep; a call that leads back to itself, or to an unknown helper, stays a call.
    """
    cols = [c for c in nodes.columns if c not in ("owner", "path", "helper")]
    known = helpers.select("helper_name").distinct().select(F.col("helper_name").alias("_known"))
    h = helpers.select(F.col("helper_name").alias("_h"), "rel_path", F.col("helper").alias("_next"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    todo = nodes.withColumn("_trail", F.array().cast("array<string>"))
    done = None
    for _ in range(most):
        marked = todo.join(known, F.col("helper") == F.col("_known"), "left")
        goes = F.col("_known").isNotNull() & ~F.array_contains("_trail", F.col("helper"))
        stay = marked.filter(~goes).drop("_known")
        done = stay if done is None else done.unionByName(stay)
        calls = marked.filter(goes).select("owner", "path", "helper", "_trail")
        todo = calls.join(h, F.col("helper") == F.col("_h")).select("owner", F.concat_ws("/", "path", F.when(F.col("rel_path") != "", F.col("rel_path"))).alias("path"), F.col("_next").alias("helper"), *[F.col(f"_n_{c}").alias(c) for c in cols], F.concat("_trail", F.array(F.col("helper"))).alias("_trail"))
        if not todo.filter("helper IS NOT NULL").limit(1).count():
            break
    return done.unionByName(todo).select(*nodes.columns)


def contributions(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """What each module inherits from all fragments that it reaches: edges(module, callee, path), facts(callee, xmlns, type, target, target_path) give (module, xmlns, type, target, target_path).

    Paths compose along edges; a fragment that two paths lead to has none. Different namespaces or types leave none,
    different addressees are Unknown, and a path counts only where one addressee has one.
    """
    from .aggregate import conflict_merge
    from .sets import closure_with_paths

    reach = closure_with_paths(edges, "module", "callee", "path").filter("module <> callee")
    got = reach.join(facts, "callee")
    whole = F.when(F.col("path").isNotNull() & F.col("target_path").isNotNull(), F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), F.col("target_path")))
    return conflict_merge(got.withColumn("target_path", whole), ["module"], ["xmlns", "type"], "target", "target_path")


def appended(table: DataFrame, extra: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The table, and those of the further rows whose key it has not, the first of each key."""
    from .dedup import first_wins

    return table.unionByName(first_wins(extra, [key], list(order)).select(*table.columns).join(table.select(key).distinct(), key, "left_anti").select(*table.columns))


def referenced(catalog: DataFrame, key: str, uses: DataFrame, use: str) -> DataFrame:
    """The entries that something refers to."""
    return catalog.join(uses.select(F.col(use).alias("_use")).distinct(), F.col(key) == F.col("_use"), "left_semi")


def resolved_members(uses: DataFrame, imports: DataFrame, constants: DataFrame) -> DataFrame:
    """Uses (module, alias, member) with the value of the constant that they name: imports(module, alias, owner), constants(owner, member, value); without an import the module is its own owner."""
    i = imports.select(F.col("module").alias("_m"), F.col("alias").alias("_a"), F.col("owner").alias("_owner"))
    named = uses.join(i, (F.col("module") == F.col("_m")) & (F.col("alias") == F.col("_a")), "left").withColumn("_owner", F.coalesce("_owner", "module"))
    c = constants.select(F.col("owner").alias("_o"), F.col("member").alias("_c"), F.col("value"))
    return named.join(c, (F.col("_owner") == F.col("_o")) & (F.col("member") == F.col("_c")), "left").select(*uses.columns, F.col("_owner").alias("owner"), "value")


def chained(df: DataFrame, steps: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Lookups one after another, each (name, table, key, value) by the value of the one before, the first by the column `start`: the last value, and `stopped_at`, the first step that found nothing."""
    out = df.withColumns({"_at": F.col("start"), "_stop": F.lit(None).cast("string")})
    for name, table, key, value in steps:
        t = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
        out = out.join(t, F.col("_at") == F.col("_k"), "left")
        out = out.withColumns({"_stop": F.coalesce("_stop", F.when(F.col("_v").isNull(), name)), "_at": F.col("_v")}).drop("_k", "_v")
    return out.select(*df.columns, F.col("_at").alias("value"), F.col("_stop").alias("stopped_at"))


def first_bindings(bindings: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One binding of each name, the first; later ones are aliases."""
    from .dedup import first_wins

    return first_wins(bindings, list(key), list(order))


def agreed_bindings(bindings: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Names whose bindings all have one value; a name that is bound to two is not resolved at all."""
    got = bindings.groupBy(*key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n"))
    return got.filter("_n = 1").drop("_n")


def capped_fan_out(df: DataFrame, group: Sequence[str], order: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first `most` rows of each group, and how many rows each group had beyond that."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    left = df.groupBy(*group).agg((F.count("*") - most).alias("n_left")).filter("n_left > 0")
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth"), left


def located(sites: DataFrame, index: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sites with all places that the index has for them, and the sites that it has none for, of which there must be none."""
    i = index.withColumnsRenamed({k: f"_i_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_i_{k}") for k in keys]
    missing = _rows(sites.join(i, on, "left_anti"), "located", _key(keys), F.lit("not in the index"))
    return sites.join(i, on).drop(*[f"_i_{k}" for k in keys]), missing
