"""Responses: what their parsers assert and read, which outcomes a call has, and what of an error each outcome accepts.

A parser is a function that takes steps on a node and returns a result made of
their values. Readers give one row for each step; what parsers take over from one
another (a mixin on the same node), which outcome comes first and what alternatives
inherit are closures, joins and aggregations over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregate, dedup, sets
from ..sources import js
from . import extract
from .catalog import ORDER, first_copies
from .requests import response_operation, variant_kind

#: Names of the modules and calls that parsers are made of.
RESULT = "makeResult"
CHILD_STEPS = ("flattenedChildWithTag", "optionalChildWithTag", "childWithTag")
TRACKED = ("WASmaxJsx", "WAWap", "WASmaxAttrs", "WASmaxChildren", "WASmaxMixins")

STEPS = "function string, ord int, kind string, name string, accessor string, wire_name string, value string, low long, high long, reference_path string, source_path string, optional boolean, target_module string, target_function string"


def functions(r: js.Reader) -> Iterator[tuple[str, list[str], int, int]]:
    """(name, parameters, first and last token of the body) of each named function."""
    for i, t in enumerate(r.toks):
        if t.kind != "name" or t.text != "function":
            continue
        j = i + 1 + r.is_(i + 1, "*")
        if j + 1 < len(r.toks) and r.toks[j].kind == "name" and r.is_(j + 1, "(") and j + 1 in r.close:
            shut = r.close[j + 1]
            if r.is_(shut + 1, "{") and shut + 1 in r.close:
                yield r.text(j), [x.text for x in r.toks[j + 2 : shut] if x.kind == "name"], shut + 2, r.close[shut + 1]


def _own_tokens(r: js.Reader, begin: int, end: int) -> Iterator[int]:
    """Tokens of a body without those of functions within it."""
    i = begin
    while i < end:
        if r.is_(i, "function") and (node := r._body(i)) is not None:
            i = node.end
        else:
            yield i
            i += 1


def _accessor(node) -> str | None:
    """The accessor that is handed on: o("Utils").attrString."""
    return node.args[1] if node is not None and node.kind == "member" else None


def _literal(node) -> str | None:
    if (s := js.as_str(node)) is not None:
        return s
    n = js.as_int(node)
    return None if n is None else str(n)


class _Parser:
    """The steps of one parse function."""

    def __init__(self, r: js.Reader, params: list[str], begin: int, end: int):
        self.r, self.begin, self.end = r, begin, end
        self.node, self.ref = (params + [None, None])[:2]
        self.path = {self.node: ()}  # of a node that a name stands for
        self.values: dict[str, dict] = {}  # of a name that holds a step's result
        self.steps: list[dict] = []

    def _path_of(self, node) -> tuple | None:
        """Where a node argument stands: the parser's own node, or a child that a step went down to."""
        if (n := js.as_name(node)) is not None:
            return self.path.get(n)
        if node is not None and node.kind == "member" and node.args[1] == "value":
            step = self.values.get(js.as_name(node.args[0]) or "")
            if step and step["kind"] == "child":
                step["read"] = True
                return (*step["at"], step["wire_name"])
        return None

    def _reference(self, node) -> str | None:
        if node is not None and node.kind == "member" and node.args[1] == "value":
            step = self.values.get(js.as_name(node.args[0]) or "")
            return step["reference_path"] if step and step["kind"] == "reference" else None
        return None

    def step(self, call) -> dict | None:
        """What a call does, if it is a step."""
        name, args = js.method(call), call.args[1]
        at = next((p for x in args if (p := self._path_of(x)) is not None), None)
        out = dict.fromkeys(("name", "accessor", "wire_name", "value", "low", "high", "reference_path", "target_module", "target_function")) | {"at": at or (), "optional": False}
        first = next((s for x in args if (s := js.as_str(x)) is not None), None)
        if name is None:
            return None
        if name == "assertTag":
            return out | {"kind": "tag", "name": first}
        if name == "assertAttr":
            texts = [s for x in args if (s := js.as_str(x)) is not None]
            return out | {"kind": "attr", "name": first, "value": texts[1] if len(texts) > 1 else None}
        if name.endswith("FromReference"):
            listed = next((js.as_array(x) for x in args if js.as_array(x)), None) or []
            return out | {"kind": "reference", "reference_path": "/".join(s for x in listed if (s := js.as_str(x)) is not None)}
        if name in ("literal", "literalJid") and len(args) > 3:
            return out | {"kind": "literal", "accessor": _accessor(args[0]), "wire_name": js.as_str(args[2]), "value": _literal(args[3]), "reference_path": self._reference(args[3])}
        if name == "literalContent":
            return out | {"kind": "content", "value": next((s for x in reversed(args) if (s := _literal(x)) is not None), None)}
        if name in CHILD_STEPS and first is not None:
            return out | {"kind": "child", "wire_name": first, "optional": name.startswith("optional"), **self._target(args)}
        if name == "mapChildrenWithTag" and first is not None:
            bounds = [n for x in args if (n := js.as_int(x)) is not None]
            return out | {"kind": "children", "wire_name": first, "low": bounds[0] if bounds else None, "high": bounds[1] if len(bounds) > 1 else None, **self._target(args)}
        if name == "optional" and args:
            return out | {"kind": "value", "accessor": _accessor(args[0]), "wire_name": first, "optional": True}
        if name.startswith(("attr", "content", "maybeAttr")):
            bounds = [n for x in args if (n := js.as_int(x)) is not None]
            return out | {"kind": "value", "accessor": name, "wire_name": first, "low": bounds[0] if len(bounds) > 1 else None, "high": bounds[1] if len(bounds) > 1 else None}
        module = js.required(call.args[0].args[0])
        if name.startswith("parse") and module is not None and at is not None:
            return out | {"kind": "mixin", "target_module": module, "target_function": name}
        return None

    def _target(self, args) -> dict:
        """A parser that children are handed to."""
        for x in args:
            if x is not None and x.kind == "member" and x.args[1].startswith("parse"):
                return {"target_module": js.required(x.args[0]), "target_function": x.args[1]}
        return {}

    def run(self) -> Iterator[dict]:
        r, results = self.r, []
        for i in _own_tokens(r, self.begin, self.end):
            t = r.toks[i]
            if t.kind == "name" and r.is_(i + 1, "=") and not r.is_(i - 1, "."):
                value = r.expression(i + 2)
                step = self.step(value) if value.kind == "call" else None
                if step is not None:
                    self.values[t.text] = step
                    self.steps.append(step)
            elif t.kind == "name" and t.text == RESULT and r.is_(i + 1, "("):
                results.append(r.items(i + 2, r.close[i + 1]))
        for args in results:
            for node in args:
                self._named(node)
        returned = {r.text(i - 1) for i in _own_tokens(r, self.begin, self.end) if r.is_(i, "}") or i == self.end}
        returned |= {r.text(i) for i in (self.end - 1, self.end - 2) if r.toks[i].kind == "name"}
        for k, s in enumerate(self.steps):
            kind = s["kind"]
            if kind == "reference" or (kind == "child" and (s.get("read") or s["optional"]) and not s["name"]) or (kind == "value" and not s["name"]):
                continue
            if kind == "literal" and not s["at"] and s["wire_name"] and (s["value"] is not None or s["reference_path"]):
                yield s | {"kind": "reference" if s["reference_path"] else "attr", "name": s["wire_name"], "ord": k, "at": (), "accessor": None, "wire_name": None}
            if kind in ("literal", "value") or (kind == "child" and s["name"]):
                if s["name"]:
                    yield s | {"kind": "field", "ord": k}
            else:
                yield s | {"ord": k}

    def _named(self, node) -> None:
        """Names the steps whose values a result has: {key: x.value}, extended by others."""
        if node is None:
            return
        if node.kind == "call":
            for x in node.args[1]:
                self._named(x)
        for key, value in js.as_object(node) or ():
            if value is not None and value.kind == "member" and value.args[1] == "value" and (step := self.values.get(js.as_name(value.args[0]) or "")):
                step["name"] = step["name"] if step["kind"] in ("tag", "attr") else key


def read_parsers(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """STEPS: assertions (tag, attr, reference, content, child), fields, children and mixins of each exported parse function."""
    r = js.Reader(src)
    exported: dict[str, str] = {}
    for _, prop, value in r.assigned():
        if (n := js.as_name(value)) is not None:
            exported.setdefault(n, prop)
    for local, params, begin, end in functions(r):
        export = exported.get(local, "")
        if not export.startswith("parse"):
            continue
        for s in _Parser(r, params, begin, end).run():
            path = "/".join(x or "" for x in s["at"]) or None
            yield export, s["ord"], s["kind"], s["name"], s["accessor"], s["wire_name"], s["value"], s["low"], s["high"], s["reference_path"], path, s["optional"], s["target_module"], s["target_function"]


def parsers(modules: DataFrame) -> DataFrame:
    return extract.facts(modules, F.col("name").startswith("WASmaxIn"), read_parsers, STEPS)


def read_outcomes(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(ord, tag, target_module, target_function): the outcomes of a call, in the order in which they are tried."""
    r = js.Reader(src)
    held: dict[str, tuple[str, str]] = {}
    for local, value in r.declared():
        n = js.method(value) if value.kind == "call" else None
        if n and n.startswith("parse") and (m := js.required(value.args[0].args[0])):
            held[local] = (m, n)
    k = 0
    for node in r.objects():
        tag, value = js.as_str(js.entry(node, "name")), js.entry(node, "value")
        if tag is not None and value is not None and value.kind == "member" and value.args[1] == "value" and (target := held.get(js.as_name(value.args[0]) or "")):
            yield k, tag, *target
            k += 1


def outcomes(modules: DataFrame) -> DataFrame:
    name = F.col("name")
    return extract.facts(modules, name.startswith("WASmax") & name.endswith("RPC"), read_outcomes, "ord int, tag string, target_module string, target_function string")


def resolved(steps: DataFrame) -> DataFrame:
    """Each parser's own steps, and those that it takes over from mixins of its node: STEPS with `module`, `own_module`, `own_function` and `distance` 0 for its own."""
    key = lambda m, f: F.concat_ws(".", m, f)
    s = steps.withColumn("_id", key("module", "function"))
    edges = s.filter("kind = 'mixin' AND source_path IS NULL AND NOT optional AND target_module IS NOT NULL").select(F.col("_id").alias("a"), key("target_module", "target_function").alias("b")).distinct()
    reach = sets.closure(edges, "a", "b").filter("a <> b")
    every = s.select(F.col("_id").alias("a"), F.col("_id").alias("b")).distinct().withColumn("distance", F.lit(0)).unionByName(reach.withColumn("distance", F.lit(1)))
    owner = s.select(F.col("_id").alias("_o"), F.col("module").alias("_om"), F.col("function").alias("_of")).distinct()
    took = every.join(owner, F.col("a") == F.col("_o")).join(s, F.col("b") == F.col("_id"))
    cols = [c for c in steps.columns if c not in ("module", "function", *ORDER)]
    return took.select(F.col("_om").alias("module"), F.col("_of").alias("function"), F.col("module").alias("own_module"), F.col("function").alias("own_function"), "distance", *cols)


def fields(every: DataFrame) -> DataFrame:
    """(module, function, name, wire_name, type, optional, value, low, high, source_path, unknown): what a parser's result has; its own fields come before those it takes over."""
    got = every.filter("kind = 'field' OR (kind = 'children' AND name IS NOT NULL) OR (kind = 'mixin' AND name IS NOT NULL)")
    first = dedup.first_wins(got, ["module", "function", "name"], ["distance", "own_module", "own_function", "ord"])
    kind = F.when(F.col("kind") == "children", "list").when(F.col("kind") == "mixin", "object").otherwise(scalars.accessor_type(F.coalesce("accessor", F.lit("attrString"))))
    return first.select("module", "function", "name", "wire_name", kind.alias("type"), "optional", "value", "low", "high", "source_path", scalars.unknown_policy(F.coalesce("accessor", F.lit(""))).alias("unknown"))


def asserted(every: DataFrame) -> DataFrame:
    """(module, function, kind, name, value, reference_path): what must hold of the parser's own node."""
    return every.filter("kind IN ('tag', 'attr', 'reference', 'content') OR (kind = 'child' AND name IS NULL AND source_path IS NULL)").select("module", "function", "kind", F.when(F.col("kind") == "child", F.col("wire_name")).otherwise(F.col("name")).alias("name"), "value", "reference_path").distinct()


def response_index(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, arms) of all operations.

    outcomes(operation, ord, tag, module, function, kind, primary): those of a call, the first success being primary;
    an operation without a call has the response module that says success, or else the first by name whose outcome is one.
    arms(operation, tag, code, text, code_min, code_max): the accepted shape of each error, from the fields that read code and text;
    `contracts.inherited_arms` does the same for errors with alternatives.
    """
    first = first_copies(modules)
    every = resolved(parsers(first))
    calls = outcomes(first).select(F.regexp_extract("module", "^WASmax(.*)RPC$", 1).alias("operation"), "ord", "tag", F.col("target_module").alias("module"), F.col("target_function").alias("function"))
    alone = parsers(first).select("module", "function").distinct().withColumn("operation", response_operation(F.col("module"))).filter("operation <> ''")
    tag = F.regexp_extract("module", "Response(.*)$", 1)
    alone = alone.filter(~tag.contains("Mixin") & (tag != "")).join(calls.select("operation").distinct(), "operation", "left_anti")
    roots = alone.join(alone.select(F.col("module").alias("_m"), F.col("function").alias("_f")), (F.col("module") == F.col("_m")) & (F.col("function") != F.col("_f")) & F.col("function").startswith(F.col("_f")) & F.substring("function", F.length("_f") + 1, F.lit(1)).rlike("[A-Z]"), "left_anti")
    order = F.when(tag == "Success", 0).otherwise(1)
    found = calls.unionByName(roots.select("operation", (order * 1000).cast("int").alias("ord"), F.regexp_extract("function", "^parse(.*)$", 1).alias("tag"), "module", "function"))
    said = asserted(every).filter("kind = 'attr' AND name = 'type'").groupBy(F.col("module").alias("_m"), F.col("function").alias("_f")).agg(F.max(F.when(F.col("value") == "error", "error")).alias("_error"), F.max(F.when(F.col("value") == "result", "result")).alias("_result"))
    typed = found.join(said, (F.col("module") == F.col("_m")) & (F.col("function") == F.col("_f")), "left")
    typed = typed.withColumn("kind", variant_kind(F.col("tag"), F.coalesce("_error", "_result"))).select(*found.columns, "kind")
    only = typed.join(calls.select("operation").distinct().withColumn("_call", F.lit(True)), "operation", "left").filter("_call OR kind = 'success'").drop("_call")
    one = dedup.first_wins(only.filter("ord >= 1000 OR kind = 'success'"), ["operation"], ["ord", "module", "function"]).select(F.col("operation").alias("_op"), F.col("module").alias("_pm"), F.col("function").alias("_pf"))
    kept = only.join(one, (F.col("operation") == F.col("_op")), "left").withColumn("primary", F.coalesce((F.col("module") == F.col("_pm")) & (F.col("function") == F.col("_pf")), F.lit(False)))
    called = calls.select("operation").distinct().withColumn("_call", F.lit(True))
    kept = kept.join(called, "operation", "left").filter("_call OR primary").select("operation", "ord", "tag", "module", "function", "kind", "primary")

    # What an error accepts: the pins on code and text of all that it reads, as one shape.
    pins = every.filter("kind IN ('field', 'literal') AND coalesce(wire_name, name) IN ('code', 'text')")
    code, text = F.coalesce("wire_name", "name") == "code", F.coalesce("wire_name", "name") == "text"
    pins = pins.groupBy("module", "function").agg(
        F.max(F.when(code, F.expr("try_cast(value AS BIGINT)"))).alias("code"), F.max(F.when(text, F.col("value"))).alias("text"), F.max(F.when(code & F.col("value").isNull(), F.col("low"))).alias("code_min"), F.max(F.when(code & F.col("value").isNull(), F.col("high"))).alias("code_max")
    )
    arms = kept.filter("kind = 'error'").select("operation", "tag", "module", "function").join(pins, ["module", "function"]).select("operation", "tag", "code", "text", "code_min", "code_max")
    refined = aggregate.error_kind(arms, ["operation", "tag"], "code", "code_min", "code_max").withColumnRenamed("kind", "_refined")
    kept = kept.join(refined, ["operation", "tag"], "left").withColumn("kind", F.when(F.col("kind") == "error", F.coalesce("_refined", "kind")).otherwise(F.col("kind"))).drop("_refined")
    return kept.select("operation", "ord", "tag", "module", "function", "kind", "primary"), arms


# Aliases of builders.


def read_aliases(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(local, owner): names that stand for one of the tracked modules; a name that stands for two stands for none."""
    found: dict[str, set[str]] = {}
    for local, value in js.Reader(src).declared():
        if (m := js.required(value)) in TRACKED:
            found.setdefault(local, set()).add(m)
    yield from ((k, next(iter(v))) for k, v in found.items() if len(v) == 1)


def aliases(modules: DataFrame) -> DataFrame:
    return extract.facts(modules, F.array_contains(F.transform("deps", lambda d: d.isin(*TRACKED)), True), read_aliases, "local string, owner string")


# Shapes of answers: selections of persisted operations.


def read_selections(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(path, kind): the tree that an operation selects, leaf, object or array, joined by "/"; what fragments and conditions add stands beside the rest."""
    r = js.Reader(src)
    local: dict[str, js.Node] = {}
    for n, value in r.declared():
        local.setdefault(n, value)

    def value_of(node, seen=()):
        n = js.as_name(node)
        return value_of(local.get(n), (*seen, n)) if n is not None and n not in seen else node

    def walk(node, path: str, depth: int) -> Iterator[tuple]:
        for item in js.as_array(value_of(node)) or ():
            one = value_of(item)
            kind = js.as_str(value_of(js.entry(one, "kind")))
            key = js.as_str(value_of(js.entry(one, "alias"))) or js.as_str(value_of(js.entry(one, "name")))
            inner = js.entry(one, "selections")
            if depth > 64:
                return
            if kind in ("ScalarField", "TypeDiscriminator"):
                yield f"{path}{key or '__typename'}", "leaf"
            elif kind == "LinkedField" and key:
                many = js.as_bool(value_of(js.entry(one, "plural"))) is True
                yield f"{path}{key}", "array" if many else "object"
                yield from walk(inner, f"{path}{key}/", depth + 1)
            elif kind in ("InlineFragment", "Condition"):
                yield from walk(inner, path, depth + 1)

    for node in r.objects():
        if js.as_str(js.entry(node, "kind")) == "Fragment" and (top := js.entry(node, "selections")) is not None:
            yield from dict.fromkeys(walk(top, "", 0))
            return


def response_shapes(modules: DataFrame) -> DataFrame:
    """(module, path, kind, type): the merged shape of each operation's answer; a container comes before a leaf and a list before an object. Leaves are typed by their names."""
    got = extract.facts(first_copies(modules.filter(F.col("name").endswith(".graphql"))), F.col("slice").contains("selections"), read_selections, "path string, kind string")
    merged = aggregate.shape_merge(got.select("module", "path", "kind"), "module", "path", "kind")
    leaf = F.element_at(F.split("path", "/"), -1)
    return merged.select("module", "path", "kind", F.when(F.col("kind") == "leaf", scalars.heuristic_type(leaf)).otherwise(F.col("kind")).alias("type"))
