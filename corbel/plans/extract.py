"""Facts of modules: one table function for each kind of fact, over the table of modules.

Each is a filter by text, which Spark keeps below the Python step, then a reader
that turns a module's source into rows. Everything after that, which copy wins,
what is joined and what is dropped, is left to `catalog`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import js

#: Names of modules and endings by which sources mark what they define.
FLAG_MODULES = "ABPropsConfigs"
PROTOCOL_ENUMS = "^(?:WASmax(?:In|Out).*Enums|WAWebAck|WAAckLevel)$"
EVENT_CODEGEN = "WAWebWamCodegenUtils"
BINARY_CACHE = "WAWasmModuleCache"
ID_MODULES = "_facebookRelayOperation"
BUILDERS = ("WAWap", "WASmaxJsx")
READER = "WADeprecatedWapParser"

_HEAD = "bundle_ord long, module_ord int, module string"


def facts(modules: DataFrame, test: Column, read: Callable[[str, str, list[str]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows (bundle_ord, module_ord, module, pos, ...) of read(slice, name, deps) for each module that passes the test."""
    columns = [c.split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", f"{_HEAD}, pos int, {schema}")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for m in pdf.itertuples(index=False):
                rows += [(m.bundle_ord, m.module_ord, m.name, k, *row) for k, row in enumerate(read(m.slice, m.name, list(m.deps)))]
            yield pd.DataFrame(rows, columns=columns)

    wanted = modules.filter(test).select("bundle_ord", "module_ord", "name", "deps", "slice")
    return wanted.mapInPandas(run, f"{_HEAD}, pos int, {schema}")


# Tokens: single-byte words, dictionaries of double-byte words.


def read_tokens(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(dictionary, position, token, version): dictionary -1 is the single-byte one, whose slot 0 is reserved."""
    r = js.Reader(src)
    local = dict(r.declared())
    export = {}
    for _, prop, value in r.assigned():
        if (n := js.as_name(value)) is not None:
            export.setdefault(prop, n)

    def texts(node) -> list[str] | None:
        items = js.as_array(node)
        got = [js.as_str(x) for x in items or ()]
        return got if got and None not in got else None

    single = texts(local.get(export.get("SINGLE_BYTE_TOKEN", "")))
    listed = js.as_array(local.get(export.get("DICTIONARIES", "")))
    names = [js.as_name(x) for x in listed or ()]
    if not names:
        names = [export[k] for k in sorted((k for k in export if re.fullmatch(r"DICTIONARY_\d+(_TOKEN)?", k)), key=lambda k: int(re.search(r"\d+", k)[0]))]
    dictionaries = [texts(local.get(n or "")) for n in names]
    if not single or not dictionaries or None in dictionaries:
        return
    version = js.as_int(local.get(export.get("DICT_VERSION", ""))) or 0
    yield (-1, 0, "", version)
    yield from ((-1, k + 1, t, version) for k, t in enumerate(single))
    yield from ((d, k, t, version) for d, words in enumerate(dictionaries) for k, t in enumerate(words))


def tokens(modules: DataFrame) -> DataFrame:
    s = F.col("slice")
    return facts(modules, s.contains("SINGLE_BYTE_TOKEN") & (s.contains("DICTIONARIES") | s.contains("DICTIONARY_")), read_tokens, "dictionary int, position int, token string, version int")


# Binaries and handles of resources.


def read_binaries(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(kind, value, hints): binary file names, and handles with the evidence of their module."""
    r = js.Reader(src)
    files = [s for s in dict.fromkeys(r.strings()) if s.endswith(".wasm") and not s.startswith("data:")]
    hints = [h for h, on in (("wasmBinaryLiteral", files), ("moduleName", "Wasm" in name), ("wasmModuleCacheDep", BINARY_CACHE in deps)) if on]
    yield from (("binary", f, []) for f in files)
    seen = set()
    for call in r.calls():
        inner = call.args[0]
        if inner.kind == "call" and inner.args[1] and js.as_str(inner.args[1][0]) == "bx" and call.args[1]:
            handle = js.as_str(call.args[1][0])
            if handle and handle.isascii() and handle.isdigit() and handle not in seen:
                seen.add(handle)
                yield "handle", handle, hints


def binaries(modules: DataFrame) -> DataFrame:
    s = F.col("slice")
    return facts(modules, s.contains(".wasm") | s.contains('"bx"') | F.array_contains("deps", "bx"), read_binaries, "kind string, value string, hints array<string>")


# Flags: { name: [code, "type", default, other default] }.


def _scalar(node, kind: str) -> str | None:
    """A literal of a type as JSON."""
    if kind == "bool":
        value = js.as_bool(node)
    elif kind == "string":
        value = js.as_str(node)
    else:
        value = js.as_number(node)
        value = None if value is None else int(value) if kind == "int" else float(value)
    return None if value is None else json.dumps(value, ensure_ascii=False)


def read_flags(src: str, name: str, deps: list[str], least: int = 5) -> Iterator[tuple]:
    """(object, name, code, type, default_json, other_json) of each object literal with `least` entries that read as flags; `object` numbers the literals."""
    k = 0
    for node in js.Reader(src).objects():
        rows = []
        for key, value in js.as_object(node):
            items = js.as_array(value)
            if not items or len(items) < 3:
                continue
            code, kind = js.as_int(items[0]), js.as_str(items[1])
            if code is None or code < 0 or kind not in ("bool", "int", "string", "float") or (default := _scalar(items[2], kind)) is None:
                continue
            other = _scalar(items[3], kind) if len(items) > 3 else None
            rows.append((k, key, code, kind, default, None if other == default else other))
        if len(rows) >= least:
            yield from rows
            k += 1


def flags(modules: DataFrame, suffix: str = FLAG_MODULES) -> DataFrame:
    return facts(modules, F.col("name").endswith(suffix), read_flags, "object int, name string, code long, type string, default_json string, other_json string")


# Enums: $InternalEnum({ NAME: value }), and plain objects of protocol modules.


def _variants(node) -> tuple[str, list[tuple[str, str]]] | None:
    """The kind and members of an object of literals that are all texts or all integers."""
    if node is None or node.kind != "object" or not node.args[1] or not node.args[0]:
        return None
    out, kinds = [], set()
    for key, value in node.args[0]:
        text, number = js.as_str(value), js.as_int(value)
        if text is None and number is None:
            return None
        kinds.add("string" if text is not None else "int")
        out.append((key, text if text is not None else str(number)))
    return (kinds.pop(), out) if len(kinds) == 1 else None


def read_enums(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(name, kind, ord, member, value): exported enums, under each name that they are exported by."""
    r = js.Reader(src)
    wrapped = "$InternalEnum" in deps
    found: dict[str, tuple] = {}

    def enum_of(node):
        if node.kind == "call" and (not wrapped or _is_enum_call(node)):
            return _variants(node.args[1][0]) if node.args[1] else None
        return _variants(node) if not wrapped else None

    for local, value in r.declared():
        if (got := enum_of(value)) is not None:
            found.setdefault(local, got)
    for _, export, value in r.assigned():
        got = found.get(js.as_name(value) or "") or enum_of(value)
        if got is None:
            continue
        kind, members = got
        if not wrapped and not all(re.fullmatch(r"[A-Z][A-Z0-9_]*", m) for m, _ in members):
            continue
        yield from ((export, kind, k, m, v) for k, (m, v) in enumerate(members))


def _is_enum_call(node) -> bool:
    """r("$InternalEnum")({...}), or a name that stands for it."""
    callee = node.args[0]
    return js.required(callee) == "$InternalEnum" or (callee.kind == "name" and len(node.args[1]) == 1) or (callee.kind == "member" and js.required(callee.args[0]) == "$InternalEnum")


def enums(modules: DataFrame, protocol: str = PROTOCOL_ENUMS) -> DataFrame:
    return facts(modules, F.array_contains("deps", "$InternalEnum") | F.col("name").rlike(protocol), read_enums, "name string, kind string, ord int, member string, value string")


def shifts(bundles_text: DataFrame, text: str) -> DataFrame:
    """(module, name, member): every 1 << o("module").name.member in whole sources, by text alone."""
    pattern = r'<<\s*[A-Za-z_$]\("([^"]*)"\)\.([A-Za-z0-9_$]+)\.([A-Za-z0-9_$]+)'
    rows = bundles_text.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("_m"))
    return rows.select(*[F.regexp_extract("_m", pattern, k).alias(n) for k, n in ((1, "module"), (2, "name"), (3, "member"))]).distinct()


# Telemetry: defineEvents({ Name: [code, { field: [id, type] }, [weights], channel, private id] }).

#: The base types of fields.
BASE_TYPES = {"BOOLEAN": "boolean", "INTEGER": "integer", "NUMBER": "number", "STRING": "string", "TIMER": "timer"}


def _field_type(node, aliases: dict[str, str]) -> tuple[str, str | None] | None:
    if node is None or node.kind != "member":
        return None
    obj, prop = node.args
    if obj.kind == "member" and obj.args[1] == "TYPES":
        return (BASE_TYPES[prop], None) if prop in BASE_TYPES else None
    module = js.required(obj) or aliases.get(js.as_name(obj) or "")
    return ("enum", module) if module else None


def read_events(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(event, export, code, channel, ps_id, weights, field, field_id, field_type, enum_module): a row for each field, one with nulls for an event without any."""
    r = js.Reader(src)
    aliases, local, by_start = {}, {}, {}
    for n, value in r.declared():
        if (m := js.required(value)) is not None:
            aliases.setdefault(n, m)
        if value.kind == "call" and js.method(value) == "defineEvents":
            local[n] = value.start
    for _, export, value in r.assigned():
        if value.kind == "call" and js.method(value) == "defineEvents":
            by_start[value.start] = export
        elif js.as_name(value) in local:
            by_start[local[js.as_name(value)]] = export
    seen = set()
    for call in r.calls():
        if js.method(call) != "defineEvents" or not call.args[1] or call.start in seen:
            continue
        seen.add(call.start)
        for event, value in js.as_object(call.args[1][0]) or ():
            items = js.as_array(value) or []
            get = lambda k, items=items: items[k] if k < len(items) else None
            code, props = js.as_int(get(0)), js.as_object(get(1))
            if code is None or props is None:
                continue
            weights = [w for x in js.as_array(get(2)) or () if (w := js.as_int(x)) is not None]
            ps = js.as_int(get(4))
            head = (event, by_start.get(call.start), code, js.as_str(get(3)) or "regular", None if ps == -1 else ps, weights)
            rows = []
            for field, spec in props:
                parts = js.as_array(spec) or []
                fid = js.as_int(parts[0]) if parts else None
                kind = _field_type(parts[1], aliases) if len(parts) > 1 else None
                if fid is not None and kind is not None:
                    rows.append((*head, field, fid, *kind))
            yield from rows or [(*head, None, None, None, None)]


def events(modules: DataFrame, codegen: str = EVENT_CODEGEN) -> DataFrame:
    return facts(modules, F.col("name").endswith("WamEvent") & F.array_contains("deps", codegen), read_events, "event string, export string, code long, channel string, ps_id long, weights array<int>, field string, field_id long, field_type string, enum_module string")


def read_sites(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(event_module, export, start, field, write, value): constructions new (o("module").Export)({ field: value }), a row for each field; value is JSON of a literal, or null."""
    r = js.Reader(src)
    aliases = {n: m for n, v in r.declared() if (m := js.required(v)) is not None}
    for i, t in enumerate(r.toks):
        if t.text != "new" or t.kind != "name":
            continue
        node = r._named(i, "new")
        callee, args = node.args
        if callee.kind != "member":
            continue
        module = js.required(callee.args[0]) or aliases.get(js.as_name(callee.args[0]) or "")
        if not module or not module.endswith("WamEvent"):
            continue
        fields = js.as_object(args[0]) if args else None
        start = len(src[: t.start].encode())
        rows = [(module, callee.args[1], start, key, "constructor", next((x for k in ("string", "float", "bool") if (x := _scalar(v, k)) is not None), None)) for key, v in fields or ()]
        yield from rows or [(module, callee.args[1], start, None, None, None)]


def sites(modules: DataFrame) -> DataFrame:
    return facts(modules, F.col("slice").contains("WamEvent"), read_sites, "event_module string, export string, start long, field string, write string, value string")


# Persisted operations: { kind: "Request", params: { id, name, operationKind }, fragment | operation: { argumentDefinitions } }.


def read_operations(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(original_name, operation_kind, doc_id, doc_id_ref, variables) of the first request literal of a module."""
    r = js.Reader(src)
    local = dict(r.declared())
    for node in r.objects():
        if js.as_str(js.entry(node, "kind")) != "Request":
            continue
        params = js.entry(node, "params")
        original = js.as_str(js.entry(params, "name"))
        if original is None:
            continue
        kind = js.as_str(js.entry(params, "operationKind"))
        ident = js.entry(params, "id")
        ref = js.as_str(ident.args[1][0]) if ident is not None and ident.kind == "call" and ident.args[1] else None
        args = js.entry(js.entry(node, "fragment"), "argumentDefinitions") or js.entry(js.entry(node, "operation"), "argumentDefinitions")
        args = local.get(js.as_name(args) or "", args)
        names = [js.as_str(js.entry(local.get(js.as_name(x) or "", x), "name")) for x in js.as_array(args) or () if x is not None]
        yield original, kind if kind in ("query", "mutation") else None, js.as_str(ident), ref, [n for n in names if n is not None]
        return


def operations(modules: DataFrame) -> DataFrame:
    return facts(modules, F.col("name").endswith(".graphql"), read_operations, "original_name string, operation_kind string, doc_id string, doc_id_ref string, variables array<string>")


def read_exported_text(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(value): the text that a module exports as a whole."""
    for obj, prop, value in js.Reader(src).assigned():
        if prop == "exports" and (text := js.as_str(value)) is not None:
            yield (text,)
            return


def exported_ids(modules: DataFrame, suffix: str = ID_MODULES) -> DataFrame:
    return facts(modules, F.col("name").endswith(suffix), read_exported_text, "value string")


# Message specifications: alias.internalSpec = { field: [id, types.X | flags.Y, reference], __oneofs__: {...} }.


def read_messages(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(message, ord, field, number, label, type, ref_module, ref_name, packed, oneof): fields of exported specifications; enums have a row for each member, with label "enum"."""
    r = js.Reader(src)
    local = dict(r.declared())
    exported: dict[str, str] = {}
    for obj, prop, value in r.assigned():
        if prop not in ("internalSpec", "internalDefaults") and (n := js.as_name(value)) is not None:
            exported.setdefault(n, prop)
    clean = lambda s: re.sub(r"Spec$", "", s).replace("$", ".")
    for alias, export in exported.items():
        node = local.get(alias)
        if node is not None and node.kind == "call" and node.args[1] and (got := _variants(node.args[1][0])) and got[0] == "int":
            yield from ((clean(export), k, m, int(v), "enum", "", None, None, False, None) for k, (m, v) in enumerate(got[1]))
    for alias, prop, value in r.assigned():
        if prop != "internalSpec" or alias not in exported or value.kind != "object":
            continue
        oneof = {f: n for n, arr in js.as_object(js.entry(value, "__oneofs__")) or () for x in js.as_array(arr) or () if (f := js.as_str(x)) is not None}
        k = 0
        for field, spec in value.args[0]:
            items = js.as_array(spec) or []
            number = js.as_int(items[0]) if items else None
            if field.startswith("__") or number is None:
                continue
            kind, labels = None, []
            for part in js.alternatives(items[1]) if len(items) > 1 and items[1] is not None else ():
                if part.kind == "member" and part.args[0].kind == "member":
                    group, word = part.args[0].args[1], part.args[1].lower()
                    if group == "TYPES":
                        kind = word
                    elif group == "FLAGS":
                        labels.append(word)
            module = ref = None
            if kind in ("message", "enum") and len(items) > 2 and items[2] is not None:
                target = items[2]
                if target.kind == "member":
                    module, ref = js.required(target.args[0]) or name, clean(target.args[1])
                elif (n := js.as_name(target)) is not None:
                    module, ref = name, clean(exported.get(n, n))
            label = next((x for x in labels if x in ("required", "optional", "repeated")), "optional")
            yield clean(exported[alias]), k, field, number, label, kind or "", module, ref, "packed" in labels, oneof.get(field)
            k += 1


def messages(modules: DataFrame) -> DataFrame:
    return facts(modules, F.col("slice").contains("internalSpec"), read_messages, "message string, ord int, field string, number long, label string, type string, ref_module string, ref_name string, packed boolean, oneof string")


# Builders of requests and stanzas: wap("tag", { attribute: value }, children...).


def _attribute(node) -> tuple[str, str | None]:
    """(kind, literal) of a request attribute."""
    if (s := js.as_str(node)) is not None:
        return "const", s
    if (n := js.as_int(node)) is not None:
        return "const", str(n)
    name = js.method(node) if node.kind == "call" else None
    plain = node.args[0].args[0] if node.kind == "call" and node.args[0].kind == "name" else name
    kinds = {"CUSTOM_STRING": "string", "INT": "int", "generateId": "generated", "OPTIONAL": "optional", "MAYBE_CUSTOM_STRING": "optional", "JID": "jid", "USER_JID": "user_jid", "GROUP_JID": "group_jid", "DEVICE_JID": "device_jid"}
    return kinds.get(name or plain or "", "dynamic"), None


def read_builders(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(path, tag, attr, kind, literal) of nested builder calls: a row for each attribute, one with nulls for a node without any; path counts the children from the root call."""
    r = js.Reader(src)
    inside = -1
    count = 0

    def walk(node, path: str) -> Iterator[tuple]:
        args = node.args[1]
        tag = js.as_str(args[0]) if args else None
        if tag is None:
            return
        attrs = js.as_object(args[1]) if len(args) > 1 and args[1] is not None else None
        rows = [(path, tag, a, *_attribute(v)) for a, v in attrs or ()]
        yield from rows or [(path, tag, None, None, None)]
        for k, child in enumerate(args[2:]):
            if child is not None and child.kind == "call" and js.method(child) in ("wap", "smax"):
                yield from walk(child, f"{path}/{k}")

    for call in r.calls():
        if js.method(call) in ("wap", "smax") and call.start >= inside:
            inside = call.end
            yield from walk(call, str(count))
            count += 1


def builders(modules: DataFrame) -> DataFrame:
    s = F.col("slice")
    test = (s.rlike(r"\.wap\([\"']") & F.array_contains("deps", BUILDERS[0])) | (s.rlike(r"\.smax\([\"']") & F.array_contains("deps", BUILDERS[1]))
    return facts(modules, test, read_builders, "path string, tag string, attr string, kind string, literal string")


# Dispatch of incoming stanzas: switch (x) { case "type": handler }.


def read_cases(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(case, handler_module, handler_name): cases of switches, with the first call of another module's function in each."""
    r = js.Reader(src)
    open_cases: list[str] = []
    for i, t in enumerate(r.toks):
        if t.kind != "name":
            continue
        if t.text == "case" and r.is_(i + 2, ":") and r.toks[i + 1].kind == "str":
            open_cases.append(js.unescape(r.text(i + 1)[1:-1]))
            handler = (None, None)
            depth = i + 3
            while depth < len(r.toks) and not (r.toks[depth].kind == "name" and r.text(depth) in ("case", "default", "break")) and not r.is_(depth, "}"):
                if r.toks[depth].kind == "name":
                    node = r._postfix(r._named(depth, r.text(depth)))
                    if node.kind == "call" and node.args[0].kind == "member" and (m := js.required(node.args[0].args[0])):
                        handler = (m, node.args[0].args[1])
                        break
                depth += 1
            falls = not r.is_(depth, "}") and r.text(depth) == "case" and handler == (None, None)
            if not falls:
                yield from ((c, *handler) for c in open_cases)
                open_cases = []


def cases(modules: DataFrame, marker: str = "switch") -> DataFrame:
    return facts(modules, F.col("slice").contains(marker) & F.col("slice").contains("case"), read_cases, "case string, handler_module string, handler_name string")


# Readers of incoming stanzas: parser.attrString("name"), parser.child("tag").


def read_accessors(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(accessor, argument) of calls of readers with one text."""
    for call in js.Reader(src).calls():
        n = js.method(call)
        if n and re.match(r"(?:maybe|has)?(?:[aA]ttr|[cC]hild|[cC]ontent)", n):
            yield n, js.as_str(call.args[1][0]) if call.args[1] else None


def accessors(modules: DataFrame) -> DataFrame:
    return facts(modules, F.col("slice").contains(READER) | F.array_contains("deps", READER), read_accessors, "accessor string, argument string")
