"""Synced actions: what each handler writes, where, and under which index.

A handler is a class over a base that tells its scope; it names its action,
collection and version by constants of another module, and its value's field tells
the message that it carries. Readers give one row a handler; names become values,
fields become messages, and indexes are laid out by joins and column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import js
from . import extract
from .catalog import first_copies, messages
from .responses import _own_tokens

#: Modules that handlers refer to (the constants have two names), and the scope that a base stands for.
CONSTANTS, HANDLERS, BASES, VALUES = ("WAWebSyncdConst", "WASyncdConst"), "WAWebCollectionHandlerActions", "WAWebSyncdAction", "SyncActionValue"
SCOPES = {"AccountSyncdActionBase": "account", "ChatSyncdActionBase": "chat", "ChatOrContactSyncdActionBase": "chatOrContact", "MessageSyncdActionBase": "message", "ChatMessageRangeSyncdActionBase": "chatMessageRange"}
#: Slots that a scope has at least, and what the ones of a message are.
LEAST_SLOTS = {"account": 1, "chat": 2, "chatOrContact": 2, "chatMessageRange": 2, "message": 5}
MESSAGE_SLOTS = (("jid", "remote"), ("string", "id"), ("boolString", "fromMe"), ("jidOrZero", "participant"))


def read_constants(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(kind, key, value): members of the exported enums, under the enum's name, and integer constants, under ""."""
    r = js.Reader(src)
    local = {}
    for n, value in r.declared():
        local.setdefault(n, value)
    for _, prop, value in r.assigned():
        node = local.get(js.as_name(value) or "", value)
        got = extract._variants(node.args[1][0]) if node.kind == "call" and node.args[1] else None
        if got is not None:
            yield from ((prop, k, v) for k, v in got[1])
        elif (n := js.as_int(value)) is not None:
            yield "", prop, str(n)


def _constant(node, group: str | None) -> str | None:
    """The key of o("constants").group.key, or of o("constants").key without a group."""
    if node is None or node.kind != "member":
        return None
    inner = node.args[0]
    if group is not None:
        if inner.kind != "member" or inner.args[1] != group:
            return None
        inner = inner.args[0]
    return node.args[1] if js.required(inner) in CONSTANTS else None


def _returned(r: js.Reader, function) -> js.Node | None:
    """What a function returns first."""
    if function.kind != "function":
        return None
    begin, end = function.args
    return next((r.expression(i + 1) for i in _own_tokens(r, begin + 1, end) if r.is_(i, "return")), None)


def read_handlers(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(base, action_key, version, version_key, collection_key, chat_jid_index, value_field, slots) of a module with a handler."""
    r = js.Reader(src)
    base = action = version = version_key = collection = chat = field = None
    aliases, slots = {"indexParts"}, 0
    for i, t in enumerate(r.toks):
        if t.kind == "str" and js.unescape(t.text[1:-1]) == BASES and r.is_(i - 1, "(") and r.is_(i + 1, ")") and r.is_(i + 2, ".") and r.text(i + 3).endswith("Base"):
            base = r.text(i + 3)
    for n, value in r.declared():
        if value.kind == "member" and value.args[1] == "indexParts":
            aliases.add(n)
    for _, prop, value in r.assigned():
        if prop == "getAction" and action is None:
            action = _constant(_returned(r, value), "Actions")
        elif prop == "getVersion" and version is None and version_key is None:
            got = _returned(r, value)
            version, version_key = js.as_int(got), _constant(got, None)
        elif prop == "collectionName" and collection is None:
            collection = _constant(value, "CollectionName")
        elif prop == "chatJidIndex" and chat is None:
            chat = js.as_int(value)
    for call in r.calls():
        value = js.entry(call.args[1][0], "value") if js.method(call) == "buildPendingMutation" and call.args[1] and call.args[1][0] is not None else None
        if (keys := js.as_object(value)) and field is None:
            field = keys[0][0]
    for i, t in enumerate(r.toks):
        if t.kind == "name" and t.text in aliases and r.is_(i + 1, "[") and r.is_(i + 3, "]") and r.toks[i + 2].kind == "num":
            slots = max(slots, int(js.number(r.text(i + 2))) + 1)
        if field is None and t.kind == "name" and t.text == "value" and r.is_(i - 1, ".") and r.is_(i + 1, ".") and r.toks[i + 2].kind == "name":
            field = r.text(i + 2)
    if base is not None and action is not None:
        yield base, action, version, version_key, collection, chat, field, slots


def _index(scope: Column, slots: Column, chat: Column, name: Column) -> Column:
    """array<struct<kind, name>>: the parts of an action's index, its own name first."""
    part = lambda kind, text: F.struct(kind.alias("kind"), text.alias("name"))
    least = F.coalesce(F.element_at(F.create_map(*[x for k, v in LEAST_SLOTS.items() for x in (F.lit(k), F.lit(v))]), scope), F.lit(0))
    n = F.when(scope == "message", F.greatest(slots, least)).when(slots == 0, least).otherwise(slots)
    span = lambda low: F.when(n > low, F.sequence(F.lit(low), n - 1)).otherwise(F.array().cast("array<int>"))
    number = lambda prefix, s: F.concat(F.lit(prefix), s.cast("string"))
    fixed = F.array(*[part(F.lit(k), F.lit(v)) for k, v in MESSAGE_SLOTS])
    own = F.transform(span(1), lambda s: F.when(s.eqNullSafe(chat), part(F.lit("jid"), F.lit("chatJid"))).otherwise(part(F.lit("string"), number("key", s))))
    rest = F.when(scope == "message", F.concat(fixed, F.transform(span(5), lambda s: part(F.lit("string"), number("arg", s))))).otherwise(own)
    return F.concat(F.array(part(F.lit("literal"), name)), rest)


def actions(modules: DataFrame) -> DataFrame:
    """(action_key, module, name, collection, version, scope, base, value_field, value_type, chat_jid_index, index_parts): the handlers that the list of handlers names; an action whose key the constants lack is left out."""
    first = first_copies(modules)
    listed = first.filter(F.col("name") == HANDLERS).select(F.explode("deps").alias("module")).filter(F.col("module").rlike("(?i)Sync(?:Action)?$")).distinct()
    found = extract.facts(first, F.col("slice").contains(BASES), read_handlers, "base string, action_key string, version long, version_key string, collection_key string, chat_jid_index long, value_field string, slots int")
    found = found.join(listed, "module", "left_semi")
    constants = extract.facts(first.filter(F.col("name").isin(*CONSTANTS)), F.lit(True), read_constants, "kind string, key string, value string").select("kind", "key", "value")
    of = lambda kind, key, out: constants.filter(F.col("kind") == kind).groupBy(F.col("key").alias(key)).agg(F.min("value").alias(out))
    named = found.join(of("Actions", "action_key", "action"), "action_key").join(of("CollectionName", "collection_key", "collection"), "collection_key", "left").join(of("", "version_key", "_version"), "version_key", "left")
    types = messages(first).filter(F.col("message") == VALUES).select(F.col("field").alias("value_field"), F.col("ref_name").alias("value_type"))
    named = named.join(types, "value_field", "left")
    scope = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair]), F.col("base")), F.lit("unknown"))
    named = named.withColumns({"version": F.coalesce("version", F.expr("try_cast(_version AS BIGINT)")), "scope": scope})
    return named.select("action_key", "module", F.col("action").alias("name"), "collection", "version", "scope", "base", "value_field", "value_type", "chat_jid_index", _index(F.col("scope"), F.col("slots"), F.col("chat_jid_index"), F.col("action")).alias("index_parts"))
