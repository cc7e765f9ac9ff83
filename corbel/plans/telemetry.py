"""What telemetry buffers share: globals with the channels they may be written on, private groups, and constants.

Events and their construction sites are in `catalog`; these tables complete them,
so that `contracts.buffer_rules` can hold all of them against one another.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts, dedup
from ..sources import js
from . import extract
from .catalog import ORDER

#: Modules and names that mark the tables.
CODEGEN, CONSTANTS, TABLE = extract.EVENT_CODEGEN, "WAWebWamConstants", "PrivateStatsAllIds"


def read_globals(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(name, id, type, enum_module, channels): globals; one that names no channel may be written on the regular one, one whose channels can't be read has none."""
    r = js.Reader(src)
    aliases = {}
    for n, value in r.declared():
        if (m := js.required(value)) is not None:
            aliases.setdefault(n, m)
    seen = set()
    for call in r.calls():
        if js.method(call) != "defineGlobal" or not call.args[1] or call.start in seen:
            continue
        seen.add(call.start)
        for key, value in js.as_object(call.args[1][0]) or ():
            items = js.as_array(value) or []
            gid = js.as_int(items[0]) if items else None
            kind = extract._field_type(items[1], aliases) if len(items) > 1 else None
            if gid is None or not 0 <= gid < 1 << 32 or kind is None:
                continue
            listed = js.as_array(items[2]) if len(items) > 2 else None
            channels = ["regular"] if listed is None else [js.as_str(x) for x in listed]
            yield key, gid, *kind, channels if channels and None not in channels else None


def _group(node) -> tuple | None:
    key, gid, days = js.as_str(js.entry(node, "key")), js.as_int(js.entry(node, "keyHashInt")), js.as_int(js.entry(node, "rotationPeriodDays"))
    return None if key is None or gid is None or days is None else (key, gid, days)


def read_groups(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(key, id, days): lists whose entries are all private groups."""
    r = js.Reader(src)
    for i, t in enumerate(r.toks):
        if t.kind == "punct" and t.text == "[" and i in r.close and r.is_(i + 1, "{"):
            got = [_group(x) for x in js.as_array(r.expression(i)) or ()]
            if got and None not in got:
                yield from got


def read_further_groups(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(key, id, days): groups that are added at run time, an id and a period under one key."""
    ids, days = {}, {}
    for _, prop, value in js.Reader(src).assigned():
        if (n := js.as_int(value)) is not None:
            ids[prop] = n
        elif (d := js.as_int(js.entry(value, "rotationPeriodDays"))) is not None:
            days[prop] = d
    yield from ((k, ids[k], d) for k, d in sorted(days.items()) if k in ids)


def read_constants(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(name, value): exported integers, written as they are or by a name."""
    r = js.Reader(src)
    local = {n: v for n, value in r.declared() if (v := js.as_int(value)) is not None}
    direct, named = [], []
    for _, prop, value in r.assigned():
        if (n := js.as_int(value)) is not None:
            direct.append((prop, n))
        elif js.as_name(value) in local:
            named.append((prop, local[js.as_name(value)]))
    yield from direct + named


def buffer_catalog(modules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(globals, groups, constants, gaps): globals(name, id, type, enum_module, channels) and constants(name, value) by name, the first of each; groups(key, id, days, module): all distinct ones of the table, and further ones whose id it has not; gaps(reason, n): globals whose channels can't be read."""
    marked = modules.withColumn("_kind", contracts.module_kind(F.col("name"), F.col("deps"), F.col("slice"), CODEGEN, CONSTANTS, TABLE))
    of = lambda kind: marked.filter(F.col("_kind") == kind).drop("_kind")
    every = F.lit(True)
    found = extract.facts(of("globals"), every, read_globals, "name string, id long, type string, enum_module string, channels array<string>")
    gaps = found.filter("channels IS NULL").groupBy(F.lit("global with an unreadable channel list").alias("reason")).agg(F.count("*").alias("n"))
    order = [*ORDER, "pos"]
    globals_ = dedup.first_wins(found.filter("channels IS NOT NULL"), ["name"], order).select("name", "id", "type", "enum_module", "channels")
    table = extract.facts(of("globals"), every, read_groups, "key string, id long, days long").select("key", "id", "days", "module").distinct()
    further = extract.facts(of("private").filter(F.col("slice").contains(TABLE)), every, read_further_groups, "key string, id long, days long")
    groups = contracts.appended(table, further, "id", order)
    constants = dedup.first_wins(extract.facts(of("constants"), every, read_constants, "name string, value long"), ["name"], order).select("name", "value")
    return globals_, groups, constants, gaps


def referenced_modules(fields: DataFrame, globals_: DataFrame, enums: DataFrame) -> DataFrame:
    """The enums that a field or a global refers to."""
    uses = fields.select("enum_module").unionByName(globals_.select("enum_module")).filter("enum_module IS NOT NULL")
    return contracts.referenced(enums, "module", uses, "enum_module")
