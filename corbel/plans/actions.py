"""Actions of notifications: what a handler makes of each child that it finds.

A handler switches on a child's tag and returns an object for each; labels and the
action's type are constants of other modules. Readers give one row for each field
of each returned object; constants are looked up, and the branches of an action are
folded: a field is required if every branch has it and requires it, what branches
read differently under one name is dropped, and constants stay where all agree.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregate
from ..sources import js
from . import extract
from .catalog import first_copies

#: The field of a returned object that names its action.
TYPE = "actionType"


def _reference(node, aliases: dict[str, str]) -> tuple[str, str, str] | None:
    """(module, table, member) of o("module").TABLE.MEMBER, or of a name that stands for the module."""
    if node is None or node.kind != "member" or node.args[0].kind != "member":
        return None
    table, member = node.args[0].args[1], node.args[1]
    inner = node.args[0].args[0]
    module = js.required(inner) or aliases.get(js.as_name(inner) or "")
    return (module, table, member) if module else None


def _read(node) -> tuple[str | None, str | None, bool] | None:
    """(accessor, wire name, required) of a value that a child's accessor gives, directly or on one side of a choice."""
    if node is None:
        return None
    if node.kind == "call" and (name := js.method(node)) and scalars.plain_name(name).startswith(("attr", "content")):
        return name, js.as_str(node.args[1][0]) if node.args[1] else None, not name.startswith("maybe")
    if node.kind == "cond":
        found = [x for x in map(_read, node.args[1:]) if x is not None]
        return (*found[0][:2], False) if len({x[:2] for x in found}) == 1 else None
    return None


def read_arms(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(arm, branch, tag_module, tag_table, tag_member, field, kind, accessor, wire_name, required, value, const_module, const_table, const_member).

    An arm is a run of labels, a branch a returned object; kind is read, literal, constant or other. Functions within an arm aren't looked into.
    """
    r = js.Reader(src)
    aliases = {}
    for n, value in r.declared():
        if (m := js.required(value)) is not None:
            aliases.setdefault(n, m)
    arm = 0
    for i, t in enumerate(r.toks):
        if not (t.kind == "name" and t.text == "switch" and r.is_(i + 1, "(") and i + 1 in r.close and r.is_(r.close[i + 1] + 1, "{")):
            continue
        j, end = r.close[i + 1] + 2, r.close.get(r.close[i + 1] + 1, -1)
        labels: list[tuple] = []
        branch, live = 0, False
        while j < end:
            word = r.toks[j].kind == "name" and r.text(j)
            if word in ("case", "default"):
                if live:
                    labels, live, branch, arm = [], False, 0, arm + 1
                label = _reference(r.expression(j + 1), aliases) if word == "case" else None
                if label is not None:
                    labels.append(label)
                while j < end and not r.is_(j, ":"):
                    j = r.close.get(j, j) + 1
            elif word in ("function", "switch"):
                live = True
                body = r._body(j) if word == "function" else None
                j = body.end - 1 if body is not None else r.close.get(r.close.get(j + 1, j) + 1, j)
            elif word == "return":
                live = True
                node = r.expression(j + 1)
                for label in labels if js.as_object(node) else ():
                    for key, value in js.as_object(node):
                        yield (arm, branch, *label, key, *_field(value, aliases))
                branch += 1
                j = max(j, node.end - 1)
            elif word == "break":
                live = True
            else:
                live = live or not r.is_(j, "{")
            j += 1


def _field(value, aliases) -> tuple:
    """(kind, accessor, wire_name, required, value, const_module, const_table, const_member)."""
    none = (None,) * 3
    if (ref := _reference(value, aliases)) is not None:
        return ("constant", None, None, True, None, *ref)
    if (read := _read(value)) is not None:
        return ("read", *read, None, *none)
    text = js.as_str(value)
    number = js.as_int(value)
    flag = js.as_bool(value)
    literal = text if text is not None else str(number) if number is not None else str(flag).lower() if flag is not None else None
    return ("literal", None, None, True, literal, *none) if literal is not None else ("other", None, None, True, None, *none)


def read_tables(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(table, member, value): exported objects of texts, as they are or handed to a function."""
    r = js.Reader(src)
    local = {}
    for n, value in r.declared():
        local.setdefault(n, value)
    for _, prop, value in r.assigned():
        node = local.get(js.as_name(value) or "", value)
        if node.kind == "call" and node.args[1]:
            node = node.args[1][0]
        if (got := extract._variants(node)) is not None and got[0] == "string":
            yield from ((prop, k, v) for k, v in got[1])


def actions(modules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields, constants, drops): fields(module, wire_tag, action_type, name, accessor, wire_name, type, required) and constants(module, wire_tag, action_type, name, value) of the folded actions; drops(reason, n): labels and types that no table resolves, and values that can't be read."""
    first = first_copies(modules)
    arms = extract.facts(first, F.col("slice").contains("switch") & F.col("slice").contains(TYPE), read_arms, "arm int, branch int, tag_module string, tag_table string, tag_member string, field string, kind string, accessor string, wire_name string, required boolean, value string, const_module string, const_table string, const_member string")
    tables = extract.facts(first, F.lit(True), read_tables, "table string, member string, value string")
    wanted = arms.select(F.col("tag_module").alias("m")).unionByName(arms.select(F.col("const_module").alias("m"))).distinct()
    tables = tables.join(wanted, tables["module"] == wanted["m"], "left_semi").groupBy("module", "table", "member").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n")).filter("n = 1")
    look = lambda mark: tables.select(F.col("module").alias(f"{mark}_module"), F.col("table").alias(f"{mark}_table"), F.col("member").alias(f"{mark}_member"), F.col("value").alias(f"_{mark}"))
    rows = arms.join(look("tag"), ["tag_module", "tag_table", "tag_member"], "left").join(look("const"), ["const_module", "const_table", "const_member"], "left")
    rows = rows.withColumn("value", F.coalesce("value", "_const"))
    open_ = F.when(F.col("_tag").isNull(), "label without a constant").when((F.col("kind") == "constant") & F.col("_const").isNull(), "constant that isn't found").when(F.col("kind") == "other", "value that can't be read")
    drops = rows.withColumn("reason", open_).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    known = rows.filter("_tag IS NOT NULL").withColumnRenamed("_tag", "wire_tag")
    types = known.filter(F.col("field") == TYPE).groupBy("module", "wire_tag", "arm", "branch").agg(F.min("value").alias("action_type"))
    # Branches of one tag are folded over all its arms.
    typed = known.filter(F.col("field") != TYPE).join(types, ["module", "wire_tag", "arm", "branch"], "full_outer").withColumn("place", F.concat_ws(".", "arm", "branch"))
    keys = ["module", "wire_tag", "action_type"]
    typed = typed.filter("action_type IS NOT NULL")
    read = typed.withColumn("seen", F.when(F.col("kind") == "read", F.concat_ws("|", "accessor", F.coalesce("wire_name", F.lit("")))))
    folded = aggregate.branch_fold(read, keys, "field", "place", ["seen"], "required").filter("seen IS NOT NULL AND field IS NOT NULL")
    accessor = F.split_part("seen", F.lit("|"), F.lit(1))
    wire = F.split_part("seen", F.lit("|"), F.lit(2))
    fields = folded.select(*keys, F.col("field").alias("name"), accessor.alias("accessor"), F.when(wire != "", wire).alias("wire_name"), scalars.accessor_type(accessor).alias("type"), "required")
    # A branch without further fields counts as one all the same.
    fixed = aggregate.in_every_branch(typed.withColumn("value", F.when(F.col("kind").isin("literal", "constant"), F.col("value"))), keys, "place", ["field", "value"]).filter("value IS NOT NULL")
    return fields, fixed.select(*keys, F.col("field").alias("name"), "value"), drops
