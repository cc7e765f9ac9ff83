"""What names and calls lead to: aliases within a module, wrappers between modules, and where words stand in code.

Steps that lie within one function or statement are read; chains of them are
closures over rows, so they may be of any length and cross any number of modules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sets
from ..sources import js
from . import extract
from .catalog import first_copies
from .responses import _own_tokens, functions


def read_bindings(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(local, source, owner): what names are given, another name or a module; anything else is neither."""
    seen = set()
    for local, value in js.Reader(src).declared():
        row = (local, js.as_name(value), js.required(value))
        if row not in seen:
            seen.add(row)
            yield row


def owners(modules: DataFrame) -> DataFrame:
    """(module, local, owner): the module that a name stands for, over chains of names; a name that anything else is given too, directly or along its chain, stands for none."""
    got = extract.facts(first_copies(modules), F.size("deps") > 0, read_bindings, "local string, source string, owner string").select("module", "local", "source", "owner")
    key = lambda n: F.concat_ws("\n", "module", n)
    reach = sets.closure(got.filter("source IS NOT NULL").select(key("local").alias("a"), key("source").alias("b")), "a", "b")
    own = got.select(key("local").alias("a"), F.col("owner"), (F.col("owner").isNull() & F.col("source").isNull()).alias("other"))
    every = own.unionByName(reach.join(own.withColumnRenamed("a", "b"), "b").select("a", "owner", "other"))
    # A name at the end of a chain that is given nothing is unknown.
    ends = reach.join(own.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select("a").distinct().withColumn("_open", F.lit(True))
    per = every.groupBy("a").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner"), F.bool_or("other").alias("other")).join(ends, "a", "left")
    parts = F.split("a", "\n")
    return per.filter("n = 1 AND NOT other AND _open IS NULL").select(parts[0].alias("module"), parts[1].alias("local"), "owner")


def read_forwards(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
    """(function, target_module, target_function, position): exported functions that hand their first parameter to one function of another module, and at which place."""
    r = js.Reader(src)
    exported, aliases = {}, {}
    for _, prop, value in r.assigned():
        if (n := js.as_name(value)) is not None:
            exported.setdefault(n, prop)
    for n, value in r.declared():
        if (m := js.required(value)) is not None:
            aliases.setdefault(n, m)
    for local, params, begin, end in functions(r):
        if local not in exported or not params:
            continue
        found = set()
        for i in _own_tokens(r, begin, end):
            t = r.toks[i]
            if t.kind != "name" or r.is_(i - 1, ".") or t.text in ("return", "yield", "var"):
                continue
            node = r._postfix(r._named(i, t.text))
            if node.kind == "call" and node.args[0].kind == "member":
                module = js.required(node.args[0].args[0]) or aliases.get(js.as_name(node.args[0].args[0]) or "")
                at = next((k for k, x in enumerate(node.args[1]) if js.as_name(x) == params[0]), None)
                if module is not None and at is not None:
                    found.add((module, node.args[0].args[1], at))
        if len(found) == 1:  # two targets say nothing about either
            yield exported[local], *found.pop()


def wrappers(modules: DataFrame, module: str, function: str) -> DataFrame:
    """(module, function, steps): the functions that hand their first parameter on to `module.function`, directly (1) or through others that do, always as the first argument."""
    got = extract.facts(first_copies(modules), F.size("deps") > 0, read_forwards, "function string, target_module string, target_function string, position int")
    key = lambda m, f: F.concat_ws("\n", m, f)
    edges = got.filter("position = 0").select(key("module", "function").alias("a"), key("target_module", "target_function").alias("b"))
    base = f"{module}\n{function}"
    direct = edges.filter(F.col("b") == base).select("a").distinct().withColumn("_direct", F.lit(True))
    parts = F.split("a", "\n")
    reach = sets.closure(edges, "a", "b").filter((F.col("b") == base) & (F.col("a") != base)).select("a").distinct()
    return reach.join(direct, "a", "left").select(parts[0].alias("module"), parts[1].alias("function"), F.when(F.col("_direct"), 1).otherwise(2).alias("steps"))


def read_words(wanted: Sequence[str]):
    def read(src: str, name: str, deps: list[str]) -> Iterator[tuple]:
        """(word, start): where words stand in code, in bytes; texts, patterns and comments aren't code."""
        done, byte = 0, 0
        for t in js.tokens(src):
            if t.kind == "name" and t.text in wanted:
                byte += len(src[done : t.start].encode())
                done = t.start
                yield t.text, byte

    return read


def inventory(modules: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(module, word, start): each place of the wanted words in the code of modules' first copies."""
    some = F.lit(False)
    for w in wanted:
        some = some | F.contains("slice", F.lit(w))
    return extract.facts(first_copies(modules), some, read_words(tuple(wanted)), "word string, start long").select("module", "word", "start")
