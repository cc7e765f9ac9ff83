"""Lookups that say where a value came from, and what they leave open.

All are equi-joins; Spark broadcasts a side by its measured size. The prefix and
pairwise joins go through derived keys, so none compares all pairs of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _renamed(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in cols])


def two_tier_lookup(left: DataFrame, exact: DataFrame, fallback: DataFrame, key: Sequence[str], tag: str) -> DataFrame:
    """Adds value and tier: from `exact` (key, value), else from `fallback` (tag, value), else null."""
    a = _renamed(exact, [*key, "value"], "_a_")
    b = _renamed(fallback, [tag, "value"], "_b_")
    out = left.join(a, [left[k] == a[f"_a_{k}"] for k in key], "left").join(b, left[tag] == b[f"_b_{tag}"], "left")
    tier = F.when(F.col("_a_value").isNotNull(), "exact").when(F.col("_b_value").isNotNull(), "tag")
    return out.select(*left.columns, F.coalesce("_a_value", "_b_value").alias("value"), tier.alias("tier"))


def sole_member(left: DataFrame, within: Sequence[str], test: Column, right: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `value` of `right` by key to a row that passes the test and is the only such row of its group."""
    one = F.count_if(test).over(Window.partitionBy(*within)) == 1
    marked = left.withColumn("_one", one & test)
    look = _renamed(right, [key, value], "_r_")
    return marked.join(look, F.when(F.col("_one"), F.col(key)) == look[f"_r_{key}"], "left").select(*left.columns, F.col(f"_r_{value}").alias("value"))


def site_to_event(sites: DataFrame, events: DataFrame, module: str, export: str, event: str) -> DataFrame:
    """Adds event and how: by (module, export); else the module's sole event, if none of the module's events is exported; else unmatched."""
    exact = _renamed(events.filter(F.col(export).isNotNull()), [module, export, event], "_e_")
    alone = events.groupBy(F.col(module).alias("_s_module")).agg(F.count("*").alias("_n"), F.count(export).alias("_x"), F.min(event).alias("_s_event")).filter("_n = 1 AND _x = 0").drop("_n", "_x")
    out = sites.join(exact, (sites[module] == exact[f"_e_{module}"]) & (sites[export] == exact[f"_e_{export}"]), "left")
    out = out.join(alone, sites[module] == alone["_s_module"], "left")
    how = F.when(F.col(f"_e_{event}").isNotNull(), "export").when(F.col("_s_event").isNotNull(), "sole").otherwise("unmatched")
    return out.select(*sites.columns, F.coalesce(f"_e_{event}", "_s_event").alias("event"), how.alias("how"))


def written_keys(writes: DataFrame, fields: DataFrame, owner: str, name: str, special: str) -> DataFrame:
    """Adds state: field (known to the owner), special, or dropped."""
    known = fields.select(F.col(owner).alias("_o"), F.col(name).alias("_f")).distinct().withColumn("_known", F.lit(True))
    out = writes.join(known, (writes[owner] == known["_o"]) & (writes[name] == known["_f"]), "left")
    state = F.when(F.col("_known"), "field").when(F.col(name) == special, "special").otherwise("dropped")
    return out.select(*writes.columns, state.alias("state"))


def coalesced_with_origin(df: DataFrame, options: Sequence[tuple[str, Column]], name: str) -> DataFrame:
    """Adds the first option that is not null, and which one it was."""
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in options])
    return df.withColumns({name: F.coalesce(*[c for _, c in options]), f"{name}_origin": origin})


def aligned(shape: DataFrame, facts: DataFrame, keys: Sequence[str], fact: str, default: Column) -> DataFrame:
    """The shape with the fact of each key: facts without a place in the shape go, places without a fact get the default."""
    look = _renamed(facts, [*keys, fact], "_f_")
    out = shape.join(look, [shape[k].eqNullSafe(look[f"_f_{k}"]) for k in keys], "left")
    return out.select(*shape.columns, F.coalesce(f"_f_{fact}", default).alias(fact))


def reconciled(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old_value, new_value, state): unchanged, changed, stale (only old) or unused (only new)."""
    a, b = _renamed(old, [key, value], "_o_"), _renamed(new, [key, value], "_n_")
    out = a.join(b, a[f"_o_{key}"] == b[f"_n_{key}"], "full_outer")
    state = F.when(F.col(f"_n_{key}").isNull(), "stale").when(F.col(f"_o_{key}").isNull(), "unused").when(F.col(f"_o_{value}").eqNullSafe(F.col(f"_n_{value}")), "unchanged").otherwise("changed")
    return out.select(F.coalesce(f"_o_{key}", f"_n_{key}").alias(key), F.col(f"_o_{value}").alias("old_value"), F.col(f"_n_{value}").alias("new_value"), state.alias("state"))


def root_names(df: DataFrame, within: Sequence[str], name: str, next_class: str) -> DataFrame:
    """Drops a name that is another name of its group followed by a character of `next_class`.

    Each name gives its own proper prefixes that such a character follows; an
    anti-join by equality finds those that are names.
    """
    names = df.select(*[F.col(k).alias(f"_k_{k}") for k in within], F.col(name).alias("_root")).distinct()
    n = F.length(name)
    cuts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.transform(F.filter(cuts, lambda i: F.substring(F.col(name), i + 1, F.lit(1)).rlike(f"^{next_class}$")), lambda i: F.substring(F.col(name), F.lit(1), i))
    longer = df.select(*within, name, F.explode(heads).alias("_head")).distinct()
    under = longer.join(names, [longer[k].eqNullSafe(names[f"_k_{k}"]) for k in within] + [longer["_head"] == names["_root"]], "left_semi").select(*[F.col(k).alias(f"_u_{k}") for k in within], F.col(name).alias("_gone")).distinct()
    return df.join(under, [df[k].eqNullSafe(under[f"_u_{k}"]) for k in within] + [df[name] == under["_gone"]], "left_anti")


def longest_prefix(df: DataFrame, path: str, owners: DataFrame, prefix: str, owner: str, sep: str = "/") -> DataFrame:
    """Adds the owner of the longest prefix of a path (cut at `sep`) that has one."""
    parts = F.split(path, sep)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sep))
    rows = df.select(path).distinct().select(path, F.explode(heads).alias("_head"))
    own = owners.select(F.col(prefix).alias("_p"), F.col(owner).alias("_o"))
    best = rows.join(own, rows["_head"] == own["_p"]).groupBy(F.col(path).alias("_path")).agg(F.max(F.struct(F.length("_head").alias("n"), F.col("_o").alias("o"))).alias("_b"))
    return df.join(best, df[path] == best["_path"], "left").select(*df.columns, F.col("_b.o").alias("owner"))


def dependents(edges: DataFrame, module: str, dep: str) -> DataFrame:
    """(module, consumers): the sorted distinct modules that depend on each module, itself excluded, comma-joined."""
    used = edges.filter(F.col(module) != F.col(dep)).groupBy(F.col(dep).alias("module"))
    return used.agg(F.array_join(F.array_sort(F.collect_set(F.col(module).cast("string"))), ",").alias("consumers"))


def resolved_enum(attrs: DataFrame, catalog: DataFrame, keys: Sequence[str], guard: str, values: str, all_text: str) -> DataFrame:
    """Adds values and drop_reason: a link resolves if the entry exists, is all text and not empty, and has the guard's value (if there is one) as a member."""
    look = _renamed(catalog, [*keys, values, all_text], "_c_")
    out = attrs.join(look, [attrs[k] == look[f"_c_{k}"] for k in keys], "left")
    got = F.col(f"_c_{values}")
    reason = F.when(F.col(f"_c_{keys[0]}").isNull(), "missing").when(~F.coalesce(F.col(f"_c_{all_text}"), F.lit(False)), "not text").when(F.coalesce(F.size(got), F.lit(0)) < 1, "empty").when(F.col(guard).isNotNull() & ~F.array_contains(got, F.col(guard)), "guard")
    return out.select(*attrs.columns, F.when(reason.isNull(), got).alias(values), reason.alias("drop_reason"))


def conflicting_variants(pins: DataFrame, variant: str, key: str, value: str) -> DataFrame:
    """(a, b): variants a < b that have a different value under one key."""
    x = pins.select(F.col(variant).alias("a"), F.col(key).alias("_k"), F.col(value).alias("_v")).distinct()
    y = x.withColumnsRenamed({"a": "b", "_v": "_w"})
    return x.join(y, "_k").filter("a < b AND _v <> _w").select("a", "b").distinct()


def indistinct_variants(signature: DataFrame, pins: DataFrame, variant: str, item: str, key: str, value: str) -> DataFrame:
    """(a, b): variants of which a's signature is a part of b's and that no pin tells apart, so that a union of them can't be decided. Variants that share an item meet by it."""
    s = signature.select(F.col(variant).alias("a"), F.col(item).alias("_i")).distinct()
    size = s.groupBy("a").agg(F.count("*").alias("_n"))
    shared = s.join(s.withColumnRenamed("a", "b"), "_i").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("_m"))
    part = shared.join(size, "a").filter("_m = _n").select("a", "b")
    bad = conflicting_variants(pins, variant, key, value)
    bad = bad.union(bad.select("b", "a"))
    return part.join(bad, ["a", "b"], "left_anti")


def implied(earlier: DataFrame, later: DataFrame, owner: str, key: str, value: str) -> DataFrame:
    """Owners of which every earlier assertion is matched by a later one; a null value matches any."""
    e = earlier.select(F.col(owner).alias("_o"), F.col(key).alias("_k"), F.col(value).alias("_v"))
    open_ = e.join(later, (e["_o"] == later[owner]) & (e["_k"] == later[key]) & (e["_v"].isNull() | (e["_v"] == later[value])), "left_anti")
    return later.select(owner).distinct().join(open_.select(F.col("_o").alias(owner)).distinct(), owner, "left_anti")


def begins_with(left: DataFrame, start: str, right: DataFrame, name: str) -> DataFrame:
    """All pairs of a left row and a right row whose name begins with the left one's text, and goes on: every start of a name is a key, so that it stays an equi-join."""
    r = right.withColumn("_start", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda k: F.substring(F.col(name), F.lit(1), k)))).filter(F.length("_start") < F.length(name))
    return left.join(r, F.col(start) == F.col("_start")).drop("_start")


def drop_counts(resolved: DataFrame, key: Sequence[str], reason: str = "drop_reason") -> DataFrame:
    """(reason, n): how many different places lost their link, for each reason."""
    return resolved.filter(F.col(reason).isNotNull()).select(*key, F.col(reason).alias("reason")).distinct().groupBy("reason").agg(F.count("*").alias("n"))
