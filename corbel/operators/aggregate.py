"""Aggregations that keep a value only where the facts agree, with their provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unanimous(df: DataFrame, keys: Sequence[str], value: str, source: str) -> DataFrame:
    """(keys, value, source): keys with exactly one distinct value, and the smallest source of it."""
    out = df.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("value"), F.min(source).alias("source"))
    return out.filter("_n = 1").drop("_n")


def unanimous_rollup(df: DataFrame, parent: str, tag: str, value: str, source: str) -> DataFrame:
    """(tag, value, source): tags with one distinct value over all parents; the source is that of the first (parent, tag) key in key order."""
    per = df.filter(F.col(value).isNotNull()).groupBy(parent, tag).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.min(source).alias("_s"))
    out = per.groupBy(tag).agg(F.min("_lo").alias("value"), F.max("_hi").alias("_hi"), F.min_by("_s", parent).alias("source"))
    return out.filter("value = _hi").drop("_hi")


def unanimous_with_veto(df: DataFrame, keys: Sequence[str], value: str, veto: Column, source: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """(keys, value, and source if one is named): one distinct value, and no row that vetoes; the source is that of the first row, in `order`, that has a value."""
    first = [F.min_by(source, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("source")] if source else []
    out = df.withColumn("_veto", veto).groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("value"), F.coalesce(F.bool_or("_veto"), F.lit(False)).alias("_v"), *first)
    return out.filter("_n = 1 AND NOT _v").drop("_n", "_v")


def _merged(name: str) -> Column:
    return F.when(F.count_distinct(name) == 1, F.min(name))


def conflict_merge(df: DataFrame, keys: Sequence[str], plain: Sequence[str], target: str, path: str, unknown: str = "Unknown") -> DataFrame:
    """Optional scalars of all rows reached: a conflict makes a plain one null, the target `unknown`, and the path null (also where the target conflicts); nulls don't count."""
    many = F.count_distinct(target) > 1
    return df.groupBy(*keys).agg(
        *[_merged(c).alias(c) for c in plain],
        F.when(many, F.lit(unknown)).otherwise(F.min(target)).alias(target),
        F.when(~many, _merged(path)).alias(path),
    )


def lattice_max(df: DataFrame, op: str, path: str, site: str, level: str) -> DataFrame:
    """(op, path, level): the greatest level over the sites of an op (0 always, 1 conditional, 2 undetermined); a path that a site lacks is conditional at least."""
    sites = df.groupBy(op).agg(F.count_distinct(site).alias("_all"))
    per = df.groupBy(op, path).agg(F.max(level).alias("_l"), F.count_distinct(site).alias("_n"))
    return per.join(sites, op).select(op, path, F.when(F.col("_n") < F.col("_all"), F.greatest("_l", F.lit(1))).otherwise(F.col("_l")).alias("level"))


def withdrawn(levels: DataFrame, op: str, path: str, unreadable: DataFrame, declared: DataFrame, opaque: DataFrame) -> DataFrame:
    """Final rules over lattice_max: any unreadable site makes all of its op's paths undetermined; a declared path that no site wrote is conditional, or undetermined where an opaque spread may have written it; an op without sites is undetermined."""
    bad, spread = (d.select(op).distinct().withColumn(n, F.lit(True)) for d, n in ((unreadable, "_bad"), (opaque, "_spread")))
    known = levels.select(op).distinct().withColumn("_known", F.lit(True))
    both = declared.select(op, path).distinct().join(levels, [op, path], "full_outer")
    both = both.join(bad, op, "left").join(spread, op, "left").join(known, op, "left")
    level = F.when(F.col("_bad") | F.col("_known").isNull(), 2).when(F.col("level").isNull(), F.when(F.col("_spread"), 2).otherwise(1)).otherwise(F.col("level"))
    return both.select(op, path, level.alias("level"))


def shape_merge(df: DataFrame, op: str, path: str, kind: str) -> DataFrame:
    """Shapes of one op as paths with a kind (leaf < object < array): the strongest kind of each path; what stands below a path that became a leaf goes. Path parts are joined by '/'."""
    rank = F.when(F.col(kind) == "array", 2).when(F.col(kind) == "object", 1).otherwise(0)
    per = df.groupBy(op, path).agg(F.max(F.struct(rank.alias("rank"), F.col(kind).alias("kind"))).alias("_k")).select(op, path, F.col("_k.kind").alias("kind"))
    up = F.when(F.instr(F.col(path), "/") > 0, F.regexp_replace(F.col(path), "/[^/]*$", ""))
    parent = per.select(F.col(op).alias("_o"), F.col(path).alias("_p"), F.col("kind").alias("_pk"))
    both = per.withColumn("_up", up).join(parent, (F.col(op) == F.col("_o")) & (F.col("_up") == F.col("_p")), "left")
    return both.filter(F.col("_up").isNull() | F.coalesce(F.col("_pk") != "leaf", F.lit(True))).select(op, path, "kind")


def value_if_all_equal(df: DataFrame, keys: Sequence[str], value: str, flag: Column | None = None) -> DataFrame:
    """(keys, value, any_flag): the value where all rows have the same one, null being a value; and whether any row is flagged."""
    agreed = (F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))) == 1
    flags = [] if flag is None else [F.bool_or(flag).alias("any_flag")]
    return df.groupBy(*keys).agg(F.when(agreed, F.min(value)).alias("value"), *flags)


def first_known(df: DataFrame, keys: Sequence[str], value: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, value columns): of the first row in order whose values are not all null; they are taken together."""
    known = F.coalesce(*[F.col(v).cast("string") for v in value]).isNotNull()
    got = df.groupBy(*keys).agg(F.min(F.when(known, F.struct(*order, *value))).alias("_x"))
    return got.select(*keys, *[F.col(f"_x.{v}").alias(v) for v in value])


def branch_fold(df: DataFrame, keys: Sequence[str], name: str, branch: str, read: Sequence[str], required: str) -> DataFrame:
    """(keys, name, read, required) over the branches of a key: required only if present and required in every branch; a name with two different reads is dropped for good."""
    all_ = df.groupBy(*keys).agg(F.count_distinct(branch).alias("_all"))
    reads = F.to_json(F.struct(*read))
    per = df.withColumn("_read", reads).groupBy(*keys, name).agg(F.count_distinct(branch).alias("_n"), F.min("_read").alias("_lo"), F.max("_read").alias("_hi"), F.bool_and(required).alias("_req"), *[F.min(r).alias(r) for r in read])
    out = per.filter("_lo = _hi").join(all_, list(keys))
    return out.select(*keys, name, *read, (F.col("_req") & (F.col("_n") == F.col("_all"))).alias("required"))


def in_every_branch(df: DataFrame, keys: Sequence[str], branch: str, what: Sequence[str]) -> DataFrame:
    """(keys, what): the constants that all branches of a key have."""
    all_ = df.groupBy(*keys).agg(F.count_distinct(branch).alias("_all"))
    per = df.groupBy(*keys, *what).agg(F.count_distinct(branch).alias("_n"))
    return per.join(all_, list(keys)).filter("_n = _all").select(*keys, *what)


def set_hash(df: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(keys, set_hash): sha256 of the sorted lines 'a:b', one for each row; repeated rows count."""
    line = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("set_hash"))


def members(df: DataFrame, keys: Sequence[str], member: str, name: str = "members") -> DataFrame:
    """(keys, members): sorted distinct members of each key, comma-joined."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias(name))


def agreeing_copies(df: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(keys, copies, versions): keys whose copies differ have more than one version."""
    body = F.to_json(F.struct(*parts))
    return df.groupBy(*keys).agg(F.count("*").alias("copies"), F.count_distinct(F.md5(body)).alias("versions"))


def histogram(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, keys: Sequence[str], col: str, values: Mapping[str, str]) -> DataFrame:
    """(keys, a count for each named value, other): fixed buckets."""
    each = [F.count_if(F.col(col) == v).alias(n) for n, v in values.items()]
    return df.groupBy(*keys).agg(*each, F.count_if(~F.coalesce(F.col(col).isin(*values.values()), F.lit(False))).alias("other"))


def distinct_key_count(df: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """(keys, n): distinct combinations of `parts`, nulls being values."""
    return df.select(*keys, *[p for p in parts if p not in keys]).distinct().groupBy(*keys).agg(F.count("*").alias("n"))


def error_kind(df: DataFrame, keys: Sequence[str], code: str, low: str, high: str) -> DataFrame:
    """(keys, kind): client_error if all known codes and band ends are 4xx, server_error if all are 5xx, else error."""
    rows = df.select(*keys, F.explode_outer(F.filter(F.array(code, low, high), lambda c: c.isNotNull())).alias("_c"))
    per = rows.groupBy(*keys).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    kind = F.when((F.col("_lo") >= 400) & (F.col("_hi") <= 499), "client_error").when((F.col("_lo") >= 500) & (F.col("_hi") <= 599), "server_error").otherwise("error")
    return per.select(*keys, kind.alias("kind"))


def uncovered(earlier: DataFrame, later: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Later integer bands that the union of the earlier bands of their key doesn't cover; a null end is open."""
    floor, ceil = F.lit(-(1 << 62)), F.lit(1 << 62)
    bands = earlier.select(*keys, F.coalesce(low, floor).alias("_a"), F.coalesce(high, ceil).alias("_b"))
    w = Window.partitionBy(*keys).orderBy("_a", "_b")
    reach = F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bands = bands.withColumn("_new", (reach.isNull() | (F.col("_a") > reach + 1)).cast("int"))
    bands = bands.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    isles = bands.groupBy(*keys, "_isle").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_isle")
    want = later.withColumns({"_lo": F.coalesce(low, floor), "_hi": F.coalesce(high, ceil)})
    same = [want[k].eqNullSafe(isles[k]) for k in keys]
    return want.join(isles, [*same, want["_lo"] >= isles["_a"], want["_hi"] <= isles["_b"]], "left_anti").drop("_lo", "_hi")


def gap_subtraction(counted: DataFrame, located: DataFrame, key: str) -> DataFrame:
    """(key, left): counted gaps less those that were located, where that isn't 0. A negative one is an error that `checks` reports."""
    n = located.groupBy(key).agg(F.count("*").alias("_m"))
    got = counted.groupBy(key).agg(F.count("*").alias("_n")).join(n, key, "left")
    return got.select(key, (F.col("_n") - F.coalesce("_m", F.lit(0))).alias("left")).filter(F.col("left") != 0)


def bit_positions(catalog: DataFrame, uses: DataFrame, keys: Sequence[str], int_valued: Column) -> DataFrame:
    """The catalog with `bit_position`: an int-valued entry of which any member is shifted anywhere."""
    shifted = uses.select(*keys).distinct().withColumn("_shifted", F.lit(True))
    return catalog.join(shifted, list(keys), "left").withColumn("bit_position", int_valued & F.coalesce("_shifted", F.lit(False))).drop("_shifted")
