"""Set and multiset comparison, closures and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _staged(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop by a table in the folder that the session names in spark.checkpoint.dir; a folder of this machine only where none is set in local mode."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"file://{tempfile.gettempdir()}/corbel-loops"
    path = f"{base.rstrip('/')}/corbel/{spark.sparkContext.applicationId}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def union_in_order(parts: Sequence[DataFrame], ord_name: str = "part") -> DataFrame:
    """All rows of the parts, with the number of their part."""
    out = parts[0].withColumn(ord_name, F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn(ord_name, F.lit(k)), allowMissingColumns=True)
    return out


def set_difference(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): distinct keys that only one side has, "removed" or "added"; one full outer join."""
    a = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    b = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys]).distinct().withColumn("_new", F.lit(True))
    both = a.join(b, [a[k].eqNullSafe(b[f"_n_{k}"]) for k in keys], "full_outer").filter("_old IS NULL OR _new IS NULL")
    return both.select(*[F.when(F.col("_old"), F.col(k)).otherwise(F.col(f"_n_{k}")).alias(k) for k in keys], F.when(F.col("_old"), "removed").otherwise("added").alias("side"))


def multiset_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_left, n_right): keys whose number of rows differs."""
    n = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return n.groupBy(*keys).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right")).filter("n_left <> n_right")


def multiset_report(left: DataFrame, right: DataFrame, key: str, samples: int = 3) -> DataFrame:
    """One row: whether both hold the same rows, how many are missing or extra, and up to `samples` of the smallest keys of each."""
    d = multiset_diff(left, right, [key])
    some = lambda test: F.array_join(F.slice(F.array_sort(F.collect_set(F.when(test, F.col(key).cast("string")))), 1, samples), ",")
    first = d.withColumn("_missing", F.col("n_left") > F.col("n_right"))
    top = first.orderBy("_missing", key)
    both = top.filter("_missing").limit(samples).unionByName(top.filter("NOT _missing").limit(samples))
    total = first.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0))), F.lit(0)).alias("extra"))
    shown = both.agg(some(F.col("_missing")).alias("missing_sample"), some(~F.col("_missing")).alias("extra_sample"))
    return total.crossJoin(shown).select((F.col("n") == 0).alias("equal"), "missing", "extra", "missing_sample", "extra_sample")  # one row by one row


def closure(edges: DataFrame, src: str, dst: str, most_steps: int | None = None) -> DataFrame:
    """(src, dst): all pairs that edges lead to, safe against cycles.

    Each round joins the pairs that are new with the pairs of the rounds before
    (with the edges alone, where steps are bounded) and keeps what is new again,
    until nothing is. So a path of n edges takes about log2 n rounds; only new
    pairs are written, and what is known is the union of those parts.
    """
    e = _staged(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    parts, fresh, step = [e], e, 1
    while (most_steps is None or step < most_steps) and fresh.limit(1).count():
        known = reduce(DataFrame.unionByName, parts)
        via = e if most_steps is not None else known
        hop = fresh.join(via.withColumnsRenamed({"a": "m", "b": "c"}), F.col("b") == F.col("m")).select("a", F.col("c").alias("b"))
        if most_steps is None:  # what is new may also be the second half of a path
            hop = hop.unionByName(known.join(fresh.withColumnsRenamed({"a": "m", "b": "c"}), F.col("b") == F.col("m")).select("a", F.col("c").alias("b")))
        fresh = _staged(hop.distinct().join(known, ["a", "b"], "left_anti"))
        parts.append(fresh)
        step += 1
    return reduce(DataFrame.unionByName, parts).select(F.col("a").alias(src), F.col("b").alias(dst))


def closure_with_paths(edges: DataFrame, src: str, dst: str, path: str) -> DataFrame:
    """(src, dst, path) with composed paths: "" is the identity, a path is prefixed by those before it, null can't be named and absorbs. A node that two different paths lead to has a null path, and is followed once more as such; at most two states of a pair exist, so it ends on cycles."""
    e = _staged(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.col(path).alias("p")))

    def settled(df: DataFrame) -> DataFrame:
        agreed = (F.count_distinct("p") + F.max(F.col("p").isNull().cast("int"))) == 1
        return df.groupBy("a", "b").agg(F.when(agreed, F.min("p")).alias("p"))

    known = _staged(settled(e))
    fresh = known
    while fresh.limit(1).count():
        nxt = e.withColumnsRenamed({"a": "m", "b": "c", "p": "q"})
        joined = F.when(F.col("p") == "", F.col("q")).when(F.col("q") == "", F.col("p")).otherwise(F.concat_ws("/", "p", "q"))
        hop = fresh.join(nxt, F.col("b") == F.col("m")).select("a", F.col("c").alias("b"), F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), joined).alias("p"))
        now = _staged(settled(known.unionByName(hop)))
        old = known.withColumnsRenamed({"a": "_a", "b": "_b", "p": "_p"})
        fresh = _staged(now.join(old, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & F.col("p").eqNullSafe(F.col("_p")), "left_anti"))
        known = now
    return known.select(F.col("a").alias(src), F.col("b").alias(dst), F.col("p").alias(path))


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): the smallest node that edges lead to, in either direction; by minima along edges and a pointer jump each round."""
    both = _staged(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(dst, src)).distinct())
    label = _staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        far = label.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = _staged(step.join(far, step["component"] == far["_n"]).select("node", "old", F.least("component", "_c").alias("component")))
        label = new.select("node", "component")
        if not new.filter("old <> component").limit(1).count():
            return label


def accumulated(rounds: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all rounds, the latest of each key: a later round's row replaces an earlier one."""
    return _latest(union_in_order(rounds, "_round"), keys)


def _latest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    from .dedup import first_wins

    return first_wins(df, list(keys), [F.desc("_round")]).drop("_round")


def fixed_point(start: DataFrame, step, keys: Sequence[str], most: int = 32) -> DataFrame:
    """Adds the rows of step(all so far) until a round adds no new key, or after `most` rounds."""
    known = _staged(start.dropDuplicates(list(keys)))
    for _ in range(most):
        new = _staged(step(known).dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti"))
        if not new.limit(1).count():
            break
        known = _staged(known.unionByName(new))
    return known
