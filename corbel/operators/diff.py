"""Keyed comparison of two snapshots, with stable ids of changes, and reviews of them.

Documents are rows (domain, collection, idx, item) with the item as JSON text.
Items meet by an identity; two items of one identity are walked key by key,
arrays being compared as a whole, so that each change is a row. An identity that
either side has more than once is compared as an ordered group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an assessment of a change may be.
CLASSES = ("upstream-change", "extraction-improvement", "extraction-loss", "indeterminate")
SKIPPED = ("schemaVersion", "waVersion")


class _ABSENT:  # a class, so that it stays itself in other processes
    """What an object doesn't have."""




def pointer_escape(key: Column) -> Column:
    """A key as a part of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def canonical(value) -> str:
    """JSON with sorted keys; 1 and 1.0 stay different, as do null and absent."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def tree_changes(old, new, path: str = "") -> Iterator[tuple[str, str, str | None, str | None]]:
    """(pointer, kind, before, after) of all differences of two JSON values; an array or a scalar that differs is one change."""
    if old is _ABSENT or new is _ABSENT:
        if old is not new:
            yield path, "added" if old is _ABSENT else "removed", None if old is _ABSENT else canonical(old), None if new is _ABSENT else canonical(new)
    elif isinstance(old, dict) and isinstance(new, dict):
        for key in sorted(old.keys() | new.keys()):
            part = key.replace("~", "~0").replace("/", "~1")
            if path or key not in SKIPPED:
                yield from tree_changes(old.get(key, _ABSENT), new.get(key, _ABSENT), f"{path}/{part}")
    elif canonical(old) != canonical(new):
        yield path, "changed", canonical(old), canonical(new)


def change_id(parts: Mapping) -> str:
    """sha256 of the change's canonical JSON."""
    return hashlib.sha256(canonical(dict(parts)).encode()).hexdigest()


def keyed_diff(old: DataFrame, new: DataFrame, identity: Column, domain: str = "domain", collection: str = "collection", idx: str = "idx", item: str = "item") -> DataFrame:
    """(domain, collection, identity, pointer, kind, before, after, id) of all changes between two snapshots.

    The sides are grouped by identity and joined as one union, so that each
    identity is one row with its items of both sides in order. An identity is
    expected to be unique; what repeats is compared in order.
    """
    sides = [df.select(domain, collection, identity.cast("string").alias("identity"), F.lit(k).alias("side"), idx, item) for k, df in enumerate((old, new))]
    rows = sides[0].unionByName(sides[1])
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct(idx, item)))), lambda x: x[item])
    both = rows.groupBy(domain, collection, "identity").agg(of(0).alias("old"), of(1).alias("new"))
    both = both.filter(~F.col("old").eqNullSafe(F.col("new")))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = [json.loads(x) for x in r.old], [json.loads(x) for x in r.new]
                if len(a) <= 1 and len(b) <= 1:
                    changes = tree_changes(a[0] if a else _ABSENT, b[0] if b else _ABSENT)
                else:
                    changes = [("", "changed", canonical(a), canonical(b))] if canonical(a) != canonical(b) else []
                for pointer, kind, before, after in changes:
                    parts_ = {"domain": r.domain, "collection": r.collection, "identity": r.identity, "pointer": pointer, "kind": kind, "before": before, "after": after}
                    out.append((*parts_.values(), change_id(parts_)))
            yield pd.DataFrame(out, columns=["domain", "collection", "identity", "pointer", "kind", "before", "after", "id"])

    both = both.select(F.col(domain).alias("domain"), F.col(collection).alias("collection"), "identity", "old", "new")
    return both.mapInPandas(walk, "domain string, collection string, identity string, pointer string, kind string, before string, after string, id string")


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, kind, before, after) for flat tables: one full outer join and an unpivot, all in the engine."""
    text = lambda c: F.col(c).cast("string")
    a = old.select(F.col(key).alias("_a"), *[text(f).alias(f"_a_{f}") for f in fields])
    b = new.select(F.col(key).alias("_b"), *[text(f).alias(f"_b_{f}") for f in fields])
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").alias("before"), F.col(f"_b_{f}").alias("after")) for f in fields])
    moved = F.filter(cells, lambda c: ~c["before"].eqNullSafe(c["after"]))
    return both.select(F.coalesce("_a", "_b").alias(key), kind.alias("kind"), F.explode(moved).alias("c")).select(key, "kind", "c.*")


def reviewed(changes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Changes with the classification of their review, "unreviewed" without one. A review of an unknown id, a second one of an id, or an unknown class is an error."""
    unknown = reviews.join(changes.select("id").distinct(), "id", "left_anti").select("id", F.lit("unknown change").alias("why"))
    twice = reviews.groupBy("id").count().filter("count > 1").select("id", F.lit("reviewed twice").alias("why"))
    label = reviews.filter(~F.coalesce(F.col("classification").isin(*CLASSES), F.lit(False))).select("id", F.lit("unknown classification").alias("why"))
    bad = unknown.unionByName(twice).unionByName(label).orderBy("id", "why").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r.id}: {r.why}" for r in bad))
    r = reviews.select(F.col("id").alias("_id"), "classification")
    return changes.join(r, changes["id"] == r["_id"], "left").select(*changes.columns, F.coalesce("classification", F.lit("unreviewed")).alias("classification"))


def classification_counts(reviewed_changes: DataFrame) -> DataFrame:
    return reviewed_changes.groupBy("classification").agg(F.count("*").alias("n"))


def owner_of_pointer(changes: DataFrame, owners: DataFrame) -> DataFrame:
    """Changes with the nearest owner above their pointer: owners(prefix, owner)."""
    from .lookup import longest_prefix

    return longest_prefix(changes, "pointer", owners, "prefix", "owner")
