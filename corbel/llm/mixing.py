"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document's intensity is proportional to its
relative weight (1 if no weights are given), at the level at which the source's
intensities, none above the cap, add up to its target: the whole part is taken as
certain copies, the fraction f is its inclusion probability for one copy more.
Documents are ranked within their source by random odds over inclusion odds,
(U / (1 - U)) / (f / (1 - f)), and taken in this order until the words that are
left are filled: a sample of fixed size, in words. The last gap, below the size of
the next document, goes to the one remaining document whose size is nearest to it,
if that brings the source nearer to its target.

No source is sorted: the cut is searched in the histogram of the ranks, refined
until few documents stand at it, and then, among rows of equal rank, in that of a
hash of their places in the table; so a source with a third of all rows, or a row
that is repeated as often, costs a few counts. U comes from a hash of seed, id and
text, so reruns agree. Targets are worked out in one task, over one row a source.

Defined results: null texts have size 0; a null source is a source of its own,
last in order; a weight that is null counts as 1, a negative one as 0; documents of
size 0 are taken with the certain copies only; equal rows share their rank and
differ by copies only where the cut falls among them; an empty table gives an empty
result; further columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, hashed, keyed, shuffled, staged

#: Fixed value: what a word is, for sizes.
SIZE_WORD = r"[^\x20\x09-\x0D]+"
BINS, ROUNDS = 1024, 5  # 1024^5 steps are finer than the ranks are
CROSSING_ROWS = 20_000
#: Sources up to which a row for each is broadcast; sources don't grow with documents as a rule, and are counted.
BROADCAST_SOURCES = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, total: float | None = None) -> DataFrame:
    """(source, source_size, target): shares of `total` (all sizes) by weights that repeat in order of sources, null last; no target exceeds cap x size, the excess is reshared by weight.

    Sources are filled in order of cap x size / weight: those that come before
    the level at which the rest is shared are full. One row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")))
    per = per.withColumn("room", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = F.sum("source_size").over(everything).cast("double") if total is None else F.lit(float(total))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left_over", whole - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left_over") / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("room")).otherwise(F.least("room", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", F.greatest(F.lit(0.0), target).alias("target"))


def _by_source(rows: DataFrame, per: DataFrame, small: bool, how: str = "left") -> DataFrame:
    """Rows with the columns of their source, of which there is one row; null is a source. `small`: there are counted to be few sources."""
    source = fresh(per, "_src")[0]
    per = per.withColumnRenamed("source", source)
    return rows.join(F.broadcast(per) if small else per, rows["source"].eqNullSafe(F.col(source)), how).drop(source)


def _levels(slim: DataFrame, per: DataFrame, cap: float, small: bool) -> DataFrame:
    """(source, source_size, target, level): the factor of the weights at which the intensities, none above the cap, fill the target.

    What documents at the cap can't take goes to the others, in rounds; a round
    adds documents to those at the cap, or is the last.
    """
    mass = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("w")).alias("mass"), F.max("w").alias("top"))
    per = _by_source(per, mass, small).withColumn("level", F.coalesce(F.try_divide("target", "mass"), F.lit(0.0))).drop("mass")
    per = staged(per, "levels")
    while per.filter((F.col("level") * F.col("top") > cap) & (F.col("level") > 0)).limit(1).count():
        at = _by_source(slim.select("source", "size", "w"), per.select("source", "level"), small, "inner")
        full = F.col("w") * F.col("level") >= cap
        left = at.groupBy("source").agg(F.sum(F.when(full, F.col("size")).otherwise(0)).alias("stuck"), F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("w"))).alias("mass"))
        level = F.greatest("level", F.coalesce(F.try_divide(F.col("target") - cap * F.col("stuck"), F.col("mass")), F.lit(0.0)))
        new = staged(_by_source(per.withColumnRenamed("level", "old"), left, small).withColumnRenamed("old", "level").withColumn("next", level), "levels")
        moved = new.filter(F.col("next") > F.col("level") * (1 + 1e-12)).limit(1).count()
        per = new.select("source", "source_size", "target", "top", F.col("next").alias("level"))
        if not moved:
            break
    return per.drop("top")


def _narrowed(rows: DataFrame, cut: DataFrame, by: str, small: bool) -> DataFrame:
    """The cut of each source, (source, need, lo, hi, below, n), narrowed to a range of `by` with few documents: need words are met in [lo, hi), below words stand before it."""
    for k in range(ROUNDS):
        if k and not cut.filter(F.col("n") > CROSSING_ROWS).limit(1).count():
            break
        inside = _by_source(rows, cut.drop("n", "need", "below"), small, "inner").filter(f"{by} >= lo AND {by} < hi")
        inside = inside.withColumn("bin", F.least(F.floor((F.col(by) - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int"))
        hist = inside.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        hist = hist.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        hist = hist.withColumn("last", F.col("bin") == F.max("bin").over(Window.partitionBy("source")))
        hist = _by_source(hist, cut.drop("n"), small, "inner")
        # the bin in which the need is met, or the last one
        pick = hist.filter((F.col("below") + F.col("upto") >= F.col("need")) | F.col("last")).groupBy("source").agg(F.min(F.struct("bin", "upto", "words", "docs", "need", "lo", "hi", "below")).alias("x"))
        width = (F.col("x.hi") - F.col("x.lo")) / BINS
        cut = staged(pick.select("source", F.col("x.need").alias("need"), (F.col("x.lo") + F.col("x.bin") * width).alias("lo"), (F.col("x.lo") + (F.col("x.bin") + 1) * width).alias("hi"), (F.col("x.below") + F.col("x.upto") - F.col("x.words")).alias("below"), F.col("x.docs").alias("n")), "cut")
    return cut


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, total: float | None = None, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight_col: str | None = None) -> DataFrame:
    """A row for each document: f and r (its place in the table), _id, source, size, source_size, target, copies, taken."""
    return _mix(*keyed(docs), weights, cap, total, seed, doc_id, text, source, weight_col)


def _mix(docs: DataFrame, file: str, row: str, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, total: float | None = None, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight_col: str | None = None) -> DataFrame:
    own = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    u = (hashed(name, 13) + 0.5) / F.lit(float(1 << 52))
    tie = (F.pmod(F.xxhash64(file, row), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    slim = docs.select(F.col(file).alias("f"), F.col(row).alias("r"), F.col(doc_id).alias("_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), own.alias("w"), u.alias("u"), tie.alias("tie"))
    slim = staged(slim, "sizes")
    per = staged(source_targets(slim, weights, cap, total), "targets")
    small = per.count() <= BROADCAST_SOURCES
    per = _levels(slim, per, cap, small)
    rows = _by_source(slim, per, small)
    rows = rows.withColumn("rate", F.coalesce(F.least(F.lit(float(cap)), F.col("w") * F.col("level")), F.lit(0.0))).withColumn("whole", F.floor("rate").cast("long"))
    rows = rows.withColumn("p", F.col("rate") - F.col("whole"))
    # The rank as a number below 1: q / (1 + q), q the random odds over the inclusion odds.
    odds = F.col("u") * (1 - F.col("p"))
    rows = rows.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (odds + (1 - F.col("u")) * F.col("p"))))
    rows = staged(rows.drop("u", "p", "rate", "level", "w"), "ranked")

    need = rows.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.count("rank").alias("n"))
    span = lambda lo, hi: (F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    cut = staged(need.select("source", (F.col("target") - F.col("sure")).alias("need"), *span(0.0, 1.0), F.lit(0).cast("long").alias("below"), "n"), "cut")
    cut = _narrowed(rows.select("source", "size", "rank"), cut, "rank", small)
    # Rows of equal rank, as repeated ones have, are told apart by their places.
    inside = _by_source(rows, cut.select("source", F.col("lo").alias("rank_lo"), F.col("hi").alias("rank_hi")), small).withColumn("at_cut", F.coalesce((F.col("rank") >= F.col("rank_lo")) & (F.col("rank") < F.col("rank_hi")), F.lit(False)))
    many = cut.filter(F.col("n") > CROSSING_ROWS)
    fine = _narrowed(inside.filter("at_cut").select("source", "size", "tie"), many.select("source", "need", *span(0.0, 1.0), "below", "n"), "tie", small) if many.limit(1).count() else many
    fine = fine.select("source", F.col("lo").alias("tie_lo"), F.col("hi").alias("tie_hi"), F.col("below").alias("tie_below"))
    edge = _by_source(cut.select("source", "need", "below"), fine, small).select("source", "need", F.coalesce("tie_below", "below").alias("below"), "tie_lo", "tie_hi")
    inside = _by_source(inside, edge, small)
    narrow = F.col("at_cut") & (F.col("tie_lo").isNull() | ((F.col("tie") >= F.col("tie_lo")) & (F.col("tie") < F.col("tie_hi"))))
    before = F.coalesce(F.col("rank") < F.col("rank_lo"), F.lit(False)) | (F.col("at_cut") & F.coalesce(F.col("tie") < F.col("tie_lo"), F.lit(False)))
    inside = inside.withColumns({"narrow": narrow, "before": before}).drop("rank_lo", "rank_hi", "tie_lo", "tie_hi", "at_cut")
    inside = staged(inside, "at-the-cut")
    # At most CROSSING_ROWS of a source, but for rows whose ranks and places can't be told apart.
    order = Window.partitionBy("source").orderBy("rank", "_id", "tie", "f", "r").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.filter("narrow").withColumn("upto", F.col("below") + F.sum("size").over(order))
    fits = ranked.filter("upto <= need").select("f", "r", "upto", "source")
    filled = _by_source(edge.select("source", "need", "below"), fits.groupBy("source").agg(F.max("upto").alias("filled")), small)
    gaps = filled.select("source", (F.col("need") - F.coalesce("filled", "below")).alias("gap"))
    fits = fits.select(F.col("f").alias("fit_f"), F.col("r").alias("fit_r"))
    rows = inside.join(fits, (inside["f"] == fits["fit_f"]) & (inside["r"] == fits["fit_r"]), "left")
    rows = _by_source(rows.withColumn("extra", F.when(F.col("before") | F.col("fit_f").isNotNull(), 1).otherwise(0)).drop("fit_f", "fit_r"), gaps, small)
    rows = staged(rows, "taken")
    # One more document where it brings the source nearer; ties by rank, then id.
    able = rows.filter((F.col("extra") == 0) & (F.col("whole") < cap) & (F.col("size") > 0) & (F.abs(F.col("size") - F.col("gap")) < F.abs("gap")))
    close = able.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("d"), F.coalesce("rank", F.lit(2.0)).alias("k"), "_id", "f", "r")).alias("x"))
    close = close.select(F.col("x.f").alias("close_f"), F.col("x.r").alias("close_r"))  # one a source
    rows = rows.join(close, (rows["f"] == close["close_f"]) & (rows["r"] == close["close_r"]), "left")
    copies = (F.col("whole") + F.col("extra") + F.when(F.col("close_f").isNotNull(), 1).otherwise(0)).cast("long")
    return rows.select("f", "r", "_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: documents, each row as often as it is taken."""
    src, file, row = keyed(docs)
    f, r, times = fresh(src, "_mix_file", "_mix_row", "_times")
    got = _mix(src, file, row, **how).filter("copies > 0").select(F.col("f").alias(f), F.col("r").alias(r), F.col("copies").alias(times))
    got = staged(got, "copies")
    both = shuffled(src, got, [file, row], [f, r], "inner")
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(times)).select(*docs.columns)


def op1_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns, and source and copies."""
    return mix(docs).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  (CAST('0x' || substr(md5('7:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS weight FROM d GROUP BY source),
t AS (SELECT *, 3.0::DOUBLE * source_size AS room, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
v AS (SELECT *, (total - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
x AS (SELECT *, max(CASE WHEN level * weight <= room THEN level END) OVER () AS lv FROM v),
g AS (SELECT source, source_size, greatest(0.0::DOUBLE, CASE WHEN lv IS NULL THEN room ELSE least(room, lv * weight) END) AS target FROM x),
r AS (SELECT d.*, source_size, target, coalesce(least(3.0::DOUBLE, target / nullif(CAST(source_size AS DOUBLE), 0)), 0.0::DOUBLE) AS rate FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
f AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS f FROM r),
q AS (SELECT *, CASE WHEN f > 0 AND size > 0 THEN u * (1 - f) / (u * (1 - f) + (1 - u) * f) END AS rank, target - sum(whole * size) OVER (PARTITION BY source) AS need FROM f),
c AS (SELECT *, CASE WHEN rank IS NOT NULL AND sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) <= need THEN 1 ELSE 0 END AS extra FROM q),
e AS (SELECT *, need - sum(extra * size) OVER (PARTITION BY source) AS gap FROM c),
o AS (SELECT *, extra = 0 AND whole < 3 AND size > 0 AND abs(size - gap) < abs(gap) AS able FROM e),
p AS (SELECT *, able AND row_number() OVER (PARTITION BY source, able ORDER BY abs(size - gap), coalesce(rank, 2.0), doc_id) = 1 AS closing FROM o)
SELECT doc_id, size, source_size, target, source, CAST(whole + extra + CASE WHEN closing THEN 1 ELSE 0 END AS BIGINT) AS copies, CAST((whole + extra + CASE WHEN closing THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p
"""
