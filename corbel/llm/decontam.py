"""Benchmark decontamination with DataFrame operations only.

A hash set of normalised test n-grams is broadcast (behind a check of its size,
which the benchmark alone decides; beyond it Spark chooses the join), token
windows of the training texts probe it, hits are verified word by word, and spans
or documents are removed.

A window of m words is found without probing at each position: of any m
neighbouring words of a text, one run of L = ceil(m / 2) words starts at a
multiple of k = m - L + 1. So every k-th run of L words of a text probes the set
of all runs of L words of the items. Texts are cut into pieces of PIECE words that
overlap by a window; a piece with a probe that matches is compared exactly at
every position right there, so no text is shuffled, and a very long text costs no
more a word than a short one.

Rows are told apart by their place in the table. Defined results: a null text has
no words, a null or wordless item has no window, an item without id marks words
but isn't listed, items that share an id count once, repeated rows of documents
give repeated rows, and further columns of either table don't matter, whatever
their names. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, keyed, let, shuffled, staged, words

#: Runs of word characters and of others, as they stand in a text.
_IS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_EDGE = r"(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])|(?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"

#: Words of a piece, without its overlap; hashes of the benchmark up to which their set is broadcast.
PIECE, BROADCAST_HASHES = 128, 2_000_000


def _run(array: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.slice(array, at + 1, F.lit(size)), F.lit(size))


def _starts(count: Column, size: int, step: int) -> Column:
    return F.when(count >= size, F.sequence(F.lit(0), count - size, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _runs(array: Column, size: int, step: int) -> Column:
    """Hashes of the runs of `size` words that start at each `step`-th word."""
    return F.transform(_starts(F.size(array), size, step), lambda p: _run(array, p, size))


def _spots(array: Column, m: int) -> Column:
    return F.transform(_starts(F.size(array), m, 1), lambda p: F.struct(p.alias("s"), F.lit(m).alias("m")))


def benchmark_windows(bench: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """(win, m, items): each distinct window, its number of words, and the ids of the items that have it."""
    items = bench.select(F.col(item_id).cast("string").alias("item"), words(ascii_lower(F.col(text))).alias("w"))
    items = items.withColumn("m", F.least(F.lit(n), F.size("w"))).filter("m > 0")
    at = F.sequence(F.lit(0), F.size("w") - F.col("m"))
    rows = items.select("item", "m", F.explode(F.transform(at, lambda p: F.array_join(F.slice("w", p + 1, F.col("m")), " "))).alias("win"))
    return rows.groupBy("win", "m").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _cover(spans: Column) -> Column:
    """Number of words under sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda a, x: F.struct(F.greatest(a["end"], x["s"] + x["m"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["s"] + x["m"] - F.greatest(a["end"], x["s"]))).alias("n")), lambda a: a["n"])


def _marks(base: DataFrame, bench: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """(f, r, spans, n_hit, items) of the documents with a hit; spans are array<struct<s, m>> in words."""
    spark = base.sparkSession
    win = staged(benchmark_windows(bench, n, item_id, text if text in bench.columns else "text"), "windows")
    sizes = sorted(r["m"] for r in win.select("m").distinct().collect())  # n values at most
    plans = [(m, (m + 1) // 2, m - (m + 1) // 2 + 1) for m in sizes]
    anchors = spark.createDataFrame([], "anchor bigint")
    for m, size, _ in plans:
        w = win.filter(F.col("m") == m).select(F.split("win", " ").alias("w"))
        anchors = anchors.union(w.select(F.explode(_runs(F.col("w"), size, 1))))
    anchors = staged(anchors.distinct(), "anchors")
    small = anchors.count() <= BROADCAST_HASHES
    known = lambda df: F.broadcast(df) if small else df

    # Cased as in the exact comparison: lower() of a letter may depend on what follows its word.
    low = base.select("f", "r", words(ascii_lower(F.col("t"))).alias("w")).filter(F.size("w") > 0)
    # A piece has PIECE starts of windows, and the words that the last of them needs. Steps of probes divide no piece, so each has its own.
    piece = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(PIECE)), lambda p: F.struct(p.alias("at"), F.slice("w", p + 1, F.lit(PIECE + n - 1)).alias("w")))
    pieces = low.select("f", "r", F.explode(piece).alias("p")).select("f", "r", "p.at", "p.w")
    probes = F.concat(F.array().cast("array<bigint>"), *[_runs(F.col("w"), size, step) for _, size, step in plans])
    # A probe carries its piece as one text, which is copied at a quarter of the cost of its words.
    seen = pieces.select("f", "r", "at", F.array_join("w", " ").alias("body"), F.explode(probes).alias("probe"))
    seen = seen.join(known(anchors), seen["probe"] == anchors["anchor"], "left_semi")
    maybe = seen.groupBy("f", "r", "at").agg(F.any_value("body").alias("body")).select("f", "r", "at", F.split("body", " ").alias("w"))
    spots = F.concat(F.array().cast("array<struct<s:int,m:int>>"), *[_spots(F.col("w"), m) for m in sizes])
    spot = maybe.select("*", F.explode(spots).alias("spot")).select("f", "r", F.struct((F.col("at") + F.col("spot.s")).alias("s"), F.col("spot.m").alias("m")).alias("spot"), F.array_join(F.slice("w", F.col("spot.s") + 1, F.col("spot.m")), " ").alias("run"))
    marks = spot.join(known(win), (spot["run"] == win["win"]) & (spot["spot.m"] == win["m"])).select("f", "r", "spot", "items")
    marks = marks.groupBy("f", "r").agg(F.array_sort(F.collect_set("spot")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return staged(marks.withColumn("n_hit", _cover(F.col("spans"))), "hits")


def contamination(docs: DataFrame, bench: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """A row for each document: _id, n_words, spans array<struct<s, m>> (in words), n_hit, items array<string>."""
    src, file, row = keyed(docs)
    base = src.select(F.col(file).alias("f"), F.col(row).alias("r"), F.col(doc_id).alias("_id"), F.col(text).alias("t"))
    marks = _marks(base, bench, n, item_id, text).withColumnsRenamed({"f": "f_", "r": "r_"})
    count = F.size(F.array_remove(F.split(F.coalesce("t", F.lit("")), _GAP), ""))
    out = shuffled(base.select("f", "r", "_id", count.cast("long").alias("n_words")), marks, ["f", "r"], ["f_", "r_"])
    return out.select("_id", "n_words", "spans", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "documents", n: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents without contaminated ones (mode "documents"), or without their hit words and what follows each (mode "spans")."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    src, file, row = keyed(docs)
    hits = _marks(src.select(F.col(file).alias("f"), F.col(row).alias("r"), F.col(text).alias("t")), bench, n, item_id, text)
    f, r, spans = fresh(src, "_hit_file", "_hit_row", "_spans")
    hits = hits.select(F.col("f").alias(f), F.col("r").alias(r), F.col("spans").alias(spans))
    if mode == "documents":
        return shuffled(src, hits, [file, row], [f, r], "left_anti").select(*docs.columns)
    both = shuffled(src, hits, [file, row], [f, r])
    # Word w is part first + 2 w; the gap after it goes with it. What lies between runs of hit words is kept.
    parts = F.split(F.col(text), _EDGE)
    first = F.when(F.element_at(parts, 1).rlike(f"^{_IS_WORD}"), 0).otherwise(1)
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["s"], x["s"] + x["m"] - 1)))))

    def between(w: Column) -> Column:
        starts = F.filter(w, lambda x, i: (i == 0) | (F.get(w, i - 1) < x - 1))
        ends = F.filter(w, lambda x, i: (i == F.size(w) - 1) | (F.get(w, i + 1) > x + 1))
        return F.transform(F.sequence(F.lit(0), F.size(starts)), lambda i: F.struct(F.coalesce(first + 2 * F.get(ends, i - 1) + 2, F.lit(0)).alias("a"), F.coalesce(first + 2 * F.get(starts, i), F.size(parts)).alias("b")))

    pieces = let(parts, lambda p: F.transform(let(hit, between), lambda g: F.array_join(F.slice(p, g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0))), "")))
    kept = F.array_join(pieces, "")
    cut = F.when(F.col(spans).isNull(), F.col(text)).otherwise(kept)
    return both.withColumn(text, cut).select(*docs.columns)


def op5_rows(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The contract's columns: a row for each document."""
    got = contamination(docs, bench)
    return got.select(F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT r, p, dw.m AS m, item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
