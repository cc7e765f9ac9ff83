"""Line dedup by winnowing over line hashes.

The lines of a text that are not blank are hashed (normalised), each K
neighbouring lines form a gram, and of any W neighbouring grams the smallest is
selected as a fingerprint. So any run of K + W - 1 lines that two places share has
a fingerprint that both select. A line of LONG words or more is a fingerprint by
itself, so a long repeated passage that fills only a line or two is found as well.
Each fingerprint is joined with its earliest place in the corpus (by document id,
then place in the table, then position). A match is a repeat; it is extended both
ways, line by line, by at most K + W - 2 lines, as a longer run has a further
fingerprint that matches for itself. The lines of later runs are deleted.

A fingerprint carries the few line hashes around it, so extension needs no
second join and a passage that a third of the corpus shares is never paired with
itself: only the earliest place of each fingerprint is looked up. Where the
earliest place shares only the core of a run, short lines at the run's ends stay;
its long lines go.

Rows are told apart by their place in the table. Defined results: a null text has
no lines; a text of fewer than K lines that are not blank loses long lines at most;
repeated rows are further places, so one of them keeps its lines; documents without
id rank last; where a run repeats within one text and overlaps its first place, the
lines of the first place stay; a blank line is never deleted; an empty table gives
an empty result; further columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hashed, keyed, let, shuffled, skew_lookup, staged
from .linehash import normalised

K, W, LONG = 3, 2, 24


def line_hashes(text: Column) -> Column:
    """array<struct<line, h, n>> of the lines that are not blank: number in the text, hash, and words."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), normalised(x).alias("n")))
    return F.transform(F.filter(lines, lambda x: x["n"] != ""), lambda x: F.struct(x["line"].alias("line"), hashed(x["n"]).alias("h"), F.size(F.split(x["n"], " ")).alias("n")))


def fingerprints(lines: Column, k: int = K, w: int = W, long: int = LONG) -> Column:
    """array<struct<at, m, g, left, right>>: selected grams of m lines, and long lines, with the hashes of up to k + w - 2 lines on both sides, nearest first."""
    reach = k + w - 2
    gram = lambda hs, p: hashed(F.array_join(F.transform(F.slice(hs, p + 1, F.lit(k)), lambda h: h.cast("string")), ","))
    grams = lambda hs: F.when(F.size(hs) >= k, F.transform(F.sequence(F.lit(0), F.size(hs) - k), lambda p: gram(hs, p))).otherwise(F.array().cast("array<bigint>"))
    near = lambda g, p: F.slice(g, F.greatest(p - w + 2, F.lit(1)), F.least(p + 1, F.lit(w)))  # noqa: E731  the window that ends at p

    def picked(g: Column) -> Column:
        # The rightmost smallest gram of a window, as is usual; a text with fewer grams than a window has one window.
        ends = F.when(F.size(g) > 0, F.sequence(F.least(F.size(g), F.lit(w)) - 1, F.size(g) - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(ends, lambda p: p - F.array_position(F.reverse(near(g, p)), F.array_min(near(g, p))).cast("int") + 1))

    def of(hs: Column) -> Column:
        before = lambda p: F.reverse(F.slice(hs, F.greatest(p + 1 - reach, F.lit(1)), F.least(p, F.lit(reach))))
        after = lambda p, m: F.slice(hs, p + m + 1, F.lit(reach))
        one = lambda p, m, g: F.struct(p.alias("at"), F.lit(m).alias("m"), g.alias("g"), before(p).alias("left"), after(p, m).alias("right"))
        runs = let(grams(hs), lambda g: F.transform(picked(g), lambda p: one(p, k, F.get(g, p))))
        # One bit apart from those of grams, which are sums of other texts.
        alone = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["n"].alias("n"))), lambda x: x["n"] >= long), lambda x: one(x["i"], 1, F.get(hs, x["i"]).bitwiseXOR(F.lit(1 << 61))))
        return F.concat(runs, alone)

    return let(F.transform(lines, lambda x: x["h"]), of)


def _common(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _repeated(docs: DataFrame, file: str, row: str, k: int, w: int, long: int, doc_id: str, text: str) -> DataFrame:
    """(f, r, gone): for each text with later runs, the numbers of its lines that go, ascending."""
    base = docs.select(F.col(file).alias("f"), F.col(row).alias("r"), F.col(doc_id).alias("_id"), line_hashes(F.col(text)).alias("lines"))
    rows = base.filter(F.size("lines") > 0).select("f", "r", "_id", F.transform("lines", lambda x: x["line"]).alias("nums"), F.explode(fingerprints(F.col("lines"), k, w, long)).alias("x"))
    reach = k + w - 2
    rows = rows.select("f", "r", "_id", "x.*", F.slice("nums", F.greatest(F.col("x.at") + 1 - reach, F.lit(1)), F.lit(k + 2 * reach)).alias("near"))
    rows = staged(rows, "fingerprints")
    place = F.struct(F.col("_id").isNull().alias("last"), "_id", "f", "r", "at", "left", "right")
    firsts = rows.groupBy("g").agg(F.min(place).alias("first"), F.count("*").alias("cnt")).filter("cnt > 1")
    found = skew_lookup(rows, staged(firsts, "firsts"), "g", "cnt", rows.count(), ["first"], F.xxhash64(F.lit("none"), "f", "r", "at"))
    own = (F.col("f") == F.col("first.f")) & (F.col("r") == F.col("first.r"))
    found = found.filter(F.col("first").isNotNull() & ~(own & (F.col("at") == F.col("first.at"))))
    found = found.withColumn("l", _common(F.col("left"), F.col("first.left"))).withColumn("t", _common(F.col("right"), F.col("first.right")))
    low, high = F.col("at") - F.col("l"), F.col("at") + F.col("m") + F.col("t")  # of the lines that are not blank
    low = F.when(own, F.greatest(low, F.col("first.at") + F.col("m"))).otherwise(low)
    begin = F.greatest(F.col("at") - reach, F.lit(0))  # where `near` begins
    gone = F.when(high > low, F.slice("near", low - begin + 1, high - low)).otherwise(F.array().cast("array<int>"))
    per = found.select("f", "r", F.explode(gone).alias("line")).groupBy("f", "r").agg(F.array_sort(F.collect_set("line")).alias("gone"))
    return per.filter(F.size("gone") > 0)


def deduplicated(docs: DataFrame, k: int = K, w: int = W, long: int = LONG, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its columns with the lines that stay, `n_lines`: its lines before, and `gone`: numbers of the deleted lines (columns of these names give way)."""
    src, file, row = keyed(docs)
    f, r, gone = fresh(src, "_cut_file", "_cut_row", "_gone")
    per = staged(_repeated(src, file, row, k, w, long, doc_id, text).select(F.col("f").alias(f), F.col("r").alias(r), F.col("gone").alias(gone)), "runs")
    both = shuffled(src, per, [file, row], [f, r])
    stay = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n")
    left = F.when(F.size(gone) < F.size(F.split(F.col(text), "\n")), let(F.split(F.col(text), "\n"), stay)).otherwise(F.lit(""))
    kept = [F.when(F.col(gone).isNotNull(), left).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns if c.lower() not in ("gone", "n_lines")]
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n")))
    return both.select(*kept, lines.cast("long").alias("n_lines"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))


def op10_rows(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_gone, gone (numbers of deleted lines from 0, comma-joined), kept_sha256 (of the text that stays)."""
    got = deduplicated(docs)
    return got.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_gone"), F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("gone"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents),
n AS (SELECT doc_id, i - 1 AS line, trim(regexp_replace(lower(p[i]), '[\s\x00-\x20]+', ' ', 'g')) AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM d)),
a AS (SELECT doc_id, list(line ORDER BY line) AS nums, list(CAST('0x' || substr(md5(n), 1, 15) AS BIGINT) ORDER BY line) AS hs, list(len(string_split(n, ' ')) ORDER BY line) AS ns FROM n WHERE n <> '' GROUP BY doc_id),
g AS (SELECT doc_id, [CAST('0x' || substr(md5(hs[i] || ',' || hs[i + 1] || ',' || hs[i + 2]), 1, 15) AS BIGINT) FOR i IN range(1, len(hs) - 1)] AS gs FROM a WHERE len(hs) >= 3),
w AS (SELECT doc_id, gs, unnest(range(least(len(gs), 2) - 1, len(gs))) AS p FROM g),
f AS (SELECT DISTINCT doc_id, 3 AS m, CASE WHEN p = 0 OR gs[p + 1] <= gs[p] THEN p ELSE p - 1 END AS q, CASE WHEN p = 0 OR gs[p + 1] <= gs[p] THEN gs[p + 1] ELSE gs[p] END AS g FROM w
  UNION ALL SELECT doc_id, 1, p - 1, xor(hs[p], 2305843009213693952) FROM (SELECT doc_id, hs, ns, unnest(range(1, len(hs) + 1)) AS p FROM a) WHERE ns[p] >= 24),
n1 AS (SELECT *, min((doc_id, q)) OVER (PARTITION BY g) AS f FROM f),
x AS (SELECT n1.doc_id, n1.m, n1.q, n1.f[1] AS fd, n1.f[2] AS fa, a.nums, a.hs AS h, b.hs AS e FROM n1 JOIN a ON a.doc_id = n1.doc_id JOIN a b ON b.doc_id = n1.f[1] WHERE (n1.doc_id, n1.q) <> n1.f),
y AS (SELECT *, CASE WHEN NOT coalesce(q >= 1 AND fa >= 1 AND h[q] = e[fa], false) THEN 0 WHEN NOT coalesce(q >= 2 AND fa >= 2 AND h[q - 1] = e[fa - 1], false) THEN 1 WHEN NOT coalesce(q >= 3 AND fa >= 3 AND h[q - 2] = e[fa - 2], false) THEN 2 ELSE 3 END AS l,
  CASE WHEN NOT coalesce(h[q + m + 1] = e[fa + m + 1], false) THEN 0 WHEN NOT coalesce(h[q + m + 2] = e[fa + m + 2], false) THEN 1 WHEN NOT coalesce(h[q + m + 3] = e[fa + m + 3], false) THEN 2 ELSE 3 END AS r FROM x),
z AS (SELECT DISTINCT doc_id, unnest(nums[CASE WHEN doc_id = fd THEN greatest(q - l, fa + m) ELSE q - l END + 1:q + m + r]) AS line FROM y),
c AS (SELECT doc_id, count(*) AS n_gone, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS gone FROM z GROUP BY doc_id),
k AS (SELECT s.doc_id, string_agg(s.body, chr(10) ORDER BY s.line) AS kept FROM (SELECT doc_id, i - 1 AS line, p[i] AS body FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM d)) s LEFT JOIN z ON z.doc_id = s.doc_id AND z.line = s.line WHERE z.line IS NULL GROUP BY s.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.p), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_gone, coalesce(gone, '') AS gone, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
