"""Substring dedup by hashing lines, and pieces of lines for passages within them.

Lines are normalised (lower case, runs of white space as one blank, ends trimmed)
and digested; digests are grouped over the whole corpus, the occurrence that ranks
first (by document id, then place in the table, then position) is kept, and a line
of `least` words or more goes wherever else it stands.

A copied passage often stands within longer lines, so a second pass works on
pieces of lines in the same way. A line is cut after the word whose value is
smallest among any WINDOW neighbouring ones (the last of equal ones); the value
depends on the word and the three after it alone, so a passage is cut alike wherever
it stands, and a piece has WINDOW words at most (the last of a line GRAM - 1 more).
Pieces of later occurrences are removed where they make a run of `run` words or
more. Of a passage of n words at least n - 2 * WINDOW - GRAM + 2 are in pieces that
all its occurrences share, so each passage of over 50 words is found, wherever it
stands; at most WINDOW + GRAM - 1 words stay at each of its ends. Shorter repeats, as
headings, list items and common phrases are, stay.

Removed spans keep the offsets that they had in the original text, in code points,
end exclusive; white space goes with the words before it.

Rows are told apart by their place in the table. Defined results: a null text has
no units; repeated rows are further occurrences, so that one row keeps its units;
documents without id rank last; what a text repeats of itself goes too, but for its
first place; an empty table gives an empty result; further columns, whatever their
names, are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import fresh, keyed, shuffled, skew_lookup, staged

#: Words from which a whole line, and a run of pieces, counts as copied; words of a window, and those that the value of one depends on.
LEAST, RUN, WINDOW, GRAM = 10, 16, 16, 4
PASSAGE = 50 - WINDOW
#: Rows and megabytes of a batch: a unit takes some hundred bytes while a batch is read.
BATCH = (256, 2)
_WORD = re.compile(r"[^\x00-\x20]+")
_LAST = (1 << 63) - 1
#: What a unit is: a piece, a line that is one piece, a line of several pieces.
PIECE, LINE, WHOLE = 0, 1, 2


def normalised(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"[\s\x00-\x20]+", " "))


def _words_at(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    ink = np.concatenate([[False], points > 0x20, [False]])
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    return edge[::2], edge[1::2]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _cuts(value: np.ndarray, line: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest value of each window within a line, the last of equal ones."""
    out = []
    for a in range(0, len(value) - window + 1, 1 << 18):
        v = np.lib.stride_tricks.sliding_window_view(value[a : a + (1 << 18) + window - 1], window)
        at = a + np.arange(len(v))
        pick = at + window - 1 - v[:, ::-1].argmin(1)
        out.append(np.unique(pick[line[at] == line[at + window - 1]]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def units(texts: list[str], least: int = LEAST, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of some texts, in order: text, kind, words before and up to its end (in all texts), start and end in its text."""
    low = _points("\n".join(t.lower() for t in texts))
    start, end = _words_at(low)
    n = len(start)
    if not n:
        return (np.zeros(0, np.int64),) * 6
    at, _ = _words_at(_points("\n".join(texts)))
    line = np.cumsum(low == 10)[start]
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    doc = np.searchsorted(base, at, "right") - 1
    value = 7 * (end - start) + 3 * low[start].astype(np.int64) + 5 * low[end - 1].astype(np.int64)
    full = np.flatnonzero(line[GRAM - 1 :] == line[: n - GRAM + 1]) if n >= GRAM else np.zeros(0, np.int64)
    mixed = np.zeros(len(full), np.uint64)
    for k in range(GRAM):
        mixed = (mixed * np.uint64(1000003) + value[full + k].astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    mixed = mixed * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)
    last = np.append(line[1:] != line[:-1], True)
    stop = last.copy()
    stop[full[_cuts(mixed, line[full], window)]] = True
    b = np.flatnonzero(stop) + 1
    a = np.append(0, b[:-1])
    lb = np.flatnonzero(last) + 1
    la = np.append(0, lb[:-1])
    # Units tile their text: the first begins at 0, each ends where the next one begins.
    head = np.append(True, doc[1:] != doc[:-1])
    begin = np.where(head, 0, at - base[doc])
    after = np.append(np.where(head[1:], sizes[doc[:-1]], begin[1:]), sizes[doc[-1]])
    kind = np.where(np.isin(a, la) & np.isin(b, lb) & last[b - 1] & (np.searchsorted(la, a) == np.searchsorted(lb, b)), LINE, PIECE)
    many = (lb - la >= least) & ~np.isin(la, a[kind == LINE])
    a, b, kind = np.append(a, la[many]), np.append(b, lb[many]), np.append(kind, np.full(many.sum(), WHOLE))
    turn = np.lexsort((kind, a))
    a, b, kind = a[turn], b[turn], kind[turn]
    return doc[a], kind, a, b, begin[a], after[b - 1]


def _reader(least: int):
    """Rows (f, r, rank, dg, mark, span, again): a digest for each unit; mark packs 32 more bits of it, the kind and the words; again: the text has had it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            full = [k for k, t in enumerate(texts) if t is not None]
            texts = [texts[k] for k in full]
            doc, kind, a, b, s, e = units(texts, least)
            words = [w for t in texts for w in _WORD.findall(t.lower())]
            digest = xxhash.xxh3_128_intdigest
            made = [digest(("\n" if k == WHOLE else "") + " ".join(words[i:j])) for i, j, k in zip(a.tolist(), b.tolist(), kind.tolist(), strict=True)]
            high = np.array([d >> 64 for d in made], np.uint64)
            check = np.array([d & 0xFFFFFFFF for d in made], np.int64)
            order = np.lexsort((high, doc))  # stable: the first of equal ones stays first
            again = np.zeros(len(made), bool)
            again[order[1:]] = (doc[order][1:] == doc[order][:-1]) & (high[order][1:] == high[order][:-1])
            mark = (check << 26) | (kind.astype(np.int64) << 24) | np.minimum(b - a, (1 << 24) - 1)
            rows = pa.array(np.array(full, np.int32)[doc] if len(doc) else np.zeros(0, np.int32))
            columns = [*(batch.column(k).take(rows) for k in ("f", "r", "rank")), pa.array(high.view(np.int64)), pa.array(mark.astype(np.int64)), pa.array((s.astype(np.int64) << 32) | e), pa.array(again)]
            yield pa.RecordBatch.from_arrays(columns, ["f", "r", "rank", "dg", "mark", "span", "again"])

    return run


def _joiner(least: int, least_run: int):
    """Of the units of a text that others have before it: the spans that go, neighbours as one, with their words and the rank of the first one's earliest place. All texts of a batch at once, without a Python object for a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            units_of = found.flatten()
            sizes = np.diff(np.asarray(found.offsets))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            span, mark = (np.asarray(units_of.field(k)) for k in ("span", "mark"))
            s, e, kind, w = span >> 32, span & 0xFFFFFFFF, mark >> 24 & 3, mark & 0xFFFFFF
            # Pieces in order, in runs of neighbours.
            p = np.flatnonzero(kind != WHOLE)
            p = p[np.lexsort((s[p], doc[p]))]
            new = np.append(True, (doc[p][1:] != doc[p][:-1]) | (s[p][1:] != e[p][:-1])) if len(p) else np.zeros(0, bool)
            chain = np.cumsum(new) - 1
            words = np.bincount(chain, w[p]) if len(p) else np.zeros(0)
            p = p[(words[chain] >= least_run) | ((kind[p] == LINE) & (w[p] >= least))]
            go = np.append(p, np.flatnonzero((kind == WHOLE) & (w >= least)))
            go = go[np.lexsort((-e[go], s[go], doc[go]))]
            if len(go):
                # Pieces of a line that goes as a whole are in it already: units are nested or apart.
                top = np.maximum.accumulate(e[go] + (doc[go].astype(np.int64) << 32))
                go = go[np.append(True, e[go][1:] + (doc[go][1:].astype(np.int64) << 32) > top[:-1])]
            head = np.append(True, (doc[go][1:] != doc[go][:-1]) | (s[go][1:] != e[go][:-1])) if len(go) else np.zeros(0, bool)
            at = np.flatnonzero(head)
            last = np.append(at[1:], len(go)) - 1
            total = np.add.reduceat(w[go], at) if len(at) else np.zeros(0, np.int64)
            first = units_of.field("first").take(pa.array(go[at]))
            fields = [pa.array(s[go[at]].astype(np.int32)), pa.array(e[go[last]].astype(np.int32)), pa.array(total.astype(np.int32)), first]
            offsets = np.append(0, np.cumsum(np.bincount(doc[go[at]], minlength=len(sizes)))).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["s", "e", "w", "first"]))
            yield pa.RecordBatch.from_arrays([batch.column("f"), batch.column("r"), spans], ["f", "r", "spans"])

    return run


def _removed(docs: DataFrame, file: str, row: str, least: int, least_run: int, doc_id: str, text: str) -> DataFrame:
    """(f, r, removed): for each text that loses something, array<struct<s, e, w, first_id>>, ascending."""
    id_type = dict(docs.dtypes)[doc_id]
    whole = id_type in ("bigint", "int", "smallint", "tinyint")
    # A number ranks as it is, anything else with a mark for null.
    rank = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)) if whole else F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"))
    rank_type = "bigint" if whole else f"struct<last:boolean,id:{id_type}>"
    back = lambda c: F.when(c != _LAST, c).cast(id_type) if whole else c["id"]
    rows = docs.select(F.col(file).alias("f"), F.col(row).alias("r"), rank.alias("rank"), F.col(text).alias("t")).filter("t IS NOT NULL")
    twins = rows.groupBy("rank").count().filter("count > 1").limit(1)
    rows = rows.mapInArrow(_reader(least), f"f bigint, r bigint, rank {rank_type}, dg bigint, mark bigint, span bigint, again boolean")
    rows = staged(rows, "units", BATCH)
    every = rows.filter("NOT again").drop("again")
    check = F.shiftrightunsigned("mark", 26)
    rows = rows.withColumn("mark", F.col("mark").bitwiseAND(F.lit((1 << 26) - 1)))  # the kind and the words
    once = rows.filter("NOT again").drop("again")
    firsts = every.groupBy("dg").agg(F.min("rank").alias("first"), F.count("*").alias("cnt"), F.min(check).alias("c1"), F.max(check).alias("c2"))
    firsts = staged(firsts.filter("cnt > 1 AND c1 = c2").select("dg", "first", "cnt"), "firsts")  # 96 bits are equal
    total = once.count()
    salt = F.xxhash64(F.lit("none"), "f", "r", "span")
    found = skew_lookup(once, firsts, "dg", "cnt", total, ["first"], salt).filter("first IS NOT NULL")
    if not twins.count():
        later = found.filter("rank <> first")
    else:
        # Rows of one rank (without id, or with the same) go by their places.
        found = staged(found, "found")
        tied = found.filter("rank = first")
        low = tied.groupBy("dg").agg(F.min(F.struct("f", "r")).alias("low"), F.count("*").alias("cnt")).filter("cnt > 1")
        tied = skew_lookup(tied, staged(low, "ties"), "dg", "cnt", total, ["low"], salt).filter("low IS NOT NULL AND struct(f, r) <> low").drop("low")
        later = found.filter("rank <> first").unionByName(tied)
    later = later.select("f", "r", "mark", "span", "first").unionByName(rows.filter("again").select("f", "r", "mark", "span", F.col("rank").alias("first")))
    per = later.groupBy("f", "r").agg(F.collect_list(F.struct("mark", "span", "first")).alias("found"))
    got = staged(per.mapInArrow(_joiner(least, least_run), f"f bigint, r bigint, spans array<struct<s:int,e:int,w:int,first:{rank_type}>>"), "spans", BATCH)
    spans = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["w"].alias("w"), back(x["first"]).alias("first_id")))
    return got.filter(F.size("spans") > 0).select("f", "r", spans.alias("removed"))


@F.pandas_udf(StringType())
def _without(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for t, a, b in zip(text, starts, ends, strict=True):
        if t is None:
            out.append(None)
            continue
        out.append("".join(t[i:j] for i, j in zip([0, *b], [*a, len(t)], strict=True)))
    return pd.Series(out, dtype=object)


def deduplicated(docs: DataFrame, least: int = LEAST, least_run: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its columns with the text that is kept, and `removed`: array<struct<s, e, w, first_id>> with offsets in the original text (a column of this name gives way)."""
    src, file, row = keyed(docs)
    f, r, cut = fresh(src, "_cut_file", "_cut_row", "_cut")
    per = _removed(src, file, row, least, least_run, doc_id, text).select(F.col("f").alias(f), F.col("r").alias(r), F.col("removed").alias(cut))
    both = shuffled(src, staged(per, "removed"), [file, row], [f, r])
    at = lambda name: F.transform(cut, lambda x: x[name])
    # Only texts that lose something go to Python.
    kept = _without(F.when(F.col(cut).isNotNull(), F.col(text)), at("s"), at("e"))
    none = F.array().cast(per.schema[cut].dataType)
    both = both.select(*[c for c in docs.columns if c not in (text, "removed")], F.when(F.col(cut).isNotNull(), kept).otherwise(F.col(text)).alias(text), F.coalesce(cut, none).alias("removed"))
    return both.select(*[c for c in docs.columns if c != "removed"], "removed")


def op8_rows(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_removed (spans), n_passages (those of PASSAGE words or more: what a passage of over 50 words leaves, but for its ends), removed (start:end:first doc_id, comma-joined, original offsets in code points), kept_sha256 (of the text that is kept)."""
    got = deduplicated(docs)
    text = F.transform("removed", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"), F.coalesce(x["first_id"].cast("string"), F.lit(""))))
    long = F.size(F.filter("removed", lambda x: x["w"] >= PASSAGE))
    return got.select("doc_id", F.size("removed").cast("long").alias("n_removed"), long.cast("long").alias("n_passages"), F.array_join(text, ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '^[\x00-\x20]+|[^\x00-\x20]+[\x00-\x20]*') AS t0 FROM documents),
d2 AS (SELECT doc_id, text, CASE WHEN len(t0) > 1 AND regexp_full_match(t0[1], '[\x00-\x20]+') THEN [t0[1] || t0[2]] || t0[3:] WHEN len(t0) = 1 AND regexp_full_match(t0[1], '[\x00-\x20]+') THEN [] ELSE t0 END AS t FROM d),
w AS (SELECT doc_id, i, t[i] AS tok, lower(regexp_extract(t[i], '[^\x00-\x20]+')) AS word, contains(regexp_extract(t[i], '[\x00-\x20]*$'), chr(10)) AS nl, length(t[i]) AS l FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM d2)),
v AS (SELECT *, coalesce(sum(l) OVER a, 0) AS s, coalesce(sum(CAST(nl AS INTEGER)) OVER a, 0) AS line, CAST(7 * length(word) + 3 * unicode(word) + 5 * unicode(right(word, 1)) AS HUGEINT) AS val FROM w WINDOW a AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (((val * 1000003 + lead(val, 1) OVER l) % 4294967296 * 1000003 + lead(val, 2) OVER l) % 4294967296 * 1000003 + lead(val, 3) OVER l) % 4294967296 * 2654435761 % 4294967296 AS pv FROM v WINDOW l AS (PARTITION BY doc_id, line ORDER BY i)),
q AS (SELECT doc_id, line, i, min((pv, -i)) OVER (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS m, count(*) OVER (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS n FROM p WHERE pv IS NOT NULL),
c AS (SELECT DISTINCT doc_id, -m[2] AS i FROM q WHERE n = 16),
b AS (SELECT p.*, coalesce(sum(CASE WHEN c.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id, line ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i),
u AS (SELECT doc_id, line, piece, CAST(min(s) AS BIGINT) AS s, CAST(max(s + l) AS BIGINT) AS e, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM b GROUP BY 1, 2, 3),
ln AS (SELECT doc_id, line, min(s) AS s, max(e) AS e, sum(n) AS n, count(*) AS k, string_agg(body, ' ' ORDER BY piece) AS body FROM u GROUP BY 1, 2),
un AS (SELECT u.doc_id, u.line, u.s, u.e, u.n, CASE WHEN k = 1 THEN 1 ELSE 0 END AS kind, u.body FROM u JOIN ln ON ln.doc_id = u.doc_id AND ln.line = u.line UNION ALL SELECT doc_id, line, s, e, n, 2, chr(10) || body FROM ln WHERE k > 1 AND n >= 10),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS fd, row_number() OVER (PARTITION BY doc_id, body ORDER BY s) AS nth FROM un),
g AS (SELECT *, CASE WHEN nth > 1 THEN doc_id ELSE fd END AS first_id FROM f WHERE nth > 1 OR fd <> doc_id),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS isle FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY doc_id ORDER BY s) = s THEN 0 ELSE 1 END AS fresh FROM g WHERE kind < 2)),
o AS (SELECT doc_id, s, e, n, first_id FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, isle) AS run FROM r) WHERE run >= 16 OR (kind = 1 AND n >= 10) UNION SELECT doc_id, s, e, n, first_id FROM g WHERE kind = 2),
x AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.kind = 2 AND g.doc_id = o.doc_id AND g.s <= o.s AND g.e >= o.e AND g.e - g.s > o.e - o.s)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS isle FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY doc_id ORDER BY s) = s THEN 0 ELSE 1 END AS fresh FROM x)),
z AS (SELECT doc_id, isle, min(s) AS s, max(e) AS e, sum(n) AS n, arg_min(first_id, s) AS first_id FROM y GROUP BY 1, 2),
t AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (n >= 34) AS n_passages, string_agg(s || ':' || e || ':' || first_id, ',' ORDER BY s) AS removed FROM z GROUP BY doc_id),
k AS (SELECT v.doc_id, string_agg(tok, '' ORDER BY i) AS kept FROM v WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = v.doc_id AND v.s >= z.s AND v.s < z.e) GROUP BY v.doc_id)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, coalesce(removed, '') AS removed, sha256(coalesce(CASE WHEN n_removed IS NULL THEN text ELSE kept END, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
