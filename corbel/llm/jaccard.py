"""N-gram Jaccard join by MinHash banding.

Texts that share their word sequence are one class, which goes on as one
representative. Each representative's set of n-grams (five words) gets MinHash
bands; bands and rows are chosen so that a pair at the threshold is missed with
a probability below 1 - recall. Band hashes are shuffled, and representatives that
meet in a bucket are verified: exact Jaccard on the full n-gram sets, as sparse
products of blocks, so that no pair is ever a row. A block has at most BLOCK texts
and about WORDS words, whatever the length of texts is.

Buckets that share members overlap, so a connected set of buckets is verified in
the cheaper of two exact ways, told by counts for each set: as one (all pairs of
its blocks), or, where that is more pairs than its buckets have (chains of texts,
boilerplate that ties unlike texts together), bucket by bucket, a pair counting in
the first band that it shares. So never more pairs are verified than share a band.
A bucket of any size is split over as many tasks as it has pairs of blocks. What
comes back is, for each representative, its number of links and the links of a
spanning forest.

Words are lower-cased, and are runs of letters, digits and whatever is not ASCII.
A text of fewer than five words has one n-gram, all its words.

Rows are told apart by their place in the table, so repeated rows, repeated ids
and rows without id need no rule of their own. Defined results: a null text is
linked with nothing; texts without words are linked if they are equal; repeated
rows are copies of each other; class_id is the smallest doc_id of the class that
is not null, and null if all are; further columns don't matter, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, keyed, shuffled, skew_lookup, staged, words

N, THRESHOLD, RECALL = 5, 0.8, 0.99999
BLOCK, WORDS = 256, 1 << 21
BATCH = (256, 32)
#: Columns that a row of signatures begins with: its number among them, its place in the table, its id and its word sequence.
ROW = ("no", "f", "r", "_id", "rid")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - threshold^rows)^bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _rid(text: Column) -> Column:
    """16 bytes that stand for the word sequence of a text, or for a text without words."""
    w = words(F.lower(text))
    return F.unhex(F.md5(F.when(F.size(w) > 0, F.array_join(w, " ")).otherwise(F.concat(F.lit("\n"), text))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _ODD
    return h ^ (h >> np.uint64(29))


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as unsigned, and the offsets of its lists."""
    off = np.asarray(col.offsets)
    return np.asarray(col.values)[off[0] : off[-1]].view(np.uint64), off - off[0]


def grams(values: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each list of word hashes, and their offsets; a short list has one n-gram, an empty one none."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out = np.concatenate([[0], np.cumsum(counts)])
    total = int(out[-1])
    start = np.repeat(offsets[:-1], counts) + np.arange(total) - np.repeat(out[:-1], counts)
    end = np.repeat(offsets[1:], counts)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        at = start + k
        h = _mixed(h + np.where(at < end, values[np.minimum(at, len(values) - 1)], np.uint64(k)) if total else h)
    return h, out


def _signer(bands: int, rows: int, n: int):
    rng = np.random.default_rng(20)
    odd = rng.integers(1, 1 << 63, size=(bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), bands), np.uint64)
        for b in range(bands):
            key = np.full(len(starts), b, np.uint64)
            for r in range(rows):
                key = _mixed(key ^ np.minimum.reduceat(h * odd[b, r], starts))
            out[:, b] = key
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, off = grams(*_lists(batch.column("w")), n)
            count = np.diff(off)
            sig = np.zeros((len(count), bands), np.uint64)
            full = np.flatnonzero(count)
            # A bounded number of n-grams at a time, but never less than one text.
            at = 0
            while at < len(full):
                to = max(at + 1, int(np.searchsorted(off[full], off[full[at]] + (1 << 19))))
                some = full[at:to]
                sig[some] = sign(h[off[some[0]] : off[some[-1] + 1]], off[some] - off[some[0]])
                at = to
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * bands), pa.array(sig.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ROW), pa.array(count.astype(np.int64)), lists], [*ROW, "n", "bands"])

    return run


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, limit: Fraction) -> np.ndarray:
    """Boolean matrix of the pairs of `left` by `right` (or by itself) whose Jaccard reaches the limit."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, col, seen = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = seen[col] > 1
    row, col = row[shared], col[shared]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 8192
    both = np.zeros((len(left), len(left if right is None else right)), np.float64)
    where = np.full(len(sets), -1)
    where[left] = np.arange(len(left))
    other = where.copy()
    if right is not None:
        other = np.full(len(sets), -1)
        other[right] = np.arange(len(right))
    names = np.cumsum(np.concatenate([[0], np.diff(col) > 0])) if len(col) else col
    at = 0
    while at < len(col):
        to = int(np.searchsorted(names, names[at] + width))
        r, c = row[at:to], names[at:to] - names[at]
        x = np.zeros((len(left), width), np.float32)
        own = where[r] >= 0
        x[where[r[own]], c[own]] = 1
        y = x
        if right is not None:
            y = np.zeros((len(right), width), np.float32)
            own = other[r] >= 0
            y[other[r[own]], c[own]] = 1
        both += x @ y.T
        at = to
    size = n[left][:, None] + n[left if right is None else right][None, :]
    return both * (limit.numerator + limit.denominator) >= limit.numerator * size


def _meet_first(bands: np.ndarray, left: np.ndarray, right: np.ndarray, bucket: int) -> np.ndarray:
    """Pairs whose first band in common is the one of this bucket."""
    out = np.zeros((len(left), len(right)), bool)
    open_ = np.ones_like(out)
    for k in range(bands.shape[1]):
        same = bands[left, k][:, None] == bands[right, k][None, :]
        out |= open_ & same & (bands[left, k] == bucket)[:, None]
        open_ &= ~same
    return out


def _labels(near: np.ndarray, left: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Labels by minima along links until none changes."""
    label = np.arange(n)
    while True:
        old = label.copy()
        some = near.any(1)
        label[left[some]] = np.minimum(label[left[some]], np.where(near[some], label[to][None, :], n).min(1))
        some = near.any(0)
        label[to[some]] = np.minimum(label[to[some]], np.where(near[:, some], label[left][:, None], n).min(0))
        label = np.minimum(label, label[label])
        if (label == old).all():
            return label


def _verifier(n: int, threshold: float):
    limit = Fraction(str(threshold))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        w = table.column("w")
        w = w.chunk(0) if w.num_chunks else pa.array([], pa.list_(pa.int64()))
        h, off = grams(*_lists(w), n)
        no, cnt, group, i, j, side = (table.column(k).to_numpy() for k in ("no", "cnt", "grp", "i", "j", "side"))
        bucket, bands = table.column("is_bucket").to_pylist(), table.column("bands")
        groups: dict = {}
        for k, key in enumerate(zip(group.tolist(), bucket, i.tolist(), j.tolist(), strict=True)):
            groups.setdefault(key, []).append(k)
        out: list[tuple] = []
        for (g, by_bucket, a, b), members in groups.items():
            idx = np.array(sorted(members, key=lambda k: no[k]))
            cross = a != b
            left = np.flatnonzero(side[idx] == a) if cross else np.arange(len(idx))
            right = np.flatnonzero(side[idx] == b) if cross else None
            to = left if right is None else right
            links, label = np.zeros(len(idx), np.int64), np.arange(len(idx))
            if len(left) and len(to):
                near = _linked([np.unique(h[off[k] : off[k + 1]]) for k in idx], left, right, limit)
                if by_bucket:
                    near &= _meet_first(np.array(bands.take(pa.array(idx)).to_pylist(), np.int64), left, to, g)
                if not cross:
                    np.fill_diagonal(near, False)
                own = cnt[idx]
                links[left] += near @ own[to]
                if cross:
                    links[right] += near.T @ own[left]
                label = _labels(near, left, to, len(idx))
            out += zip(no[idx].tolist(), links.tolist(), no[idx[label]].tolist(), [by_bucket or b > 0] * len(idx), strict=True)
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("no", "links", "label", "open"), columns, kinds, strict=True)})

    return run


def _unit_rows(grp: Column, is_bucket: bool, chunks: Column, bins: int) -> Column:
    """array<struct<unit, grp, is_bucket, i, j, side>>: the blocks that a member of a group of so many chunks takes part in; small groups share a unit."""
    side = F.pmod(F.xxhash64("no"), chunks).cast("int")
    kind = F.lit(is_bucket)

    def one(x: Column) -> Column:
        i, j = F.least(side, x), F.greatest(side, x)
        unit = F.when(chunks == 1, F.xxhash64(kind, F.pmod(F.xxhash64(grp), F.lit(bins)))).otherwise(F.xxhash64(kind, grp, i, j))
        return F.struct(unit.alias("unit"), grp.alias("grp"), kind.alias("is_bucket"), i.alias("i"), j.alias("j"), side.alias("side"))

    return F.transform(F.sequence(F.lit(0), chunks - 1), one)


def _chunks(members: str, size: str) -> Column:
    return F.greatest(F.ceil(F.col(members) / BLOCK), F.ceil(F.col(size) / WORDS)).cast("int")


def _links(sig: DataFrame, reps: DataFrame, base: DataFrame, bands: int, n: int, threshold: float) -> DataFrame:
    """(no, links, label): for each representative that meets another one, the documents linked with it and the smallest representative that links lead to."""
    reps = shuffled(sig.select("no", "f", "r", "bands"), reps.select(F.col("no").alias("rep"), "cnt", "n"), ["no"], ["rep"], "inner").filter("n > 0").drop("rep")
    reps = staged(reps, "representatives")
    cells = reps.select("no", "n", F.explode("bands").alias("bucket"))
    many = cells.groupBy("bucket").agg(F.min("no").alias("low"), F.count("*").alias("k")).filter("k > 1")
    many = staged(many, "buckets")
    # A bucket, as a set of buckets, may hold a third of all representatives: its one row is looked up and not met by key.
    salt = F.xxhash64(F.lit("none"), F.col("no"))
    met = staged(skew_lookup(cells, many, "bucket", "k", reps.count() * bands, ["low", "k"], salt).filter("low IS NOT NULL"), "met")
    linked = components(met.filter("no <> low").select(F.col("no").alias("a"), F.col("low").alias("b")))
    linked = staged(linked.select("node", F.col("label").alias("comp")), "linked")

    # How each connected set is verified: as one, or bucket by bucket where that is fewer pairs.
    inside = met.join(linked, met["no"] == linked["node"])
    pairs = inside.groupBy("comp").agg(F.sum("k").alias("band_pairs"))
    own = reps.select("no", "f", "r", "cnt", "n", "bands").join(linked, F.col("no") == F.col("node")).drop("node")
    size = own.groupBy("comp").agg(F.count("*").alias("g"), F.sum("n").alias("size")).join(pairs, "comp")
    size = size.select("comp", "g", "size", _chunks("g", "size").alias("chunks"), "band_pairs")
    size = size.withColumn("by_bucket", (F.col("chunks") > 1) & (F.col("band_pairs") < F.col("g") * F.col("g")))
    own = staged(skew_lookup(own, staged(size, "sets"), "comp", "g", linked.count(), ["chunks", "by_bucket"], salt), "candidates")
    total = own.agg(F.sum("n")).first()[0] or 0
    bins = max(64, total // WORDS)
    whole = own.filter("NOT by_bucket").select("no", "f", "r", "cnt", F.lit(None).cast("array<bigint>").alias("bands"), _unit_rows(F.col("comp"), False, F.col("chunks"), bins).alias("units"))
    split = own.filter("by_bucket").select(F.col("no").alias("rep"))
    split = met.join(split, met["no"] == split["rep"]).select("no", "bucket", "n")
    load = staged(split.groupBy("bucket").agg(F.count("*").alias("g"), F.sum("n").alias("size")).select("bucket", "g", _chunks("g", "size").alias("chunks")), "loads")
    units = skew_lookup(split, load, "bucket", "g", met.count(), ["chunks"], salt).groupBy("no").agg(F.flatten(F.collect_list(_unit_rows(F.col("bucket"), True, F.col("chunks"), bins))).alias("units"))  # a list for each band at most
    parts = own.filter("by_bucket").select("no", "f", "r", "cnt", "bands").join(units, "no")
    work = whole.unionByName(parts.select(*whole.columns)).withColumnsRenamed({"f": "f_", "r": "r_"})

    # Each representative's words, once, to the blocks that it takes part in.
    full = shuffled(base, work, ["f", "r"], ["f_", "r_"], "inner").select("no", "cnt", "bands", word_hashes(F.col("_t")).alias("w"), F.explode("units").alias("u"))
    full = full.select("no", "cnt", "bands", "w", "u.*")
    seen = full.groupBy("unit").applyInArrow(_verifier(n, threshold), "no bigint, links bigint, label bigint, open boolean")
    seen = staged(seen, "verified", BATCH)

    # Sets within one block are done; the others' forests are joined over their blocks.
    over = components(seen.filter("open AND label <> no").select(F.col("no").alias("a"), F.col("label").alias("b")))
    got = seen.groupBy("no").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
    return got.join(over.withColumnRenamed("label", "far"), got["no"] == F.col("node"), "left").select("no", "links", F.coalesce("far", "label").alias("label"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: f and r (its place in the table), _id, rid (word sequence), label (of its class), first_id (the smallest id of equal word sequences), n_links (other documents at or above the threshold), class_id (the smallest id that links lead to)."""
    return _classes(*keyed(docs), threshold, n, recall, doc_id, text)


def _classes(docs: DataFrame, file: str, row: str, threshold: float, n: int, recall: float, doc_id: str, text: str) -> DataFrame:
    bands, rows = bands_for(threshold, recall)
    base = docs.select(F.col(file).alias("f"), F.col(row).alias("r"), F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    made = base.select(F.monotonically_increasing_id().alias("no"), "f", "r", "_id", _rid(F.col("_t")).alias("rid"), F.coalesce(word_hashes(F.col("_t")), F.array().cast("array<bigint>")).alias("w"))
    kind = dict(docs.dtypes)[doc_id]
    sig = staged(made.mapInArrow(_signer(bands, rows, n), f"no bigint, f bigint, r bigint, _id {kind}, rid binary, n bigint, bands array<bigint>"), "signatures", BATCH)
    reps = sig.filter("rid IS NOT NULL").groupBy("rid").agg(F.min("no").alias("no"), F.count("*").alias("cnt"), F.max("n").alias("n"), F.min("_id").alias("first_id"))
    reps = staged(reps, "classes")
    got = staged(_links(sig, reps, base.select("f", "r", "_t"), bands, n, threshold).withColumnRenamed("no", "rep"), "links")
    # Sequences with a copy or a link; all others stand alone.
    every = reps.join(got, reps["no"] == got["rep"], "left").filter("cnt > 1 OR rep IS NOT NULL")
    every = every.select("rid", "first_id", "cnt", (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "no").alias("label"))
    every = staged(every, "linked")
    low = every.groupBy(F.col("label").alias("l")).agg(F.min("first_id").alias("class_id"))
    every = staged(every.join(low, F.col("label") == F.col("l")).drop("l"), "labelled")
    out = skew_lookup(sig.select("no", "f", "r", "_id", "rid"), every, "rid", "cnt", sig.count(), ["first_id", "n_links", "class_id", "label"], F.unhex(F.md5(F.concat(F.lit("none"), F.col("no").cast("string")))))
    alone = F.col("label").isNull()
    return out.select("f", "r", "_id", "rid", F.coalesce("label", "no").alias("label"), F.when(alone, F.col("_id")).otherwise(F.col("first_id")).alias("first_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id (rows without id rank last; ties go by word sequence, and one of equal rows stays); null texts stay."""
    src, file, row = keyed(docs)
    got = _classes(src, file, row, threshold, n, RECALL, doc_id, text).filter("n_links > 0").select(F.col("f").alias("gone_f"), F.col("r").alias("gone_r"), "_id", "class_id", "rid", "label")
    got = staged(got, "near")
    stay = got.filter("_id <=> class_id").groupBy("label").agg(F.min(F.struct("rid", "gone_f", "gone_r")).alias("x")).select(F.col("x.gone_f").alias("f"), F.col("x.gone_r").alias("r"))
    gone = shuffled(got.select("gone_f", "gone_r"), stay, ["gone_f", "gone_r"], ["f", "r"], "left_anti")
    return shuffled(src, staged(gone, "gone"), [file, row], ["gone_f", "gone_r"], "left_anti").select(*docs.columns)


def op7_rows(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id, first_id (of its equal copies), n_links (other documents, copies included)."""
    return classes(docs).select(F.col("_id").alias("doc_id"), "class_id", "first_id", "n_links")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE chr(10) || text END AS body FROM d WHERE text IS NOT NULL),
c AS (SELECT body, min(doc_id) AS first_id, count(*) AS cnt, any_value(w) AS w FROM k GROUP BY body),
g AS (SELECT DISTINCT first_id, gram FROM (SELECT first_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[p:p + 4], ' ') FOR p IN range(1, len(w) - 3)] END) AS gram FROM c WHERE len(w) > 0)),
n AS (SELECT first_id, count(*) AS n FROM g GROUP BY first_id),
p AS (SELECT a.first_id AS a, b.first_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.first_id <> b.first_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.first_id = a JOIN n y ON y.first_id = b WHERE common * 9 >= 4 * (x.n + y.n)),
reach AS (SELECT first_id AS v, first_id AS u FROM c UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.u),
cls AS (SELECT v, min(u) AS class_id FROM reach GROUP BY v),
deg AS (SELECT l.a, sum(c.cnt) AS links FROM l JOIN c ON c.first_id = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(cls.class_id, d.doc_id) AS class_id, coalesce(c.first_id, d.doc_id) AS first_id,
       CAST(coalesce(c.cnt - 1 + coalesce(deg.links, 0), 0) AS BIGINT) AS n_links
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN c ON c.body = k.body LEFT JOIN cls ON cls.v = c.first_id LEFT JOIN deg ON deg.a = c.first_id
"""
