"""Exact top-k inner products with block-at-a-time pruning.

Vectors are arranged by their nearest of a few pivots and cut into ranges of
about 4096 documents; a range is one row with its forward index (a matrix) and,
for each block of 256 documents and each term (dimension), the largest and the
smallest value. The bound of a query in a block is the sum of its term maxima.
Within a range, blocks are taken in descending order of the bound and scored
through the forward index, until every query's bounds fall below its kth score.

Queries are first answered within their own range, which gives each a kth score
to beat. The box around a range's queries is then held against the boxes of the
pivots (a bounded number), and within those it can reach, by a join on the pivot,
against the boxes of their ranges: so ranges that can't hold a better score are
never met. A range's matrix goes to the query groups that reach it once for every
FEW of them, and only scores that beat the query's own come back.

Queries and candidates are rows, not ids: rows of one id are queries of their own
and candidates of each other. Values are floor(scale * x); inner products are exact
whatever their size: floats where those are exact, else 64-bit integers, else
integers without bounds; a score beyond 64 bits counts as the nearest number of 64
bits.

Defined results: vectors that are null or hold a null, infinite or undefined
value take no part; missing values at the end of a shorter vector count as 0;
ties go to the smaller id; rows without id are left out; an empty table gives an
empty result; further columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

RANGE, BLOCK, PIVOTS, PIVOT_ROWS, FEW = 4096, 256, 32, 2_000, 32
BATCH = (64, 32)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
FOUND = "query_no long, query_id long, no long, vec_id long, score long"


def _order(v: np.ndarray) -> np.ndarray:
    """An order of vectors in which neighbours are alike: by signs of the three directions of most variance, then along the first."""
    if len(v) < 2:
        return np.arange(len(v))
    x = v - v.mean(0)
    _, axes = np.linalg.eigh(x.T @ x)
    p = x @ axes[:, ::-1][:, :3]
    code = (p > 0) @ np.array([4, 2, 1])[: p.shape[1]]
    return np.lexsort((p[:, 0], code))


def _whole(x: np.ndarray, scale: int, kind: type) -> np.ndarray:
    """floor(scale * x), exactly."""
    if kind is object:
        return np.array([[int(np.floor(y * scale)) if np.isfinite(y * scale) else int(y) * scale for y in row] for row in x.tolist()], object).reshape(x.shape)
    return np.floor(x * scale).astype(kind)


def _kind(q: np.ndarray, v: np.ndarray, scale: int) -> type:
    """The numbers in which all inner products are exact."""
    most = (max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) * scale + 1) ** 2 * max(1, v.shape[1])
    return np.float64 if most < 2.0**52 else np.int64 if most < 2.0**62 else object


class Best:
    """Per query: the best candidates so far, with a floor that further ones must reach."""

    def __init__(self, n: int, k: int, floor: list[int]):
        self.k, self.least = k, list(floor)
        self.found: list[list[tuple]] = [[] for _ in range(n)]  # (-score, id, no)

    def add(self, r: int, ids: np.ndarray, nos: np.ndarray, scores: list) -> None:
        got = sorted([*self.found[r], *((-s, i, n) for s, i, n in zip(scores, ids.tolist(), nos.tolist(), strict=True))])[: self.k]
        self.found[r] = got
        if len(got) == self.k:
            self.least[r] = max(self.least[r], -got[-1][0])


def _cut(score: np.ndarray) -> np.ndarray:
    return np.clip(score, _LOW, _HIGH) if score.dtype == object else score


def _answer(q: np.ndarray, own: np.ndarray, floor: list[int], ids: np.ndarray, nos: np.ndarray, v: np.ndarray, k: int, scale: int) -> tuple[Best, int]:
    """The best k of the documents for each query, with a score of at least its floor; and the number of blocks that were scored for a query."""
    cuts = list(range(0, len(ids), BLOCK))
    kind = _kind(q, v, scale)
    q, v = _whole(q, scale, kind), _whole(v, scale, kind)
    high = np.stack([v[c : c + BLOCK].max(0) for c in cuts])
    low = np.stack([v[c : c + BLOCK].min(0) for c in cuts])
    bound = _cut(np.where(q > 0, q, 0) @ high.T + np.where(q < 0, q, 0) @ low.T)
    best, done = Best(len(q), k, floor), 0
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(cuts)):
        at = order[:, turn]
        alive = np.array([r for r in range(len(q)) if bound[r, at[r]] >= best.least[r]], int)
        if not len(alive):
            break  # bounds only fall from here
        for b in np.unique(at[alive]):
            some = alive[at[alive] == b]
            done += len(some)
            block = slice(cuts[b], cuts[b] + BLOCK)
            score = _cut(q[some] @ v[block].T)
            for r, row in zip(some.tolist(), score, strict=True):
                hit = np.flatnonzero((nos[block] != own[r]) & (row >= best.least[r]))
                if len(hit) > 4 * k:  # the best of them, ties included
                    hit = hit[row[hit] >= np.sort(row[hit])[-k]]
                if len(hit):
                    best.add(r, ids[block][hit], nos[block][hit], [int(s) for s in row[hit]])
    return best, done


def _matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, width)


def _rows(best: Best, qno: np.ndarray, qid: np.ndarray) -> pd.DataFrame:
    """Candidates as rows."""
    out = [(n, i, x[2], x[1], -x[0]) for n, i, found in zip(qno.tolist(), qid.tolist(), best.found, strict=True) for x in found]
    return pd.DataFrame(out, columns=["query_no", "query_id", "no", "vec_id", "score"])


def _ranges(width: int, every: int, k: int, scale: int):
    """Makes a range of the vectors of a group: forward index, box, its queries with their answers within the range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((len(pdf), width))
        for r, x in enumerate(pdf["v"]):
            v[r, : len(x)] = x
        ids, nos = pdf["id"].to_numpy(np.int64), pdf["no"].to_numpy(np.int64)
        turn = np.lexsort((nos, ids))
        turn = turn[_order(np.clip(v[turn], -1e100, 1e100))]
        ids, nos, v = ids[turn], nos[turn], v[turn]
        asks = np.flatnonzero(ids % every == 0)
        best, done = _answer(v[asks], nos[asks], [_LOW] * len(asks), ids, nos, v, k, scale)
        floor = np.array(best.least, np.int64)
        q, home = v[asks], _rows(best, nos[asks], ids[asks])
        return pd.DataFrame(
            {
                "pivot": [pdf["pivot"].iloc[0]], "rng": [pdf["rng"].iloc[0]], "ids": [ids.tobytes()], "nos": [nos.tobytes()], "mat": [v.tobytes()], "hi": [v.max(0).tolist()], "lo": [v.min(0).tolist()],
                "qid": [ids[asks].tobytes()], "qno": [nos[asks].tobytes()], "qmat": [q.tobytes()], "qfloor": [floor.tobytes()], "qhi": [q.max(0).tolist() if len(q) else []], "qlo": [q.min(0).tolist() if len(q) else []], "qmin": [None if not len(floor) else -np.inf if floor.min() == _LOW else float(floor.min())],
                "done": [done], "found": [home.to_dict("records")],
            }
        )

    return run


_RANGE = "pivot int, rng long, ids binary, nos binary, mat binary, hi array<double>, lo array<double>, qid binary, qno binary, qmat binary, qfloor binary, qhi array<double>, qlo array<double>, qmin double, done long, found array<struct<query_no:long,query_id:long,no:long,vec_id:long,score:long>>"


def _pairs(width: int, k: int, scale: int):
    """Answers the query groups of a unit in one range; a row without query says how many blocks were scored."""

    def run(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out, done = [], 0
        for b in held.itertuples(index=False):
            ids, nos, v = np.frombuffer(b.ids, np.int64), np.frombuffer(b.nos, np.int64), _matrix(b.mat, width)
            for row in asks.itertuples(index=False):
                own, qid = np.frombuffer(row.qno, np.int64), np.frombuffer(row.qid, np.int64)
                floor = np.frombuffer(row.qfloor, np.int64).tolist()
                best, n = _answer(_matrix(row.qmat, width), own, floor, ids, nos, v, k, scale)
                out.append(_rows(best, own, qid))
                done += n
        out.append(pd.DataFrame([(None, None, None, None, done)], columns=["query_no", "query_id", "no", "vec_id", "score"]))
        return pd.concat(out, ignore_index=True).astype({c: "Int64" for c in ("query_no", "query_id", "no", "vec_id", "score")})

    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(no, id, v): the vectors that take part, with a number for each row."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("no"), F.col(vec_id).cast("long").alias("id"), x.alias("v"))


def _centres(vec: DataFrame, width: int) -> np.ndarray:
    """Pivots that arrange the vectors, from a bounded number of rows by hash; any choice gives the same result."""
    some = vec.select("id", "no", "v").orderBy(F.xxhash64("id"), "id", "no").limit(PIVOT_ROWS).toPandas()
    pts = np.zeros((len(some), width))
    for r, x in enumerate(some["v"]):
        pts[r, : len(x)] = x
    pts = np.clip(pts, -1e100, 1e100)
    pick = [0]
    far = ((pts - pts[0]) ** 2).sum(1)
    while len(pick) < min(PIVOTS, len(pts)):
        pick.append(int(far.argmax()))
        far = np.minimum(far, ((pts - pts[pick[-1]]) ** 2).sum(1))
    centres = [pts[p] for p in pick]
    for _ in range(5):
        near = np.argmin([((pts - c) ** 2).sum(1) for c in centres], axis=0)
        centres = [pts[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)]
    return np.stack(centres)


def _most(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.maximum.reduce([q[0] * v[0], q[0] * v[1], q[1] * v[0], q[1] * v[1]]).sum(-1)


def _index(vec: DataFrame, width: int, k: int, every: int, scale: int) -> DataFrame:
    """The ranges, one row each, staged."""
    spark, centres = vec.sparkSession, _centres(vec, width)

    def nearest(x: pd.Series) -> pd.Series:
        m = np.zeros((len(x), width))
        for r, y in enumerate(x):
            m[r, : len(y)] = y
        m = np.clip(m, -1e100, 1e100)
        return pd.Series(np.argmin((centres**2).sum(1)[None, :] - 2 * m @ centres.T, axis=1).astype(np.int32))

    placed = staged(vec.withColumn("pivot", F.pandas_udf(nearest, "int")("v")), "placed", (10_000, 32))
    sizes = {r["pivot"]: r["count"] for r in placed.groupBy("pivot").count().collect()}  # a row for each pivot
    parts = spark.createDataFrame([(p, max(1, -(-c // RANGE))) for p, c in sizes.items()], "pv int, parts int")
    placed = placed.join(F.broadcast(parts), F.col("pivot") == F.col("pv"))
    placed = placed.select("pivot", "no", "id", "v", F.xxhash64("pivot", F.pmod(F.xxhash64("no"), F.col("parts"))).alias("rng"))
    return staged(placed.groupBy("rng").applyInPandas(_ranges(width, every, k, scale), _RANGE), "ranges", BATCH)


def _far(made: DataFrame, width: int, k: int, scale: int) -> DataFrame:
    """What queries find outside their own range."""
    dims = made.select("pivot", F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "x")).groupBy("pivot", "d").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in dims.collect():  # PIVOTS x width rows
        box = boxes.setdefault(r["pivot"], (np.zeros(width), np.zeros(width)))
        box[0][r["d"]], box[1][r["d"]] = r["lo"], r["hi"]
    names = list(boxes)
    low = np.stack([boxes[p][0] for p in names])
    high = np.stack([boxes[p][1] for p in names])
    # Rounding moves floor(scale * x) by less than 1, and sums in floats by less than a share of 1e-9; boxes are widened by that.
    wide = lambda b, sign: np.floor(b * scale) + sign

    def reached(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                most = _most((wide(np.array(row.qlo), -1), wide(np.array(row.qhi), 1)), (wide(low, -1), wide(high, 1)))
                out += [(row.a, names[i]) for i in np.flatnonzero(~(most + np.abs(most) * 1e-9 < row.qmin))]
            yield pd.DataFrame(out, columns=["a", "pv"])

    asks = made.filter("qmin IS NOT NULL").select(F.col("rng").alias("a"), "qhi", "qlo", "qmin")
    held = made.select("pivot", F.col("rng").alias("b"), "hi", "lo")
    most = lambda y, z: F.greatest(y["qlo"] * z["lo"], y["qlo"] * z["hi"], y["qhi"] * z["lo"], y["qhi"] * z["hi"])
    near = asks.join(asks.mapInPandas(reached, "a long, pv int").withColumnRenamed("a", "a_"), F.col("a") == F.col("a_")).drop("a_")
    pairs = near.join(held, (near["pv"] == held["pivot"]) & (near["a"] != held["b"]))
    grown = lambda lo, hi: F.arrays_zip(_wider(F.col(lo), scale, -1).alias(lo), _wider(F.col(hi), scale, 1).alias(hi))
    reach = F.aggregate(F.zip_with(grown("qlo", "qhi"), grown("lo", "hi"), most), F.lit(0.0), lambda t, y: t + y)
    pairs = staged(pairs.filter(reach + F.abs(reach) * 1e-9 >= F.col("qmin")).select("a", "b"), "pairs")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / FEW).cast("int").alias("parts")).select(F.col("b").alias("b_"), "parts")
    pairs = pairs.join(parts, F.col("b") == F.col("b_")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    left = pairs.join(made.select(F.col("rng").alias("a_"), "qid", "qno", "qmat", "qfloor"), F.col("a") == F.col("a_")).select("b", "part", "qid", "qno", "qmat", "qfloor")
    right = made.select(F.col("rng").alias("b"), "ids", "nos", "mat").join(parts, F.col("b") == F.col("b_")).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ids", "nos", "mat")
    return staged(left.groupBy("b", "part").cogroup(right.groupBy("b", "part")).applyInPandas(_pairs(width, k, scale), FOUND), "far", BATCH)


def _wider(values: Column, scale: int, by: int) -> Column:
    """floor(scale * x) + by of each, in floats."""
    return F.transform(values, lambda x: x * scale - F.pmod(x * scale, F.lit(1.0)) + by)


def _search(vectors: DataFrame, k: int, every: int, vec_id: str, embedding: str, scale: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Ranges, what queries find in their own, and what they find in others; None without any value."""
    vec = staged(usable(vectors, vec_id, embedding), "vectors")
    n, width = vec.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    # Vectors without values get one of 0, which changes no score.
    vec, width = (vec, width) if width else (vec.withColumn("v", F.array(F.lit(0.0))), 1)
    made = _index(vec, width, k, every, scale)
    return made, made.select(F.explode("found").alias("x")).select("x.*"), _far(made, width, k, scale)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each vector whose id is divisible by `every`."""
    got = _search(vectors, k, every, vec_id, embedding, scale)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = got[1].unionByName(got[2].filter("query_no IS NOT NULL"))
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id", "no"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored_share(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> float:
    """The share of all pairs of a query and a block that were scored; the rest was pruned."""
    got = _search(vectors, k, every, vec_id, embedding, scale)
    if got is None:
        return 0.0
    made, _, far = got
    row = made.agg(F.sum("done"), F.sum(F.ceil(F.length("ids") / 8 / BLOCK)), F.sum(F.length("qid") / 8)).first()
    done = (row[0] or 0) + (far.filter("query_no IS NULL").agg(F.sum("score")).first()[0] or 0)
    return done / max(1, row[1] * row[2])


OP3_SQL = """
WITH v AS (SELECT vec_id AS id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def op3_rows(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    return top_k(vectors)
