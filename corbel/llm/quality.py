"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on statistics of labelled texts, every path of
theirs becomes a conjunctive rule, a lasso logistic fit keeps few rules, and the
kept rules are compiled into one Spark column expression. Texts are scored by
that expression alone, over the whole text, without Python.

The fit uses at most `most` labelled rows (those with the smallest hash of
doc_id), a documented bound; only rows whose crc32(doc_id) mod 5 is not 0 are
learned from. Statistics and scores cover every document.

Defined results: a null or empty text has statistics of 0 and the score that
follows from them; labels that are null are not used; a label for an unknown
document isn't either; if there are no labels of both kinds the score is the
share of label 1 (0.5 without any); repeated rows give repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MOST = 20_000
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; shares lie between 0 and 1."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    parts = F.array_remove(F.split(t, r"[\s\x00-\x1F]+"), "")
    count = F.greatest(F.size(parts), F.lit(1)).cast("double")
    per = lambda pattern, of: F.regexp_count(t, F.lit(pattern)) / of
    return {
        "length": F.log1p(F.length(t).cast("double")),
        "word_length": F.length(t) / count,
        "upper": per(r"\p{Lu}", n),
        "symbols": per(r"[#$%&*@^~<>{}\[\]\\/_=+]", n),
        "bars": per(r"[|]", count),
        "marks": per(r"[!?]", count),
        "stops": per(r"[.,;:]", count),
        "digits": per(r"[0-9]", n),
        "short": per(r"(?<![^\s])\p{L}{1,3}(?![^\s.,])", count),
        "lines": per(r"\n", count),
        "distinct": F.size(F.array_distinct(parts)) / count,
        "doubled": per(r"(?<![^\s])([^\s]++)(?= \1(?![^\s]))", count),
    }


@dataclass
class Rules:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold))); a rule is a conjunction of (name, "<=" or ">", bound)."""

    bias: float
    rules: list[tuple[float, tuple[tuple[str, str, float], ...]]]

    def column(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for weight, terms in self.rules:
            holds = None
            for name, sign, bound in terms:
                one = stats[name] <= bound if sign == "<=" else stats[name] > bound
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, fit: np.ndarray, least: int) -> None:
    """One tree of second-order boosting over binned statistics; appends each path below the root to `out`."""
    if path:
        out.append(path)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, 0)
    if depth:
        for j, edges in enumerate(cuts):
            if not len(edges):
                continue
            b = bins[rows, j]
            sg = np.bincount(b, g[rows], len(edges) + 1).cumsum()[:-1]
            sh = np.bincount(b, h[rows], len(edges) + 1).cumsum()[:-1]
            sn = np.bincount(b, minlength=len(edges) + 1).cumsum()[:-1]
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            gain[(sn < least) | (len(rows) - sn < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    _, j, k = best
    if j < 0:
        fit[rows] = -total_g / (total_h + 1)
        return
    left = bins[rows, j] <= k
    bound = float(cuts[j][k])
    for side, sign in ((rows[left], "<="), (rows[~left], ">")):
        _grow(x, cuts, bins, g, h, side, depth - 1, (*path, (j, sign, bound)), out, fit, least)


def _holds(x: np.ndarray, terms: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, sign, bound in terms:
        out &= x[:, j] <= bound if sign == "<=" else x[:, j] > bound
    return out


def _merged(path: tuple) -> tuple:
    """The same conjunction with one bound for each statistic and side."""
    best: dict = {}
    for j, sign, bound in path:
        old = best.get((j, sign))
        best[j, sign] = bound if old is None else (min if sign == "<=" else max)(old, bound)
    return tuple(sorted((j, sign, bound) for (j, sign), bound in best.items()))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    n, m = r.shape
    w, b, v, vb, t = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(m), 0.0, 1.0
    vb = b
    rate = 4 / (np.linalg.norm(np.column_stack([r, np.ones(n)]), 2) ** 2 / n + 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ v + vb)))
        d = (p - y) / n
        nw = v - rate * (r.T @ d)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * d.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, penalty: float = 2e-4, most_rules: int = 60) -> Rules:
    """Grows trees, turns their paths into rules and keeps those with a lasso weight."""
    if not len(y) or y.min() == y.max():
        share = min(0.999, max(0.001, float(y.mean()) if len(y) else 0.5))
        return Rules(float(np.log(share / (1 - share))), [])
    least = max(2, len(y) // 500)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64)))[:-1] for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        _grow(x, cuts, bins, p - y, p * (1 - p), np.arange(len(y)), depth, (), paths, step, least)
        f += 0.4 * step
    terms, seen = [], set()
    columns = []
    for path in map(_merged, paths):
        on = _holds(x, path)
        mark = on.tobytes()
        if path not in seen and mark not in seen and 0 < on.sum() < len(y):
            seen |= {path, mark}
            terms.append(path)
            columns.append(on)
    if not terms:
        share = float(y.mean())
        return Rules(float(np.log(share / (1 - share))), [])
    r = np.column_stack(columns).astype(float)
    w, b = _lasso(r, y, penalty)
    keep = sorted(np.flatnonzero(np.abs(w) > 1e-3), key=lambda k: (-abs(w[k]), k))[:most_rules]
    return Rules(b, [(float(w[k]), tuple((names[j], sign, bound) for j, sign, bound in terms[k])) for k in keep])


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> Rules:
    """Fits the rules to at most `most` labelled rows, those with the smallest hash of doc_id."""
    own = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    own = own.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    own = own.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    rows = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).join(F.broadcast(own), F.col("_d") == F.col("_id"))  # `most` rows at most
    stats = statistics(F.col("_t"))
    rows = rows.select("_id", "_y", *[c.cast("double").alias(k) for k, c in stats.items()])
    got = rows.orderBy(F.xxhash64("_id"), "_id", *stats).limit(most).toArrow()
    names = list(stats)
    x = np.column_stack([got[k].to_numpy() for k in names]) if got.num_rows else np.zeros((0, len(names)))
    y = (got["_y"].to_numpy() > 0).astype(float) if got.num_rows else np.zeros(0)
    return fit_rules(x, y, names)


def scored(docs: DataFrame, rules: Rules, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with a column `name` (one of this name gives way)."""
    stats = statistics(F.col(text))
    used = sorted({k for _, terms in rules.rules for k, _, _ in terms})
    own = dict(zip(used, fresh(docs, *(f"_stat_{k}" for k in used)), strict=True))
    wide = docs.select("*", *[stats[k].cast("double").alias(own[k]) for k in used])
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    return wide.select(*kept, rules.column({k: F.col(own[k]) for k in used}).alias(name))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold."""
    (score,) = fresh(docs, "_score")
    return scored(docs, train(docs, labels), name=score).filter(F.col(score) >= threshold).select(*docs.columns)


def op9_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: a row for each document."""
    got = scored(docs.select("doc_id", "text"), train(docs, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
