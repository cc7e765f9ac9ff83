"""Personal data by weak supervision, with DataFrame operations only.

Patterns propose spans: the exact ones of each kind (base spans, always kept where
they hold) and looser ones beside them, which also look again into what an exact
pattern took and had to drop, as two card numbers in a row. Labelers vote yes, no
or nothing on each proposal: its form (a checksum, bounds, shape), lists of known
endings, prefixes and ranges (gazetteer), the words before it (context), and whether
it stands by itself. Expectation-maximisation estimates, for each kind, how often
each labeler is right, from the counts of the vote patterns; a logistic span
classifier is then trained on the posteriors and compiled into a column
expression, which decides on the proposals that no exact pattern holds; what its
form speaks against, as a failed checksum, is learned from and never added.

Only counts of vote patterns reach the driver: 3^4 patterns for each kind, whatever
the size of the corpus. They are taken over all documents.

Kinds are email, ip, card and phone, and on request `secret`: long runs of letters
and digits, as keys and tokens are, which have no exact pattern, so the classifier
alone decides.

Offsets are code points, end exclusive. A kind's matches are leftmost and do not
overlap; spans that are added never overlap a base span of their kind. Patterns
are written so that long runs cost linear time and no recursion.

Defined results: a null text is an empty one, a text without matches has empty
lists, repeated rows give repeated rows, further columns don't matter, whatever their
names, an empty table gives an empty result; a kind without proposals adds none.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, staged

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
LABELERS = 4

#: Marks around matches; characters of a text that are equal to one become another that no pattern knows.
_MARK, _OTHER, _FILL = "\uE000", "\uE001", "\uE002"

#: The exact patterns. A match starts where no part of a longer run stands before it, or at the end of the last match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Looser forms: spelled-out or spaced addresses, defanged dots, other separators, national numbers, and single numbers within longer runs.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+\[\.\][0-9]{1,3}+\[?\.\]?[0-9]{1,3}+\[?\.\]?[0-9]{1,3}+(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[-\x20./_][0-9]{4}){3})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+(])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: What a text must hold for a looser form.
HINTS = {"email": r"[\[(](?:at|AT|@)[\])]", "ip": r"[0-9]\[\.\]", "card": r"[0-9]{4}", "phone": r"[0-9]{3}[.-][0-9]{4}", "secret": r"[A-Za-z0-9+/_-]{20}"}
#: The labelers' patterns, for yes and for no. Form: shapes that hold or don't (cards, addresses of machines and phones are computed beside).
FORM = {"email": (r"[.)\]]\x20?[A-Za-z]{2,}$", r"[0-9-]$"), "secret": (r"^(?=.*[0-9])(?=.*[A-Za-z]).*$", r"^(?:[A-Za-z_-]*+|[0-9_/-]*+)$")}
#: Gazetteers: endings of addresses and of files, networks that belong to nobody, card prefixes, dialling codes, names of keys.
KNOWN = {
    "email": (r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$", r"(?i)\.(?:png|jpg|gif|js|py|txt|html)$"),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\b", r"^(?:0+|10|127|22[4-9]|2[345][0-9])\b"),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", r"^(?:[01789]|2[01]|3[0-3])"),
    "phone": (r"^(?:\+(?:1|33|34|44|49)\b|\(?[2-9])", r"^(?:\+0|\(?[01])"),
    "secret": (r"^(?:AKIA|ghp_|sk-|xox|eyJ)", r"^(?:-+|_+|/)"),
}
#: Words that announce a kind, or something else, within 24 characters before the span.
CONTEXT = {
    "email": (r"(?i)(?:e-?mail|mail|contact|write|adress|correo|courriel)[^\n]{0,16}$", r"(?i)(?:ssh|scp|git|clone)[^\n]{0,8}$"),
    "ip": (r"(?i)(?:\bip\b|host|server|address|ping|adresse)[^\n]{0,16}$", r"(?i)(?:version|release|section|chapter|\bv)[^\n]{0,4}$"),
    "card": (r"(?i)(?:card|visa|credit|karte|carte|tarjeta|account)[^\n]{0,16}$", r"(?i)(?:order|invoice|isbn|tracking|serial|article|\bref|\bno\.?|#)[^\n]{0,8}$"),
    "phone": (r"(?i)(?:phone|tel|call|fax|mobile|telefon|numéro)[^\n]{0,16}$", r"(?i)(?:order|invoice|isbn|part|serial|version|#)[^\n]{0,8}$"),
    "secret": (r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|bearer|credential)[^\n]{0,8}$", r"(?i)(?:sha(?:1|256)|md5|commit|checksum|https?:|www\.)[^\n]{0,16}$"),
}
_DIGITS = r"[^0-9]"


def _luhn(digits: Column) -> Column:
    """Sum of an account number's digits, each second one from the right doubled, is a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: (d.cast("int") * (1 + i % 2)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(span, _DIGITS, "")
    n = F.length(digits)
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str, holds: Column | None) -> Column:
    """The text cut before and after each match: matches stand at odd positions."""
    cut = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    return cut if holds is None else F.when(holds, cut).otherwise(F.array(text))


def _base_pieces(text: Column, kind: str) -> Column:
    if kind not in BASE:
        return F.array(text)
    return _pieces(text, BASE[kind], F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else None)


def _offsets(pieces: Column, body) -> Column:
    """body(start_of), start_of(i) being the length of all pieces before the i-th; sums are taken in two levels, so that many pieces cost little more than linear time."""
    step = 64
    sums = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    lengths = F.transform(pieces, lambda p: F.length(p))
    inner = let(lengths, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / step).cast("int")), lambda c: sums(F.slice(n, c * step + 1, F.lit(step)))))
    whole = lambda inn: sums(F.transform(inn, lambda a: F.element_at(a, -1)))
    at = lambda inn, top: lambda i: F.get(top, F.floor(i / step).cast("int")) + F.coalesce(F.get(F.get(inn, F.floor(i / step).cast("int")), i % step), F.lit(0))
    return let(inner, lambda inn: let(whole(inn), lambda top: body(at(inn, top))))


def _yes_no(value: Column, patterns: tuple[str, str]) -> Column:
    return F.when(value.rlike(patterns[0]), 1).when(value.rlike(patterns[1]), 2).otherwise(0)


def _votes_on(kind: str, pieces: Column, i: Column, exact: bool) -> Column:
    """The votes on the i-th piece, base 3: 0 abstains, 1 yes, 2 no."""
    span, before, after = F.get(pieces, i), F.right(F.get(pieces, i - 1), F.lit(24)), F.left(F.get(pieces, i + 1), F.lit(1))
    digits = F.regexp_replace(span, _DIGITS, "")
    if kind == "card":
        form = F.when(_luhn(digits), 1).otherwise(2)
    elif kind == "ip":
        form = F.when(_valid(kind, F.translate(span, "[]", "")), 1).otherwise(2)
    elif kind == "phone":
        form = F.when((F.length(digits) >= 9) & (F.length(digits) <= 15), 1).otherwise(2)
    else:
        form = F.lit(1) if exact else _yes_no(span, FORM[kind])
    alone = F.when((F.right(before, F.lit(1)).rlike(r"[\s(<\"':;,=]|^$")) & after.rlike(r"[\s)>\"':;,.]|^$"), 1).otherwise(2)
    return (form + 3 * _yes_no(span, KNOWN[kind]) + 9 * _yes_no(before, CONTEXT[kind]) + 27 * alone).cast("int")


def _spans(kind: str, pieces: Column, exact: bool) -> Column:
    """array<struct<s, e, f>> of the matches among `pieces`, of exact ones those that hold; f packs the votes."""
    n = F.size(pieces)
    odd = F.when(n > 1, F.sequence(F.lit(1), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    if exact:
        odd = F.filter(odd, lambda i: _valid(kind, F.get(pieces, i)))
    one = lambda start: lambda i: F.struct(start(i).alias("s"), start(i + 1).alias("e"), _votes_on(kind, pieces, i, exact).alias("f"))
    return _offsets(pieces, lambda start: F.transform(odd, one(start)))


def _clean(text: Column) -> Column:
    """The text without the marks that this module sets itself."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(f"[{_MARK}{_FILL}]"), F.translate(t, _MARK + _FILL, _OTHER + _OTHER)).otherwise(t)


def proposals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row for each document: _id, and for each kind the arrays `<kind>` (base spans) and `<kind>_more` (further proposals)."""
    rows = docs.select(F.col(doc_id).alias("_id"), _clean(F.col(text)).alias("_t"))
    none = F.array().cast("array<struct<s:int,e:int,f:int>>")
    rows = rows.select("_id", "_t", *[_base_pieces(F.col("_t"), k).alias(f"_p_{k}") for k in kinds])
    # Looser forms are only sought outside the base spans that hold, which are blotted out at equal length.
    gone = lambda k: F.array_join(F.transform(f"_p_{k}", lambda p, i: F.when((i % 2 == 1) & _valid(k, p), F.repeat(F.lit(_FILL), F.length(p))).otherwise(p)), "")
    blot = lambda k: F.when(F.size(f"_p_{k}") == 1, F.col("_t")).otherwise(gone(k))
    rows = rows.select("_id", *[f"_p_{k}" for k in kinds], *[_pieces(blot(k), LOOSE[k], F.col("_t").rlike(HINTS[k])).alias(f"_m_{k}") for k in kinds])
    base = [F.when(F.size(f"_p_{k}") > 1, _spans(k, F.col(f"_p_{k}"), True)).otherwise(none).alias(k) for k in kinds]
    more = [F.when(F.size(f"_m_{k}") > 1, _spans(k, F.col(f"_m_{k}"), False)).otherwise(none).alias(f"{k}_more") for k in kinds]
    return rows.select("_id", *base, *more)


def _vote(f: int, labeler: int) -> int:
    return f // 3**labeler % 3


def reliabilities(counts: dict[int, int], steps: int = 50) -> tuple[dict[int, float], list[list[list[float]]], float]:
    """EM over vote patterns with their counts: posterior of each pattern, P(vote | class) of each labeler, and the share of true spans.

    Labelers vote independently given the class; starting from the majority of
    their votes, smoothed by one count each, until the estimates settle.
    """
    post = {}
    for f in counts:
        votes = [_vote(f, k) for k in range(LABELERS)]
        post[f] = (0.5 + votes.count(1)) / (1 + votes.count(1) + votes.count(2))
    table, share = [], 0.5
    for _ in range(steps):
        total = sum(counts.values())
        share = (1 + sum(n * post[f] for f, n in counts.items())) / (2 + total)
        table = []
        for k in range(LABELERS):
            row = []
            for cls in (0, 1):
                mass = [1.0, 1.0, 1.0]
                for f, n in counts.items():
                    mass[_vote(f, k)] += n * (post[f] if cls else 1 - post[f])
                row.append([m / sum(mass) for m in mass])
            table.append(row)
        # A yes must speak for the class, on the whole; else the classes have changed places.
        if sum(row[1][1] - row[1][2] - row[0][1] + row[0][2] for row in table) < 0:
            table, share = [row[::-1] for row in table], 1 - share
        new = {}
        for f in counts:
            yes, no = math.log(share), math.log(1 - share)
            for k in range(LABELERS):
                v = _vote(f, k)
                yes, no = yes + math.log(table[k][1][v]), no + math.log(table[k][0][v])
            new[f] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        moved = max((abs(new[f] - post[f]) for f in counts), default=0.0)
        post = new
        if moved < 1e-6:
            break
    return post, table, share


def train_classifier(counts: dict[int, int], post: dict[int, float], steps: int = 300) -> list[float]:
    """Logistic weights over (bias, yes and no of each labeler), fitted to the posteriors; a bounded number of patterns."""
    size = 1 + 2 * LABELERS
    rows = [([1.0, *(float(_vote(f, k) == v) for k in range(LABELERS) for v in (1, 2))], post[f], n) for f, n in counts.items()]
    total = sum(n for _, _, n in rows) or 1
    w = [0.0] * size
    for _ in range(steps):
        grad = [0.001 * v for v in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for k in range(size):
                grad[k] += n / total * (p - y) * x[k]
        w = [a - 1.5 * g for a, g in zip(w, grad, strict=True)]
    return w


def _score(f: Column, w: list[float]) -> Column:
    total = F.lit(w[0])
    for k in range(LABELERS):
        vote = F.floor(f / 3**k) % 3
        total = total + F.when(vote == 1, w[1 + 2 * k]).when(vote == 2, w[2 + 2 * k]).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def _votes(kind: str, spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["f"].alias("f")))


def _accepts(f: Column, w: list[float], threshold: float) -> Column:
    """The classifier's word, unless the form itself speaks against the span, as a checksum does."""
    return (_score(f, w) >= threshold) & (f % 3 != 2)


def _accepted(spans: str, w: list[float], threshold: float) -> Column:
    return F.filter(spans, lambda x: _accepts(x["f"], w, threshold))


def _trained(got: DataFrame, kinds: tuple[str, ...]) -> dict[str, list[float]]:
    """The classifier's weights for each kind, from all proposals."""
    votes = [_votes(k, c) for k in kinds for c in (k, f"{k}_more")]
    seen = got.select(F.explode(F.concat(*votes)).alias("v")).groupBy("v.kind", "v.f").count().collect()  # 81 rows a kind at most
    out = {}
    for k in kinds:
        counts = {r["f"]: r["count"] for r in seen if r["kind"] == k}
        out[k] = train_classifier(counts, reliabilities(counts)[0])
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A row for each document: _id, for each kind `<kind>` (base spans) and `<kind>_added`: array<struct<s, e, f>>."""
    got = staged(proposals(docs, doc_id, text, kinds), "proposals")
    weights = _trained(got, kinds)
    return got.select("_id", *kinds, *[_accepted(f"{k}_more", weights[k], threshold).alias(f"{k}_added") for k in kinds])


def _replaced(pieces: Column, kind: str, weights: list[float] | None, threshold: float) -> Column:
    """The pieces with the matches that hold, or that the classifier accepts, replaced."""
    goes = lambda x, i: _valid(kind, x) if weights is None else _accepts(_votes_on(kind, pieces, i, False), weights, threshold)
    return F.transform(pieces, lambda x, i: F.when((i % 2 == 1) & goes(x, i), f"[{kind.upper()}]").otherwise(x))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, kinds: tuple[str, ...] = ALL) -> DataFrame:
    """The documents with each span, base or added, replaced by [KIND], kind after kind."""
    weights = _trained(staged(proposals(docs, doc_id, text, kinds), "proposals"), kinds)
    now, cut = fresh(docs, "_text", "_pieces")
    out = docs.withColumn(now, _clean(F.col(text)))
    for k in kinds:
        for exact in (True, False):
            pieces = _base_pieces(F.col(now), k) if exact else _pieces(F.col(now), LOOSE[k], F.col(now).rlike(HINTS[k]))
            marked = _replaced(F.col(cut), k, None if exact else weights[k], threshold)
            out = out.withColumn(cut, pieces).withColumn(now, F.when(F.size(cut) > 1, F.array_join(marked, "")).otherwise(F.col(now)))
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.col(now))).select(*docs.columns)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _joined(lists: list[tuple[str, Column]]) -> Column:
    return F.array_join(reduce(F.concat, [_named(k, c) for k, c in lists]), ",")


def op6_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns: a row for each document."""
    got = find(docs)
    both = [(k, F.sort_array(F.concat(k, f"{k}_added"))) for k in KINDS]
    return got.select(F.col("_id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined([(k, F.col(k)) for k in KINDS]), 256).alias("base_sha256"), _joined(both).alias("spans"))
