"""The ten operators against plain Python versions, on small tables with nulls, ties, repeated rows, long and empty texts."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corbel.llm import decontam, jaccard, linehash, mixing, pii, quality, sharding, topk, winnow
from corbel.llm import tokens as tok

from . import brute

VOCAB = [a + b for a in ("ba", "ko", "ri", "ne", "tu", "sa") for b in ("l", "n", "st", "ré", "m", "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def table(spark, rows, **more):
    """Documents from (doc_id, text[, source]); with further columns whose names the operators use themselves."""
    data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    own = ("size", "shard", "score", "rid", "w", "g", "_more", "_id", "_hash", "_group", "_copy", "f", "r", "_file", "_row", "_metadata", "gone", "removed", "text_", "spans", "items", "rank", "copies", "target", "label", "no", "_text", "_t")
    return df.withColumns({k: F.lit(f"own {k}") for k in own})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.choice([3, 12, 40, 90]))) for i in range(60)]
    out += [(100 + i, out[i][1]) for i in range(8)]  # exact copies
    for i in range(10, 30):  # near copies
        w = out[i][1].split(" ")
        if len(w) > 30:
            w[len(w) // 2] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300, None), (301, ""), (302, ""), (303, "a"), (304, "!!! ... \n"), (305, prose(rng, 6000)), (306, "x" * 5000), (307, None)]
    return out


def test_mixing_targets_and_counts(spark, rows):
    src = ["a", "b", "a", None, "c", "a", "z", "a"]
    data = [(d, t, src[i % 8]) for i, (d, t) in enumerate(rows)]
    got = mixing.op1_rows(table(spark, data)).collect()
    assert len(got) == len(data)
    sizes = defaultdict(int)
    for d, t, s in data:
        sizes[s] += brute.size_words(t)
    want = brute.targets(sizes)
    source = {d: s for d, _, s in data}
    text = {d: t for d, t, _ in data}
    taken = Counter()
    for r in got:
        assert r.size == brute.size_words(text[r.doc_id])
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        biggest = max(brute.size_words(x) for d, x in text.items() if source[d] == s)
        assert abs(taken[s] - t) <= biggest / 2 + 1
    again = mixing.op1_rows(table(spark, data[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixed(table(spark, data))
    assert mixed.count() == sum(r.copies for r in got)
    assert mixed.columns == table(spark, data).columns


def test_mixing_order_is_pareto(spark):
    """Within a source of equal inclusion, those with the smallest odds are taken."""
    data = [(i, "w " * 10, "a") for i in range(400)] + [(1000 + i, "w " * 10, "b") for i in range(400)]
    got = mixing.mix(table(spark, data)).collect()
    by = {s: [r for r in got if r.source == s] for s in "ab"}
    assert sum(r.taken for r in by["a"]) == pytest.approx(by["a"][0].target, abs=10)
    assert {r.copies for r in by["a"]} == {1, 2} and {r.copies for r in by["b"]} == {0, 1}


def test_mixing_repeated_rows_and_empty(spark):
    data = [(1, "a b c", "s")] * 5 + [(2, "d", "t")]
    got = mixing.op1_rows(table(spark, data)).collect()
    assert len(got) == 6
    assert sum(r.taken for r in got if r.doc_id == 1) == pytest.approx(got[0].target, abs=3)
    assert mixing.op1_rows(table(spark, [])).count() == 0
    assert mixing.mixed(table(spark, [])).count() == 0


def test_mixing_of_unequal_probabilities(spark):
    """Targets are met though some documents are held at the cap; heavier documents are taken more often."""
    rng = random.Random(12)
    data = [(i, "w " * rng.randrange(1, 30), "ab"[i % 3 > 0]) for i in range(900)]
    docs = table(spark, data).withColumn("worth", F.pow(F.lit(2.0), F.col("doc_id") % 9))
    got = mixing.mix(docs, weight_col="worth").collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert max(r.copies for r in mine) <= 3 and (s == "b" or max(r.copies for r in mine) == 3)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 15
        by = [[r.copies for r in mine if r._id % 9 == k] for k in range(9)]
        mean = [sum(x) / len(x) for x in by if x]
        assert mean[0] < mean[-1] / 5
    none = mixing.mix(docs.withColumn("worth", F.lit(None).cast("double")), weight_col="worth").collect()
    same = mixing.mix(docs).collect()
    assert sorted((r._id, r.copies) for r in none) == sorted((r._id, r.copies) for r in same)


def test_mixing_of_rows_that_equal_each_other(spark, monkeypatch):
    """A row that is repeated more often than the cut may hold is dealt out by place."""
    monkeypatch.setattr(mixing, "CROSSING_ROWS", 20)
    data = [(1, "a b c", "s")] * 400 + [(i, "a b c d", "s") for i in range(2, 50)] + [(100 + i, "e " * 40, "t") for i in range(100)]
    got = mixing.mix(table(spark, data)).collect()
    for s in "st":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 20
    assert max(r.copies for r in got) - min(r.copies for r in got if r.source == "s") <= 3
    mixed = Counter(r.doc_id for r in mixing.mixed(table(spark, data)).collect())
    want = Counter()
    for r in got:
        want[r._id] += r.copies
    assert mixed == +want


def test_differencing_beats_greedy():
    rng = random.Random(1)
    for ways in (2, 5, 24):
        w = [rng.randrange(1, 10_000) for _ in range(400)]
        part = sharding.differencing(w, ways)
        loads = [0] * ways
        for x, p in zip(w, part, strict=True):
            loads[p] += x
        greedy = [0] * ways
        for x in sorted(w, reverse=True):
            greedy[greedy.index(min(greedy))] += x
        assert max(loads) - min(loads) <= max(greedy) - min(greedy)
    assert sharding.differencing([], 3) == [] and sharding.differencing([5], 3) == [0]
    assert sorted(sharding.differencing([8, 7, 6, 5, 4], 2)).count(0) in (2, 3)


def test_sharding(spark, rows):
    data = rows + [(500 + i, "one large group of copies " * 30) for i in range(40)] + [rows[3]] * 2
    got = sharding.op2_rows(table(spark, data)).collect()
    assert len(got) == len(data)
    slots, loads, where = defaultdict(list), Counter(), {}
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    text = dict(data)
    import zlib

    for r in got:
        t = text[r.doc_id]
        assert r.size == (len(t.encode()) if t is not None else 0) + 8
        assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert where.setdefault(t, r.shard) == r.shard
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert set(slots) <= set(range(24))
    assert sharding.op2_rows(table(spark, [])).count() == 0
    out = sharding.sharded(table(spark, data))
    assert out.count() == len(data) and "shard" in out.columns


def test_sharding_against_plain_differencing(spark, rows):
    """The loads are those of differencing over all groups of equal texts."""
    data = rows + [(500 + i, "copies " * 40) for i in range(12)]
    got = sharding.op2_rows(table(spark, data)).collect()
    weights = Counter()
    for _, t in data:
        weights[t] += (len(t.encode()) if t is not None else 0) + 8
    parts = [[(w, [k])] + [(0, [])] * 23 for k, w in weights.items()]
    while len(parts) > 1:  # the two partitions of the largest spread, oppositely ordered
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1])), key=lambda x: -x[0]))
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    spread = lambda x: max(x) - min(x)
    assert spread([loads[s] for s in range(24)]) == pytest.approx(spread([w for w, _ in parts[0]]), rel=0.02)


def test_slots_of_a_row_that_is_repeated(spark, monkeypatch):
    data = [(1, "same text")] * 500 + [(i, f"text {i}") for i in range(2, 90)]
    slots = defaultdict(list)
    for r in sharding.op2_rows(table(spark, data)).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    out = sharding.sharded(table(spark, data)).collect()
    assert len(out) == len(data) and len({r.shard for r in out if r.doc_id == 1}) == 1


def test_sharding_is_tight_with_a_large_group(spark):
    rng = random.Random(3)
    data = [(i, "x" * rng.randrange(100, 900)) for i in range(3000)] + [(9000 + i, "y" * 500) for i in range(150)]
    loads = Counter()
    for r in sharding.op2_rows(table(spark, data)).collect():
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 0.01 * min(loads.values()) or max(loads.values()) == 150 * 508


def best_by_force(vec, k=20, every=20):
    """Rows (query_id, rank, vec_id, score) of all usable vectors, each row being a query or candidate of its own."""
    import math

    fine = [(i, [math.floor(64 * x) if math.isfinite(64 * x) else int(x) * 64 for x in v]) for i, v in vec if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(fine):
        if q % every == 0:
            best = sorted((-min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(a, b)))), i) for m, (i, b) in enumerate(fine) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(2)
    vec = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(500)]
    vec += [(800 + i, vec[0][1]) for i in range(30)] + [(0, vec[1][1]), (40, vec[40][1]), (40, vec[40][1])]
    vec += [(900, None), (901, [float("nan")] * 16), (902, [None] * 16), (903, [float("inf")] + [0.0] * 15), (None, vec[1][1]), (1000, [0.5]), (1020, [])]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>").withColumns({k: F.lit("x") for k in ("v", "score", "id", "no", "rng", "pivot", "rank", "query_id")})
    assert sorted(map(tuple, topk.op3_rows(df).collect())) == best_by_force(vec)
    assert topk.op3_rows(df.limit(0)).count() == 0
    assert sorted(map(tuple, topk.op3_rows(df.filter("vec_id in (0, 5)")).collect())) == best_by_force([x for x in vec if x[0] in (0, 5)])
    assert topk.op3_rows(df.filter("vec_id = 1020")).count() == 0


def test_top_k_of_values_of_any_size(spark):
    rng = random.Random(22)
    for size in (1e4, 1e8, 1e18, 1e307):
        vec = [(i, [rng.uniform(-size, size) for _ in range(4)]) for i in range(60)]
        df = spark.createDataFrame(vec, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, topk.op3_rows(df).collect())) == best_by_force(vec)


def test_top_k_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 60)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "FEW", 2)
    rng = random.Random(8)
    centres = [[rng.gauss(0, 0.5) for _ in range(8)] for _ in range(6)]
    vec = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 6]]) for i in range(900)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.op3_rows(df).collect())) == best_by_force(vec)
    assert 0 < topk.scored_share(df) < 0.5
    plan = topk.op3_rows(df)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def encoder():
    P = pytest.importorskip("public_tokenizers")
    return tok.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), tok.Encoder(P.path("byte_bpe_50k.json"))


def test_tokens_match_the_library(spark, rows, encoder):
    fast, slow = encoder
    extra = [(700, "a <|endoftext|> b<|endoftext|>c"), (701, "日本語 text 🙂🙂 é̀  x y  \t z"), (702, "it's we'll 'RE 12345 ..." * 3)]
    data = rows + extra
    got = {r.doc_id: r for r in tok.op4_rows(table(spark, data), fast.path, fast.twin, fast.pattern).collect()}
    for d, t in data:
        n = len(slow.slow.encode(t or "", add_special_tokens=False).ids)
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len((t or "").encode()), n > 512)
    assert tok.op4_rows(table(spark, []), fast.path).count() == 0


def test_both_encoders_agree_on_plain_characters(encoder):
    fast, slow = encoder
    for c in range(0x250):
        for form in ("{0}", "a{0}b", " {0} 1{0}", "\n{0}{0} {0}'s"):
            text = form.format(chr(c))
            assert fast.quick(text) and fast.count(text) == slow.count(text), hex(c)


@pytest.mark.parametrize("chunk,overlap", [(400, 120), (1000, 200), (300, 90)])
def test_resynchronisation(encoder, chunk, overlap):
    rng = random.Random(chunk)
    for enc in encoder:
        for text in (
            " ".join(rng.choice([*VOCAB, "<|endoftext|>", "1234567", "don't", "été", "...", "  ", "\n\n"]) for _ in range(1500)),
            prose(rng, 300) + "z" * 3000 + prose(rng, 300),
            "q" * 5000,
            " " * 4000 + "end",
            "日本語🙂 " * 700,
        ):
            n, _ = tok.resynchronised(text, enc.ends, chunk, overlap)
            assert n == len(enc.slow.encode(text, add_special_tokens=False).ids)
    assert tok.resynchronised(prose(rng, 300) + "z" * 3000 + prose(rng, 300), encoder[0].ends, chunk, overlap)[1] > 0


def test_decontamination(spark, rows):
    rng = random.Random(9)
    item = [prose(rng, 25), prose(rng, 10), prose(rng, 11), "Short ITEM here", "one", None, "", "!!", prose(rng, 40)]
    items = list(enumerate(item)) + [(77, item[0]), (None, item[1])]
    docs = rows + [(400, "intro words " + "".join(c.upper() if c.isascii() else c for c in item[0]) + " and more"), (401, "x " + " ".join(item[8].split()[5:16]) + " y"), (402, "x " + " ".join(item[8].split()[5:14]) + " y"), (403, "a short, item HERE! one"), (404, item[2] + " " + item[2]), (404, item[2] + " " + item[2]), (405, "É " + item[1] + " É")]
    d = table(spark, docs).withColumn("n_words", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(1)).withColumn("m", F.lit(1))
    got = sorted(map(tuple, decontam.op5_rows(d, b).collect()), key=str)
    assert got == sorted(brute.contamination(docs, items), key=str)
    assert decontam.op5_rows(d.limit(0), b).count() == 0
    none = decontam.op5_rows(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    kept = decontam.decontaminate(d, b)
    hit = {x[0] for x in brute.contamination(docs, items) if x[5]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x for x, _ in docs if x not in hit)
    cut = {r.doc_id: r.text for r in decontam.decontaminate(d, b, "spans").collect()}
    assert cut[400] == "intro words and more" and cut[300] is None and cut[402] == dict(docs)[402]


def test_letters_beyond_ascii_keep_their_case(spark):
    d = spark.createDataFrame([(1, "ÉTÉ un deux"), (2, "été UN deux")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "été un deux")], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontam.op5_rows(d, b).collect()} == {1: False, 2: True}


def test_probes_match_whatever_follows_a_word(spark):
    # The lower case of a capital sigma is another one at the end of a word.
    text = ".".join(f"{a}{b}Σ" for a in "ΑΒ" for b in "ΓΔΕΖΗ")
    d = spark.createDataFrame([(1, text), (2, text.replace(".", " "))], "doc_id long, text string")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.op5_rows(d, b).collect()} == {1: 10, 2: 10}


def test_personal_data(spark, rows):
    extra = [
        "mail a.b@c.de, x@y and a@b.c_d@e.f.g or a@b.c.", "192.168.0.1 256.1.1.1 1.2.3.4.5.6.7.8 007.0.0.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 or 378282246310005",
        "+1 (499) 555-6503, +12 3 +1.2.3.4.5.6.7.8.9 +(1) +49 30 1234567-", "é🙂 a@b.cc é 10.0.0.1", "a" * 4000 + "@" + "b." * 3000 + "c", "1 " * 6000, "1." * 5000, "+1" + " 2" * 4000, "@.@.@" * 500, "xy a@b.cd", "jo [at] host [dot] org, mail: jo (at) host.org", "call 555-123-4567 or (555) 123-4567",
    ]
    docs = rows + [(600 + i, t) for i, t in enumerate(extra)] + [rows[0]]
    d = table(spark, docs).withColumn("email", F.lit(1)).withColumn("_t", F.lit(1))
    got = pii.op6_rows(d).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(brute.pii_row(i, t) for i, t in docs)
    for r in got:
        base = brute.pii(dict(docs)[r.doc_id])
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert all([k, str(s), str(e)] in spans for k in base for s, e in base[k])
        assert spans == sorted(spans, key=lambda x: (list(brute.PII).index(x[0]), int(x[1]), int(x[2])))
    assert pii.op6_rows(d.limit(0)).count() == 0
    clean = pii.redacted(table(spark, [(1, "mail a@b.cd now"), (2, None)]).select("doc_id", "text")).collect()
    assert {r.doc_id: r.text for r in clean} == {1: "mail [EMAIL] now", 2: None}


def test_em_recovers_reliabilities():
    rng = random.Random(4)
    counts = Counter()
    for _ in range(5000):
        true = rng.random() < 0.4
        f = 0
        for k, right in enumerate((0.95, 0.8, 0.7, 0.6)):
            yes = true if rng.random() < right else not true
            f += 3**k * (1 if yes else 2)
        counts[f] += 1
    post, rates, share = pii.reliabilities(counts)
    assert abs(share - 0.4) < 0.08
    assert rates[0][1][1] > rates[2][1][1] > 0.55
    w = pii.train_classifier(counts, post)
    assert w[1] > w[5] > 0 > w[2]


def test_jaccard(spark, rows):
    got = {r.doc_id: r for r in jaccard.op7_rows(table(spark, rows)).collect()}
    want = brute.jaccard_classes(rows)
    assert len(got) == len(rows)
    assert {d: (r.class_id, r.n_links) for d, r in got.items()} == want
    assert jaccard.op7_rows(table(spark, [])).count() == 0
    kept = jaccard.keep_one(table(spark, rows + [rows[0]]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})


def test_jaccard_with_null_ids_and_repeated_rows(spark):
    rng = random.Random(41)
    a, b, c = (prose(rng, 60) for _ in range(3))
    docs = [(1, a), (1, a), (2, a + " end"), (None, b), (3, b + " end"), (4, "start " + b), (None, c), (None, c), (None, c + " end")]
    got = sorted((tuple(r) for r in jaccard.op7_rows(table(spark, docs)).select("doc_id", "class_id", "n_links").collect()), key=str)
    want = brute.jaccard_classes([(i, t) for i, (_, t) in enumerate(docs)])
    smallest = {k: min((docs[i][0] for i in want if want[i][0] == k and docs[i][0] is not None), default=None) for k, _ in want.values()}
    assert got == sorted(((d, smallest[want[i][0]], want[i][1]) for i, (d, _) in enumerate(docs)), key=str)


def test_jaccard_of_texts_with_one_gram(spark):
    docs = [(1, "a a a a a"), (2, "a a a a a a"), (3, "a a a a a a a"), (4, "b b b b b"), (5, "one two"), (6, "")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.op7_rows(table(spark, docs)).collect()}
    assert got == brute.jaccard_classes(docs)


def test_keep_one_with_repeated_rows_and_ids(spark):
    rng = random.Random(31)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    near = lambda t: t + " one more"
    docs = [(1, a), (1, a), (None, b), (None, c), (None, None), (2, d), (3, e), (3, near(d)), (4, prose(rng, 60)), (4, prose(rng, 60)), (5, None), (5, None)]
    docs += [(6, f := prose(rng, 60)), (6, near(f)), (7, f)]
    kept = Counter((r.doc_id, r.text) for r in jaccard.keep_one(table(spark, docs)).collect())
    six = [x for x in kept if x[0] == 6]
    assert len(six) == 1 and kept[six[0]] == 1
    assert {k: v for k, v in kept.items() if k[0] != 6} == dict.fromkeys([x for x in docs if x[0] not in (6, 7) and x != (3, near(d))], 1) | {(5, None): 2}


def test_jaccard_of_a_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(11)
    base = prose(rng, 120).split(" ")
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 5])):
            w[rng.randrange(120)] = f"new{rng.randrange(1000)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, prose(rng, 50)) for i in range(40)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.op7_rows(table(spark, docs)).collect()}
    assert got == brute.jaccard_classes(docs)


def test_jaccard_of_a_long_chain(spark, monkeypatch):
    """Each text is near to the next few only: verified bucket by bucket, as all pairs of the set would be more."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(21)
    stream = [f"{rng.choice(VOCAB)}{rng.randrange(50)}" for _ in range(1400)]
    docs = [(i, " ".join(stream[6 * i : 6 * i + 120])) for i in range(200)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.op7_rows(table(spark, docs)).collect()}
    assert got == brute.jaccard_classes(docs)


def test_jaccard_splits_long_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WORDS", 2000)
    rng = random.Random(23)
    base = prose(rng, 900).split(" ")
    docs = [(i, " ".join(base[:k] + [f"n{i}"] + base[k:])) for i, k in enumerate(rng.randrange(900) for _ in range(12))]
    docs += [(50 + i, prose(rng, 30)) for i in range(5)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.op7_rows(table(spark, docs)).collect()}
    assert got == brute.jaccard_classes(docs)


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_for(0.8, 0.99999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999


def by_sql(query, docs):
    """Rows of a query's SQL over a table of documents, in DuckDB."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [d for d, _ in docs], "text": pd.Series([t for _, t in docs], dtype=object)}))
    return sorted(con.sql(query).fetchall(), key=str)


def test_line_hashing(spark, rows):
    rng = random.Random(6)
    lines = [prose(rng, n) for n in (20, 30, 3, 16, 11, 40, 9)]
    docs = [(i, "\n".join(rng.choice(lines + [prose(rng, 20)]) for _ in range(rng.randrange(1, 7))) + rng.choice(["", "\n", "\n\n"])) for i in range(40)]
    docs += [(50, lines[0].upper() + "  \n tail"), (51, None), (52, ""), (53, "\n\n"), (54, lines[1] + "\n" + lines[1]), (55, "x " * 100), (56, "y " + "x " * 100), (57, " \n " + lines[4]), (58, "ÉTÉ " + lines[5] + "\t\x1f\n\n" + prose(rng, 300))]
    passage = " ".join(prose(rng, 1) + str(rng.randrange(30)) for _ in range(60))
    docs += [(60 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for i in range(3)] + [(70, prose(rng, 400)), (71, prose(rng, 20) + "\n" + passage[:150] + "\n" + passage[150:] + "\n" + prose(rng, 20))]
    got = {r.doc_id: r for r in linehash.deduplicated(table(spark, docs)).collect()}
    text = dict(docs)
    for d, r in got.items():
        kept = "".join((text[d] or "")[a:b] for a, b in zip([0, *(x.e for x in r.removed)], [*(x.s for x in r.removed), len(text[d] or "")]))
        assert (r.text or "") == kept and (r.text is None) == (text[d] is None)
    for d in (61, 62):
        ((s, e, w, first),) = got[d].removed
        assert first == 60 and w > 25 and text[d][s:e].strip() in passage
    assert not got[60].removed and not got[70].removed
    eleven = [d for d, t in docs if lines[4] in (t or "")]
    assert [d for d in eleven if lines[4] in (got[d].text or "")] == eleven[:1]
    assert sorted(map(tuple, linehash.op8_rows(table(spark, docs)).collect()), key=str) == by_sql(linehash.OP8_SQL, docs)
    assert linehash.op8_rows(table(spark, [])).count() == 0


def test_line_hashing_of_repeated_rows_and_ids(spark):
    rng = random.Random(61)
    a, b, c = (prose(rng, 20) for _ in range(3))
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b + "\n" + c), (None, None), (3, c), (3, c + "\n" + b)]
    for back in (False, True):
        got = linehash.deduplicated(table(spark, rows[::-1] if back else rows)).collect()
        assert Counter(r.text for r in got if r.doc_id in (1, 2)) == {a: 1, "": 2}
        kept = Counter(x for r in got if r.text for x in r.text.split("\n") if x)
        assert kept == {a: 1, b: 1, c: 1}


def test_units_of_any_passage_of_51_words(spark):
    rng = random.Random(62)
    for _ in range(60):
        passage = " ".join(prose(rng, 1) + str(rng.randrange(9)) for _ in range(51))
        sides = []
        for _ in range(2):
            t = prose(rng, rng.randrange(40)) + " " + passage + " " + prose(rng, rng.randrange(40))
            _, kind, a, b, s, e = linehash.units([t])
            sides.append({(t[x:y].strip(), int(j - i)) for k, i, j, x, y in zip(kind, a, b, s, e) if k != linehash.WHOLE})
            assert all(j - i <= linehash.WINDOW + linehash.GRAM - 1 for k, i, j in zip(kind, a, b) if k != linehash.WHOLE)
        assert sum(n for _, n in sides[0] & sides[1]) >= linehash.RUN


def test_winnowing(spark):
    rng = random.Random(7)
    pool = [prose(rng, 6) for _ in range(25)]
    runs = [pool[a : a + 6] for a in (0, 7, 14)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += rng.choice(runs) if rng.random() < 0.5 else [prose(rng, 5) for _ in range(3)]
            if rng.random() < 0.3:
                parts.append("  ")
        docs.append((i, "\n".join(parts)))
    docs += [(70, None), (71, ""), (72, "a"), (73, "\n".join(["same line here"] * 9))]
    got = {r.doc_id: r for r in winnow.deduplicated(table(spark, docs)).collect()}
    k, w = winnow.K, winnow.W
    place = {}
    repeated, long_repeats = defaultdict(set), defaultdict(set)
    for size, to in ((k, repeated), (k + w - 1, long_repeats)):
        place = {}
        for d, t in docs:
            lines = [(n, brute.normalised(x)) for n, x in enumerate((t or "").split("\n")) if brute.normalised(x)]
            for p in range(len(lines) - size + 1):
                key = tuple(x for _, x in lines[p : p + size])
                if key in place:
                    to[d] |= {n for n, _ in lines[p : p + size]}
                else:
                    place[key] = (d, p)
    for d, t in docs:
        gone = set(got[d].gone)
        assert gone <= repeated[d], d  # only lines of runs that stand earlier
        if d != 73:
            # Each long run that stands earlier loses its lines, but for less than w at its ends.
            assert len(long_repeats[d] - gone) <= 2 * (w - 1) * max(1, len(long_repeats[d]) // (k + w - 1)), d
        kept = [x for n, x in enumerate((t or "").split("\n")) if n not in gone]
        assert (got[d].text or "") == "\n".join(kept)
    assert sum(len(r.gone) for r in got.values()) > 100
    assert 0 < len(got[73].gone) <= 6 and 0 not in got[73].gone
    assert winnow.op10_rows(table(spark, [])).count() == 0


def test_winnowing_of_long_lines(spark):
    """A long line that stands earlier goes, whatever stands around it; short ones need a run."""
    rng = random.Random(71)
    long, short = [prose(rng, 30) for _ in range(4)], [prose(rng, 5) for _ in range(6)]
    docs = [(0, "\n".join([short[0], long[0], short[1]])), (1, "\n".join([prose(rng, 8), long[0].upper(), prose(rng, 8)])), (2, long[0] + "\n" + long[0]), (3, "\n".join([short[0], prose(rng, 6), short[1]])), (4, "\n".join([*short, long[1]])), (5, "\n\n" + "\n".join([*short, long[2]])), (6, None), (7, "")]
    got = {r.doc_id: list(r.gone) for r in winnow.deduplicated(table(spark, docs)).collect()}
    assert got[0] == [] and got[1] == [1] and got[2] == [0, 1] and got[3] == [] and got[4] == [] and set(range(2, 8)) >= set(got[5]) and len(got[5]) >= 5
    assert sorted(map(tuple, winnow.op10_rows(table(spark, docs)).collect()), key=str) == by_sql(winnow.OP10_SQL, docs)


def test_winnowing_of_repeated_rows_and_ids(spark):
    rng = random.Random(72)
    a, b = (prose(rng, 40) for _ in range(2))
    docs = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, b)]
    got = Counter((r.doc_id, r.text) for r in winnow.deduplicated(table(spark, docs)).collect())
    assert got == {(1, a): 1, (1, ""): 1, (2, ""): 1, (3, b): 1, (None, ""): 2}


def test_tokens_of_repeated_rows(spark, rows, encoder):
    got = tok.op4_rows(table(spark, [rows[0]] * 3 + [(None, "a b")]), encoder[0].path).collect()
    assert sorted(Counter(tuple(r) for r in got).values()) == [1, 3]


def test_quality(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    got = quality.op9_rows(docs.withColumn("score", F.lit("x")), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == brute.crc_held_out(r.doc_id) for r in got)
    test = [r for r in got if r.held_out]
    good = [r.score for r in test if r.quality == 1]
    bad = [r.score for r in test if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert sum(r.predicted == r.quality for r in test) / len(test) > 0.9


def test_quality_never_sees_held_out_labels(spark, rows):
    docs = table(spark, rows)
    labels = [(d, int(i % 3 > 0), 0) for i, (d, _) in enumerate(rows)]
    turned = [(d, 1 - q if brute.crc_held_out(d) else q, 0) for d, q, _ in labels] + [(None, 1, 0), (0, None, None)]
    schema = "doc_id long, quality int, toxic int"
    a = quality.train(docs, spark.createDataFrame(labels, schema))
    b = quality.train(docs, spark.createDataFrame(turned, schema))
    assert a == b
    none = quality.op9_rows(docs, spark.createDataFrame([], schema)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    assert quality.op9_rows(docs.limit(0), spark.createDataFrame(labels, schema)).count() == 0


def test_compiled_rules_score_as_the_rules_say(spark, rows):
    """The column against the same rules in numpy, over texts with nulls, repeats and a very long one."""
    import numpy as np

    docs = table(spark, rows + [rows[5], (900, "word, " * 60_000)])
    stats = quality.statistics(F.col("text"))
    names = list(stats)
    got = docs.select("doc_id", *[stats[k].cast("double").alias(f"z_{k}") for k in names]).collect()
    x = np.array([[r[f"z_{k}"] for k in names] for r in got])
    y = (x[:, names.index("length")] + 0.3 * np.sin(np.arange(len(x))) > 4).astype(float)
    rules = quality.fit_rules(x, y, names)
    assert len(rules.rules) > 2
    want = np.full(len(x), rules.bias)
    for weight, terms in rules.rules:
        want += weight * quality._holds(x, tuple((names.index(n), sign, bound) for n, sign, bound in terms))
    scores = sorted((r.doc_id, r.score) for r in quality.scored(docs, rules).collect())
    assert [s for _, s in scores] == pytest.approx([s for _, s in sorted(zip((r.doc_id for r in got), 1 / (1 + np.exp(-want))))])


def test_personal_data_added_by_the_classifier(spark):
    """Spans beyond the exact patterns, on texts whose truth is known."""
    rng = random.Random(77)

    def card(first="4"):
        d = [int(first)] + [rng.randrange(10) for _ in range(14)]
        s = sum(v - 9 if v > 9 else v for v in (x * (2 - i % 2) for i, x in enumerate(d)))
        return "".join(map(str, d)) + str(-s % 10)

    docs, truth, traps = [], set(), set()
    for i in range(600):
        words, kind = prose(rng, 30).split(" "), i % 6
        spans = []
        if kind == 0:  # two cards in a row, which the exact pattern drops
            item = [card(), card()]
            spans = [("card", x) for x in item]
        elif kind == 1:  # order numbers that are no cards
            item = ["order", "9" + "".join(str(rng.randrange(10)) for _ in range(15))]
            while brute.luhn(item[1]):
                item[1] = "9" + "".join(str(rng.randrange(10)) for _ in range(15))
            traps.add((i, "card", item[1]))
        elif kind == 2:
            item = ["mail", f"jo{i} [at] host{i % 7} [dot] org"]
            spans = [("email", item[1])]
        elif kind == 3:
            item = ["server", f"{rng.randrange(1, 200)}[.]{rng.randrange(256)}[.]{rng.randrange(256)}[.]{rng.randrange(256)}"]
            spans = [("ip", item[1])]
        elif kind == 4:
            item = ["token", "=", f'"{rng.randrange(16**32):032x}a1"']
            spans = [("secret", item[2].strip('"'))]
        else:
            item = [card()]
        at = rng.randrange(len(words))
        docs.append((i, " ".join(words[:at] + item + words[at:])))
        truth |= {(i, k, x) for k, x in spans}
    text = dict(docs)
    got = pii.find(table(spark, docs), kinds=pii.ALL).collect()
    found = {(r._id, k, text[r._id][x.s : x.e]) for r in got for k in pii.ALL for x in r[f"{k}_added"]}
    hit = len(found & truth)
    assert hit / len(truth) > 0.95 and hit / len(found) > 0.95 and not found & traps
    assert all(len(r.card) == 1 for r in got if r._id % 6 == 5)
    clean = {r.doc_id: r.text for r in pii.redacted(table(spark, docs)).collect()}
    assert all(x not in clean[i] for i, _, x in found)
    rows = pii.op6_rows(table(spark, docs)).collect()
    assert sum(len([x for x in r.spans.split(",") if x.startswith("card")]) - r.n_card for r in rows) == 200


def test_staged_tables_go(spark):
    """What is staged in a scope is deleted with it, and Arrow bounds of a write don't stay."""
    import os

    from corbel.llm import common

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with common.scratch(spark) as outer:
        inner = common.staged(spark.range(5).toDF("a"), "x", (7, 1))
        kept = common.staged(inner, "y", scope=outer)
        folder = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(folder)
    assert not os.path.isdir(folder) and kept.count() == 5 and spark.conf.get(key) == before
