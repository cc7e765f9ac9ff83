"""The whole pipeline on the smallest supplied scale, stage by stage against plain Python."""

import random
from collections import Counter

import corpus_pipeline
from corbel.llm import quality

from . import brute
from .test_ops import prose, table


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "shard"]
    got = out.collect()

    rules = quality.train(docs, labels)
    good = [r for r in quality.scored(docs, rules).collect() if r.score >= quality.THRESHOLD]
    cls = brute.jaccard_classes([(r.doc_id, r.text) for r in good])
    one = [r for r in good if cls[r.doc_id][0] == r.doc_id]
    hit = {x[0] for x in brute.contamination([(r.doc_id, r.text) for r in one], bench) if x[5]}
    clean = [r for r in one if r.doc_id not in hit]
    sizes = Counter()
    for r in clean:
        sizes[r.source] += brute.size_words(r.text)
    target, text = brute.targets(sizes), {r.doc_id: r for r in clean}
    taken, copies, shard, loads = Counter(), Counter(), {}, Counter()
    for r in got:
        assert text[r.doc_id].text == r.text and text[r.doc_id].source == r.source
        taken[r.source] += brute.size_words(r.text)
        copies[r.doc_id] += 1
        assert shard.setdefault(r.text, r.shard) == r.shard
        loads[r.shard] += len(r.text.encode()) + 8
    assert max(copies.values()) <= 3
    for s in target:
        big = max(brute.size_words(r.text) for r in clean if r.source == s)
        assert abs(taken[s] - target[s]) <= big / 2 + 1


def test_stages_keep_the_columns_and_accept_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns + ["shard"] * (k == 4)
        assert out.count() == 0


def test_odd_documents_pass_all_stages(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, empty and long texts, and columns named like the operators' own."""
    rng = random.Random(17)
    base = [(i, prose(rng, rng.choice([20, 60, 200])), f"s{i % 4}") for i in range(40)]
    item = prose(rng, 12)
    odd = [base[0]] * 3 + [(None, prose(rng, 50), "s0"), (None, prose(rng, 50), None), (None, None, None), (50, None, "s1"), (51, "", "s1"), (52, prose(rng, 9000), "s2"), (53, f"{prose(rng, 20)} {item} {prose(rng, 20)}", "s3"), (1, prose(rng, 70), "s0"), (54, base[2][1] + " more", "s1")]
    docs = table(spark, base + odd).drop("_metadata")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard"]
    rows = out.collect()
    copies = Counter((r.doc_id, r.text) for r in rows)
    assert max(copies.values()) <= 3 and all(r.score == "own score" and r._id == "own _id" for r in rows)
    assert 53 not in {r.doc_id for r in rows} and 54 not in {r.doc_id for r in rows}
    assert {t for _, t, _ in base + odd if t} - {r.text for r in rows if r.text} <= {odd[9][1], odd[11][1], *(t for _, t, _ in base + odd)}
    # What near duplicates keep: one of each repeated row, both texts of an id that stands twice, and every row without id.
    name, near = corpus_pipeline.STAGES[1]
    kept = Counter((r.doc_id, r.text) for r in near(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect())
    want = Counter({(d, t): 1 for d, t, _ in base + odd if d != 54})
    assert kept == want
