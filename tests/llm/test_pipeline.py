from collections import Counter

import brute
from compare import same

import __spark_entry__ as entry
import corpus_pipeline
from lodeway.llm import queries, quality_rules, sql


def test_sql_twins(spark, small):
    for name, text in sql.ORACLES.items():
        assert same(spark, small, queries.queries()[name], text) > 0


def test_names():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries() and [n for n, _ in corpus_pipeline.STAGES]


def test_run_equals_the_stages_by_hand(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    ledger = quality_rules.judge(quality_rules.quality_ledger(spark.read.parquet(f"{small}/documents.parquet")), quality_rules.POLICIES["standard"])
    kept = {r["doc_id"]: docs[r["doc_id"]]["text"] for r in ledger.where("kept").collect()}
    reps = {c for _, c in brute.components(kept, 5, 80).values()}
    kept = {i: t for i, t in kept.items() if i in reps}
    bad = {i for i, _ in brute.leaks(kept, bench)}
    kept = {i: t for i, t in kept.items() if i not in bad}
    rows = corpus_pipeline.run(spark, small).collect()
    count = Counter(r["doc_id"] for r in rows)
    assert set(count) <= set(kept) and max(count.values()) <= 2
    sizes, taken = Counter(), Counter()
    for i, t in kept.items():
        sizes[docs[i]["source"]] += len(brute.words(t))
        taken[docs[i]["source"]] += len(brute.words(t)) * count[i]
    want = brute.targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + max(len(brute.words(t)) for i, t in kept.items() if docs[i]["source"] == s) / 2 for s in want)
    assert {r["shard"] for r in rows} <= set(range(16))
    assert all(r["text"] == docs[r["doc_id"]]["text"] for r in rows)
