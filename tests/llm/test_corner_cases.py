"""Every operator and pipeline stage on odd and empty tables."""

import pytest

import corpus_pipeline
from lodeway.llm import decontamination, jaccard_join, language_id, license_scan, mixing, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts


def _tokens(d, spark):
    return token_counts.token_counts(d, pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def _leaks(d, spark):
    return decontamination.leaks(d, spark.createDataFrame([(1, "a b c d e f g h"), (2, None)], "item_id long, text string"))


OPERATORS = {
    "license": (lambda d, s: license_scan.license_scan(d), 5),
    "tokens": (_tokens, 6),
    "language": (lambda d, s: language_id.language_id(d), 6),
    "quality": (lambda d, s: quality_rules.judge(quality_rules.quality_ledger(d), quality_rules.POLICIES["standard"]), 6),
    "leaks": (_leaks, 2),
    "substring": (lambda d, s: substring_dedup.substring_dedup(d), 6),
    "jaccard": (lambda d, s: jaccard_join.jaccard_join(d), 6),
    "suffix": (lambda d, s: suffix_dedup.suffix_dedup(d), 6),
    "sharding": (lambda d, s: sharding.shard_by_bytes(d), 6),
    "mixing": (lambda d, s: mixing.mixture(d), 6),
    "near_dedup": (lambda d, s: jaccard_join.near_dedup(d), 5),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    run, n = OPERATORS[name]
    assert run(odd, spark).count() == n


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd, name):
    assert OPERATORS[name][0](odd.where("false"), spark).collect() == []


def rows_of(df):
    """All rows without what an operator may choose freely, in a fixed order."""
    return sorted((str(r) for r in df.drop("k", "slot", "shard").collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_with_clashing_names(spark, texts, name):
    from pyspark.sql import functions as F

    plain = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in texts.items() if i % 4 == 0 or i > 90], "doc_id long, text string, lang string, source string, n_chars long")
    names = "k v h i j m n p q s e t a b w l se salt low id row parts stay whole first last times turn copies taken size rate bucket mass part band own block component node lead seg once held_out paragraph grams hits z best score _source at pid".split()
    crowded = plain.select("*", *(F.lit("x").alias(c) for c in names if c not in ("text", "source")))
    run = OPERATORS[name][0]
    got, want = run(crowded, spark), run(plain, spark)
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    assert want.count() or name == "leaks"


def test_values_of_odd_rows(spark, odd):
    by = lambda df, *c: sorted(((r["doc_id"], *(r[x] for x in c)) for r in df.collect()), key=str)
    ids = [(1,), (1,), (2,), (3,), (None,), (None,)]
    assert by(_tokens(odd, spark), "n_bytes", "over_limit") == sorted([(1, 15, False), (1, 15, False), (2, 0, False), (3, 0, False), (None, 0, False), (None, 20, False)], key=str)
    quality = quality_rules.judge(quality_rules.quality_ledger(odd), quality_rules.POLICIES["standard"])
    assert by(quality, "n_words", "fail_bits", "base_failed", "kept") == sorted([(1, 8, 9, True, False), (1, 8, 9, True, False), (2, 0, 1, True, False), (3, 0, 1, True, False), (None, 0, 1, True, False), (None, 4, 1, True, False)], key=str)
    language = language_id.language_id(odd)
    assert by(language, "lang_pred") == sorted([(1, "en"), (1, "en"), (2, "und"), (3, "und"), (None, "und"), (None, "en")], key=str)
    for df, total in ((substring_dedup.substring_dedup(odd), "n_words"), (suffix_dedup.suffix_dedup(odd), "n_bytes")):
        assert by(df, "n_removed") == sorted(((*i, 0) for i in ids), key=str) and {r["spans"] == [] for r in df.collect()} == {True}
    joined = jaccard_join.jaccard_join(odd)
    assert [x for x in by(joined, "n_shingles", "component_id") if x[0] is not None] == [(1, 6, 1), (1, 6, 1), (2, 0, 2), (3, 0, 3)]
    assert sorted(x[1] for x in by(joined, "n_shingles") if x[0] is None) == [0, 2]
    shards = sharding.shard_by_bytes(odd, 4).collect()
    assert sorted(r["size"] for r in shards) == [1, 1, 1, 16, 16, 21]
    for n in {r["shard"] for r in shards}:
        slots = sorted(r["slot"] for r in shards if r["shard"] == n)
        assert slots == list(range(len(slots)))
    mixed = mixing.mixture(odd)
    assert by(mixed, "size") == sorted([(1, 8), (1, 8), (2, 0), (3, 0), (None, 0), (None, 4)], key=str)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mixed.collect())
    assert [tuple(r) for r in _leaks(odd, spark).select("doc_id", "item_id", "similarity").collect()] == [(1, 1, 1.0)] * 2
    assert {r["license"] for r in license_scan.license_scan(odd).collect()} == {"none"}


def test_very_long_texts(spark):
    import random

    import brute

    rng = random.Random(8)
    words = [rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice(["", "x", "yz"]) + str(rng.randrange(2000)) for _ in range(160_000)]
    long = " ".join(words)
    docs = {1: long, 2: "z" * 300_000, 3: "intro " + " ".join(words[50_000:50_400]) + " end", 4: "Released under the MIT License.\n" + long[::-1][:200_000]}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1 AS n_chars")
    assert len(long) > 1_000_000
    t = token_counts.load(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in _tokens(d, spark).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in docs.items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(d).collect()}
    assert got == {i: v[:2] for i, v in brute.substring(docs).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"])) for r in suffix_dedup.suffix_dedup(d).collect()}
    shared = len(" ".join(words[50_000:50_400])) + 2
    assert got[1][0] == len(long) and got[2] == (300_000, 300_000, 1) and abs(got[3][1] - shared) <= 2 and got[1][1] >= shared - 2
    got = {r["doc_id"]: r["n_shingles"] for r in jaccard_join.jaccard_join(d).collect()}
    assert got == {i: len(brute.shingles(x, 3)) for i, x in docs.items()}
    rows = {r["doc_id"]: r for r in quality_rules.judge(quality_rules.quality_ledger(d), quality_rules.POLICIES["standard"]).collect()}
    assert rows[1]["n_words"] == 160_000 and rows[1]["kept"] and rows[2]["base_failed"]
    item = " ".join(words[50_100:50_140])
    found = decontamination.leaks(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} >= {1, 3} and all(r["similarity"] == 1.0 for r in found)
    assert {r["doc_id"]: r["license"] for r in license_scan.license_scan(d).collect()} == {1: "none", 2: "none", 3: "none", 4: "MIT"}
    assert sum(r["size"] for r in sharding.shard_by_bytes(d).collect()) == sum(len(x) + 1 for x in docs.values())
    assert {r["doc_id"]: r["size"] for r in mixing.mixture(d).collect()} == {i: len(brute.words(x)) for i, x in docs.items()}
    assert all(r["lang_pred"] == "en" for r in language_id.language_id(d).collect())


def test_repeated_rows_are_one_document(spark, odd):
    long = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, long), (1, long), (2, "short")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.substring_dedup(d).collect()] == [0, 0, 0]
    assert [r["n_removed"] for r in suffix_dedup.suffix_dedup(d).collect()] == [0, 0, 0]
    assert sorted(r["component_id"] for r in jaccard_join.jaccard_join(d).collect()) == [1, 1, 2]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty(spark, odd, small, stage):
    stage(spark, odd, small).count()
    assert stage(spark, odd.where("false"), small).count() == 0
