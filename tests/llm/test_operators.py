import math
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from lodeway.llm import decontamination, jaccard_join, language_id, license_scan, mixing, quality_rules, repeats, sharding, substring_dedup, suffix_dedup, token_counts


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- 1 licences ---


def test_license_families(spark):
    names = list(license_scan.TEMPLATES)
    rows = [(i, "Some prose first.\n" + t + "\nmore prose") for i, f in enumerate(names) for t in license_scan.TEMPLATES[f]] + [(100 + i, t) for i, t in enumerate(license_scan.OTHER)]
    got = license_scan.license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("paragraph is not null").collect()
    for r in got:
        assert r["family"] == (names[r["doc_id"]] if r["doc_id"] < 100 else "unknown"), r


def test_license_variants(spark):
    rows = [(1, "licensed under the apache license, version 2.0 by its authors"), (2, "the licence of the dog"), (3, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (4, None)]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["license"] for i in (1, 2, 3, 4)] == ["Apache-2.0", "none", "mixed", "none"]
    assert got[3]["families"] == "CC-BY-NC,MIT" and got[3]["n_licensed"] == 2


@pytest.mark.parametrize("width", [24, 45, 72])
def test_license_wrapped(spark, width):
    import textwrap

    notice = lambda family, i=-1: "\n".join(textwrap.wrap(license_scan.TEMPLATES[family][i], width, break_long_words=False, break_on_hyphens=False))
    long = ["MIT", "BSD", "GPL-3.0"]
    rows = [(i, "Some prose first.\n\n" + notice(f) + "\n\nmore prose") for i, f in enumerate(long)]
    rows += [(10 + i, "Some prose first\n" + notice(f) + "\nmore prose") for i, f in enumerate(long)]
    rows += [(20, notice("MIT") + "\n\n" + notice("BSD")), (21, "# " + notice("GPL-3.0").replace("\n", "\n# ")), (22, notice("BSD").replace("\n", "\n\n\n")), (23, notice("MIT") + "\nReleased under the BSD License.")]
    rows += [(30 + i, "\n".join(textwrap.wrap(t, width))) for i, t in enumerate(license_scan.OTHER)]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["license"] for i in (0, 1, 2, 10, 11, 12, 21)] == [*long, *long, "GPL-3.0"]
    assert all(got[i]["n_licensed"] == 1 for i in (0, 1, 2, 10, 11, 12, 21))
    assert (got[20]["families"], got[20]["n_licensed"]) == (got[23]["families"], got[23]["n_licensed"]) == ("BSD,MIT", 2)
    assert {got[i]["license"] for i in (22, *range(30, 30 + len(license_scan.OTHER)))} == {"none"}


def plain_license(text):
    """Family, probability and similarity of one paragraph, without Spark."""
    names, weights, bias, cut = license_scan.train()
    w = [weights[g] for g in license_scan.grams(text) if g in weights]
    z = [b + sum(v[i] for v in w) / math.sqrt(max(1, len(w))) for i, b in enumerate(bias)]
    e = [math.exp(v - max(z)) for v in z]
    best = names[z.index(max(z))]
    own = set(license_scan.grams(text))
    near = max((len(own & set(g)) / len(g) for g in license_scan.confirming(best)), default=0) if best != "unknown" else 0.0
    return (best if best != "unknown" and max(e) / sum(e) >= cut and near >= 0.6 else "unknown"), max(e) / sum(e), near


def test_license_equals_the_plain_classifier(spark):
    lines = [*license_scan.OTHER, *license_scan.HELD_OTHER, "the MIT professor lost his license", "", "licence"]
    for f in license_scan.TEMPLATES:
        lines += [*license_scan.TEMPLATES[f], *license_scan.mentions(f, license_scan.FRAMES), *license_scan.mentions(f, license_scan.HELD_FRAMES)]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = license_scan.license_paragraphs(d).where("paragraph is not null").collect()
    assert len(got) > 150
    for r in got:
        family, probability, near = plain_license(r["paragraph"])
        assert r["family"] == family, r
        assert math.isclose(r["probability"], probability, abs_tol=1e-6) and math.isclose(r["similarity"], near, abs_tol=1e-9)


def test_license_of_short_and_unseen_notices(spark):
    probes = {
        "SPDX-License-Identifier: MIT": "MIT",
        "available under the MIT licence": "MIT",
        "licensed under GPLv3": "GPL-3.0",
        "Creative Commons Attribution 4.0": "CC-BY",
        "Redistributions of source code must retain the above copyright notice...": "BSD",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,': "MIT",
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "GPL-3.0",
        "the MIT professor lost his license": "none",
    }
    got = by_id(license_scan.license_scan(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")))
    assert {t: got[i]["license"] for i, t in enumerate(probes)} == probes


def test_license_calibration():
    """Frames and sentences that training has not seen."""
    held = [(f, t) for f in license_scan.NAMES for t in license_scan.mentions(f, license_scan.HELD_FRAMES)]
    right = sum(plain_license(t)[0] == f for f, t in held)
    wrong = sum(plain_license(t)[0] not in (f, "unknown") for f, t in held) + sum(plain_license(t)[0] != "unknown" for t in license_scan.HELD_OTHER)
    assert right >= 0.85 * len(held) and wrong <= 0.03 * (len(held) + len(license_scan.HELD_OTHER))
    assert 0.3 < license_scan.train()[3] < 0.95


def test_license_is_native(table):
    plan = license_scan.license_scan(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 2 tokens ---


@pytest.fixture(scope="module")
def tokenizer_file():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts(table, texts, tokenizer_file):
    t = token_counts.load(tokenizer_file)
    got = by_id(token_counts.token_counts(table, tokenizer_file, chunk=500, overlap=32))
    for i, text in texts.items():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 1024)


def test_splice_widens(tokenizer_file):
    import random

    t, rng, widened = token_counts.load(tokenizer_file), random.Random(2), 0
    encode = lambda s: t.encode(s, add_special_tokens=False).offsets
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "'re", "1", "!", "<|endoftext|>", "日", "🙂", "\t", "."]
    for _ in range(400):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        n, w = token_counts.splice(encode, s, 40, 8)
        widened += w
        assert n == len(encode(s))
    assert widened
    assert token_counts.splice(encode, "x" * 2000, 100, 8)[0] == len(encode("x" * 2000))


def test_other_tokenizers(table, texts):
    path = pytest.importorskip("public_tokenizers").path
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        t = token_counts.load(path(name))
        size = (lambda s: len(t.encode(s))) if name.endswith("model") else lambda s: len(t.encode(s, add_special_tokens=False).ids)
        got = by_id(token_counts.token_counts(table.where("doc_id < 20"), path(name), chunk=100))
        assert all(got[i]["n_tokens"] == size(texts[i] or "") for i in range(20))


# --- 3 language ---


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 30 and right >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in language_id.language_id(docs).collect())


def plain_languages(rows, bits=16):
    """Multinomial naive Bayes over the same n-grams, without numpy and Spark: doc_id -> (language, score)."""
    mask = (1 << 64) - 1

    def mix(h):
        h = h ^ (h >> 30)
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    def buckets(text):
        symbols, border = [], False
        for ch in text:
            if ch.isalpha():
                symbols.append(mix(ord(ch.lower()[0]) + 1))
                border = False
            elif not border:
                symbols.append(mix(1))
                border = True
        for n in (1, 2, 3):
            for i in range(len(symbols) - n + 1):
                h = n
                for x in symbols[i : i + n]:
                    h = (h * 0xD6E8FEB86659FD93 + x) & mask
                yield mix(h) >> (64 - bits)

    counts, texts = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if text is not None and lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 3 == 1):
            counts[lang].update(buckets(text))
            texts[lang] += 1
    names = sorted(texts)
    total = {x: sum(counts[x].values()) + 0.5 * (1 << bits) for x in names}
    prior = sum(texts.values()) + 0.5 * len(names)
    out = {}
    for i, text, _ in rows:
        own = Counter(buckets(text or ""))
        if not any(map(str.isalpha, text or "")):
            out[i] = ("und", 0.0)
            continue
        z = [math.log((texts[x] + 0.5) / prior) + sum(n * math.log((counts[x][b] + 0.5) / total[x]) for b, n in own.items()) for x in names]
        scale = 16 / max(16, sum(own.values()))
        e = [math.exp((v - max(z)) * scale) for v in z]
        out[i] = (names[z.index(max(z))], max(e) / sum(e))
    return out


def test_language_equals_plain_naive_bayes(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(10_000, "", "xx"), (10_001, None, "yy"), (10_002, "ß ǅ 日本", None), (10_003, "a", "zz"), (10_004, "...", None)]
    got = by_id(language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    for i, (lang, score) in plain_languages(rows).items():
        assert got[i]["lang_pred"] == lang and math.isclose(got[i]["score"], score, rel_tol=1e-3, abs_tol=1e-6), i


def test_more_languages_than_are_held_at_a_time(spark):
    rows = [(i, chr(97 + i % 26) * 5 + " " + chr(97 + i % 26) * 3, f"l{i % 26:02}") for i in range(260)]
    names, logp, prior = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1))
    assert names == [f"l{i:02}" for i in range(26)] and logp.shape == (1 << 16, 26) and abs(prior - prior[0]).max() < 1e-9
    with pytest.raises(ValueError):
        language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_langs=25)


def test_language_does_not_see_labels(spark, table):
    a = by_id(language_id.language_id(table))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    b = by_id(language_id.language_id(table.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))))
    assert {k: v["lang_pred"] for k, v in a.items()} == {k: v["lang_pred"] for k, v in b.items()}
    assert all(a[i]["lang_pred"] == "und" and a[i]["score"] == 0 for i in (125, 126, 127, 134, 135))
    none = language_id.language_id(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


# --- 4 quality ---


def test_quality_counts(table, texts):
    got = by_id(quality_rules.judge(quality_rules.quality_ledger(table), quality_rules.POLICIES["standard"]))
    for i, text in texts.items():
        w, lines = brute.words(text), [x for x in (text or "").split("\n") if brute.words(x)]
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n, hit = Counter(grams), set()
        for j, g in enumerate(grams):
            if n[g] > 1:
                hit |= {j, j + 1, j + 2}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r["n_symbols"] == sum(c in quality_rules.SYMBOLS for c in text or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])


def test_quality_ledger_serves_policies(table):
    ledger = quality_rules.quality_ledger(table)
    standard = quality_rules.POLICIES["standard"]
    rows = {r["rule"]: r for r in quality_rules.ablations(ledger, standard).collect()}
    kept = quality_rules.judge(ledger, standard).where("kept").count()
    for rule in quality_rules.RULES:
        less = quality_rules.Policy("less", 1, tuple(x for x in quality_rules.RULES if x != rule))
        more = ledger.where(F.col("fail_bits").bitwiseAND(F.lit(less.mask).cast("long")) == 0).count()
        assert rows[rule]["n_only"] == more - kept
    plan = quality_rules.judge(ledger, standard).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 5 benchmark ---


def test_leaks(spark, texts):
    piece = " ".join(texts[132].split()[:40])
    items = {1: texts[5], 2: piece.replace("k", "K"), 3: "never seen words " * 9, 4: None, 5: ""}
    docs = dict(texts)
    docs[200] = "intro " + piece + " outro"
    edited = texts[5].split()
    edited[-1] = "changed"
    docs[201] = "x y z " + " ".join(edited)
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(d, b).collect()}
    assert got == brute.leaks(docs, {k: v for k, v in items.items() if v})
    assert {(200, 2), (132, 2), (5, 1)} <= got
    kept = {r["doc_id"] for r in decontamination.decontaminate(d, b).collect()}
    assert kept == set(docs) - {i for i, _ in got}


def test_hamming_blocks_find_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    index = decontamination.Index.build([(i, " ".join(f"w{rng.integers(1000)}" for _ in range(30))) for i in range(40)], 5, 19)
    known = index.prints
    prints = []
    for i in range(300):
        flips = rng.choice(64, rng.integers(0, 24), replace=False)
        prints.append(int(known[i % 40]) ^ sum(1 << int(b) for b in flips))
    prints = np.array(prints, np.uint64)
    win, item, dist = index.near((5, 30), prints)
    want = {(w, j) for w in range(300) for j in range(40) if int(np.bitwise_count(prints[w] ^ known[j])) <= 19}
    assert set(zip(win.tolist(), item.tolist(), strict=True)) == want and dist.max() <= 19


def test_fingerprints_in_pieces(monkeypatch):
    import numpy as np

    gram = np.random.default_rng(1).integers(0, 2**63, 900).astype(np.uint64)
    starts = np.array([0, 3, 4, 200, 201, 333, 600, 880])
    whole = decontamination.fingerprints(gram, starts, 20)
    monkeypatch.setattr(decontamination, "PIECE", 50)
    assert (decontamination.fingerprints(gram, starts, 20) == whole).all()


def test_decontaminate_knows_texts_that_share_an_id(spark, texts):
    item = " ".join(texts[132].split()[:40])
    d = spark.createDataFrame([(1, "clean words " * 30, 1), (1, item, 2), (2, item, 3), (None, item, 4), (None, "other words " * 9, 5)], "doc_id long, text string, k long")
    kept = decontamination.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["k"] for r in kept.collect()) == [1, 5]


# --- 6 and 8 repeats ---


@pytest.mark.parametrize("hot,crowd", [(50_000, 64), (2, 64), (3, 1)])
def test_substring_dedup(table, texts, hot, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    out = substring_dedup.substring_dedup(table, hot=hot).withColumn("h", F.sha2("kept_text", 256))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["h"]) for r in out.collect()} == brute.substring(texts)


@pytest.mark.parametrize("hot,crowd", [(50_000, 64), (2, 64), (3, 1)])
def test_suffix_dedup(table, texts, hot, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    out = suffix_dedup.suffix_dedup(table, hot=hot).withColumn("h", F.sha2("kept", 256))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["h"]) for r in out.collect()} == brute.suffix(texts)


def arrow(spark, rows, schema, function, out):
    return spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(function, out).collect()


@pytest.mark.parametrize("limit", [10**9, 400, 60])
def test_shards_merge_to_the_whole(spark, limit):
    import numpy as np

    from lodeway.llm.repeats import Unit

    rng = np.random.default_rng(6)
    unit = Unit(words=False, length=24, k=8)
    base = [rng.integers(97, 123, 400).astype(np.uint8) for _ in range(4)]
    rows = []
    for i in range(80):
        m = int(rng.choice(4, p=[0.55, 0.2, 0.2, 0.05]))
        s = int(rng.integers(0, 300))
        rows.append((m, base[m][s : s + int(rng.integers(24, 80))].tobytes(), i, 10 * i, bool(rng.random() < 0.8)))
    rows.sort(key=lambda r: r[0])
    seen = Counter((m, seg[p : p + 24]) for m, seg, *_ in rows for p in range(len(seg) - 23))
    want = {(k, s + p) for m, seg, k, s, once in rows if once for p in range(len(seg) - 23) if seen[m, seg[p : p + 24]] == 1}
    got = arrow(spark, rows, "m long, seg binary, k long, s int, once boolean", suffix_dedup.SuffixArray.emit(unit, limit), "k long, p int")
    assert {(r["k"], r["p"]) for r in got} == want and len(got) == len(want) > 100


def test_greedy_factors_of_a_known_text():
    import numpy as np

    words = "a b c d e f g h i j".split()
    segments = [words, ["x", *words[2:7], "y", *words[5:], *words[:4]], words[1:9]]
    symbol = np.array([hash(w) % 2**32 for seg in segments for w in seg], np.uint64)
    bounds = np.append(0, np.cumsum([len(x) for x in segments]))
    at, source, length = substring_dedup.factors(symbol, bounds, 3)
    # c-g from 2; f-j from 5; then a-d from 0; the last segment b-i from 1
    assert list(zip(at.tolist(), source.tolist(), length.tolist(), strict=True)) == [(11, 2, 5), (17, 5, 5), (22, 0, 4), (26, 1, 8)]
    # a match that runs over the end of a factor is found at its border
    segments = ["a b c d e".split(), "c d e f g".split(), "a b c d e f g".split()]
    symbol = np.array([ord(w) for seg in segments for w in seg], np.uint64)
    at, source, length = substring_dedup.factors(symbol, np.array([0, 5, 10, 17]), 3)
    assert list(zip(at.tolist(), source.tolist(), length.tolist(), strict=True)) == [(5, 2, 3), (10, 0, 5), (13, 6, 4)]


def test_parse_of_colliding_hashes(monkeypatch):
    import numpy as np

    from lodeway.llm import textnum as tn

    segments = [b"a b c d e f", b"x b c d y f", b"a b c d e z"]
    data, off = np.frombuffer(b"".join(segments), np.uint8), np.append(0, np.cumsum([len(x) for x in segments]))
    want = sorted(zip(*map(list, substring_dedup.parse(data, off, 3)), strict=True))
    real = tn.Words.__init__

    def colliding(self, *args, **kw):
        real(self, *args, **kw)
        self.hash = self.hash & np.uint64(1)

    monkeypatch.setattr(tn.Words, "__init__", colliding)
    assert sorted(zip(*map(list, substring_dedup.parse(data, off, 3)), strict=True)) == want == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3), (2, 3)]


def test_keys_of_windows_do_not_depend_on_the_length_of_their_document(monkeypatch):
    import numpy as np

    from lodeway.llm import textnum as tn

    monkeypatch.setattr(tn, "POSITION_BITS", 8)
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 2**62, 60).astype(np.uint64)

    def keys(before):
        symbol = np.concatenate((np.random.default_rng(9).integers(0, 2**62, before).astype(np.uint64), passage))
        bounds = np.array([0, len(symbol)])
        gram, valid = tn.grams(symbol, bounds, 8)
        _, s, e, key = tn.runs(gram, valid, bounds, 8, 20)
        return {t - before: k for a, b, k in zip(s.tolist(), e.tolist(), key.tolist(), strict=True) for t in range(a, b + 1) if t >= before}

    assert keys(50) == keys(1000) and len(keys(50)) == 41


def test_one_id_with_two_texts(spark):
    text = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    passage = text("p", 60)
    rows = [(1, "x y " + passage), (5, text("a", 30) + " " + passage), (5, text("b", 30)), (5, text("b", 30)), (7, text("b", 30))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(d).collect())
    assert got == [(1, 62, 0), (5, 30, 0), (5, 30, 0), (5, 90, 60), (7, 30, 30)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(d, 100).collect())
    n = len(passage)
    assert got == [(1, n + 4, n + 1), (5, 109, 109), (5, 109, 109), (5, n + 110, n + 1), (7, 109, 109)]
    j = jaccard_join.jaccard_join(d).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in j) == [(1, 1), (5, 5), (5, 5), (5, 5), (7, 5)]


def test_rows_without_ids_are_copies(spark):
    long = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(None, long), (None, long), (None, long), (4, "short")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring_dedup.substring_dedup(d).collect()) == [0, 0, 60, 60]
    assert sorted(r["n_removed"] for r in suffix_dedup.suffix_dedup(d).collect()) == [0] + [len(long)] * 3


def test_suffix_array_kernels():
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    depth = 24
    raw = data.tobytes()
    sa, group = suffix_dedup.refine(data, depth)
    want = sorted(range(len(raw)), key=lambda i: raw[i : i + depth])
    assert [raw[i : i + depth] for i in sa] == [raw[i : i + depth] for i in want]
    lcp = suffix_dedup.common_prefixes(data, sa, group, depth)
    for a, b, g, h in zip(sa, sa[1:], group, group[1:], strict=False):
        n = 0
        while n < depth and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert lcp[b] == (n if g == h else 0)


# --- 7 join ---


@pytest.mark.parametrize("k,percent,block", [(3, 90, 1_000_000), (5, 80, 1_000_000), (3, 90, 1500), (5, 60, 3000)])
def test_jaccard_join(table, texts, k, percent, block):
    got = by_id(jaccard_join.jaccard_join(table, k, percent, block_tokens=block))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute.components(texts, k, percent)


def test_near_dedup_keeps_one_of_each(table, texts):
    kept = jaccard_join.near_dedup(table)
    assert kept.columns == table.columns
    want = {c for _, c in brute.components(texts, 5, 80).values()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_common_tokens_are_met_in_order():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted(zip(rng.integers(0, 40, 300).tolist(), rng.integers(0, 9, 300).tolist(), strict=True)) + [(50, 1)] * 5 + [(51, 1), (51, 1), (51, 2)]
    holders = {}
    for t, a in rows:
        holders.setdefault(t, set()).add(a)
    want = sorted(a for held in holders.values() if len(held) > 1 for a in held)
    for step in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + step]], pa.int64()) for i in (0, 1)], ["t", "a"]) for at in range(0, len(rows), step)]
        assert sorted(a for b in jaccard_join._common(iter(batches)) for a in b.column("a").to_pylist()) == want
    assert [b for b in jaccard_join._common(iter([]))] == []


def test_survivors_hold_no_table_of_tokens(spark, table):
    docs = jaccard_join.keyed(table)
    sets = docs.mapInArrow(jaccard_join._sets(3, 90), "k long, doc_id long, n long, a long, b long, p long, m long")
    plan = jaccard_join.survivors(docs, sets, 3, 90)._jdf.queryExecution().sparkPlan().toString()
    assert not any(("Aggregate" in line and "keys=[t#" in line) or ("Join" in line and "Join [t#" in line) for line in plan.splitlines()), plan


# --- 9 shards ---


def test_sharding(table, texts):
    rows = sharding.shard_by_bytes(table, 16).collect()
    assert len(rows) == len(texts)
    shards = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        shards[r["shard"]].append(r)
    total, biggest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    before = -1
    for s in sorted(shards):
        part = sorted(shards[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in part] == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 16) <= biggest
        ids = [r["doc_id"] for r in part]
        assert ids == sorted(ids) and ids[0] > before
        before = ids[-1]


def test_write_shards(spark, table, tmp_path):
    sharding.write_shards(table, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == table.count() and set(back.columns) == {*table.columns, "shard", "slot"}


# --- 10 mixing ---


def test_mixing(table, texts):
    rows = mixing.mixture(table).collect()
    assert len(rows) == len(texts)
    sizes, taken, target, widest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len(brute.words(texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        widest[r["source"]] = max(widest[r["source"]], r["size"])
    want = brute.targets(dict(sizes))
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9), (s, target, want)
        # a document longer than all others of its source together can't be balanced
        assert abs(taken[s] - target[s]) <= (widest[s] if 2 * widest[s] > sizes[s] else 0.02 * target[s] + 50)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixture(table.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    count = Counter(r["doc_id"] for r in mixed.collect())
    assert count == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_mixing_tree(table, texts, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 5)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    taken, target = Counter(), {}
    for r in mixing.mixture(table).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 3000 for s in target)


def rounded(sizes, rate, seed):
    import numpy as np
    import pandas as pd

    pdf = pd.DataFrame({"k": np.arange(len(sizes)), "v": 0, "doc_id": 0, "source": "s", "size": sizes, "n": 1, "bucket": 0, "copies": 0, "mass": [rate * x for x in sizes]})
    return mixing.pivot(pdf, seed, True).sort_values("k")["copies"].to_numpy()


@pytest.mark.parametrize("sizes,rate,miss", [([300] + [10] * 60, 0.3, 270), ([300] + [10] * 100, 0.3, 10), ([900, 500, 400] + [25, 40, 7, 60, 33] * 12, 0.6, 400), ([50, 40, 30], 0.5, 50), ([1000] + [10] * 5, 0.4, 1000)])
def test_rounding_keeps_each_expectation(sizes, rate, miss):
    import numpy as np

    runs = 1500
    taken = np.array([rounded(sizes, rate, seed) for seed in range(runs)])
    error = 4.5 * math.sqrt(rate * (1 - rate) / runs)
    assert set(np.unique(taken)) <= {0, 1}
    assert np.abs(taken.mean(axis=0) - rate).max() < error
    assert np.abs(taken @ np.array(sizes) - rate * sum(sizes)).max() <= miss


def test_mix_of_repeated_rows_is_exact(spark):
    rows = [(1, "a b c", "s", i) for i in range(7)] + [(1, "d e f", "s", 7)] + [(2, " ".join(["w"] * n), "t", n) for n in (5, 6, 7)] + [(None, "x y", "t", 0)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(4)
    want = Counter()
    for r in mixing.mixture(d).collect():
        want[r["doc_id"], r["size"], r["source"]] += r["copies"]
    assert mixing.mixture(d).count() == len(rows)
    got = mixing.mix(d).collect()
    assert Counter((r["doc_id"], len(r["text"].split()), r["source"]) for r in got) == +want
    each = Counter(r["extra"] for r in got if r["source"] == "s" and r["text"] == "a b c")
    assert max(each.values()) - min(each.get(i, 0) for i in range(7)) <= 1


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 1}, {"a": 10, "b": 0, None: 7}, {"a": 5}, {"a": 3, "b": 3, "c": 3, "d": 500, None: 1}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)
