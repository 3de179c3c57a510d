"""Quality rules as a bitmask ledger: measure once, judge by versioned policies."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import pinned, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words")

#: Each rule's name, its bit by order, and the SQL condition under which a text fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "few_letters": "100 * n_letter_words < 50 * n_words",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a text passes when it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, rule in enumerate(RULES) if rule in self.rules)


POLICIES: Mapping[str, Policy] = {
    "base": Policy("base", 1, BASE),
    "standard": Policy("standard", 1, tuple(RULES)),
}


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from column `w`: words covered by 3-word windows that stand twice or more.

    Windows are sorted by hash with their place beside; a window repeats when a
    neighbour has its hash.  A fold over the places in order counts each word once.
    """
    n = F.size("w")
    window = F.transform("w", lambda x, i: F.struct(F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.sort_array(F.slice(window, F.lit(1), F.greatest(n - 2, F.lit(0)))))
    near = lambda x, i: (x.h == F.get(F.col("_s"), i - 1).h) | (x.h == F.get(F.col("_s"), i + 1).h)
    place = F.transform("_s", lambda x, i: F.when(F.coalesce(near(x, i), F.lit(False)), x.i))
    df = df.withColumn("_p", F.sort_array(F.filter(place, lambda p: p.isNotNull())))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).alias("last"))
    step = lambda acc, p: F.struct((acc.total + F.least(F.lit(3), p - acc["last"])).alias("total"), p.alias("last"))
    return df.withColumn("n_repeat_words", F.aggregate("_p", start, step, lambda acc: acc.total)).drop("_s", "_p")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns as a struct `row`, and one column for each of MEASURES."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    row = [F.struct(*(docs[c] for c in carry)).alias("row")] if carry else []
    df = docs.select(docs[doc_id].alias("doc_id"), *row, body.alias("text"), words(body).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)
    df = df.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_letter_words": F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))).cast("long"),
        }
    )
    return _repeat_words(df).select("doc_id", *(["row"] if carry else []), *MEASURES)


def fail_bits(rules: Mapping[str, str] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def quality_ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The ledger: measurements and fail_bits of every document.

    Corner cases: null and empty texts have no words and fail few_words only;
    null ids and repeated rows come through row by row; other columns are
    ignored; an empty table gives an empty ledger.
    """
    return measure(docs, doc_id, text, carry).withColumn("fail_bits", pinned(fail_bits()))


def judge(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Add base_failed and kept under a policy; no text is read again."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long")) != 0
    base = failed(POLICIES["base"])
    return ledger.withColumn("base_failed", base).withColumn("kept", ~base & ~failed(policy))


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: texts that fail it, and those that it alone removes.

    The ledger is first summed by fail_bits, so what is exploded is at most
    2 ** number of rules rows.
    """
    sums = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r in policy.rules))
    each = sums.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
