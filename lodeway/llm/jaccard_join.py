"""N-gram Jaccard join by prefix filters under several global orders."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .components import components
from .keys import WIDE, cut, keyed, repeats_ids, row_key

ORDERS = (0x1F123BB5159A55E5, 0x2C7A1D5B3F4E6A79, 0x3B9AC9FF1D2E4C5B)
BLOCK_TOKENS = 1_000_000


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, A-Z lowered: hashes and document bounds, sorted in each.

    A document of fewer than k words has its whole sequence as its only shingle.
    """
    w = tn.Words(data, off, lower=True)
    gram, valid = w.grams(k)
    doc = np.repeat(np.arange(len(w.count)), w.count)
    hashes, owners = [gram[valid]], [doc[valid]]
    for c in range(1, k):
        short = np.flatnonzero(w.count == c)
        if len(short):
            whole, _ = w.grams(c)
            hashes.append(tn.mix(whole[w.bounds[short]] ^ tn.U64(c)))
            owners.append(short)
    h, d = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[fresh], d[fresh]
    return h, np.searchsorted(d, np.arange(len(w.count) + 1))


def least_overlap(n: np.ndarray | int, percent: int):
    return -((-n * percent) // 100)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - least_overlap(n, percent) + 1, 0)


def order_keys(h: np.ndarray, order: int) -> np.ndarray:
    """Rank of the tokens of one block under one order: rarer class first, then a hash of its own."""
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    key = tn.mix(h ^ tn.U64(ORDERS[order])) >> tn.U64(6)
    return key | (np.log2(n)[inverse].astype(np.uint64) << tn.U64(58))


def prefixes(h: np.ndarray, bounds: np.ndarray, order: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that stand first under the order, and the document of each.

    Two sets with that Jaccard share a token among the first n - ceil(t n) + 1
    of each, whatever the order.
    """
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    sort = np.lexsort((order_keys(h, order), doc))
    take = prefix_length(n, percent)
    at = tn.ranges(bounds[:-1], take)
    return h[sort][at], np.repeat(np.arange(len(n)), take)


def _sampled(h: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that the first order ranks by frequency: a hash class 2.5 times as wide as a prefix."""
    return (h & tn.U64(0xFF)) < tn.U64(min(256, 640 * (100 - percent) // 100 + 1))


def _sets(k: int, percent: int):
    """One row for each document: set size, two fingerprints, prefix length and sampled tokens."""

    def emit(batches):
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                h, bounds = shingles(*tn.flat(piece.column("text")), k)
                n = np.diff(bounds)
                sums = [np.append(tn.U64(0), np.cumsum(x, dtype=np.uint64)) for x in (tn.mix(h), tn.mix(h ^ tn.U64(0x5851F42D4C957F2D)), _sampled(h, percent))]
                a, b, m = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                p = prefix_length(n, percent)
                yield pa.RecordBatch.from_arrays([piece.column("k"), piece.column("doc_id"), *map(pa.array, (n, a, b, p, m))], ["k", "doc_id", "n", "a", "b", "p", "m"])

    return emit


def _sampled_tokens(k: int, percent: int):
    """Sampled tokens (40 bits) with the fingerprint of their set, so that copies count once."""

    def emit(batches):
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                h, bounds = shingles(*tn.flat(piece.column("text")), k)
                sums = np.append(tn.U64(0), np.cumsum(tn.mix(h), dtype=np.uint64))
                a = np.repeat(sums[bounds[1:]] - sums[bounds[:-1]], np.diff(bounds))
                keep = _sampled(h, percent)
                yield pa.RecordBatch.from_arrays([pa.array((h[keep] >> tn.U64(24)).view(np.int64)), pa.array(a[keep].view(np.int64))], ["t", "a"])

    return emit


def _all_tokens(k: int):
    def emit(batches):
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                h, bounds = shingles(*tn.flat(piece.column("text")), k)
                ids = np.repeat(piece.column("id").to_numpy(zero_copy_only=False), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids)], ["t", "id"])

    return emit


def class_id() -> Column:
    return F.xxhash64("n", "a", "b")


def _common(batches):
    """Distinct rows (t, a), met in order, whose t has two a or more; of what came before only the last row is held."""
    t, a, shared = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        t, a = (np.append(x, batch.column(c).to_numpy(zero_copy_only=False)) for x, c in ((t, "t"), (a, "a")))
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1])
        t, a = t[fresh], a[fresh]
        same = np.append(t[1:] == t[:-1], False)
        both = same | np.append(shared, same[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(a[:-1][both[:-1]])], ["a"])
        t, a, shared = t[-1:], a[-1:], bool(both[-1])
    if shared:
        yield pa.RecordBatch.from_arrays([pa.array(a)], ["a"])


def common_tokens(tokens: DataFrame) -> DataFrame:
    """The a of each distinct row (t, a) whose t has two a or more.

    All rows of a token are in one task, which sorts them and goes through them
    once: no table of all tokens and no second sort for a join with it.
    """
    return tokens.repartition("t").sortWithinPartitions("t", "a").mapInArrow(_common, "a long")


def survivors(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Classes (id, n, p, rep) that the first order leaves as candidates; id is a hash of size and fingerprints.

    The first order ranks sampled tokens that stand in one class only before all
    others.  A class with as many of them as its prefix is long shares no prefix
    token with any other, so it has no link.
    """
    classes = sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("k").alias("rep"), F.first("p").alias("p"), F.first("m").alias("m"))
    held = common_tokens(docs.select("text").mapInArrow(_sampled_tokens(k, percent), "t long, a long")).groupBy("a").agg(F.count("*").alias("held"))
    return classes.join(held, "a", "left").where(F.col("m") - F.coalesce("held", F.lit(0)) < F.col("p")).select(class_id().alias("id"), "n", "p", "rep")


def shared_prefixes(texts: DataFrame, k: int) -> DataFrame:
    """Rows (t, id) of prefix tokens under the second order that two sets or more share.

    The second order ranks by the number of candidate sets with the token, then
    by hash.  texts has id, n, p and text of the candidates.
    """
    tokens = texts.select("id", "text").mapInArrow(_all_tokens(k), "t long, id long")
    tokens = tokens.where("t is not null and id is not null").repartition("t")
    many = tokens.groupBy("t").agg(F.count("*").alias("df"), F.max("id").alias("_id")).where("df > 1 and _id is not null").select("t", "df")
    common = tokens.join(many, "t")
    turn = Window.partitionBy("id").orderBy("df", "t")
    lone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    ranked = common.join(texts.select("id", "n", "p"), "id").withColumn("turn", F.row_number().over(turn)).withColumn("left", F.col("p") - lone)
    return ranked.where("turn <= left").select("t", "id")


def link(h: np.ndarray, bounds: np.ndarray, percent: int, own: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Component (least member) of each of the sets of one block, under exact links.

    Sets are met from small to large.  Candidates of a set are the earlier ones
    that share prefix tokens under every order and are large enough; of those in
    one component, verification stops at the first link.  own: only these count
    as the smaller one of a pair; side: only sets of different sides are pairs.
    """
    n = np.diff(bounds)
    count = len(n)
    label = np.arange(count)
    turn = np.argsort(n, kind="stable")
    place = np.empty(count, np.int64)
    place[turn] = np.arange(count)
    posts = []
    for order in range(len(ORDERS)):
        token, doc = prefixes(h, bounds, order, percent)
        _, token = np.unique(token, return_inverse=True)
        by_token = np.lexsort((place[doc], token))
        edge = np.append(0, np.cumsum(np.bincount(token))) if len(token) else np.zeros(1, np.int64)
        posts.append((token, np.searchsorted(doc, np.arange(count + 1)), place[doc[by_token]], edge))
    size, ident = n, np.unique(h, return_inverse=True)[1] if len(h) else np.zeros(0, np.int64)
    mark = np.zeros(int(ident.max()) + 1 if len(ident) else 0, bool)
    for x in turn:
        found = None
        for token, at, members, edge in posts:
            parts = []
            for t in token[at[x] : at[x + 1]]:
                if edge[t + 1] - edge[t] > 1:
                    post = members[edge[t] : edge[t + 1]]
                    parts.append(post[: np.searchsorted(post, place[x])])
            near = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            found = near if found is None else np.intersect1d(found, near, assume_unique=True)
            if not len(found):
                break
        if not len(found):
            continue
        found = turn[found]
        found = found[100 * size[found] >= percent * size[x]]
        if own is not None:
            found = found[own[found]]
        if side is not None:
            found = found[side[found] != side[x]]
        if not len(found):
            continue
        mark[ident[bounds[x] : bounds[x + 1]]] = True
        step = 16
        while len(found):
            now, found = found[:step], found[step:]
            step *= 4
            both = np.add.reduceat(mark[ident[tn.ranges(bounds[now], size[now])]].astype(np.int64), np.append(0, np.cumsum(size[now])[:-1]))
            linked = now[100 * both >= percent * (size[now] + size[x] - both)]
            if len(linked):
                joined = np.unique(np.append(label[linked], label[x]))
                label[np.isin(label, joined)] = joined[0]
            found = found[label[found] != label[x]]
        mark[ident[bounds[x] : bounds[x + 1]]] = False
    return label


def _verify(k: int, percent: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        h, bounds = shingles(*tn.flat(pa.array(pdf["text"], pa.large_string())), k)
        crossed = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        label = link(h, bounds, percent, pdf["own"].to_numpy(bool), pdf["part"].to_numpy() if crossed else None)
        ids = pdf["id"].to_numpy(np.int64)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})

    return block


def _blocks(member: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """Rows (id, block, band, i, j, part, own): where each member (id, component, n) of a family is verified.

    Families are packed into blocks of about block_tokens.  A larger one is cut
    by size: sets whose sizes differ by more than the threshold allows have no
    link, so a set meets those of its own band and of the next one, as the
    smaller of a pair in its own.  A band that is still too large is dealt into
    parts, and every pair of parts forms a block.
    """
    weight = cut(member.groupBy("component").agg(F.sum("n").alias("n_tokens")))
    small = weight.where(F.col("n_tokens") <= block_tokens).agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, math.ceil(small / block_tokens))
    placed = member.join(weight, "component")
    zero, yes = F.lit(0).cast("long"), F.lit(True)
    alone = placed.where(F.col("n_tokens") <= block_tokens).select("id", F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("block"), F.lit(-1).cast("long").alias("band"), zero.alias("i"), zero.alias("j"), zero.alias("part"), yes.alias("own"))
    # a hair wider than the threshold, so that rounding never puts two bands between sets that may be linked
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    band = F.floor(F.log("n") / step).cast("long")
    rows = placed.where(F.col("n_tokens") > block_tokens).select("id", "n", F.col("component").alias("block"), F.explode(F.array(F.struct(band.alias("band"), yes.alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own")))).alias("b"))
    rows = rows.select("id", "n", "block", "b.*")
    parts = rows.groupBy("block", "band").agg(F.ceil(F.sum("n") / block_tokens).alias("parts"), F.max("own").alias("any")).where("any")
    rows = rows.join(parts, ["block", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    split = rows.withColumn("q", F.explode(F.sequence(zero, F.col("parts") - 1)))
    split = split.select("id", "block", "band", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "own")
    return alone.unionByName(split)


def jaccard_join(docs: DataFrame, k: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Components of documents under links of Jaccard percent/100 or more.

    The set of a document: distinct shingles of k words `[^\\x20\\x09-\\x0D]+`,
    A-Z lowered; with fewer words the whole sequence; without words empty and
    linked with nothing.  Returns k (the row's key), doc_id, n_shingles and
    component_id, the least id reachable by links.

    1. Equal sets become one class, so copies never form pairs.
    2. A first order over all documents leaves out classes whose prefix nobody
       shares (see survivors).
    3. Classes that share a prefix token under a second order fall into one
       candidate family (a star for each token, never its pairs).
    4. Families are verified in blocks of bounded size (see _blocks).  A block
       intersects the candidates of further orders, verifies exactly and sends
       one edge for each member that joins another.

    Corner cases: null and empty texts are components of their own; rows without
    an id are known by a hash of their text; rows with one id and the same text
    stand for one document, texts that share an id are documents of their own;
    other columns are ignored; an empty table gives an empty result.
    """
    wide = repeats_ids(docs, doc_id, text)
    docs = keyed(docs, doc_id, text, wide)
    sets = cut(docs.mapInArrow(_sets(k, percent), f"k {WIDE if wide else 'long'}, doc_id long, n long, a long, b long, p long, m long"))
    classes = cut(survivors(docs, sets, k, percent))
    texts = cut(docs.select("k", "text").join(classes.withColumnRenamed("rep", "k"), "k").dropDuplicates(["k"]).select("id", "n", "p", "text"))

    tokens = cut(shared_prefixes(texts, k))
    stars = tokens.groupBy("t").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("t", "lead")
    family = components(tokens.join(stars, "t").where("id <> lead").select("id", "lead"), "id", "lead")
    member = family.withColumnRenamed("node", "id").join(classes.select("id", "n"), "id")
    work = texts.select("id", "text").join(_blocks(member, percent, block_tokens), "id")
    links = work.groupBy("block", "band", "i", "j").applyInPandas(_verify(k, percent), "a long, b long")
    joined = components(links, "a", "b").withColumnRenamed("node", "id").join(classes.select("id", "rep"), "id")
    named = joined.groupBy("component").agg(F.min("rep").alias("least"))
    final = joined.join(named, "component").select("id", "least")

    every = sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("k").alias("rep")).withColumn("id", class_id())
    by_class = every.join(final, "id", "left").select("n", "a", "b", F.coalesce("least", "rep").alias("least"))
    out = sets.select("k", "doc_id", "n", "a", "b").join(by_class, ["n", "a", "b"], "left").withColumn("least", F.coalesce("least", "k"))
    return out.select("k", "doc_id", F.col("n").alias("n_shingles"), (F.col("least.i") if wide else F.col("least")).alias("component_id"), (F.col("k") == F.col("least")).alias("leads"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document, that of the least key, of each component; all columns kept.

    Rows without words are components of their own.  Of rows with one id and the
    same text, or without id and with the same text, one stays: the least one by
    its other columns.
    """
    found = jaccard_join(docs, k, percent, doc_id, text)
    keep = found.where("leads").select("k").distinct()
    wide = keep.schema["k"].dataType.typeName() == "struct"
    rows = docs.select(row_key(docs[doc_id], docs[text], wide).alias("k"), F.struct("*").alias("row"))
    order = [F.col(f"row.`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    return rows.join(keep, "k", "left_semi").groupBy("k").agg(F.min_by("row", F.struct(*order)).alias("row")).select("row.*")
