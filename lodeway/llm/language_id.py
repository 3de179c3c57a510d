"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .keys import cut

BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Lower-case form of each code point that is a letter, 0 elsewhere; a run of other characters is one border."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0])
    return table


_table: list[np.ndarray] = []


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of letters and word borders, and the document each belongs to."""
    if not _table:
        _table.append(_letters())
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), size)
    letter = _table[0][np.minimum(code, 0x10FFFF)]
    keep = letter > 0
    fresh = np.ones(len(code), bool)
    fresh[1:] = keep[:-1] | keep[1:] | (doc[1:] != doc[:-1])  # of a run of non-letters the first stays
    sym, doc = letter[fresh].astype(np.uint64), doc[fresh]
    sym = tn.mix(sym + np.uint64(1))
    buckets, owners = [], []
    for n in ORDERS:
        m = len(sym) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for j in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + sym[j : j + m]
        same = doc[:m] == doc[n - 1 :]
        buckets.append((tn.mix(h) >> np.uint64(64 - bits)).astype(np.int64)[same])
        owners.append(doc[:m][same])
    none = np.zeros(0, np.int64)
    return np.concatenate(buckets or [none]), np.concatenate(owners or [none])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _counts(bits: int, held: int = 16):
    """Rows lang, bucket and n; bucket -1 counts texts.  At most `held` languages are summed at a time."""

    def rows(total: dict[str, np.ndarray], texts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(counts[at], texts[name]))], ["lang", "bucket", "n"])

    def emit(batches):
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                langs = piece.column("lang").to_pylist()
                bucket, owner = features(texts, bits)
                names = sorted(set(langs))
                place = {x: i for i, x in enumerate(names)}
                code = np.array([place[x] for x in langs])
                key, n = np.unique((code[owner] << bits) + bucket, return_counts=True)
                edge = np.searchsorted(key >> bits, np.arange(len(names) + 1))
                for i, name in enumerate(names):
                    if name not in total and len(total) >= held:
                        yield from rows(total, seen)
                        total, seen = {}, {}
                    counts = total.setdefault(name, np.zeros(1 << bits, np.int64))
                    counts[key[edge[i] : edge[i + 1]] & ((1 << bits) - 1)] += n[edge[i] : edge[i + 1]]
                    seen[name] = seen.get(name, 0) + int((code == i).sum())
        yield from rows(total, seen)

    return emit


def train(labelled: DataFrame, bits: int = BITS, smoothing: float = 0.5, max_langs: int = 100) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log probability of each bucket by language, and log priors.

    Counts cover every labelled row; each task sums its own first.  The driver
    holds one count for each language and bucket: at the bound of `max_langs`
    languages (more raise an error) 52 MB of counts, and 26 MB go out.
    """
    sums = cut(labelled.select("text", "lang").mapInArrow(_counts(bits), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    names = sorted(r["lang"] for r in sums.where("bucket < 0").select("lang").limit(max_langs + 1).collect())
    if len(names) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    if not names:
        return [], np.zeros((1 << bits, 0), np.float32), np.zeros(0)
    counts, prior = np.full((1 << bits, len(names)), smoothing), np.full(len(names), smoothing)
    # one array of buckets and one of counts for each language
    for r in sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("all")).toLocalIterator():
        bucket, n = np.array([tuple(x) for x in r["all"]], np.int64).T
        i = names.index(r["lang"])
        counts[bucket[bucket >= 0], i] += n[bucket >= 0]
        prior[i] += n[bucket < 0].sum()
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum())


def _score(model, bits: int):
    def emit(batches):
        names, logp, prior = model.value
        for batch in batches:
            for piece in tn.slices(batch, "text"):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if names:
                    bucket, owner = features(texts, bits)
                    value = np.stack([np.bincount(owner, weights=logp[bucket, j], minlength=len(texts)) for j in range(len(names))], axis=1).astype(float)
                    seen = np.bincount(owner, minlength=len(texts))
                    value += prior
                    best = value.argmax(axis=1)
                    # posterior at the length of sixteen n-grams, so that long texts keep a graded score
                    scale = 16 / np.maximum(16, seen)
                    odds = np.exp((value - value.max(axis=1, keepdims=True)) * scale[:, None])
                    share = odds.max(axis=1) / odds.sum(axis=1)
                    for i, t in enumerate(texts):
                        if has_letter(t):
                            pred[i], score[i] = names[best[i]], share[i]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(pred), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return emit


def language_id(docs: DataFrame, bits: int = BITS, folds: int = 3, held_fold: int = 1, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Predict the language of every whole text.

    Learns from text and non-null language of the rows whose crc32 of the id as
    text leaves another remainder than `held_fold` modulo `folds`; language and
    id are never features.  Returns doc_id, held_out, lang_pred and score, the
    posterior of the language as if the text had sixteen n-grams of its mean
    (all of them, where it has fewer), so that long texts keep a graded score.

    Corner cases: null texts and texts without a letter get 'und' and score 0,
    as does every text where nothing was learned; rows without an id are never
    held out; ties take the first language by name; repeated rows count as
    often as they come; other columns are ignored.
    """
    rows = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.coalesce(F.crc32(docs[doc_id].cast("string")) % folds == held_fold, F.lit(False)).alias("held_out"),
        docs[text].cast("string").alias("text"),
        docs[lang].cast("string").alias("lang"),
    )
    model = train(rows.where("not held_out and lang is not null and text is not null"), bits)
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**bits floats
    return rows.select("doc_id", "held_out", "text").mapInArrow(_score(held, bits), "doc_id long, held_out boolean, lang_pred string, score double")
