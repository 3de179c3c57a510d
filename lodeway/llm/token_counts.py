"""Token counts of whole texts, with overlap resynchronisation for huge ones."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

CHUNK = 16_384
OVERLAP = 256
_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file, once for each worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def can_resynchronise(tokenizer) -> bool:
    """Whether a break before white space is proven safe.

    It is with byte-level pre-tokens cut by the usual pattern, no normaliser and
    no special string that has or takes in white space: no pre-token holds a
    white space character after another one, so one always starts there.
    """
    import json

    if not hasattr(tokenizer, "to_str"):
        return False
    about = json.loads(tokenizer.to_str())
    pre = about.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(map(str.isspace, t["content"])) for t in about["added_tokens"])
    return pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space") and about.get("normalizer") is None and plain


def splice(encode: Callable[[str], list[tuple[int, int]]], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of a text encoded in overlapping chunks, and how often an overlap was widened.

    encode gives the character offsets of a string's tokens.  Two neighbours are
    joined at the first place in their overlap where both have a token border,
    a character that isn't white space stands before it and white space behind:
    there the pattern breaks whatever stands around.  Without such a place the
    overlap doubles, at last to the end of the text.
    """
    total, widened, start, n = 0, 0, 0, len(text)
    spans = encode(text[: min(n, chunk + overlap)])
    end = min(n, chunk + overlap)
    while end < n:
        wide = overlap
        while True:
            low = max(start + 1, end - wide)
            after = encode(text[low : min(n, low + chunk + wide)])
            left = {start + a for a, _ in spans}
            right = {low + a for a, _ in after}
            common = [p for p in sorted(left & right) if low < p < end and not text[p - 1].isspace() and text[p].isspace()]
            if common:
                cut = common[len(common) // 2]
                total += sum(start + b <= cut for _, b in spans)
                spans = [(a + low - cut, b + low - cut) for a, b in after if low + a >= cut]
                start, end = cut, min(n, low + chunk + wide)
                break
            widened += 1
            wide *= 2
            # more text to the right as well, so that a common place can come into reach
            end = min(n, end + wide)
            spans = encode(text[start:end])
            if end >= n:
                break
    return total + len(spans), widened


def _count(path: str, chunk: int, overlap: int, batch_chars: int = 1 << 20):
    def emit(batches):
        tokenizer = load(path)
        piece_model = path.endswith(".model")
        by_chunk = not piece_model and can_resynchronise(tokenizer)
        for batch in batches:
            for part in tn.slices(batch, "text", batch_chars):
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts = np.zeros(len(texts), np.int64)
                widened = np.zeros(len(texts), np.int32)
                long = [i for i, t in enumerate(texts) if by_chunk and len(t) > chunk]
                short = [i for i in range(len(texts)) if not by_chunk or len(texts[i]) <= chunk]
                if piece_model:
                    counts[short] = [len(x) for x in tokenizer.encode([texts[i] for i in short], num_threads=1)]
                elif short:
                    counts[short] = [len(x.ids) for x in tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)]
                for i in long:
                    counts[i], widened[i] = splice(lambda s: tokenizer.encode(s, add_special_tokens=False).offsets, texts[i], chunk, overlap)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(counts), pa.array(widened)], [*(c for c in part.schema.names if c != "text"), "n_tokens", "n_widened"])

    return emit


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Tokens of every whole text under the tokenizer file `path`.

    No begin, end or added special tokens, no truncation, no padding; special
    strings inside texts count as the library takes them by default.  Texts over
    `chunk` characters are encoded in overlapping chunks (see splice); where the
    tokenizer gives no proven break they are encoded whole.  Returns doc_id,
    n_bytes, n_tokens, over_limit and n_widened.

    Corner cases: null is empty (0 bytes, 0 tokens); null ids and repeated rows
    come through row by row; other columns are ignored; an empty table gives an
    empty result.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    counted = rows.mapInArrow(_count(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long, n_widened int")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_widened")
