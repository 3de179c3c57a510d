"""Column helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Types of the key of a row: the id alone, or with a hash of its text where ids repeat with other texts.
NARROW, WIDE = "long", "struct<i:long,v:long>"


def row_key(doc_id: Column, text: Column, wide: bool = False) -> Column:
    """The id, or a hash of the text where the id is null; wide: together with a hash of the text."""
    ident, body = doc_id.cast("long"), text.cast("string")
    narrow = F.coalesce(ident, F.xxhash64(body))
    return F.struct(narrow.alias("i"), F.xxhash64(body).alias("v")) if wide else narrow


def repeats_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> bool:
    """Whether one id stands for different texts, so that rows are known by id and text.

    Only hashes are shuffled, summed by id first.
    """
    body = docs[text].cast("string")
    ids = docs.select(row_key(docs[doc_id], docs[text]).alias("i"), F.xxhash64(body).alias("v"))
    return not ids.groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high").isEmpty()


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """Columns k, doc_id and text only, whatever else the table has."""
    ident, body = docs[doc_id], docs[text]
    return docs.select(row_key(ident, body, wide).alias("k"), ident.cast("long").alias("doc_id"), body.cast("string").alias("text"))


def key_type(docs: DataFrame) -> str:
    return WIDE if docs.schema["k"].dataType.typeName() == "struct" else NARROW


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared(spark) -> None:
    """Set a checkpoint folder where the session has none.

    It is the one that spark.checkpoint.dir names.  Without that setting a
    folder of this machine serves where driver and executors are one process
    (tests, local runs); on a cluster it is an error.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="lodeway-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and continue from there."""
    shared(df.sparkSession)
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of results that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def pinned(bits: Column) -> Column:
    """The same long, computed where it stands: Spark pushes no filter on it below.

    A pushed filter would put whole array expressions inside the lambdas that
    name their columns, and so compute them once for each element.
    """
    return bits.bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long")))
