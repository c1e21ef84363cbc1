"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it; ``bytes.split()`` splits on the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

#: ASCII lower-casing of UTF-8 bytes; bytes of other letters are above 0x7F.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def free(spark: SparkSession) -> None:
    """Have Spark delete what was shuffled for frames that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank``, 0, 1, ... in this order, by sorted partitions and the counts of their rows."""
    rows = cut(df.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row a partition
    before, starts = 0, []
    for r in sizes:
        starts.append((r["p"], before))
        before += r["count"]
    known = df.sparkSession.createDataFrame(starts, "__part long, __before long")
    joined = rows.join(F.broadcast(known), part == F.col("__part"))
    return joined.select(*df.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def unsigned(h: Column) -> Column:
    """Signed 64-bit hash -> the same hash with its order as an unsigned number kept under signed comparison."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def top_bits(h: Column, bits: int) -> Column:
    """The leading ``bits`` bits of a 64-bit hash as a number from 0."""
    return F.shiftrightunsigned(h, 64 - bits) if bits > 0 else F.lit(0).cast("long")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c: Column) -> Column:
    """Number of white-space separated words; null counts as empty."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id hashes as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def narrow_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, the latter never null."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
