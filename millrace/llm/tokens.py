"""Token counts by scanning flat token files for their separators.

A flat file holds 16-bit token ids, documents one after the other, each closed by the end-of-document id, and no index.
Files are cut into blocks; tasks search each block's ids for the separator at once. A document may begin in one block
and end in another: a running maximum over the blocks of a file of the place of their last separator tells every block
where the document that is open at its start began.

``write`` makes such files from texts, with the ids of a public byte-pair vocabulary plus one, so that 0 is free for the
separator.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import pick, slices
from millrace.session import new_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: how the byte-pair vocabularies of this family cut a text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SEPARATOR = 0
ID = np.dtype("<u2")

#: Bytes of a block that is searched, and of a file that ``write`` closes.
BLOCK_BYTES = 1 << 20
FILE_BYTES = 4 << 20


def load_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    rows = (line.split() for line in vocabulary.splitlines() if line.strip())
    ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
    if max(ranks.values()) + 1 >= 1 << 16:
        raise ValueError("the ids do not fit 16 bits")
    return tiktoken.Encoding("flat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def write(docs: DataFrame, folder: str, vocabulary: bytes, file_bytes: int = FILE_BYTES) -> None:
    """Write the tokens of every row's whole ``text`` to flat files in ``folder``; a null text has none.

    Rows keep their order within a task, so reruns write the same documents. A task holds one file and one text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        end = np.array([SEPARATOR], ID).tobytes()
        parts: list[bytes] = []
        size = 0
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                parts.append((np.array(encode(text or ""), np.int64) + 1).astype(ID).tobytes())
                size += len(parts[-1]) + 2
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(parts)], pa.binary())], names=["value"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(parts)], pa.binary())], names=["value"])

    files = pick(docs, "text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # the writer puts the separator behind the last document of each file
    files.write.option("lineSep", "\x00\x00").option("maxRecordsPerFile", 1).text(folder)


def blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, block, data`` of all files in ``folder``; a task holds one file at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where("length > 0").select("path", "length", "content")
    places = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes).cast("int"))
    cut = files.select("path", "content", F.explode(places).alias("block"))
    data = F.substring(F.col("content"), F.col("block") * block_bytes + 1, F.lit(block_bytes))
    return cut.select(F.col("path").alias("file"), "block", data.alias("data"))


def separators(cut: DataFrame, separator: int = SEPARATOR, wide: bool = False) -> DataFrame:
    """``file, block, n, ends``: ids in each block, and the places of its separators. ``wide``: ids of 32 bits."""
    kind = np.dtype("<u4") if wide else ID

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ends = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), kind, len(data.as_buffer()) // kind.itemsize)
                counts.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "n", "ends"])

    return cut.mapInArrow(run, "file string, block int, n bigint, ends array<bigint>")


def documents(found: DataFrame) -> DataFrame:
    """``file, document, first_token, n_tokens, closed`` from the separators of all blocks.

    Empty documents count. Tokens behind the last separator of a file are a document that is not closed. A window holds
    the blocks of one file.
    """
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    located = found.withColumn("start", start).withColumn("ends", F.transform("ends", lambda e: e + F.col("start")))
    located = located.withColumn("last", F.try_element_at("ends", F.lit(-1)))
    located = located.withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1)))
    located = located.withColumn("document", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    located = located.withColumn("final", F.lead("block").over(order).isNull())
    after = F.coalesce("last", "open")
    rest = (F.col("start") + F.col("n")) - after - 1
    closed = F.transform(
        "ends",
        lambda end, i: F.struct(
            (F.col("document") + i).alias("document"),
            F.when(i == 0, F.col("open")).otherwise(F.col("ends")[i - 1]).alias("previous"),
            end.alias("end"),
            F.lit(True).alias("closed"),
        ),
    )
    tail = F.struct(
        (F.col("document") + F.size("ends")).alias("document"),
        after.alias("previous"),
        (F.col("start") + F.col("n")).alias("end"),
        F.lit(False).alias("closed"),
    )
    all_ = F.when(F.col("final") & (rest > 0), F.concat(closed, F.array(tail))).otherwise(closed)
    rows = located.select("file", F.explode(all_).alias("d"))
    return rows.select(
        "file",
        F.col("d.document").cast("bigint").alias("document"),
        (F.col("d.previous") + 1).alias("first_token"),
        (F.col("d.end") - F.col("d.previous") - 1).alias("n_tokens"),
        F.col("d.closed").alias("closed"),
    )


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR, wide: bool = False) -> DataFrame:
    """The documents of all flat files in ``folder`` and their token counts. Empty files have none."""
    return documents(separators(blocks(spark, folder), separator, wide))


def count_text_tokens(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """Write ``docs`` to flat files in the shared folder and count their tokens from those.

    One row for every row of ``docs``, with the file's name and the document's place in it; null and empty texts have
    no tokens, repeated rows are counted each, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write(docs, folder, vocabulary)
    found = count_tokens(spark, folder)
    return found.withColumn("file", F.regexp_replace("file", "^.*/(part-[0-9]+)-[0-9a-f-]{36}", "$1"))
