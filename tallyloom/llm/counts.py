"""Token counts of the documents in flat, unindexed token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import slices
from tallyloom.llm.tokenise import EOD_ID, encoder
from tallyloom.session import scratch_dir

#: Ids per file. A stream goes on from file to file, wherever that cuts its documents.
FILE_IDS = 1 << 21
#: The text sink ends each file with one terminator, of one id's size; the reader leaves it out.
_TERMINATOR = "\n\n"


def _streams(tokenizer: str, file_ids: int, eod: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size, stream, block = encoder(tokenizer, special=False), [], 0, None, 0

        def row(ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{stream:08d}-{block:08d}"]), pa.array([ids.astype("<u2").tobytes()], pa.binary())], ["block", "ids"])

        for part, data, offsets in slices(batches, "text"):
            raw = data.tobytes()
            if stream is None:
                stream = part.column(0)[0].as_py() >> 33
            for i in range(len(part)):
                ids = np.append(encode(raw[offsets[i]:offsets[i + 1]].decode()), np.uint32(eod)).astype("<u2")
                held.append(ids)
                size += len(ids)
                if size >= file_ids:
                    joined = np.concatenate(held)
                    while len(joined) >= file_ids:
                        yield row(joined[:file_ids])
                        block, joined = block + 1, joined[file_ids:]
                    held, size = [joined], len(joined)
        if size:
            yield row(np.concatenate(held))

    return run


def write_token_files(df: DataFrame, path: str, text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", eod: int = EOD_ID, file_ids: int = FILE_IDS) -> None:
    """Flat files below ``path``: the ids of all texts as little-endian 16-bit numbers, each text's followed by ``eod``.

    One stream per partition of ``df`` in row order, cut into files ``block=<stream>-<number>`` of ``file_ids`` ids.
    The string of ``eod`` inside a text is encoded as the text it is, so no text's ids hold ``eod`` itself.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(F.monotonically_increasing_id().alias("row"), text.alias("text"))
    blocks = docs.mapInArrow(_streams(tokenizer, file_ids, eod), "block string, ids binary")
    # A binary cast to string keeps its bytes, and the text sink writes them as they are.
    blocks.select("block", F.col("ids").cast("string").alias("value")).write.partitionBy("block").option("lineSep", _TERMINATOR).text(path)


def _separators(eod: int):
    """Of each file: how many separators it has, the ids before the first and after the last, and the gaps between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2")[:-1]  # without the terminator
                at = np.flatnonzero(ids == eod)
                head, tail = (int(at[0]), int(len(ids) - at[-1] - 1)) if len(at) else (len(ids), len(ids))
                out.append((block.as_py(), len(at), head, tail, (np.diff(at) - 1).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())], strict=True)], ["block", "ends", "head", "tail", "gaps"])

    return run


def count_tokens(spark: SparkSession, path: str, eod: int = EOD_ID) -> DataFrame:
    """``stream``, ``nth`` (document of the stream, from 0), ``n_tokens`` (without separator), from the files alone.

    Every file is searched on its own. A prefix scan over each stream's files (one short row per file) gives the
    number of documents ended before a file and the ids that the document running into it has had so far: the tails
    since the last file with a separator. Ids after a stream's last separator are no document. No files: no rows.
    """
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    named = files.where("length > 2").select(F.regexp_extract("path", r"block=([0-9-]+)", 1).alias("block"), "content")
    found = named.mapInArrow(_separators(eod), "block string, ends long, head long, tail long, gaps array<long>")
    parts = found.select(F.split("block", "-")[0].cast("long").alias("stream"), F.split("block", "-")[1].cast("long").alias("number"), "ends", "head", "tail", "gaps")
    before = Window.partitionBy("stream").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    scanned = parts.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # Files in which the same document is still running share ``first`` until one has a separator; that one ends it.
    running = Window.partitionBy("stream", "first").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.lag("tail").over(Window.partitionBy("stream").orderBy("number"))
    scanned = scanned.withColumn("_before", ended)
    carried = F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("head"))).over(running), F.lit(0)) + F.coalesce(F.first("_before").over(running.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    closed = scanned.withColumn("carried", carried).where("ends > 0")
    lengths = F.concat(F.array(F.col("carried") + F.col("head")), F.col("gaps"))
    return closed.select("stream", "first", F.posexplode(lengths).alias("i", "n_tokens")).select("stream", (F.col("first") + F.col("i")).alias("nth"), "n_tokens")


def document_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """id, ``n_tokens``, ``stream``, ``nth``: writes the token files, scans them, and names each document by its place.

    The place of a row, its partition and number there, is taken again from ``df``, which must have the same
    partitions on both passes, as a scan of a table has. The job fails if files hold another number of documents.
    Null and empty texts count 0 tokens. Null and repeated ids are kept as they are. An empty table gives no rows.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark, "tokens")
    write_token_files(df, path, text_col, tokenizer)
    row = F.monotonically_increasing_id()
    names = df.select(F.col(f"`{id_col}`").alias("_id"), row.alias("_row"))
    names = names.select("_id", F.shiftright("_row", 33).alias("stream"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    both = count_tokens(spark, path).withColumn("_found", F.lit(True)).join(names.withColumn("_named", F.lit(True)), ["stream", "nth"], "full")
    sound = F.col("_found").isNotNull() & F.col("_named").isNotNull()
    n = F.when(sound, F.col("n_tokens")).otherwise(F.raise_error(F.lit("files and table differ in documents")).cast("long"))
    return both.select(F.col("_id").alias(id_col), n.alias("n_tokens"), "stream", "nth")
