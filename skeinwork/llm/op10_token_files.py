"""Token ids as Parquet list columns that can be read by column, row group and page."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import texts, work_dir
from skeinwork.llm.encode import encoder


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, part_bytes: int = 1 << 23) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``tokens`` of rows (``doc_id``, ``text``), in their order, with ``end_id`` behind each text.

    Null is the empty text. Batches are cut so that some ``part_bytes`` of text are Python objects at a time.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            column = batch.column(1)
            step = max(1, int(part_bytes / max(1, column.nbytes / max(1, len(column)))))
            for k in range(0, len(column), step):
                rows = [enc.encode(t) + end for t in texts(column.slice(k, step))]
                lengths = np.array([len(r) // 4 for r in rows], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                values = pa.Array.from_buffers(pa.int32(), int(lengths.sum()), [None, pa.py_buffer(b"".join(rows))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, step), pa.array(lengths), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n_tokens", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>")


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    row_group_bytes: int = 1 << 25, page_bytes: int = 1 << 17,
) -> None:
    """Write ``doc_id``, ``n_tokens`` and ``tokens`` (list of int) in ascending order of ``doc_id``, nulls first.

    Documents are dealt to files by ranges of ids and sorted inside, so files, row groups and pages hold id ranges and the
    footers' and page indexes' bounds let a reader skip. Tokens are dictionary encoded (the vocabulary bounds the
    dictionary), ids and counts are delta encoded. Rows with one id, repeated ones too, are all kept and lie together. An
    empty table gives files without rows. Other columns are not read. Spark's own committer makes a lost task's file
    disappear, so the output is whole or absent.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = token_ids(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), tokenizer, end_id)
    (
        rows.write
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("compression", "zstd")
        .parquet(path)
    )


class TokenFiles:
    """Reads what ``write_tokens`` wrote; each method touches the columns and pages that it needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = spark.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(path)

    def _placed(self, *columns: Column) -> DataFrame:
        """Given columns with ``start``.

        Files hold disjoint id ranges, so totals per file are summed over the files (a row each, made from the metadata
        columns) and the rows of one file are summed in order of their place.
        """
        file = F.col("_metadata.file_path")
        files = self.files.select("doc_id", "n_tokens", file.alias("_of")).groupBy("_of").agg(
            F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_of")).alias("_first"), F.sum("n_tokens").alias("_total"))
        base = files.select("_of", F.coalesce(F.sum("_total").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
        rows = self.files.select("doc_id", "n_tokens", *columns, file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
        inside = F.sum("n_tokens").over(Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
        joined = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(base, F.col("_file") == F.col("_of"))
        return joined.withColumn("start", F.col("_base") + F.col("_inside")).drop("_file", "_of", "_row", "_base", "_inside")

    def metadata(self) -> DataFrame:
        """``doc_id``, ``n_tokens`` and ``start``: the ids of all documents before it. Tokens are not read."""
        return self._placed()

    def tokens(self, ids: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
        """Documents of some ids or of a range of ids; page and row-group bounds skip the others."""
        out = self.files
        if ids is not None:
            out = out.where(F.col("doc_id").isin(ids))
        if first is not None:
            out = out.where(F.col("doc_id") >= first)
        if last is not None:
            out = out.where(F.col("doc_id") <= last)
        return out

    def spans(self, spans: DataFrame) -> DataFrame:
        """Rows of ``spans`` (doc_id, start, length) with the ids found there (fewer at a document's end)."""
        found = spans.select("doc_id", "start", "length").join(self.files.select("doc_id", "tokens"), "doc_id")
        return found.select("doc_id", "start", "length", F.slice("tokens", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("tokens"))

    def digest(self) -> DataFrame:
        """``doc_id``, ``start``, ``n_tokens`` and the checksum of the ids as they are in the files."""
        read = self._placed(F.size("tokens").cast("long").alias("_counted"), ids_crc32(F.col("tokens")).alias("ids_crc32"))
        return read.select("doc_id", "start", F.col("_counted").alias("n_tokens"), "ids_crc32")


def ids_crc32(column: Column) -> Column:
    def crc(column: pa.Array) -> pa.Array:
        values, offsets = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), column.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(values)).cast("B")
        return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64())

    crc.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(crc, "long").asNondeterministic()(column)


def write_and_read(df: DataFrame, tokenizer: str, end_id: int = 0, **columns: str) -> DataFrame:
    """Write all documents to a new folder below the shared one and return the digest of what the files hold."""
    path = work_dir(df.sparkSession, "tokens")
    write_tokens(df, path, tokenizer, end_id, **columns)
    return TokenFiles(df.sparkSession, path).digest()
