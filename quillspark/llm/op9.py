"""Query op9_token_files: what the written token files hold of each document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspark.llm import token_files
from quillspark.llm._shared import documents, fat_rows, table_path


def with_crc(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids_crc32", T.LongType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names)

    return rows.mapInArrow(run, schema)


def token_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    fat_rows(spark)
    path = table_path(spark, "token_ids")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return with_crc(token_files.read(spark, path))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))
