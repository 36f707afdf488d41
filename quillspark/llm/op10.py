"""Query op10_bpe_round_trip: digests of the ids and of the decoded text of each document."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe
from quillspark.llm._shared import documents

DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(encoded: list[bytes], decoded: list[str]) -> list[pa.Array]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [
        pa.array([len(e) // 4 for e in encoded], pa.int64()),
        pa.array([sha(e) for e in encoded], pa.string()),
        pa.array([sha(d.encode()) for d in decoded], pa.string()),
    ]


def round_trip(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), schema=DIGESTS, finish=digests)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
