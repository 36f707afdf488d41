"""Deterministic hashes for splits, samples and ids; all built-in, equal in any SQL with SHA-256."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def hash60(seed: str, *parts: Column, separator: str = "\x1f") -> Column:
    """The first 60 bits of SHA-256 of the seed and the parts, as a long."""
    text = F.concat_ws(separator, F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def split_of(seed: str, group: Column, shares: dict[str, float]) -> Column:
    """The split of a group: its hash against the running shares, in millionths."""
    at = hash60(seed, group) % 1_000_000
    out, upto = None, 0
    for name, share in shares.items():
        upto += round(share * 1_000_000)
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return out.otherwise(list(shares)[-1])


def fold_of(seed: str, group: Column, folds: int) -> Column:
    return (hash60(seed, group) % folds).cast("int")


def stable_id(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """A prefix and the first digits of SHA-256 of the parts, with a zero byte between."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256), 1, digits))


def blake_split(seed: int, shares: tuple[float, float] = (0.8, 0.1)):
    """Split by 8-byte BLAKE2b of ``seed:id`` over 2^64, for ids split elsewhere by that digest; Spark has no such function."""

    @pandas_udf("string")
    def split(ids):
        def one(i):
            at = int.from_bytes(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest(), "big") / 2**64
            return "train" if at < shares[0] else "dev" if at < shares[0] + shares[1] else "test"

        return ids.map(one)

    return split
