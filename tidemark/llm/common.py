"""What the operators of this subpackage share: tables in the shared folder, checked broadcasts, bounded prefilters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bounded_batches, discard, new_path, saved, shared_dir  # noqa: F401
from .kernels import mix

#: Words of every contract: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A prefilter never has more bits than this (32 MB); beyond its capacity it lets more through, and results stay the same.
FILTER_BITS = 1 << 28


class Bitmap:
    """A fixed-size membership prefilter over rows of integers, built by Spark's bitmap aggregates.

    It answers "surely not" or "maybe".  Callers only use it to leave out rows that cannot
    matter, so its size bound costs selectivity at most, never rows.
    """

    def __init__(self, keys: DataFrame, *columns: str, max_bits: int = FILTER_BITS):
        n = keys.count()
        self.bits = min(max_bits, max(1 << 16, 1 << int(16 * n).bit_length()))
        shift = np.uint64(64 - (self.bits.bit_length() - 1))

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array((_key([c.to_numpy() for c in batch.columns]) >> shift).astype(np.int64) + 1)], ["p"])

        rows = (
            keys.select(*columns)
            .mapInArrow(run, "p long")
            .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
            .collect()  # bits / 32768 rows of 4 KB at most
        )
        raw = np.zeros(self.bits // 8, np.uint8)
        for bucket, bits in rows:
            raw[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(raw)

    def close(self) -> None:
        """Frees it everywhere; to be called when what used it has been written."""
        self.shared.destroy()

    def maybe(self, *columns: np.ndarray) -> np.ndarray:
        place = _key(columns) >> np.uint64(64 - (self.bits.bit_length() - 1))
        return (self.shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _key(columns) -> np.ndarray:
    out = mix(columns[0].view(np.uint64))
    for c in columns[1:]:
        out = mix(out ^ c.view(np.uint64))
    return out
