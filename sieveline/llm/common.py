"""What the operators share: reading, Arrow batches cut by bytes, word classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Bytes that stand in a word once A-Z are lower-cased: digits, a-z and every
# byte of a multi-byte character. All others become a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one holds about ``limit`` bytes of text (or a single longer row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes]:
    """Each text's bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def map_texts(docs: DataFrame, columns: list[str], schema: str, step: Callable[[pa.RecordBatch], dict | None],
              limit: int = 8 << 20) -> DataFrame:
    """``step`` over batches of ``columns`` of ``docs``, ``limit`` bytes of text each; it returns columns by name."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in texts(batches, limit):
            made = step(batch)
            if made is not None:
                yield pa.RecordBatch.from_arrays([as_arrow(made[n]) for n in names], names=names)

    return docs.select(*columns).mapInArrow(run, schema)


def as_arrow(values):
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def learn_fold(modulus: int, held: int):
    """True for a row that is held out: crc32 of the id as text leaves ``held``. A row without an id never is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
