"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
#: Words that one Python worker remembers before it starts afresh; bounds its memory, changes no result.  Hashes are cheap to make again.
WORDS_KEPT = 1 << 19
HASHES_KEPT = 1 << 17
ROWS_AT_ONCE = 256
_BITS = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  A temporary one only in local mode, where that is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("marketframe.shared.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("marketframe.shared.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marketframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, a subfolder for each value of the columns ``by`` (last in ``df``).  Cuts the lineage;
    survives the loss of executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def maybe_among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose value in ``column`` may be among those of ``ids`` (one column of the same type).

    What is broadcast is a bitmap of ``_BITS`` hashed values: 65,536 rows of 16 bytes at most, whatever ``ids`` holds.  A few other
    rows come through, and more the fuller it is; what follows must be right without it.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(_BITS))
    bits = ids.select(spot(ids.columns[0]).alias("_spot")).groupBy(F.shiftright("_spot", 6).alias("_slot")).agg(F.expr("bit_or(shiftleft(1L, cast(_spot % 64 as int)))").alias("_bits"))
    met = df.withColumn("_spot", spot(column)).join(F.broadcast(bits), F.shiftright("_spot", 6) == F.col("_slot"))
    return met.where("shiftright(_bits, cast(_spot % 64 as int)) & 1 = 1").drop("_spot", "_slot", "_bits")


_holder: tuple[object, Callable[[], None]] | None = None


def remembers(owner: object, forget: Callable[[], None]) -> None:
    """``owner`` remembers words from here on; what another one remembered in this Python worker, for an earlier stage, is forgotten.  A
    worker outlives its stage, and its memory counts while the next one runs."""
    global _holder
    if _holder is None or _holder[0] is not owner:
        if _holder is not None:
            _holder[1]()
        _holder = owner, forget


class WordHashes:
    """64-bit xxHash of words, remembered for the words a worker has met."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        remembers(self, self.known.clear)
        if len(self.known) > HASHES_KEPT:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        found = list(map(known.get, words))
        if None in found:
            for i, h in enumerate(found):
                if h is None:
                    w = words[i]
                    found[i] = known[w] = digest(w)
        return np.array(found, dtype=np.uint64)


_hashes: WordHashes | None = None


def word_hashes(words: list[bytes]) -> np.ndarray:
    global _hashes
    if _hashes is None:
        _hashes = WordHashes()
    return _hashes(words)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Well-mixed 64-bit hashes of all runs of ``width`` words; of the whole sequence if it is shorter, none if it is empty."""
    width = min(width, len(hashes))
    if not width:
        return np.empty(0, np.uint64)
    n = len(hashes) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h * _MIX[0] ^ hashes[k : k + n]) * _MIX[1]
        h ^= h >> np.uint64(32)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(29))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text as UTF-8; ``lower`` turns A-Z into a-z only.  None has no words."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The values of some columns, row by row; only ``ROWS_AT_ONCE`` rows are Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS_AT_ONCE):
            part = b.slice(k, ROWS_AT_ONCE)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``size`` rows."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(part: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as ``id`` and ``text``: columns beside them, whatever their names, can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
