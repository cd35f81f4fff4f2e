"""Token ids in files of bit or byte planes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.common import id_text, in_batches, new_path, rows_of

BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())),
    ("doc_seq", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("doc_first", pa.list_(pa.int64())), ("doc_len", pa.list_(pa.int64())),
])
_BLOCKS = "shard int, block int, first long, n_ids int, kind string, planes array<binary>, doc_seq array<long>, doc_id array<long>, doc_first array<long>, doc_len array<long>"
_PARTS = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("doc_first", pa.int64()), ("n_tokens", pa.int64()), ("block", pa.int32()), ("crc", pa.int64()), ("ids", pa.binary())])


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """A block of 32-bit ids as 4 byte planes or 32 bit planes, each compressed with zstandard.  An empty block has empty planes."""
    import zstandard

    flat = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(flat, axis=1, bitorder="little").T, axis=1)
    elif kind == "byte":
        rows = np.ascontiguousarray(flat.T)
    else:
        raise ValueError(f"planes are 'bit' or 'byte', not {kind!r}")
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(r.tobytes()) for r in rows]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block again."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(unpack.decompress(p, max_output_size=max(1, n)), np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int | None, *, path: str | None = None, block_ids: int = 1 << 16, kind: str = "byte", level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text and write its ids in ascending id order; return the folder written.

    Rows are dealt in ranges of the id, so task k holds the k-th stretch of documents and writes shard k.  A shard is cut into
    blocks of ``block_ids`` ids (the last is shorter).  A block's row holds its planes, and its part of the chunk index: its place in
    the shard and every document that it touches (sequence in the shard, id, place, length).  Only one block is held in memory.

    Null and empty texts have only the end id (nothing where ``end_id`` is None: such documents are still in the index, with length
    0, in the block that follows or the last).  Null ids sort first.  Repeated ids are separate documents, ordered by a hash of
    their texts.  Columns other than the two named are not read.  An empty table gives an empty folder.
    """
    path = path or new_path(docs.sparkSession, "token-planes")
    rows = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from marketframe.llm.tokens import word_tokenizer

        encode, shard = word_tokenizer(tokenizer).ids, TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], "<u4")
        held, count, at, number, first, index = [], 0, 0, 0, 0, []

        def block(ids: np.ndarray) -> tuple:
            return (shard, number, first, len(ids), kind, to_planes(ids, kind, level), *(list(c) for c in (zip(*index, strict=True) if index else ((), (), (), ()))))

        for seq, (doc, text) in enumerate(rows_of(batches, "id", "text")):
            ids = np.concatenate([encode(text), end])
            index.append(entry := (seq, doc, at, len(ids)))
            at += len(ids)
            held.append(ids)
            count += len(ids)
            if count >= block_ids:
                ids = np.concatenate(held)
                for k in range(0, count - block_ids + 1, block_ids):
                    yield block(ids[k : k + block_ids])
                    number, first, index = number + 1, first + block_ids, [entry] if at > first + block_ids else []
                ids = ids[count - count % block_ids :] if count % block_ids else ids[:0]
                held, count = [ids], len(ids)
        if count or index:
            yield block(np.concatenate(held))

    rows.select("id", "text").mapInArrow(lambda b: in_batches(blocks(b), BLOCK_SCHEMA, 8), _BLOCKS).write.parquet(path)
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document what the files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are read apart from each other, in any order.  A document inside one block is finished there; only those that cross a
    block's end are put together from their parts.
    """
    stored = spark.read.schema(_BLOCKS).parquet(path)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for shard, block, first, n, kind, planes, seqs, docs, starts, lengths in rows_of(batches, *BLOCK_SCHEMA.names):
            ids = from_planes(planes, n, kind)
            for seq, doc, start, length in zip(seqs, docs, starts, lengths, strict=True):
                raw = ids[max(0, start - first) : max(0, start + length - first)].tobytes()
                inside = start >= first and start + length <= first + n
                yield shard, seq, doc, start, length, block, zlib.crc32(raw) if inside else None, None if inside else raw

    found = stored.mapInArrow(lambda b: in_batches(parts(b), _PARTS), "shard int, seq long, doc_id long, doc_first long, n_tokens long, block int, crc long, ids binary")
    whole = found.where("ids is null").select("shard", "doc_id", "doc_first", "n_tokens", "crc")
    cut = found.where("ids is not null").groupBy("shard", "seq").agg(
        F.first("doc_id").alias("doc_id"), F.first("doc_first").alias("doc_first"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("parts")
    )
    cut = cut.select("shard", "doc_id", "doc_first", "n_tokens", F.expr("crc32(unhex(array_join(transform(parts, p -> hex(p.ids)), '')))").alias("crc"))
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # a row for each shard
    return whole.union(cut).join(before, "shard").select("doc_id", (F.col("before") + F.col("doc_first")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))
