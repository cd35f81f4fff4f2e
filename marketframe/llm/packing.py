"""Sum-of-squares packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import id_text, in_batches, rows_of, written

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("copy", pa.int64())])
_PACKED = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "copy": "long", "sequence_id": "long", "offset": "long", "left": "long"}
#: Pieces that one task packs; groups are drawn by hash, so no key is hot.
GROUP_PIECES = 4096


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every whole text with its end id: doc_id, piece, start, length, ids_crc32, copy.

    Only documents longer than ``capacity`` are cut.  Null and empty texts are the end id alone.  Repeated ids stay separate rows;
    ``copy`` is a hash of the text that tells them apart.  Columns other than the two named are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from marketframe.llm.tokens import word_tokenizer

        encode, end = word_tokenizer(tokenizer).ids, np.array([end_id], "<u4")
        for doc, text, copy in rows_of(batches, "id", "text", "copy"):
            ids = np.concatenate([encode(text), end])
            for k in range(0, len(ids), capacity):
                part = ids[k : k + capacity]
                yield doc, k // capacity, k, len(part), zlib.crc32(part.tobytes()), copy

    rows = id_text(docs, id_col, text_col).withColumn("copy", F.xxhash64("text"))
    return rows.mapInArrow(lambda b: in_batches(cut(b), _PIECES, 4096), "doc_id long, piece int, start long, length long, ids_crc32 long, copy long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item in the order given, and what each bin has left.

    ``open_`` counts open bins by what they have left.  An item goes where the sum of the squared counts becomes smallest: into a bin
    with ``g`` left, which then has ``g - s`` left, or into a new bin.  Ties: the smallest ``g``.  Full bins are closed, not counted.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    left: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        # how the sum changes for a bin with g left, g from s on
        before = open_[s:]
        change = 2 * (open_[: capacity + 1 - s] - before + 1)
        change[0] = 1 - 2 * before[0]
        change[before == 0] = np.iinfo(np.int64).max
        g = int(change.argmin()) + s
        fresh = 2 * int(open_[capacity - s]) + 1 if s < capacity else 0
        if open_[g] and change[g - s] <= fresh:
            b = bins[g].pop()
            open_[g] -= 1
        else:
            b, g = len(left), capacity
            left.append(capacity)
        where[i], offset[i] = b, capacity - g
        left[b] = g - s
        if g > s:
            bins[g - s].append(b)
            open_[g - s] += 1
    return where, offset, np.array(left, np.int64)


def pack(rows: DataFrame, capacity: int, *, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece a sequence_id and a gapless offset.

    Pieces are dealt by a hash of their place in the written table into groups of about ``group_pieces``; each is packed by itself, longest first.  Sequences that are not
    full are then packed once more across groups, so a group's end wastes no space.  Any number of groups is packed at the same
    time, and none grows with the data.  An empty table gives no rows.
    """
    rows = written(rows, "pieces")

    def deal(part: DataFrame, seed: int) -> DataFrame:
        groups = max(1, -(-part.count() // group_pieces))
        return part.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).cast("long"))

    def packed(part: DataFrame, seed: int) -> DataFrame:
        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable")
            where, offset, left = sum_of_squares(group["length"].to_numpy(), capacity)
            return group.assign(sequence_id=(2 * group["pack_group"] + seed) * (1 << 32) + where, offset=offset, left=left[where])[list(_PACKED)]

        return deal(part, seed).groupBy("pack_group").applyInPandas(one, ", ".join(f"{name} {kind}" for name, kind in _PACKED.items()))

    once = written(packed(rows, 0), "packed")
    again = packed(once.where("left > 0").select(rows.columns), 1)
    return once.where("left = 0").union(again).drop("left", "copy")
