"""Concatenate-and-cut packing of tokenised documents (operator 9).

Pass one encodes every document once, each followed by an end id, and writes
ids with their offset inside the partition.  The partitions' totals, one row
each, become base offsets by a prefix sum.  Pass two reads the written ids,
adds the base and cuts at every multiple of the sequence length; what lies in
one sequence is one boundary record.  No row is shuffled and no partition waits
for another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(part, at, doc_id, n, width, ids) of every document; ``at`` is the offset inside the partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(enc.width, "little")
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                ids = [(enc.encode(t) if t else b"") + end for t in some.column("text").to_pylist()]
                n = np.array([len(x) // enc.width for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), some.column("doc_id"), pa.array(n), pa.array(np.full(len(ids), enc.width, np.int32)), pa.array(ids, pa.binary())],
                    names=["part", "at", "doc_id", "n", "width", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "part int, at long, doc_id long, n long, width int, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Boundary records (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    docs: any table with doc_id and text; other columns are ignored.  A null
    or empty text is its end id alone; repeated rows and null ids are packed
    like others.  Every sequence holds ``length`` ids but the last.
    """
    ids = materialise(encode_documents(docs, tokenizer, end_id), "token_ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    # one row a partition of the input, so this window stays small
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, first, n, width, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "width", "ids"))):
                own = np.frombuffer(packed, f"<u{width}").astype("<u4")
                a = 0
                while a < n:
                    sequence, offset = divmod(first + a, length)
                    b = min(n, a + length - offset)
                    rows.append((doc, a, b - a, zlib.crc32(own[a:b]), n, sequence, offset))
                    a = b
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")])

    placed = ids.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("first"), "n", "width", "ids")
    return placed.mapInArrow(cut, PIECES)
