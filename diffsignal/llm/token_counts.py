"""Token counts of whole texts by overlap resynchronisation (operator 4).

A text longer than a chunk is encoded in overlapping chunks with word offsets.
Two neighbours are spliced at a word boundary that both report at the same
offset, where the words around it agree in offset and token count and an ASCII
space between letters or digits separates them, so neither the pattern nor the
normaliser can join what it parts.  If an overlap holds no such boundary it is
doubled, at last up to the rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SAFE_CUT, Encoder, encoder


def splice(left: tuple[list[int], list[int]], right: tuple[list[int], list[int]], text: str, around: int) -> int | None:
    """The first common boundary of two encodings (absolute word offsets, token counts), or None."""
    at = {s: i for i, s in enumerate(left[0])}
    for j in range(around, len(right[0]) - around):
        i = at.get(right[0][j])
        if i is None or i < around or i + around > len(left[0]):
            continue
        p = right[0][j]
        stable = SAFE_CUT.match(text, p) or p and SAFE_CUT.match(text, p - 1)
        if stable and left[0][i - around : i + around] == right[0][j - around : j + around] and left[1][i - around : i + around - 1] == right[1][j - around : j + around - 1]:
            return p
    return None


def count_tokens(enc: Encoder, text: str, chunk: int, overlap: int, around: int = 4) -> int:
    """Tokens of ``text``; chunk and overlap in characters."""
    if len(text) <= chunk:
        return len(enc.encode(text)) // enc.width

    def encode(a: int, b: int) -> tuple[list[int], list[int]]:
        starts, counts = enc.spans(text[a:b])
        return [a + s for s in starts], counts

    total, a, b = 0, 0, chunk
    cut, left = 0, encode(0, chunk)
    while b < len(text):
        wide = overlap
        while True:
            a = max(cut, b - wide)
            end = min(len(text), a + max(chunk, 2 * wide))
            right = encode(a, end)
            p = splice(left, right, text, around)
            if p is not None or end == len(text) and a == cut:
                break
            wide *= 2
            if a == cut:  # the whole left chunk overlaps: take it and what follows anew
                b, left = end, right
        if p is None:
            left, b = right, end
            continue
        total += sum(n for s, n in zip(*left) if cut <= s < p)
        cut, left, b = p, right, end
    return total + sum(n for s, n in zip(*left) if s >= cut)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = 1 << 15, overlap: int = 1 << 9) -> DataFrame:
    """Per document (doc_id, n_bytes, n_tokens, over_limit).

    docs: any table with doc_id and text; other columns are ignored, repeated
    rows counted each.  A null or empty text has 0 bytes and 0 tokens.
    tokenizer: path of a ``tokenizers`` file, the same on every executor; no
    begin, end or added special tokens, strings of special tokens inside texts
    as the library's default handles them.  over_limit: more than ``limit``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n = pa.array([count_tokens(enc, t, chunk, overlap) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
