"""Exact deduplication through content-defined chunk recipes.

Each normalised text (white space ``[\\x20\\x09-\\x0D]`` deleted) is cut where a rolling hash
of its last ``WINDOW`` bytes hits a pattern, so equal passages are cut alike wherever they
stand. The distinct chunks are shuffled once, each with its digest; when no digest stands for
two different byte strings, the digests are verified identifiers, else the digests are widened
and verified anew. After that no text moves any more: a document is its recipe, the ordered
list of its chunks' identifiers, and texts are equal exactly when their recipes are.

Defined results: null and empty texts, and texts of white space only, are equal to each other
(the empty recipe); of equal texts the one with the most code points before normalisation
stays, then the smallest id; rows that repeat an id count as rows of their own, and a null id as the largest. An empty table
gives an empty table; extra columns are ignored. A text of any length is cut into chunks of at
most ``MOST`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textbatch import IS_SPACE, code_points, slices

WINDOW = 32
#: A chunk is at least and at most so many bytes (the last of a text may be shorter), 2 KB on average.
LEAST, MOST, MASK = 512, 8192, (1 << 10) - 1 + (1 << 20)


def squeeze(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets without white space."""
    keep = ~IS_SPACE[buf]
    upto = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(keep, out=upto[1:])
    return buf[keep], upto[off]


def rolling(buf: np.ndarray) -> np.ndarray:
    """At each byte a hash of the last WINDOW bytes, by doubling the span it covers."""
    h = buf.astype(np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    span, factor = 1, np.uint32(0x01000193)
    while span < WINDOW:
        g = h.copy()
        g[span:] += h[:-span] * factor
        h, span, factor = g, span * 2, factor * factor
    return h ^ (h >> np.uint32(16))


def cuts(buf: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks, as places in ``buf``."""
    with np.errstate(over="ignore"):
        marks = np.flatnonzero((rolling(buf) & np.uint32(MASK)) == 0) + 1 if len(buf) else np.zeros(0, np.int64)
    out = []
    for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        own = marks[np.searchsorted(marks, s + WINDOW) : np.searchsorted(marks, e, side="right")].tolist() if e - s > LEAST else []
        ends, at = [], s
        for m in [*own, e]:
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST or m == e and m > at:
                at = m
                ends.append(at)
        out.append(ends)
    return out


def name_of(chunk: bytes, width: int) -> bytes:
    """A chunk's identifier of ``width`` bytes, before it is verified."""
    return xxhash.xxh3_128_digest(chunk)[:width] if width <= 16 else hashlib.blake2b(chunk, digest_size=width).digest()


def chunks(docs: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """(name, chunk) of the chunks of all texts; within a stretch of rows each one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, off in slices(b.column(0)):
                buf, off = squeeze(buf, off)
                raw, seen = buf.tobytes(), set()
                for (s, _), ends in zip(zip(off[:-1].tolist(), off[1:].tolist(), strict=True), cuts(buf, off), strict=True):
                    for e in ends:
                        seen.add(raw[s:e])
                        s = e
                rows = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([name_of(x, width) for x in rows], pa.binary()), pa.array(rows, pa.binary())], names=["name", "chunk"])

    return docs.select(text_col).mapInArrow(run, "name binary, chunk binary")


def verified_width(docs: DataFrame, text_col: str = "text", width: int = 16) -> int:
    """The least width from ``width`` on at which every name stands for one chunk.

    The distinct chunks are shuffled by their names and bytes (with a partial distinct before
    it, so a passage that a third of the rows share travels once for each task); what is counted
    after that are names alone.
    """
    while True:
        distinct = chunks(docs, width, text_col).distinct()
        if not distinct.groupBy("name").count().where("count > 1").limit(1).count():
            return width
        if width >= 64:
            raise ValueError("chunk names of 64 bytes collide")
        width = min(64, 2 * width)


def recipes(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, code points of the original, SHA-256 of the normalised text, recipe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, buf, off in slices(b.column(1)):
                n = code_points(buf, off)
                buf, off = squeeze(buf, off)
                raw, sha, recipe = buf.tobytes(), [], []
                for s, e, ends in zip(off[:-1].tolist(), off[1:].tolist(), cuts(buf, off), strict=True):
                    sha.append(hashlib.sha256(raw[s:e]).hexdigest())
                    names = []
                    for x in ends:
                        names.append(name_of(raw[s:x], width))
                        s = x
                    recipe.append(b"".join(names))
                ids = b.column(0).slice(first, last - first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())], names=["doc_id", "n_chars", "text_sha256", "recipe"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, text_sha256 string, recipe binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 16) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    The keeper and size of a repeated recipe come from a partial aggregate, so a recipe that a
    third of the rows share is one row for each task. They are written, and joined back from
    there, so that both sides of the join are plain shuffles whose hot side adaptive execution
    may split; recipes that occur once aren't in that table.
    """
    width = verified_width(docs, text_col, width)
    rows = written(recipes(docs, width, id_col, text_col), "recipes")
    best = rows.groupBy("recipe").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("back"))).alias("best"), F.count("*").alias("size"))
    best = written(best.where("size > 1").select("recipe", (-F.col("best.back")).alias("keeper"), "size"), "keepers")
    out = rows.join(best, "recipe", "left").withColumn("keep_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keeper")))
    return out.select("doc_id", "keep_id", F.coalesce("size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chars")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; of rows that repeat id and text one stays."""
    groups = written(exact_groups(docs, id_col, text_col), "groups")
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha"))
    if groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        docs = docs.dropDuplicates([id_col, text_col])
    if groups.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # an id with several texts: only the rows of the text that goes
        sha = F.sha2(F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), r"[\x20\x09-\x0D]", ""), 256)
        return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (sha == gone["_sha"]), "left_anti")
    return docs.join(gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
