"""Substring deduplication through super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Consecutive windows that share a
minimiser (the least hash among their runs of ``MINIMISER`` words) travel together as one
packed string, a super-k-mer, to the bucket of that minimiser; equal windows have equal
minimisers and so meet there. In a bucket the windows are sorted and windows of equal
bytes grouped; the smallest document id owns the window, and every other
document's copy of it is to be removed.

Before anything is shuffled, the windows of one stretch of input rows are settled among
themselves: only copies in the stretch's smallest document travel on. A passage that a third of
all documents share thus travels once for each stretch, whatever the number of its copies.

A run of words that is frequent in the corpus would draw all windows around its occurrences into one
bucket. Frequent runs, counted in a sample whose share is set by the measured size, therefore come
last in the minimiser's order: a window is dealt by a rarer run wherever it has one. The list (at most
``MOST_HOT`` hashes) is the same for all tasks, so equal windows still meet; it decides where
windows meet and never what is removed.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; texts of fewer than ``k``
words have no window and stay whole; repeated windows within one document don't count
against each other, nor do those of rows that repeat an id; rows without an id have no place in
the order and are left out; empty and null texts give a row without words; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import parts_for, text_bytes, written
from .textbatch import gram_hashes, mix, slices, word_hashes, words

K = 13
MINIMISER = 4
#: Bytes of text for each bucket, and of text that is settled together.
BUCKET_BYTES, STRETCH = 5 << 20, 4 << 20
#: Frequent runs are looked for in so many bytes of text at least, or in this share of a larger corpus;
#: a run is frequent if it draws more than this share of a bucket's windows, and counted that often.
SAMPLE_BYTES, SAMPLE_SHARE, HOT_OF_BUCKET, HOT_COUNT, MOST_HOT = 48 << 20, 256, 8, 16, 1 << 18
HOT_BITS = 22
SHUFFLED = "bucket long, id long, mark long, ranges binary, packed binary"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
NAMES = ["bucket", "id", "mark", "ranges", "packed"]


def pack(ids: np.ndarray, marks: np.ndarray, firsts: np.ndarray, pieces: list[bytes]) -> bytes:
    """Super-k-mers with their rows' ids and marks and their first words' places: byte planes, then the strings."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (ids, marks, firsts)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([len(ids).to_bytes(8, "little"), *planes, b"\n".join(pieces)]))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind, width in (("<i8", 8), ("<i8", 8), ("<i4", 4)):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return *out, raw[at:]


def plain(buf: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with one blank after each word, and their offsets."""
    raw, out, at = buf.tobytes(), [], [0]
    for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        found = raw[s:e].split()
        if found:
            out.append(b" ".join(found) + b" ")
            at.append(at[-1] + len(out[-1]))
        else:
            at.append(at[-1])
    return b"".join(out), np.array(at)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, span = x, 1
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    if span < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - span :])
    return out


def owners(raw: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, h: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """For the windows at words ``at`` with hashes ``h``: the least ``doc`` with equal bytes.

    Sorting by hash brings equal windows together; a window whose hash occurs with one ``doc``
    only is its own; the others are compared byte by byte.
    """
    least = doc.copy()
    if not len(at):
        return least
    order = np.lexsort((doc, h))
    s = h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    first = doc[order][np.flatnonzero(new)]
    last = doc[order][np.append(np.flatnonzero(new)[1:], len(s)) - 1]
    shared = order[(first != last)[group]]
    seen: dict[bytes, int] = {}
    spots = []
    for i, w, d in zip(shared.tolist(), at[shared].tolist(), doc[shared].tolist(), strict=True):
        window = raw[starts[w] : ends[w + k - 1]]
        got = seen.get(window)
        if got is None or d < got:
            seen[window] = d
        spots.append((i, window))
    for i, window in spots:
        least[i] = seen[window]
    return least


def spans(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs in which the first column counts up by one and the others stay equal."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = columns[0][1:] != columns[0][:-1] + 1
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], len(new))[: len(begin)] - 1


class Order:
    """The minimiser's order of runs of words, by their hashes: frequent ones last."""

    def __init__(self, hot: np.ndarray):
        self.hot = np.unique(hot.astype(np.uint64))
        self.maybe = np.zeros(1 << HOT_BITS, dtype=bool)
        self.maybe[self.hot >> np.uint64(64 - HOT_BITS)] = True

    def of(self, grams: np.ndarray) -> np.ndarray:
        place = grams >> np.uint64(1)
        if len(self.hot):
            at = np.flatnonzero(self.maybe[grams >> np.uint64(64 - HOT_BITS)])
            found = np.minimum(np.searchsorted(self.hot, grams[at]), len(self.hot) - 1)
            place[at[self.hot[found] == grams[at]]] |= np.uint64(1 << 63)
        return place


def frequent_runs(docs: DataFrame, size: int, buckets: int, k: int = K, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Hashes of the runs of ``MINIMISER`` words that would draw too much into one bucket, at most ``MOST_HOT``."""
    wanted = max(sample_bytes, size // SAMPLE_SHARE)
    own = docs.select(id_col, text_col)
    if wanted < size:
        own = own.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(wanted / size * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, off in slices(b.column(1), STRETCH):
                starts, ends, cut = words(buf, off)
                grams = gram_hashes(word_hashes(buf, starts, ends), MINIMISER)
                each, n = np.unique(grams, return_counts=True)
                several = n > 1
                hashes, counts = np.append(each[several].astype(np.int64), 0), np.append(n[several], 0)
                total = np.zeros(len(counts), dtype=np.int64)
                total[-1] = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts.astype(np.int64)), pa.array(total)], names=["run", "n", "total"])

    seen = own.mapInArrow(run, "run long, n long, total long")
    seen = written(seen.groupBy("run").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "runs")
    total = seen.agg(F.sum("total")).first()[0] or 0
    least = max(HOT_COUNT, total // ((k - MINIMISER + 1) * HOT_OF_BUCKET * buckets))
    hot = seen.where(F.col("n") >= least).orderBy(F.desc("n"), "run").limit(MOST_HOT).select("run").toArrow()
    return hot.column("run").to_numpy().astype(np.int64).view(np.uint64)


def stretch_rows(ids: np.ndarray, marks: np.ndarray, buf: np.ndarray, off: np.ndarray, k: int, buckets: int, order: Order) -> Iterator[tuple]:
    """What one stretch of rows sends: packed super-k-mers, and the ranges settled among its own rows."""
    raw, off = plain(buf, off)
    buf = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, cut = words(buf, off)
    row = np.repeat(np.arange(len(ids)), np.diff(cut))
    h = word_hashes(buf, starts, ends)
    if len(h) < k:
        return
    valid = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
    grams = gram_hashes(h, MINIMISER)
    least = sliding_min(order.of(grams), k - MINIMISER + 1)[valid]
    whole = gram_hashes(h, k)[valid]
    doc = ids[row[valid]]
    own = owners(raw, starts, ends, valid, whole, doc, k)
    gone = own != doc
    lost, lost_row = valid[gone], row[valid[gone]]
    begin, finish = spans(lost, lost_row)
    where: dict[int, list[int]] = {}
    for r, x, y in zip(lost_row[begin].tolist(), lost[begin].tolist(), lost[finish].tolist(), strict=True):
        where.setdefault(r, []).extend((x - int(cut[r]), y - int(cut[r]) + k))
    for r, ranges in where.items():
        yield (int(ids[r] % buckets), int(ids[r]), int(marks[r]), np.array(ranges, np.int32).tobytes(), None)
    sent, key = valid[~gone], least[~gone]
    begin, finish = spans(sent, row[sent], key)
    bucket = (mix(key[begin]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    begin, finish, bucket = sent[begin[by]], sent[finish[by]], bucket[by]
    pieces = [raw[s:e] for s, e in zip(starts[begin].tolist(), ends[finish + k - 1].tolist(), strict=True)]
    r = row[begin]
    id_of, mark_of, first = ids[r], marks[r], (begin - cut[r]).astype(np.int32)
    edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else []
    for x, y in zip(edge, edge[1:], strict=False):
        yield (int(bucket[x]), None, None, None, pack(id_of[x:y], mark_of[x:y], first[x:y], pieces[x:y]))


def settle(key: tuple, table: pa.Table, k: int) -> pa.Table:
    """One bucket: (id, mark, first, last), one row for each run of words to be removed."""
    out: list[list[np.ndarray]] = [[], [], [], []]

    def add(*columns: np.ndarray) -> None:
        for c, x in zip(out, columns, strict=True):
            c.append(x)

    for i, m, r in zip(*(table.column(c).to_pylist() for c in NAMES[1:4]), strict=True):
        if r is not None:
            pairs = np.frombuffer(r, np.int32).astype(np.int64)
            add(np.full(len(pairs) // 2, i), np.full(len(pairs) // 2, m), pairs[0::2], pairs[1::2])
    got = [unpack(x) for x in table.column("packed").to_pylist() if x is not None]
    if got:
        ids, marks, firsts, data = (list(x) for x in zip(*got, strict=True))
        del got
        ids, marks, firsts = np.concatenate(ids), np.concatenate(marks), np.concatenate(firsts).astype(np.int64)
        raw = b"\n".join(data)
        del data
        buf = np.frombuffer(raw, dtype=np.uint8)
        breaks = np.flatnonzero(buf == 0x0A) + 1
        off = np.concatenate(([0], breaks, [len(buf)]))
        starts, ends, cut = words(buf, off)
        row = np.repeat(np.arange(len(ids)), np.diff(cut))
        whole = gram_hashes(word_hashes(buf, starts, ends), k)
        valid = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
        doc = ids[row[valid]]
        gone = owners(raw, starts, ends, valid, whole[valid], doc, k) != doc
        lost, lost_row = valid[gone], row[valid[gone]]
        begin, finish = spans(lost, lost_row)
        r = lost_row[begin]
        add(ids[r], marks[r], lost[begin] + firsts[r] - cut[r], lost[finish] + firsts[r] - cut[r] + k)
    columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "mark", "first", "last"])


def marked(docs: DataFrame, unique: bool, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark) of the rows with an id; the mark tells rows of one id apart, where ids repeat."""
    mark = F.lit(0).cast("long") if unique else F.xxhash64(text_col)
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), mark.alias("mark"))


def repeated_ranges(docs: DataFrame, k: int = K, buckets: int | None = None, hot: np.ndarray | None = None) -> DataFrame:
    """(id, mark, found): for each row of (id, text, mark) with something to remove, structs of first word and last word + 1."""
    if buckets is None:
        size = text_bytes(docs, "text")
        buckets = parts_for(size, BUCKET_BYTES)
        hot = frequent_runs(docs, size, buckets, k, "id")
    hot = np.zeros(0, np.uint64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(hot)
        for b in batches:
            ids, marks = (b.column(c).to_numpy() for c in (0, 2))
            for first, last, buf, off in slices(b.column(1), STRETCH):
                rows = list(stretch_rows(ids[first:last], marks[first:last], buf, off, k, buckets, order))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, KINDS, strict=True)], names=NAMES)

    sent = docs.mapInArrow(run, SHUFFLED)
    settled = sent.groupBy("bucket").applyInArrow(lambda key, table: settle(key, table, k), "id long, mark long, first long, last long")
    return settled.groupBy("id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("found"))


def without_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row; with ``keep_text`` the kept text too.

    The ranges are joined to the texts by a hash join whose build side is the ranges, so the
    texts are shuffled once and neither sorted nor spilled.
    """
    unique = not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count()
    own = marked(docs, unique, id_col, text_col)
    found = repeated_ranges(own, k, buckets).withColumnsRenamed({"id": "_id", "mark": "_mark"})
    same = F.col("id") == F.col("_id")
    joined = own.join(found.hint("shuffle_hash"), same if unique else same & (F.col("mark") == F.col("_mark")), "left").select(F.col("id").alias("doc_id"), "text", "found")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, known = b.column(0).to_pylist(), b.column(2).is_valid()
            flat_found = b.column(2).flatten()
            at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False))))
            firsts, lasts = (flat_found.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            rows = []
            for first, last, buf, off in slices(b.column(1)):
                raw = buf.tobytes()
                for r, s, e in zip(range(first, last), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    each = raw[s:e].split()
                    lost = np.zeros(len(each) + 1, dtype=np.int64)
                    if known[r].as_py():
                        np.add.at(lost, firsts[at[r] : at[r + 1]], 1)
                        np.add.at(lost, lasts[at[r] : at[r + 1]], -1)
                    keep = np.cumsum(lost[:-1]) == 0
                    kept = each if keep.all() else [w for w, own in zip(each, keep.tolist(), strict=True) if own]
                    out = b" ".join(kept)
                    rows.append((ids[r], len(each), len(each) - len(kept), hashlib.sha256(out).hexdigest(), *[out.decode()] * keep_text))
            cols = list(zip(*rows, strict=True)) or [()] * (4 + keep_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[i]) for i, c in enumerate(cols)], names=names[: len(cols)])

    return joined.mapInArrow(run, schema)
