"""N-gram Jaccard join through prefix trees, giving each document its class.

1. A document is the set of its distinct shingles of ``n_words`` words, as 64-bit hashes. Where two
   shingles of a document have one hash, their words are compared byte by byte, so set sizes are
   exact. Documents with equal sets (the hashes' digest and the sum of second hashes) are one from here on.
2. Shingles are counted over the whole corpus in hash buckets, where they arrive as packed,
   compressed columns. A shingle that only one set has can't be in any overlap, so what
   travels back to the documents are the repeated ones with their counts.
   A shingle that is frequent within one stretch of rows is known to be repeated: only a marker
   travels to its bucket, and it comes last in the global order for everyone.
3. The global order of shingles is by count (hot ones last), then hash. Two sets that link share a shingle in
   the first ``n - ceil(percent n / 100) + 1`` of that order (their prefixes); a set whose prefix is all
   unique shingles links with nothing and is out. Sets that share prefix shingles,
   directly or in a chain, form a family, so no link leaves a family.
4. Each family's sets are stored in a path-compressed trie, most frequent shingle first. One set
   after the other walks it, sharing the partial overlap of a common path; a subtree is pruned
   when the remaining lengths can't reach the needed overlap, when its sizes don't fit, or when
   all its sets are in the walker's class already, so a family of near copies costs one walk.
5. A family beyond ``block_tokens`` (a share of all candidates' shingles, at most ``BLOCK_TOKENS``) is
   split into blocks; the blocks' classes are merged through joins of one representative each, and
   the pairs that may still be missing (prefix shingles whose sets, of neighbouring sizes, are in several
   classes) are joined shingle by shingle: pieces of the largest class with blocks of the others, and
   these in pairs of blocks.
6. The links that made the classes, one less than a class has sets, are verified on the texts
   themselves. Shared hashes never hide a link once sizes are exact, they could only add one: should
   a size or a link not hold, all is done again with other hashes.

Defined results: null and empty texts have no shingles and link with nothing; texts of fewer
than ``n_words`` words are one shingle, the whole sequence; rows that repeat an id are one document to
the links, which have the texts of all its rows; rows without an id are left out; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import parts_for, written
from .textbatch import LOWER, gram_hashes, mix, same_bytes, slices, word_hashes, words

#: Defaults, those of op4: words of a shingle, and sets link when PART * overlap >= OF * union.
N = 4
PART, OF = 100, 85
#: Shingles for each bucket of the counting; bytes and rows of text that are worked off together.
BUCKET_TOKENS, STRETCH, STRETCH_ROWS = 700_000, 4 << 20, 30_000
#: A block of a family has at most so many shingles, and at most this share of all, but so many at least.
BLOCK_TOKENS, BLOCK_SHARE, LEAST_BLOCK = 4_000_000, 24, 16_000
#: Sets in a block of the last step, and those in a piece of the class that has the most.
PAIR_ROWS, PIECE_ROWS = 512, 256
#: A shingle of so many sets in one stretch is hot: its postings skip the counting (see ``postings``).
HOT, MOST = 16, 2**31 - 1


@dataclass(frozen=True)
class Hashing:
    """How shingles become tokens: words in a shingle, and the hash's seed and width."""

    n_words: int = N
    seed: int = 0
    bits: int = 64

    def tokens(self, h: np.ndarray, n: int) -> np.ndarray:
        out = gram_hashes(h, n)
        if n < self.n_words:
            out = mix(out + np.uint64(n))
        return out >> np.uint64(64 - self.bits)


def shingles(buf: np.ndarray, off: np.ndarray, how: Hashing) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles as (token, place of the first word, number of words) by row, the rows' cuts, and the words' starts, ends and bytes."""
    buf = LOWER[buf]
    starts, ends, cut = words(buf, off)
    h = word_hashes(buf, starts, ends, how.seed)
    count, n = np.diff(cut), how.n_words
    row = np.repeat(np.arange(len(off) - 1), count)
    token = np.zeros(len(h), dtype=np.uint64)
    token[: max(0, len(h) - n + 1)] = how.tokens(h, n)
    size = np.minimum(count, n)[row]
    first = np.arange(len(h)) <= (cut[1:] - np.minimum(count, n))[row]  # short rows: the first word stands for the whole
    for k in range(1, n):
        short = cut[:-1][count == k]
        if len(short):
            token[short] = how.tokens(h, k)[short]
    place = np.flatnonzero(first)
    return token[place], place, size[place], np.searchsorted(place, cut), starts, ends, buf


def shingle_sets(buf: np.ndarray, off: np.ndarray, how: Hashing = Hashing()) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """(row, token) of all distinct shingles, by row and token."""
    token, _, _, cut, *_ = shingles(buf, off, how)
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        token[s:e].sort()
    row = np.repeat(np.arange(len(off) - 1), np.diff(cut))
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return row[new], token[new]


def verified_sets(buf: np.ndarray, off: np.ndarray, how: Hashing = Hashing()) -> tuple[np.ndarray, list[bytes], np.ndarray]:  # noqa: B008
    """Of each row the number of distinct shingles, the set's digest, and whether two shingles share a token."""
    token, place, size, cut, starts, ends, buf = shingles(buf, off, how)
    order = np.arange(len(token))
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if e - s > 1:
            order[s:e] = s + np.argsort(token[s:e], kind="stable")
    token, place, size = token[order], place[order], size[order]
    row = np.repeat(np.arange(len(off) - 1), np.diff(cut))
    again = np.flatnonzero((token[1:] == token[:-1]) & (row[1:] == row[:-1]))
    same, lens = np.ones(len(again), dtype=bool), ends - starts
    for k in range(how.n_words):
        on = np.flatnonzero(same & (size[again] > k))
        a, b = place[again[on]] + k, place[again[on] + 1] + k
        equal = lens[a] == lens[b]
        equal[equal] = same_bytes(buf, starts[a[equal]], starts[b[equal]], lens[a[equal]])
        same[on[~equal]] = False
    collides = np.zeros(len(off) - 1, dtype=bool)
    collides[row[again[~same]]] = True
    new = np.ones(len(token), dtype=bool)
    new[again + 1] = False
    token, row, place = token[new], row[new], place[new]
    h, n = word_hashes(buf, starts, ends, how.seed + 1), how.n_words
    second = np.zeros(len(h), dtype=np.uint64)
    second[: max(0, len(h) - n + 1)] = gram_hashes(h, n)
    size = size[new]
    for k in range(1, n):
        short = place[size == k]
        if len(short):
            second[short] = gram_hashes(h, k)[short] + np.uint64(k)
    upto = np.zeros(len(token) + 1, dtype=np.uint64)
    np.cumsum(mix(second[place]), out=upto[1:])
    cut = np.searchsorted(row, np.arange(len(off)))
    raw, sums = token.tobytes(), (upto[cut[1:]] - upto[cut[:-1]]).tobytes()
    digests = [xxhash.xxh3_128_digest(raw[8 * s : 8 * e]) + sums[8 * k : 8 * k + 8] for k, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))]
    return np.diff(cut), digests, collides


def stretches(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of stretches of a batch (id, text)."""
    b = b.filter(b.column(0).is_valid())
    ids = b.column(0).cast(pa.int64()).to_numpy()
    for at in range(0, b.num_rows, STRETCH_ROWS):
        part = b.slice(at, STRETCH_ROWS)
        for first, last, buf, off in slices(part.column(1), STRETCH):
            yield ids[at + first : at + last], buf, off


def pack(tokens: np.ndarray) -> bytes:
    """Ascending numbers: differences by byte planes, compressed."""
    d = np.diff(tokens, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unpress(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def edges_of(sorted_keys: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(np.diff(sorted_keys)) + 1).tolist(), len(sorted_keys)] if len(sorted_keys) else [0]


def sizes(docs: DataFrame, how: Hashing = Hashing()) -> DataFrame:  # noqa: B008
    """(doc_id, n, digest, collides) of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, buf, off in stretches(b):
                n, digests, collides = verified_sets(buf, off, how)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(collides)], names=["doc_id", "n", "digest", "collides"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, collides boolean")


def postings(docs: DataFrame, buckets: int, how: Hashing = Hashing()) -> DataFrame:  # noqa: B008
    """Packed (token, document) columns by token bucket; of equal sets in a stretch the least id's.

    Kinds of rows: 0 postings to be counted; 1 markers, the hot tokens of a stretch; 2 a stretch's
    postings of its hot tokens, dealt by document, which nobody has to count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, buf, off in stretches(b):
                row, token = shingle_sets(buf, off, how)
                cut, raw = np.searchsorted(row, np.arange(len(ids) + 1)).tolist(), token.tobytes()
                digests = [xxhash.xxh3_128_digest(raw[8 * s : 8 * e]) for s, e in zip(cut, cut[1:], strict=False)]
                first: dict[bytes, int] = {}
                for r in np.argsort(ids, kind="stable").tolist():
                    first.setdefault(digests[r], r)
                keep = np.zeros(len(ids), dtype=bool)
                keep[list(first.values())] = True
                row, token = row[keep[row]], token[keep[row]]
                each, place, count = np.unique(token, return_inverse=True, return_counts=True)
                hot = count >= HOT
                cols: list[list] = [[], [], [], [], []]

                def add(kind: int, bucket: np.ndarray, token: np.ndarray, row: np.ndarray | None, cols: list[list] = cols, ids: np.ndarray = ids) -> None:
                    order = np.lexsort((token, bucket))
                    bucket, token = bucket[order], token[order]
                    row = None if row is None else row[order]
                    for x, y in zip(cut := edges_of(bucket), cut[1:], strict=False):
                        own, at = (None, None) if row is None else np.unique(row[x:y], return_inverse=True)
                        packed = (None, None) if row is None else (press(at.astype(np.uint16)), press(ids[own]))
                        for c, v in zip(cols, (int(bucket[x]), kind, pack(token[x:y]), *packed), strict=True):
                            c.append(v)

                cold, warm = ~hot[place], hot[place]
                add(0, token[cold] % np.uint64(buckets), token[cold], row[cold])
                add(1, each[hot] % np.uint64(buckets), each[hot], None)
                add(2, ids[row[warm]] % buckets, token[warm], row[warm])
                if cols[0]:
                    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "kind", "tokens", "places", "ids"])

    return docs.mapInArrow(run, "bucket long, kind int, tokens binary, places binary, ids binary")


def repeated(posted: DataFrame, homes: int) -> DataFrame:
    """Packed (document, token, count) columns of the tokens that several documents have, by the document's home."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        none, nobody = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hot, sides = [none], {0: ([none], [nobody]), 2: ([none], [nobody])}
        for kind, a, b, c in zip(*(t.column(k).to_pylist() for k in ("kind", "tokens", "places", "ids")), strict=True):
            if kind == 1:
                hot.append(unpack(a))
            else:
                sides[kind][0].append(unpack(a))
                sides[kind][1].append(unpress(c, "<i8")[unpress(b, "<u2")])
        token, doc = (np.concatenate(x) for x in sides[0])
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        token, doc = token[new], doc[new]
        cut = np.array(edges_of(token))
        count = np.where(np.isin(token, np.concatenate(hot)), MOST, np.repeat(np.diff(cut), np.diff(cut)))
        token, doc, count = token[count > 1], doc[count > 1], count[count > 1]
        more_tokens, more_docs = (np.concatenate(x) for x in sides[2])
        token, doc, count = np.concatenate((token, more_tokens)), np.concatenate((doc, more_docs)), np.concatenate((count, np.full(len(more_tokens), MOST)))
        home = doc % homes
        order = np.lexsort((token, doc, home))
        token, doc, count, home = token[order], doc[order], count[order], home[order]
        cols: list[list] = [[], [], [], []]
        for x, y in zip(edges := edges_of(home), edges[1:], strict=False):
            for c, v in zip(cols, (int(home[x]), press(doc[x:y]), press(token[x:y]), press(np.minimum(count[x:y], MOST).astype(np.int32))), strict=True):
                c.append(v)
        return pa.table([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["home", "docs", "tokens", "counts"])

    return posted.groupBy("bucket").applyInArrow(run, "home long, docs binary, tokens binary, counts binary")


def candidates(pieces: DataFrame, sets: DataFrame, homes: int, percent: int = OF) -> DataFrame:
    """(doc, n, tokens, prefix): the sets that may link, with repeated tokens in the global order.

    ``sets`` has (doc, n) of one document for each distinct set.
    """
    need = lambda n: -(-percent * n // PART)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            size = dict(zip(right.column("doc").to_pylist(), right.column("n").to_pylist(), strict=True))
            doc, token, count = (np.concatenate([unpress(x, kind) for x in left.column(c).to_pylist()]) for c, kind in (("docs", "<i8"), ("tokens", "<u8"), ("counts", "<i4")))
            order = np.lexsort((token, count, doc))
            doc, token = doc[order], token[order]
            for x, y in zip(edges := edges_of(doc), edges[1:], strict=False):
                n = size.get(int(doc[x]))
                if n is not None and y - x >= need(n):
                    prefix = n - need(n) + 1 - (n - (y - x))
                    for c, v in zip(out, (int(doc[x]), n, token[x:y].tobytes(), prefix), strict=True):
                        c.append(v)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32())], names=["doc", "n", "tokens", "prefix"])

    own = sets.select("doc", "n", F.pmod("doc", F.lit(homes)).alias("home"))
    return pieces.groupBy("home").cogroup(own.groupBy("home")).applyInArrow(run, "doc long, n long, tokens binary, prefix int")


class Trie:
    """A path-compressed trie of ascending token lists, with the bounds that walks prune by."""

    def __init__(self, lists: list[np.ndarray], sizes: np.ndarray, percent: int = OF):
        keys = [x.astype(">u4").tobytes() for x in lists]
        self.order = sorted(range(len(lists)), key=keys.__getitem__)
        self.lists, self.sizes, self.percent = lists, sizes, percent
        self.parent = list(range(len(lists)))
        self.links: list[tuple[int, int]] = []
        self.place = {d: k for k, d in enumerate(self.order)}
        common = [0] * len(lists)
        for k in range(1, len(self.order)):
            a, b = lists[self.order[k - 1]], lists[self.order[k]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[k] = int(differ[0]) if len(differ) else m
        self.nodes: list[list] = []
        self.roots = self.build(common)

    # a node: [tokens of its edge, depth at its end, children, document or -1, first place, last place, least size, largest size, longest list, one class]
    def build(self, common: list[int]) -> list[int]:
        """Inserts the lists in order, keeping the path to the last one on a stack."""
        roots: list[int] = []
        stack: list[int] = []

        def finish(node: int) -> None:
            own = self.nodes[node]
            for c in own[2]:
                child = self.nodes[c]
                own[5], own[6], own[7], own[8] = max(own[5], child[5]), min(own[6], child[6]), max(own[7], child[7]), max(own[8], child[8])

        def new(tokens: np.ndarray, depth: int, doc: int, at: int, n: int, longest: int) -> int:
            self.nodes.append([tokens, depth, [], doc, at, at, n, n, longest, False])
            return len(self.nodes) - 1

        for at, d in enumerate(self.order):
            own, n = self.lists[d], int(self.sizes[d])
            keep = common[at] if at else 0
            last = -1
            while stack and self.nodes[stack[-1]][1] - len(self.nodes[stack[-1]][0]) >= keep and (self.nodes[stack[-1]][1] > keep):
                last = stack.pop()
                finish(last)
            if stack and self.nodes[stack[-1]][1] > keep:  # the path branches within an edge
                low = stack.pop()
                finish(low)
                node = self.nodes[low]
                start = node[1] - len(node[0])
                top = new(node[0][: keep - start], keep, -1, node[4], node[6], 0)
                self.nodes[top][6], self.nodes[top][7] = 2**62, 0
                node[0] = node[0][keep - start :]
                siblings = self.nodes[stack[-1]][2] if stack else roots
                siblings[siblings.index(low)] = top
                self.nodes[top][2].append(low)
                stack.append(top)
            leaf = new(own[keep:], len(own), d, at, n, len(own))
            (self.nodes[stack[-1]][2] if stack else roots).append(leaf)
            stack.append(leaf)
        while stack:
            finish(stack.pop())
        return roots

    def find(self, d: int) -> int:
        while self.parent[d] != d:
            self.parent[d] = self.parent[self.parent[d]]
            d = self.parent[d]
        return d

    def join(self, known: list[int] | None = None) -> list[int]:
        """The class of each set: the least place in the input that it is linked to, directly or through others.

        ``known`` are classes that hold already.
        """
        for d, k in enumerate(known or []):
            self.unite(d, k)
        mask = np.zeros(1 + max((int(x[-1]) for x in self.lists if len(x)), default=0), dtype=bool)
        for q in self.order:
            own = self.lists[q]
            mask[own] = True
            self.walk(q, own, int(self.sizes[q]), mask)
            mask[own] = False
        return [self.find(d) for d in range(len(self.lists))]

    def unite(self, a: int, b: int) -> bool:
        """Makes two classes one; whether they were two."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def settled(self, node: list) -> int:
        """The class of all documents below, or -1; remembered once it holds."""
        if node[9]:
            return self.find(node[3] if node[3] >= 0 else self.order[node[5]])
        got = self.find(node[3]) if node[3] >= 0 else None
        for c in node[2]:
            child = self.nodes[c]
            k = self.find(child[3] if child[3] >= 0 else self.order[child[5]]) if child[9] else (self.find(child[3]) if not child[2] else -1)
            if k < 0 or got is not None and k != got:
                return -1
            got = k
        node[9] = True
        return got

    def walk(self, q: int, own: np.ndarray, n: int, mask: np.ndarray) -> None:
        """Unites ``q`` with every linked set that comes after it in the trie's order."""
        percent = self.percent
        at, stack = self.place[q], [(r, 0, False) for r in reversed(self.roots)]
        while stack:
            k, overlap, done = stack.pop()
            node = self.nodes[k]
            if done:
                self.settled(node)
                continue
            tokens, depth, children, doc, _, last, least, largest, longest, _ = node
            if last <= at or PART * largest < percent * n or PART * n < percent * least:
                continue
            if self.settled(node) == self.find(q):
                continue
            rest = len(own)
            if len(tokens):
                overlap += int(np.count_nonzero(mask[tokens]))
                rest -= int(np.searchsorted(own, tokens[-1], side="right"))
            if (PART + percent) * (overlap + min(rest, max(longest, depth) - depth)) < percent * (n + least):
                continue
            if doc >= 0 and self.place[doc] > at and (PART + percent) * overlap >= percent * (n + int(self.sizes[doc])):
                if self.unite(q, doc):
                    self.links.append((q, doc))
            if children:
                stack.append((k, 0, True))
                stack += [(c, overlap, False) for c in reversed(children)]


def classes(docs: list[int], n: np.ndarray, tokens: list[np.ndarray], known: list[int] | None = None, percent: int = OF) -> tuple[list[int], list[tuple[int, int]]]:
    """For each of some sets the document of least id in its class, by a trie of them all; and the links that made the classes."""
    order = sorted(range(len(docs)), key=docs.__getitem__)
    each, count = np.unique(np.concatenate(tokens), return_counts=True)
    rank = np.empty(len(each), dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(each))
    lists = [np.sort(rank[np.searchsorted(each, tokens[k])][count[np.searchsorted(each, tokens[k])] > 1]) for k in order]
    held = None
    if known is not None:
        first: dict[int, int] = {}
        held = [first.setdefault(known[k], i) for i, k in enumerate(order)]
    out, trie = [0] * len(docs), Trie(lists, n[order], percent)
    for i, c in enumerate(trie.join(held)):
        out[order[i]] = docs[order[c]]
    return out, [(docs[order[a]], docs[order[b]]) for a, b in trie.links]


JOINED = "doc long, label long, class long, a long, b long"


def _joined(rows: DataFrame, *keys: str, percent: int = OF) -> DataFrame:
    """(doc, label, class, a, b): trie joins of groups of (doc, n, tokens, label); a and b are a link that made a class, on as many rows as there are links."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        docs, label = t.column("doc").to_pylist(), t.column("label").to_pylist()
        got, links = classes(docs, t.column("n").to_numpy(), [np.frombuffer(x, np.int64) for x in t.column("tokens").to_pylist()], label, percent)
        a, b = zip(*links, strict=True) if links else ((), ())
        none = [None] * (len(docs) - len(links))
        return pa.table([pa.array(c, pa.int64()) for c in (docs, label, got, [*a, *none], [*b, *none])], names=["doc", "label", "class", "a", "b"])

    # dealt by all keys: a join by some of them before this would otherwise leave its groups together
    return rows.repartition(*keys).groupBy(*keys).applyInArrow(run, JOINED)


def prefixes(cands: DataFrame) -> DataFrame:
    """(token, doc) of every candidate's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, tokens, prefix = (b.column(k).to_pylist() for k in range(3))
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.frombuffer(t, np.int64)[:p] for t, p in zip(tokens, prefix, strict=True)]), pa.int64()), pa.array(np.repeat(docs, prefix), pa.int64())], names=["token", "doc"]
                )

    return cands.select("doc", "tokens", "prefix").mapInArrow(run, "token long, doc long")


def _links(joined: DataFrame) -> DataFrame:
    return joined.where("a is not null").select("a", "b")


def _split_family_links(members: DataFrame, heads: DataFrame, block_tokens: int, percent: int = OF) -> DataFrame:
    """The links between the block classes of families that fill more than one block (see step 5)."""
    found = None
    labels = written(members.select("doc", "label"), "labels")
    n = labels.agg(F.countDistinct("label")).first()[0]
    while True:  # one representative of each class, until no more classes merge
        now = members.drop("label").join(labels.where("doc = label"), "doc")
        weight = now.groupBy("family").agg(F.ceil(F.sum(F.length("tokens") / 8) / block_tokens).alias("blocks"))
        now = now.drop("blocks", "block").join(weight, "family").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(n)), F.col("blocks")))
        merged = written(_joined(now, "family", "block", percent=percent).where("a is not null"), "merged")
        found = _links(merged) if found is None else found.union(_links(merged))
        if not merged.limit(1).count():
            break
        comp = components(_links(merged))
        labels = written(labels.join(comp, F.col("label") == F.col("node"), "left").select("doc", F.coalesce("component", "label").alias("label")), "labels")
        n = labels.agg(F.countDistinct("label")).first()[0]
    # sets that link differ in size by less than this factor: each class of sizes meets itself and the next one
    size = F.floor(F.log("n") / math.log(1.001 * PART / percent)).cast("long")
    shared = heads.join(labels, "doc").join(members.select("doc", "n"), "doc").select("token", "doc", "label", F.explode(F.array(size - 1, size)).alias("pair"))
    # the class with the most sets is cut, and each piece meets the sets of all others; these meet each other
    each = shared.groupBy("token", "pair", "label").agg(F.count("*").alias("c")).groupBy("token", "pair")
    several = each.agg(F.count("*").alias("k"), F.max_by("label", F.struct("c", "label")).alias("most"), F.max("c").alias("n_most"), F.sum("c").alias("n_all")).where("k > 1")
    several = several.select("token", "pair", "k", "most", F.ceil(F.col("n_most") / PIECE_ROWS).alias("pieces"), F.ceil((F.col("n_all") - F.col("n_most")) / PAIR_ROWS).alias("blocks"))
    rest = shared.join(several, ["token", "pair"]).join(members.select("doc", "n", "tokens"), "doc")
    piece, block = (F.pmod(F.xxhash64("doc"), F.col(c)) for c in ("pieces", "blocks"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    at = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    from_most = F.transform(upto("blocks"), lambda j: at(0, piece, j))
    among = F.when(F.col("k") > 2, F.transform(upto("blocks"), lambda j: at(1, F.least(block, j), F.greatest(block, j)))).otherwise(F.array().cast("array<struct<kind:int,i:bigint,j:bigint>>"))
    places = F.when(F.col("label") == F.col("most"), from_most).otherwise(F.concat(F.transform(upto("pieces"), lambda i: at(0, i, block)), among))
    rest = rest.select("token", "pair", F.explode(places).alias("at"), "doc", "n", "tokens", "label").select("token", "pair", "at.*", "doc", "n", "tokens", "label")
    return found.union(_links(_joined(rest, "token", "pair", "kind", "i", "j", percent=percent))).distinct()


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int | None = None, n_words: int = N, percent: int = OF, bits: int = 64) -> DataFrame:
    """One row for each document row with an id: doc_id, n_shingles, component_id; shingles have ``n_words`` words, sets link from ``percent`` on.

    ``bits`` is the hashes' width in the first attempt, 64 in any other.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not own.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _classes(own, block_tokens, percent, Hashing(n_words, bits=bits))
    # ids repeat: each (id, text) gets a key of its own, and an id links what its texts link
    rows = own.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    got = _classes(rows.select(F.col("key").alias("doc_id"), "text").dropDuplicates(["doc_id"]), block_tokens, percent, Hashing(n_words, bits=bits))
    got = written(rows.select("doc_id", "key").join(got.select(F.col("doc_id").alias("key"), "n_shingles", "component_id"), "key"), "keyed")
    least = got.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    links = components(got.join(least, "component_id").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    return got.join(links, F.col("doc_id") == F.col("node")).select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def _classes(own: DataFrame, block_tokens: int | None, percent: int, how: Hashing) -> DataFrame:
    """The same for (doc_id, text) with ids that don't repeat."""
    for _ in range(8):
        got = _attempt(own, block_tokens, percent, how)
        if got is not None:
            return got
        how = Hashing(how.n_words, how.seed + 2)
    raise RuntimeError("shingles share hashes of 64 bits whatever the seed")


def _attempt(own: DataFrame, block_tokens: int | None, percent: int, how: Hashing) -> DataFrame | None:
    """The classes under these hashes, or None if a size or a link doesn't hold on the texts."""
    sized = written(sizes(own, how), "sizes")
    total, wrong = sized.agg(F.sum("n"), F.max(F.col("collides").cast("int"))).first()
    if wrong:
        return None
    buckets = parts_for(total or 0, BUCKET_TOKENS)
    sets = sized.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"))
    unique = written(sets, "sets")
    if unique.groupBy(F.substring("digest", 1, 16)).count().where("count > 1").limit(1).count():
        return None  # two sets of the same hashes
    cands = written(candidates(repeated(postings(own, buckets, how), buckets), unique, buckets, percent), "candidates")
    if block_tokens is None:
        every = cands.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0
        block_tokens = int(min(BLOCK_TOKENS, max(LEAST_BLOCK, every // BLOCK_SHARE)))
    heads = written(prefixes(cands), "heads")
    leader = heads.groupBy("token").agg(F.min("doc").alias("leader"), F.count("*").alias("members")).where("members > 1")
    family = components(heads.join(leader, "token").where("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct())
    family = family.select(F.col("node").alias("doc"), F.col("component").alias("family"))
    members = cands.join(family, "doc")
    weight = members.groupBy("family").agg(F.ceil(F.sum(F.length("tokens") / 8) / block_tokens).alias("blocks"))
    members = members.join(weight, "family").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn("label", F.col("doc"))
    members = written(members.select("doc", "n", "tokens", "family", "blocks", "block", "label"), "members")
    joined = written(_joined(members, "family", "block", percent=percent), "classes")
    first, links = joined.select("doc", "class"), _links(joined)
    large = members.where("blocks > 1")
    if large.limit(1).count():
        large = large.drop("label").join(first.withColumnRenamed("class", "label"), "doc")
        across = written(_split_family_links(written(large, "large"), heads, block_tokens, percent), "across")
        links = links.union(across)
        # links are between sets: what they merge are the classes these sets are in
        ends = across.join(first.select(F.col("doc").alias("a"), F.col("class").alias("ca")), "a").join(first.select(F.col("doc").alias("b"), F.col("class").alias("cb")), "b")
        more = components(ends.select("ca", "cb"), "ca", "cb")
        first = first.join(more, F.col("class") == F.col("node"), "left").select("doc", F.coalesce("component", "class").alias("class"))
    if false_links(own, links, percent, how.n_words).limit(1).count():
        return None
    out = sized.join(unique.select("digest", "doc"), "digest", "left").join(first, "doc", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc", "doc_id").alias("component_id"))


def overlap(s: bytes, t: bytes, n_words: int) -> tuple[int, int, int]:
    """The sizes of two texts' sets and of their intersection, from the words as they are: each gets a number, and so does each distinct run of them."""
    x, y = s.lower().split(), t.lower().split()  # of bytes: A-Z alone, and the white space of the definition
    if min(len(x), len(y)) < n_words:
        sizes = [len(set(zip(*(w[k:] for k in range(n_words)), strict=False))) if len(w) >= n_words else len(w) > 0 for w in (x, y)]
        return int(sizes[0]), int(sizes[1]), int(len(x) > 0 and x == y)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in (*x, *y)], dtype=np.int64)
    runs = ids
    for k in range(1, n_words):
        runs = np.unique(runs[:-1] * len(number) + ids[k:], return_inverse=True)[1]
    a, b = np.unique(runs[: len(x) - n_words + 1]), np.unique(runs[len(x) :])
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def false_links(own: DataFrame, links: DataFrame, percent: int, n_words: int) -> DataFrame:
    """The links (a, b) that don't hold on the texts of (doc_id, text)."""
    text = lambda name, to: own.select(F.col("doc_id").alias(name), F.col("text").alias(to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                m, n, both = overlap((s.as_py() or "").encode(), (t.as_py() or "").encode(), n_words)
                wrong.append(PART * both < percent * (m + n - both))
            yield batch.select([0, 1]).filter(pa.array(wrong, pa.bool_()))

    pairs = links.join(text("a", "s"), "a").join(text("b", "t"), "b").select("a", "b", "s", "t")
    return pairs.mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N, percent: int = OF) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its class; rows without an id stay too."""
    gone = linked(docs, id_col, text_col, n_words=n_words, percent=percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[id_col] == gone["_gone"], "left_anti")
