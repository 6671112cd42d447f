"""Benchmark decontamination by CGK embeddings, bit sampling and exact edit verification.

Texts and items are sequences of normalised words (ASCII lower case, without punctuation). A
document is contaminated by an item when some window of it has an edit similarity of
``SIMILARITY`` or more with it: edit distance at most ``floor((1 - SIMILARITY) * n)`` with words
as the letters and ``n`` words in the item, or, for items of more than ``SHORT`` words, the same with
the characters of the normalised words (joined by blanks), which finds passages whose words are
misspelt.

The CGK random walk of a window goes on to the next letter, or stays, by random bits that depend on
the letter and the step, which maps edit distance to Hamming distance between the walks. Walks are as
long as the item: items are put into classes of like length (a factor of ``RATIO``), and an
item of a class and each possible window are walked over the class's least length, in twice as many
steps. Bit-sampling LSH hashes a few steps of a walk, near to each other, for walks that agree
somewhere agree there for a while; the places of ``repetitions`` independent walks and samples are spread
over the whole walk, and reach the target recall.

Windows that can't match are skipped before they are walked: ``d`` edits leave at least
``n - g + 1 - g d`` grams of ``g`` words, an exact bound, so a window with fewer grams of a class isn't
walked by words. By characters a window is walked if it has a ``CHAR_SHARE`` of one item's grams of eight
characters, all telling about the same place where the item would begin, which is no guarantee but
a small part of what so many edits leave. Every gram counts, however many items hold it, and wherever
other items are found: what is left uncounted of an item's commonest grams is taken off what it needs.

Every item that collides with a window of a document is verified by Myers' bit-parallel edit distance,
by words over all places of the document that have enough of the item's own grams: distance,
place and length are those of the best match in the whole document. Items of up to ``SHORT`` words
are searched exactly: of ``d + 1`` pieces of an item, ``d`` edits leave one untouched, and
each place of a piece is verified.

Defined results: null and empty texts are clean; null or empty items match nothing; items of
repeated ids count separately; a document's copies are reported each; for each document row and
item the best match is kept (by words if there is one, else by characters; greatest similarity, then
the leftmost end, then the shortest window); an empty table gives an empty table; extra columns are
ignored; texts of any length are worked off whole. The benchmark is shipped to the executors in parts
of at most ``PART_BYTES`` of text, whatever its size; documents are read once for each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import IS_BREAK, LOWER, flat, give_back, gram_hashes, mix, runs, slices, word_hashes

SIMILARITY = 0.8
#: Items of so many words at most are searched exactly, by their pieces.
SHORT = 9
RATIO, GRAM = 1.25, 3
#: (walks, sampled steps, steps they lie within) by words and by characters.
BY_WORDS, BY_CHARS = (14, 3, 5), (32, 6, 8)
#: Hits of eight characters that a window needs, as a share of the item's length.
CHAR_SHARE, CHAR_GRAM = 0.1, 8
#: Eight characters at more places than this aren't counted for an item as long as fewer than half of those it needs are left out; it needs as many less.
COMMON = 64
#: Hits are told apart by items in stretches of the text with about so many (hit, place in an item).
TOLD = 1 << 20
#: Characters by which the places may differ where an item would begin, told by its grams in one window.
BAND = 48
BITMAP_BITS, WALKED = 22, 2048
PART_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, distance int, item_words int, start_word long, n_words int, similarity double"
PAD = np.uint64(0x5851F42D4C957F2D)


def word_sequences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, cut, characters, starts, ends) of all normalised words; ``cut`` has each text's first word (one more than texts).

    The characters are those of all words, each followed by a blank; starts and ends are places there.
    """
    solid = ~IS_BREAK[buf]
    starts, ends, cut = runs(solid, off)
    low, lens = LOWER[buf], ends - starts
    h = word_hashes(low, starts, ends)
    letters = low[solid]
    chars = np.full(len(letters) + len(lens), 0x20, dtype=np.uint8)
    chars[np.arange(len(letters)) + np.repeat(np.arange(len(lens)), lens)] = letters
    upto = np.cumsum(lens + 1)
    return h, cut, chars, upto - lens - 1, upto - 1


def char_grams(chars: np.ndarray) -> np.ndarray:
    """The eight characters from each place as one number; the last seven places have none."""
    return np.ndarray(shape=(max(0, len(chars) - CHAR_GRAM + 1),), dtype="<u8", buffer=np.ascontiguousarray(chars), strides=(1,)) if len(chars) >= CHAR_GRAM else np.zeros(0, np.uint64)


def four_grams(chars: np.ndarray) -> np.ndarray:
    """The four characters from each place as one number: ``d`` edits of n characters leave ``n - 3 - 4 d`` of them."""
    return np.ndarray(shape=(max(0, len(chars) - 3),), dtype="<u4", buffer=np.ascontiguousarray(chars), strides=(1,)) if len(chars) >= 4 else np.zeros(0, np.uint32)


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """The largest edit distance at which an item of n letters counts as found."""
    return int((1 - similarity) * n + 1e-9)


class Walks:
    """The random choices of all repetitions for windows of one length: the same on all machines."""

    def __init__(self, length: int, repetitions: int, samples: int, span: int, seed: int = 20):
        self.length, steps, rng = length, 2 * length, np.random.default_rng((seed, length))
        self.keys = rng.integers(0, 2**63, (repetitions, -(-steps // 64)), dtype=np.uint64)
        span = min(span, steps)
        origins = (((np.arange(repetitions) + rng.random(repetitions)) / repetitions) ** 2 * (steps - span)).astype(int)
        self.picks = [sorted((o + rng.choice(span, min(samples, span), replace=False)).tolist()) for o in origins.tolist()]

    def signatures(self, letters: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The sampled walks (repetition by window) from each place ``at`` in the letters, over ``length`` of them and never to ``end``."""
        end = np.minimum(end, at + self.length)
        reps = len(self.picks)
        pos = np.repeat(at[None], reps, axis=0)
        sig = np.repeat(np.arange(1, reps + 1, dtype=np.uint64)[:, None], len(at), axis=1)
        first = 0  # walks are in the order of their last sampled steps
        for j in range(max(p[-1] for p in self.picks) + 1):
            while self.picks[first][-1] < j:
                first += 1
            own = pos[first:]
            inside = own < end
            here = letters[np.where(inside, own, 0)]
            for r in range(first, reps):
                if j in self.picks[r]:
                    sig[r] = mix(sig[r] * np.uint64(0x9E3779B97F4A7C15) + np.where(inside[r - first], here[r - first], PAD))
            own += inside & ((mix(here ^ self.keys[first:, j // 64, None]) >> np.uint64(j % 64)) & np.uint64(1)).astype(bool)
        return sig


def best_match(item: Sequence[int], text: Sequence[int]) -> tuple[int, int]:
    """(least edit distance of the item to any window of the text, end of the leftmost such window), by Myers' bit vectors."""
    n = len(item)
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for k, w in enumerate(text):
        eq = masks.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        horizontal_plus = minus | (full & ~(diagonal | plus))
        horizontal_minus = plus & diagonal
        if horizontal_plus & top:
            score += 1
        elif horizontal_minus & top:
            score -= 1
        horizontal_plus = horizontal_plus << 1 & full  # a window may begin anywhere: no cost from the left
        horizontal_minus = horizontal_minus << 1 & full
        plus = horizontal_minus | (full & ~(diagonal | horizontal_plus))
        minus = horizontal_plus & diagonal
        if score < best:
            best, end = score, k + 1
    return best, end


def dense_places(hits: np.ndarray, row: np.ndarray, least: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places (intervals, merged) from which ``reach`` letters have ``least`` hits of one row; rows stand together, and hits ascend in each."""
    if len(hits) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = hits[: len(hits) - least + 1], hits[least - 1 :]
    ok = (b - a < reach) & (row[: len(a)] == row[least - 1 :])
    lo, hi, row = b[ok] - reach + 1, a[ok], row[: len(a)][ok]
    if not len(lo):
        return lo, hi
    new = np.ones(len(lo), dtype=bool)
    new[1:] = (lo[1:] > hi[:-1] + 1) | (row[1:] != row[:-1])  # both ascend within a row
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def expanded(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of ascending intervals."""
    n = np.maximum(hi - lo + 1, 0)
    return np.unique(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()))


@dataclass
class Group:
    """Items of one class of lengths, by words or by characters: what windows are told by, and the walks' tables."""

    items: np.ndarray
    grams: np.ndarray
    size: int
    least: int
    reach: int
    walks: Walks
    tables: list[tuple[np.ndarray, np.ndarray]]

    def collisions(self, letters: np.ndarray, at: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``at``, items) whose samples agree."""
        for x in range(0, len(at), WALKED):
            for own, (sig, order) in zip(self.walks.signatures(letters, at[x : x + WALKED], end[x : x + WALKED]), self.tables, strict=True):
                lo, hi = np.searchsorted(sig, own), np.searchsorted(sig, own, side="right")
                hit = np.flatnonzero(hi > lo)
                count = (hi - lo)[hit]
                place = np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                yield x + np.repeat(hit, count), self.items[order[place]]


class Grams:
    """A set of grams that most places of a text can be told apart from at once."""

    def __init__(self, parts: list[np.ndarray]):
        self.all = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64))
        self.maybe = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.maybe[self.slot(self.all)] = True

    @staticmethod
    def slot(x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP_BITS)

    def hits(self, own: np.ndarray) -> np.ndarray:
        if not len(self.all):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[self.slot(own)])
        return at[member(self.all, own[at])]


def member(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), dtype=bool)


class Index:
    """The items of one part of the benchmark."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float = SIMILARITY):
        buf, off = flat(pa.array(texts, pa.string()))
        h, cut, chars, starts, ends = word_sequences(buf, off)
        self.similarity = similarity
        kept = [k for k in range(len(ids)) if cut[k + 1] > cut[k]]
        self.ids = [ids[k] for k in kept]
        span = [(int(starts[cut[k]]), int(ends[cut[k + 1] - 1])) for k in kept]
        self.words = [h[cut[k] : cut[k + 1]].tolist() for k in kept]
        self.chars = [chars[x:y].tobytes() for x, y in span]
        self.gram, self.word_grams, self.char_grams = {}, {}, {}
        by_words: dict[tuple[int, int], list[int]] = {}
        by_chars: dict[int, list[int]] = {}
        pieces: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
        every = char_grams(chars)
        #: the items of the same words as an earlier one, by that one, which is searched for all
        self.twins: dict[int, list[int]] = {}
        earlier: dict[bytes, int] = {}
        for i, k in enumerate(kept):
            if earlier.setdefault(self.chars[i], i) != i:
                self.twins.setdefault(earlier[self.chars[i]], []).append(i)
                continue
            n = int(cut[k + 1] - cut[k])
            d = allowed(n, similarity)
            if n <= SHORT:
                bounds = [n * j // min(d + 1, n) for j in range(min(d + 1, n) + 1)]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    pieces.setdefault((b - a, d == 0), []).append((int(gram_hashes(h[cut[k] + a : cut[k] + b], b - a)[0]), i, a))
                continue
            g = max(g for g in range(1, GRAM + 1) if g == 1 or n - g + 1 - g * d >= 1)
            self.gram[i], self.word_grams[i] = (g, n - g + 1 - g * d), np.unique(gram_hashes(h[cut[k] : cut[k + 1]], g))
            by_words.setdefault((g, int(math.log(n, RATIO))), []).append(i)
            x, y = span[i]
            if y - x >= 2 * CHAR_GRAM:
                self.char_grams[i] = np.unique(every[x : y - CHAR_GRAM + 1])
                by_chars.setdefault(int(math.log(y - x, RATIO)), []).append(i)
        self.pieces = {}
        for key, rows in pieces.items():
            rows.sort()
            self.pieces[key] = (np.array([x for x, _, _ in rows], dtype=np.uint64), np.array([(i, a) for _, i, a in rows], dtype=np.int64))
        first, last = np.array([cut[k] for k in kept], dtype=np.int64), np.array([cut[k + 1] for k in kept], dtype=np.int64)
        x, y = np.array(span, dtype=np.int64).reshape(-1, 2).T
        letter = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
        self.by_words = [self.group(items, g, self.word_grams, h, first, last, min(self.gram[i][1] for i in items), BY_WORDS) for (g, _), items in by_words.items()]
        #: (by characters windows are told by ``char_need``, not by these groups' counts)
        self.by_chars = [self.group(items, CHAR_GRAM, self.char_grams, letter[chars], x, y, 1, BY_CHARS) for items in by_chars.values()]
        self.grams_of = {g: Grams([p.grams for p in self.by_words if p.size == g]) for g in {p.size for p in self.by_words}}
        pairs = [(every[x : y - CHAR_GRAM + 1], np.full(y - x - CHAR_GRAM + 1, i), np.arange(y - x - CHAR_GRAM + 1)) for i, (x, y) in enumerate(span) if i in self.char_grams]
        gram, holder, place = (np.concatenate([np.zeros(0, kind), *z]) for kind, z in zip((np.uint64, np.int64, np.int64), zip(*pairs, strict=True) if pairs else ((), (), ()), strict=True))
        each, which, n = np.unique(gram, return_inverse=True, return_counts=True)
        held = np.bincount(holder, minlength=len(kept))
        need = np.maximum(3, (CHAR_SHARE * held).astype(np.int64))
        order = np.lexsort((-n[which], holder))  # by item, the commonest first
        nth = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        left = np.zeros(len(order), dtype=bool)
        left[order] = (n[which[order]] > COMMON) & (nth < np.minimum(need // 2, need - 3)[holder[order]])
        self.char_need = need - np.bincount(holder[left], minlength=len(kept))
        gram, holder, place = gram[~left], holder[~left], place[~left]
        order = np.argsort(gram, kind="stable")
        self.holder, self.holder_place = holder[order], place[order]
        each, n = np.unique(gram, return_counts=True)
        self.chars_of = Grams([each])
        self.holders_cut = np.concatenate(([0], np.cumsum(n)))
        self.letter = letter
        self.fours: dict[int, np.ndarray] = {}

    def group(self, items: list[int], size: int, grams: dict[int, np.ndarray], letters: np.ndarray, first: np.ndarray, last: np.ndarray, least: int, how: tuple[int, int, int]) -> Group:
        own = np.array(items, dtype=np.int64)
        lengths = (last - first)[own]
        most = int(lengths.max())
        walks = Walks(int(lengths.min()), *how)
        tables = []
        for sig in walks.signatures(letters, first[own], last[own]):
            order = np.argsort(sig, kind="stable")
            tables.append((sig[order], order))
        return Group(own, np.unique(np.concatenate([grams[i] for i in items])), size, least, most + allowed(most, self.similarity) - size + 1, walks, tables)

    def short(self, h: np.ndarray, row: np.ndarray, row_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, place where the item would begin) of all places where a piece of a short item stands."""
        for (g, whole), (table, entries) in self.pieces.items():
            own = gram_hashes(h, g)
            x, y = np.searchsorted(table, own), np.searchsorted(table, own, side="right")
            hit = np.flatnonzero((y > x) & (row_end[: len(own)] >= np.arange(len(own)) + g))
            count = (y - x)[hit]
            place = np.repeat(x[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            start, (item, offset) = np.repeat(hit, count), entries[place].T
            if whole:  # the first one is the best there is
                first = np.unique(np.stack([row[start], item], axis=1), axis=0, return_index=True)[1]
                start, item, offset = start[first], item[first], offset[first]
            yield row[start], item, start - offset

    def best(self, i: int, letters: Sequence[int], at: int) -> tuple[int, int, int]:
        """(distance, end, length) of the item's best window by words among ``letters``, which begin at ``at``."""
        item = self.words[i]
        distance, end = best_match(item, letters)
        if distance > allowed(len(item), self.similarity):
            return distance, at + end, 0
        return distance, at + end, best_match(item[::-1], letters[:end][::-1])[1]

    def matches(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int, float]]:
        """(row, item, word distance, item's words, first word, number of words, similarity) of the best match of each row and item."""
        h, cut, chars, starts, ends = word_sequences(buf, off)
        if not len(h) or not self.ids:
            return
        row = np.repeat(np.arange(len(off) - 1), np.diff(cut))
        row_end = cut[1:][row]
        found: dict[tuple[int, int], tuple[float, int, int, int]] = {}

        def keep(r: int, i: int, near: tuple[int, int, int], score: float | None = None) -> None:
            distance, end, length = near
            score = 1 - distance / len(self.words[i]) if score is None else score
            if (r, i) not in found or (-score, end, length) < (-found[r, i][0], *found[r, i][1:3]):
                found[r, i] = (score, end, length, distance)

        for rows, items, begin in self.short(h, row, row_end):
            for r, i, p in np.unique(np.stack([rows, items, begin], axis=1), axis=0).tolist():
                n, d = len(self.words[i]), allowed(len(self.words[i]), self.similarity)
                lo, hi = max(int(cut[r]), p - d), min(int(cut[r + 1]), p + n + d)
                near = self.best(i, h[lo:hi].tolist(), lo)
                if near[0] <= d:
                    keep(r, i, near)
        hits, own = {}, {}
        for g, table in self.grams_of.items():
            own[g] = gram_hashes(h, g)
            at = table.hits(own[g])
            hits[g] = at[row_end[at] >= at + g]
        for group in self.by_words:
            g = group.size
            at = hits[g][member(group.grams, own[g][hits[g]])]
            lo, hi = dense_places(at, row[at], group.least, group.reach)
            places = expanded(np.maximum(lo, cut[row[hi]]) if len(lo) else lo, hi)
            if not len(places):
                continue
            pairs = [np.stack([row[places[w]], items], axis=1) for w, items in group.collisions(h, places, row_end[places])]
            for r, i in np.unique(np.concatenate(pairs), axis=0).tolist():
                n, d = len(self.words[i]), allowed(len(self.words[i]), self.similarity)
                mine = at[np.searchsorted(at, cut[r]) : np.searchsorted(at, cut[r + 1])]
                mine = mine[member(self.word_grams[i], own[g][mine])]
                for a, b in zip(*(x.tolist() for x in dense_places(mine, row[mine], self.gram[i][1], n + d - g + 1)), strict=True):
                    a = max(a, int(cut[r]))
                    near = self.best(i, h[a : min(int(cut[r + 1]), b + n + d)].tolist(), a)
                    if near[0] <= d:
                        keep(r, i, near)
        self.misspelt(h, cut, chars, starts, ends, row, found, keep)
        found |= {(r, twin): x for (r, i), x in found.items() for twin in self.twins.get(i, ())}
        for (r, i), (score, end, length, distance) in sorted(found.items()):
            yield r, i, distance, len(self.words[i]), end - length - int(cut[r]), length, round(score, 6)

    def char_places(self, chars: np.ndarray, starts: np.ndarray, cut: np.ndarray, row: np.ndarray, found: dict) -> np.ndarray:
        """word * items + item, ascending, of the words at which enough of an item's characters tell that it begins; none of ``found``'s rows and items."""
        own, n = char_grams(chars), len(self.ids)
        hits = self.chars_of.hits(own)
        if not len(hits):
            return np.zeros(0, np.int64)
        gram = np.searchsorted(self.chars_of.all, own[hits])
        of = row[np.searchsorted(starts, hits, side="right") - 1]
        count = np.diff(self.holders_cut)[gram]
        upto = np.concatenate(([0], np.cumsum(count)))
        known = np.sort(np.array([r * n + i for r, i in found], dtype=np.int64))
        longest = int(self.holder_place.max()) + 1
        least = int(self.char_need[self.holder].min())
        reach, span, out, x = longest + BAND, len(chars) + longest + 2 * BAND, [np.zeros(0, np.int64)], 0
        while x < len(hits):
            # all hits of a window are within reach, so stretches overlap by that much
            z = max(int(np.searchsorted(upto, upto[x] + TOLD)), int(np.searchsorted(hits, hits[x] + 2 * reach)))
            z = min(z, len(hits))
            # each hit at each place of each item, by row, item and diagonal (where the item would begin)
            c = count[x:z]
            entry = np.repeat(self.holders_cut[:-1][gram[x:z]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            told = (np.repeat(of[x:z], c) * n + self.holder[entry]) * span + np.repeat(hits[x:z], c) - self.holder_place[entry] + longest
            told.sort()
            first = np.flatnonzero(told[least - 1 :] - told[: max(0, len(told) - least + 1)] <= BAND)
            last = first + self.char_need[told[first] // span % n] - 1
            first, last = first[last < len(told)], last[last < len(told)]
            ok = told[last] - told[first] <= BAND
            first, last = told[first[ok]], told[last[ok]]
            if len(known):
                ok = ~member(known, first // span)
                first, last = first[ok], last[ok]
            if len(first):
                new = np.ones(len(first), dtype=bool)
                new[1:] = first[1:] - last[:-1] > BAND
                at = np.flatnonzero(new)
                key, lo = first[at] // span, first[at] % span - longest - BAND // 2
                hi = last[np.append(at[1:], len(last)) - 1] - key * span - longest + BAND // 2
                r = key // n
                w = np.maximum(np.searchsorted(starts, lo), cut[r])
                m = np.maximum(np.minimum(np.searchsorted(starts, hi, side="right"), cut[r + 1]) - w, 0)
                out.append((np.repeat(w - (np.cumsum(m) - m), m) + np.arange(m.sum())) * n + np.repeat(key % n, m))
            if z == len(hits):
                break
            x = int(np.searchsorted(hits, hits[z] - reach))
        return np.unique(np.concatenate(out))

    def alike(self, i: int, text: np.ndarray, d: int) -> list[tuple[int, int]]:
        """The stretches of a text in which any window within ``d`` edits of the item's characters lies, by the four-grams that are left."""
        m = len(self.chars[i])
        least = m - 3 - 4 * d
        if least < 1:
            return [(0, len(text))]
        if i not in self.fours:
            self.fours[i] = np.unique(four_grams(np.frombuffer(self.chars[i], np.uint8)))
        hits = np.flatnonzero(member(self.fours[i], four_grams(text)))
        lo, hi = dense_places(hits, np.zeros(len(hits), np.int64), least, m + d - 3)
        return list(zip(np.maximum(lo, 0).tolist(), np.minimum(hi + m + d, len(text)).tolist(), strict=True))

    def misspelt(self, h: np.ndarray, cut: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, found: dict, keep) -> None:
        """Matches by characters, for rows and items without one by words."""
        code = self.char_places(chars, starts, cut, row, found)
        if not len(code):
            return
        step = len(chars) // BAND + 3
        letters, places, items = self.letter[chars], code // len(self.ids), code % len(self.ids)
        for group in self.by_chars:
            words = np.unique(places[np.isin(items, group.items)])
            if not len(words):
                continue
            seen = [words[w] * len(self.ids) + own for w, own in group.collisions(letters, starts[words], ends[cut[1:][row[words]] - 1])]
            seen = np.unique(np.concatenate([x[member(code, x)] for x in seen]))
            if not len(seen):
                continue
            own = row[seen // len(self.ids)] * len(self.ids) + seen % len(self.ids)
            spots = np.unique(own * step + starts[seen // len(self.ids)] // BAND)
            cuts = np.flatnonzero(np.diff(spots, prepend=-2) > 1)  # spots next to each other are one stretch
            for x, z in zip(spots[cuts].tolist(), spots[np.append(cuts[1:], len(spots)) - 1].tolist(), strict=True):
                r, i = divmod(x // step, len(self.ids))
                item = self.chars[i]
                m, d = len(item), allowed(len(item), self.similarity)
                a, b = max(int(starts[cut[r]]), BAND * (x % step) - d), min(int(ends[cut[r + 1] - 1]), BAND * (z % step + 1) + m + d)
                for first, beyond in self.alike(i, chars[a:b], d):
                    first += a
                    text = chars[first : a + beyond].tobytes()
                    edits, end = best_match(item, text)
                    if edits > d:
                        continue
                    length = best_match(item[::-1], text[:end][::-1])[1]
                    w, v = (int(np.searchsorted(starts, first + q, side="right")) - 1 for q in (end - length, max(end - 1, 0)))
                    w = max(w, int(cut[r]))
                    keep(r, i, (best_match(self.words[i], h[w : v + 1].tolist())[0], v + 1, v + 1 - w), 1 - edits / m)


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", similarity: float = SIMILARITY, part_bytes: int = PART_BYTES) -> Iterator[Index]:
    """The benchmark's items in parts of bounded size (by a hash of the id, from the measured total)."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, -(-2 * total // part_bytes))
    for k in range(parts):
        got = sorted((r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).collect())
        yield Index([i for i, _ in got], [t for _, t in got], similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document row and item found in it; columns of ``SCHEMA``."""
    out = None
    own = docs.select(id_col, text_col)
    for index in indexes(benchmark, similarity=similarity):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                for first, _, buf, off in slices(b.column(1)):
                    rows = [(ids[first + r], index.ids[i], *rest) for r, i, *rest in index.matches(buf, off)]
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        part = own.mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    for index in indexes(benchmark, similarity=similarity):
        place = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            give_back()
            for b in batches:
                for first, last, buf, off in slices(b.column(place)):
                    hit = {r for r, *_ in index.matches(buf, off)}
                    yield b.slice(first, last - first).filter(pa.array([r not in hit for r in range(last - first)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
