"""Chat formatting in budgeted windows.

The turns of a conversation are laid into windows of at most ``budget`` tokens: prefix sums of
the turns' token counts decide where a window ends, always between turns (a turn beyond the
budget is a window of its own and stays whole). Each later window repeats the system turn the
conversation begins with, whatever its length, and a limited history, of which the oldest turns
go where the next turn needs the room. A window is over budget only if its one turn and the system turn
don't fit together. Whatever is repeated is outside the loss mask, so each assistant text is a
target exactly once.

A window's text is ``<|im_start|>role\\ncontent<|im_end|>\\n`` for each turn. Inside roles and
contents a backslash doubles and ``<|`` becomes ``<\\|`` (in roles a newline becomes ``\\n``
too), so no text can imitate a control string and ``unescape`` gives back what was there. What is
counted is the turn as it stands in the window, escaped and framed. A turn ends with a newline and
the next one begins with ``<``, where every byte-level pre-tokenizer cuts, so a window's tokens are
exactly the sum of its turns'.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text), nulls
first; repeated rows are turns of their own; rows of the null conversation form one
conversation; an empty table gives an empty table; extra columns are ignored. Conversations are
streamed from sorted partitions and never held whole: a task's memory is one window's turns,
also for a conversation that holds a third of all rows (whose digests are a single stream by
their definition).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import codec_of, ship, text_slices

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY_TURNS, HISTORY_SHARE = 1024, 2, 0.25
WINDOW = "conv_id long, window int, last boolean, first_turn long, n_repeated int, n_turns int, n_tokens long, text string, loss array<struct<start:int,end:int>>"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S) if "\\" in s else s


def framed(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the content, the content, and what stands after it."""
    return f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text), f"{END}\n"


Turn = tuple[str, str, int, int, int]  # role, framed text, where its content starts and ends, tokens


class Windows:
    """Windows of a stream of turns in order; rows are tuples in the order of ``WINDOW``."""

    def __init__(self, budget: int, history: int, share: float):
        self.budget, self.history, self.share = budget, history, share
        self.conv: object = self  # no conversation yet

    def begin(self, conv: int | None) -> None:
        self.conv, self.number, self.first, self.sum = conv, 0, 0, 0
        self.system: Turn | None = None
        self.head: list[Turn] = []
        self.own: list[Turn] = []

    def close(self, last: bool) -> tuple:
        turns, spans, at = self.head + self.own, [], 0
        for k, (role, framed_text, start, end, _) in enumerate(turns):
            if role == "assistant" and end > start and k >= len(self.head):
                spans.append({"start": at + start, "end": at + end})
            at += len(framed_text)
        row = (self.conv, self.number, last, self.first, len(self.head), len(self.own), self.sum, "".join([t[1] for t in turns]), spans)
        if self.number == 0 and self.own[0][0] == "system":
            self.system = self.own[0]
        rest = self.own[1:] if self.number == 0 and self.system else self.own
        self.head = [self.system] if self.system else []
        room, kept = self.budget * self.share, []
        for turn in reversed(rest[-self.history :] if self.history else []):
            room -= turn[4]
            if room < 0:
                break
            kept.insert(0, turn)
        self.head += kept
        self.first += len(self.own)
        self.number, self.own, self.sum = self.number + 1, [], sum(t[4] for t in self.head)
        return row

    def add(self, conv: int | None, turn: Turn) -> Iterator[tuple]:
        if self.conv is self or conv != self.conv:
            yield from self.flush()
            self.begin(conv)
        if self.own and self.sum + turn[4] > self.budget:
            yield self.close(False)
        while not self.own and self.sum + turn[4] > self.budget and len(self.head) > (self.system is not None):
            self.sum -= self.head.pop(1 if self.system else 0)[4]  # the history leaves no room for this turn
        self.own.append(turn)
        self.sum += turn[4]

    def flush(self) -> Iterator[tuple]:
        if self.conv is not self and self.own:
            yield self.close(True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``most`` bytes; ``text`` is the place of the column that is long."""
    got, size = [], 0
    for r in rows:
        got.append(r)
        size += 200 + (len(r[text]) if text is not None else 0)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)
            got, size = [], 0
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)


ARROW_WINDOW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("last", pa.bool_()), ("first_turn", pa.int64()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()),
    ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])
ARROW_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def format_windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY_TURNS, share: float = HISTORY_SHARE) -> DataFrame:
    """The windows of all conversations (columns of ``WINDOW``), each conversation's in order in one partition."""
    shipped = ship(turns.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, windows = codec_of(shipped), Windows(budget, history, share)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for at, text in text_slices(b.column(2)):
                    conv, role = (b.column(k).slice(at, len(text)).to_pylist() for k in range(2))
                    role = [x or "" for x in role]
                    parts = [framed(r, t) for r, t in zip(role, text, strict=True)]
                    whole = ["".join(p) for p in parts]
                    for c, r, w, p, n in zip(conv, role, whole, parts, own.counts(whole), strict=True):
                        yield from windows.add(c, (r, w, len(p[0]), len(w) - len(p[2]), n))
            yield from windows.flush()

        yield from batches_of(rows(), ARROW_WINDOW, 7)

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, WINDOW)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted window, unescaped."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        yield unescape(text[at + len(START) : line]), unescape(text[line + 1 : end])
        at = end + len(END) + 1


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """One row for each conversation, from its windows.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows. Windows are
    dealt by conversation and sorted, unless ``in_order`` says that they are as ``format_windows``
    left them; either way a missing, repeated or misplaced window raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, number, ended = None, -1, True
            for b in batches:
                for c, w, last, repeated, text, loss in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                    if w != (0 if ended else number + 1) or not ended and c != conv:
                        raise ValueError(f"window {w} of conversation {c} comes after window {number} of conversation {conv}")
                    if ended:
                        n_turns, n_loss, n_chars, turns, targets = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    for k, (role, content) in enumerate(parse(text)):
                        if k >= repeated:
                            n_turns += 1
                            turns.update(f"{role}\n{content}\n".encode())
                    for span in loss:
                        target = unescape(text[span["start"] : span["end"]])
                        n_loss += len(target)
                        targets.update(target.encode())
                    n_chars += len(text)
                    conv, number, ended = c, w, last
                    if last:
                        yield c, n_turns, turns.hexdigest(), n_loss, targets.hexdigest(), n_chars, w + 1
            if not ended:
                raise ValueError(f"windows of conversation {conv} after window {number} are missing")

        yield from batches_of(rows(), ARROW_DIGEST)

    own = windows.select("conv_id", "window", "last", "n_repeated", "text", "loss")
    if not in_order:
        own = own.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return own.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
