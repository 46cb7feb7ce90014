"""Sequence packing by the online sum-of-squares rule.

Every document is tokenised, closed with an end id and placed in windows of ``capacity`` ids. A document longer than a
window fills whole windows first; what is left is one item. Fill levels are steps of capacity / ``levels`` ids, rounded up.
An item goes to the open window whose level h makes the sum of squared level counts, over the partially filled levels, least:
with N the level array and g the level after placing, an open window changes it by 2(N[g] - N[h]) + 2, or 1 - 2N[h] where it
becomes full, and a new one by 2N[g] + 1. Ties take the fullest window. A window with less than a step of room is full by
this rule; what it lacks is cut from the head of the items that follow, before they are placed, so it has no padding.

When a task ends, open windows are closed out: ids of the emptiest fill the gaps of the fullest, so at most one window of a
task stays partial, and that one is cut into lengths that are powers of two, which need no padding.

Scale: one pass without a shuffle. A task packs the rows of its own split in reading order. It holds the open windows (4
bytes an id), one document and a bounded word cache. Open windows are about as many as levels in use, however many the
documents; for sizes that hardly fit together, the fullest beyond ``most_open`` is filled from the emptiest, one at a time, and
the level array stays. A sequence id is (task, count in the task), so a task that runs again gives the same rows.

Cases: null text is empty and gives a document of the end id alone. Null and repeated doc_ids are packed as rows of their
own. An empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The pre-tokenizer's own rule, for texts of the characters that ODD leaves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: Outside ASCII and plain Latin letters a text goes through the tokenizer whole.
ODD = r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ʯ]"
_LOADED: dict = {}


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes; equal to the tokenizer's own, with each word encoded once.

    Two caches of ``cached_words`` bound the memory: when one is full it becomes the former one.

    The vocabulary drops white space and treats pre-tokenized words apart, so ids of a text are the ids of its words.
    Texts with other than Latin characters or with a special token's string are handed to the tokenizer whole.
    """

    def __init__(self, path: str | None, cached_words: int = 150_000):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.find, self.odd, self.model = re.compile(PIECES).findall, re.compile(ODD).search, self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: the rest follows from 256 on
        rest = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.most = cached_words
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict = {}
        self.former: dict = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([self.shown[b] for b in word.encode()])
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.odd(text) or any(s in text for s in self.special):
            return self.whole(text)
        known, found = self.words, self.find(text.lower())
        try:
            return b"".join([known[w] for w in found])
        except KeyError:
            if len(known) > self.most:  # words used since come back from the former cache
                self.former, self.words = known, {}
                known = self.words
            former = self.former
            known.update({w: former.get(w) or self.word(w) for w in {*found} if w not in known})
            return b"".join([known[w] for w in found])


def loaded(path: str | None) -> WordTokenizer:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


class Packer:
    """Online packing of one task's documents; rows come out through ``take``. ``made`` counts windows by what completed them."""

    def __init__(self, task: int, capacity: int = 4096, levels: int = 128, most_open: int = 2048):
        self.capacity, self.levels, self.step, self.most_open = capacity, levels, -(-capacity // levels), most_open
        self.base, self.count = task << 33, 0
        self.level = np.zeros(levels + 1, np.int64)
        self.top = np.full(levels + 1, 2 * capacity, np.int64)  # fill of each level's last window
        self.open: list[list] = [[] for _ in range(levels + 1)]  # by level: (fill, window), a window a list of (doc, start, ids, tokens of the doc)
        self.short: list[tuple] = []  # (fill, window) with less than a step of room
        self.rows, self.made = [], {"whole": 0, "rule": 0, "evicted": 0, "closed": 0}

    def _emit(self, window: list, how: str) -> None:
        at, offset = self.base + self.count, 0
        self.count += 1
        self.made[how] += 1
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, at, offset))
            offset += n

    def add(self, doc: int | None, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.capacity
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            self._emit([(doc, start, ids[4 * start : 4 * start + width], total)], "whole")
        at = whole
        while at < total and self.short:
            fill, window = self.short.pop()
            n = min(total - at, self.capacity - fill)
            window.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            self._hold(fill + n, window)
            at += n
        if at < total:
            self._place((doc, at, ids[4 * at :], total), total - at)
            if int(self.level.sum()) > self.most_open:
                self._evict()

    def _grade(self, fill):
        return -(-fill // self.step)

    def _place(self, item: tuple, size: int) -> None:
        n, after, fill = self.level, self._grade(self.top + size), size
        partial = after < self.levels
        change = np.where(partial, 2 * (n[np.where(partial, after, 0)] - n) + 2, 1 - 2 * n)
        change[self.top + size > self.capacity] = np.iinfo(np.int64).max
        best = self.levels - int(np.argmin(change[::-1]))
        alone = self._grade(size)
        window = []
        if change[best] <= (2 * n[alone] + 1 if alone < self.levels else 0):
            fill, window = self._lift(best)
            fill += size
        window.append(item)
        self._hold(fill, window)

    def _lift(self, level: int, at: int = -1) -> tuple:
        """Take a window out of its level."""
        mine = self.open[level]
        found = mine.pop(at)
        self.level[level] -= 1
        self.top[level] = mine[-1][0] if mine else 2 * self.capacity
        return found

    def _hold(self, fill: int, window: list) -> None:
        level = self._grade(fill)
        if fill == self.capacity:
            self._emit(window, "rule")
        elif level >= self.levels:
            self.short.append((fill, window))
        else:
            self.open[level].append((fill, window))
            self.level[level] += 1
            self.top[level] = fill

    def _evict(self) -> None:
        """Fill the fullest open window from the emptiest."""
        some = np.flatnonzero(self.level)
        full, spare = self._lift(int(some[-1])), self._lift(int(np.flatnonzero(self.level)[0]))
        for fill, window in self._fill(full, spare):
            if fill == self.capacity:
                self._emit(window, "evicted")
            else:
                self._hold(fill, window)

    def _fill(self, full: tuple, spare: tuple) -> list[tuple]:
        """The two windows after ids of the second's end have filled the first's gap; one without ids is left out."""
        (fill, window), (rest, donor) = full, spare
        gap = self.capacity - fill
        while gap and donor:
            doc, start, ids, total = donor.pop()
            n = len(ids) // 4
            cut = max(0, n - gap)  # the donor keeps the head
            window.append((doc, start + cut, ids[4 * cut :], total))
            gap, rest = gap - (n - cut), rest - (n - cut)
            if cut:
                donor.append((doc, start, ids[: 4 * cut], total))
        return [(self.capacity - gap, window)] + ([(rest, donor)] if rest else [])

    def close_out(self) -> None:
        """Fill the fullest windows with ids of the emptiest, until at most one is partial; that one ends in powers of two."""
        windows = [*sorted(self.short, key=lambda w: -w[0]), *((f, w) for mine in self.open[::-1] for f, w in mine[::-1])]
        self.open, self.short = [[] for _ in self.open], []
        self.level[:], self.top[:] = 0, 2 * self.capacity
        while len(windows) > 1:
            filled, *rest = self._fill(windows[0], windows.pop())
            windows += rest
            windows[0] = filled
            if filled[0] == self.capacity:
                self._emit(windows.pop(0)[1], "closed")
        if windows:
            self._powers(*windows[0])

    def _powers(self, fill: int, window: list) -> None:
        pieces = window[::-1]
        while fill:
            need = part = 1 << (fill.bit_length() - 1)
            own = []
            while need:
                doc, start, ids, total = pieces.pop()
                n = min(need, len(ids) // 4)
                own.append((doc, start, ids[: 4 * n], total))
                if len(ids) > 4 * n:
                    pieces.append((doc, start + n, ids[4 * n :], total))
                need -= n
            self._emit(own, "closed")
            fill -= part

    def take(self) -> list:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, levels: int = 128, most_open: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the vocabulary file's path on the executors (None: the installed public word vocabulary).
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    out = pa.schema([(n, pa.int64()) for n in names])

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = loaded(tokenizer), np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId(), capacity, levels, most_open)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc, encode(text.as_py() or "") + end)
            if rows := packer.take():
                yield batch(rows)
        packer.close_out()
        if rows := packer.take():
            yield batch(rows)

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
