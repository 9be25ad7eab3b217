"""Periodic runs of words, found with a grammar made by recompression.

The words of some documents, a separator of its own after each, form one sequence.
Rounds of block compression (equal neighbours become one symbol) and pair compression (a symbol of one
half of the alphabet and a following one of the other half become one) shrink it until a symbol or so is
left per document. What is compressed depends on neighbours only, so equal stretches have equal symbols
but for a few at their ends, and the longest common extension of two places takes a few steps a
level: up while the symbols agree, down to the first word that differs. All queries go
through a level together.

A run with period q and exponent e or more covers a multiple of (e - 1) q, and the next place q words on. These places,
n / ((e - 1) q) for each q, are the candidates; extension to both sides gives the run exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of text that share a grammar (a longer text has its own), and candidates looked at together.
CHUNK, STEP = 1 << 20, 1 << 20
ROUNDS = 200
_ODD = 0x9E3779B97F4A7C15
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _names(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def compress_blocks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the maximal blocks of equal symbols, and the blocks' lengths."""
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    sizes = np.diff(np.append(starts, len(s)))
    if len(starts) == len(s):
        return s, sizes
    return _names(s[starts] * (sizes.max() + 1) + sizes), sizes


def compress_pairs(s: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after joining each symbol of the left half with a right one behind it, and how many each holds."""
    mixed = (s.astype(np.uint64) + np.uint64(salt)) * np.uint64(_ODD)
    left = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(_ODD) >> np.uint64(63)).astype(bool)
    joins = np.append(left[:-1] & ~left[1:], False)
    starts = np.flatnonzero(~np.concatenate(([False], joins[:-1])))
    paired = joins[starts]
    second = np.where(paired, s[np.minimum(starts + 1, len(s) - 1)] + 1, 0)
    return _names(s[starts] * (s.max() + 2) + second), np.where(paired, 2, 1)


@dataclass
class Level:
    """Symbols, and where they lie in the symbols above: parent, whether first in it, and how many are left in it."""

    symbols: np.ndarray
    blocks: bool
    first: np.ndarray
    parent: np.ndarray
    opens: np.ndarray
    left: np.ndarray


def _level(symbols: np.ndarray, sizes: np.ndarray, blocks: bool) -> Level:
    first = np.cumsum(sizes) - sizes
    parent = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(symbols)) - first[parent]
    return Level(symbols, blocks, first, parent.astype(np.int32), at == 0, sizes[parent] - at)


class Grammar:
    """Recompression of a sequence whose last symbol occurs once; ``ends`` is about how many symbols may be left."""

    def __init__(self, sequence: np.ndarray, ends: int):
        steps, s = [], sequence.astype(np.int64)
        for k in range(ROUNDS):
            if len(s) <= max(ends, 2):
                break
            for blocks in (True, False):
                above, sizes = compress_blocks(s) if blocks else compress_pairs(s, k)
                if len(above) < len(s):
                    steps.append((s, sizes, blocks))
                s = above
        self.top = s
        self.levels = [_level(*step) for step in steps]
        self.mirror = [_level(x[::-1], sizes[::-1], blocks) for x, sizes, blocks in steps]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from places i and j (i < j) on."""
        return _extend(self.levels, self.top, i, j)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from places i and j (i < j) backwards, both included; place 0 must be unique."""
        n = len(self.levels[0].symbols) if self.levels else len(self.top)
        return _extend(self.mirror, self.top[::-1], n - 1 - i, n - 1 - j)


def _extend(levels: list[Level], top: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b, ends = i.copy(), j.copy(), []
    going = np.arange(len(i))
    # Up: what of a parent is left is compared, whole parents wait for the next level.
    for level in levels:
        x, y = a[going], b[going]
        equal = level.symbols[x] == level.symbols[y]
        inside = equal & ~(level.opens[x] & level.opens[y])
        p, q = level.left[x], level.left[y]
        step = np.where(inside, np.minimum(p, q), 0)
        x, y = x + step, y + step
        stops = ~equal | (inside & (p != q))
        ends.append(going[stops])
        a[going], b[going] = x, y
        going = going[~stops]
        a[going], b[going] = level.parent[a[going]], level.parent[b[going]]
    down = []
    while len(going):
        equal = top[a[going]] == top[b[going]]
        down.append(going[~equal])
        going = going[equal]
        a[going] += 1
        b[going] += 1
    # Down: two symbols that differ agree in one part of theirs at most, a block or the left of a pair.
    down = np.concatenate([*down, going])
    for level, stopped in zip(reversed(levels), reversed(ends)):
        x, y = level.first[a[down]], level.first[b[down]]
        equal = level.symbols[x] == level.symbols[y]
        step = equal * (np.minimum(level.left[x], level.left[y]) if level.blocks else 1)
        a[down], b[down] = x + step, y + step
        down = np.concatenate([down, stopped])
    return a - i


def candidates(codes: np.ndarray, first: np.ndarray, n: np.ndarray, min_length: int, exponent: int):
    """Places i of the harmonic grids with the same word q on, and q, over all documents."""
    periods = np.where(n >= min_length, n // exponent, 0)
    doc = np.repeat(np.arange(len(n)), periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    stride = (exponent - 1) * q
    count = -(-(n[doc] - q) // stride)
    at, total = 0, np.cumsum(count)
    while at < len(count):
        till = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        part = count[at:till]
        k = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        i = np.repeat(first[doc[at:till]], part) + k * np.repeat(stride[at:till], part)
        period = np.repeat(q[at:till], part)
        same = codes[i] == codes[i + period]
        yield np.repeat(doc[at:till], part)[same], i[same], period[same]
        at = till


def runs_of(codes: np.ndarray, n: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """Runs of documents with ``n`` words each: rows doc, start, length, period, by document, start and period."""
    first = np.cumsum(n) - n + np.arange(len(n)) + 1
    sequence = np.empty(len(codes) + len(n) + 1, np.int64)
    separators = np.concatenate(([0], first + n))
    sequence[separators] = (codes.max() if len(codes) else 0) + 1 + np.arange(len(separators))
    inside = np.ones(len(sequence), bool)
    inside[separators] = False
    sequence[inside] = codes
    grammar, found = None, [np.zeros((0, 4), np.int64)]
    for doc, i, q in candidates(sequence, first, n, min_length, exponent):
        if not len(i):
            continue
        grammar = grammar or Grammar(sequence, len(n))
        before = grammar.behind(i - 1, i + q - 1)
        length = before + grammar.ahead(i, i + q) + q
        keep = length >= np.maximum(min_length, exponent * q)
        found.append(np.stack([doc, i - before - first[doc], length, q], axis=1)[keep])
    rows = np.concatenate(found)
    # A stretch that is found with several periods has the least: the others are its multiples.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _repeated(n: np.ndarray, given: Sequence[pa.Array]) -> np.ndarray:
    """Place of the word that each place takes, where some documents repeat the words of (place, period) from it on."""
    first, at = np.cumsum(n) - n, np.arange(n.sum())
    if given:
        place, period = given
        for d in np.flatnonzero(pc.and_(place.is_valid(), period.is_valid()).to_numpy(zero_copy_only=False)):
            a, p = place[d].as_py(), period[d].as_py()
            if p > 0 and 0 <= a < n[d]:
                at[first[d] + a : first[d] + n[d]] = first[d] + a + np.arange(n[d] - a) % p
    return at


def _chunk(texts: pa.Array, given: Sequence[pa.Array], min_length: int, exponent: int) -> pa.StructArray:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(words, "")
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    n = np.bincount(owner, minlength=len(texts))
    if len(given):
        words = words.take(pa.array(_repeated(n, given)))
    codes = words.dictionary_encode().indices.to_numpy()
    rows = runs_of(codes, n, min_length, exponent)
    start = np.cumsum(n) - n
    change = np.zeros(len(codes) + 1, np.int64)
    doc, at, length, period = rows.T
    np.add.at(change, start[doc] + at + period, 1)
    np.add.at(change, start[doc] + at + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(np.bincount(owner[kept], minlength=len(texts)))))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept))), " ")
    each = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))
    fields = [pa.array(x, pa.int64()) for x in (at, length, period)]
    found = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(each, pa.int32()), found), joined], ["runs", "collapsed"])


def periodic_runs(
    text: Column, min_length: int = 6, exponent: int = 4, repeat: tuple[Column, Column] | None = None
) -> Column:
    """Runs of each text and the text without their repeats: runs, collapsed.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a longest stretch of words with smallest
    period q, at least ``min_length`` words and ``exponent`` q long; runs are in order of start and period. collapsed
    holds the words that no run has after its first q, joined by one space. A null, empty or blank text has
    no words, no runs and an empty collapsed text; texts do not affect each other, so repeated rows
    and the order of rows play no part. With ``repeat``, (place, period) columns of longs, the words of a text from
    that place on first become repeats of that many of them; null, a period below 1 or a place that the text
    lacks leave it as it is. Work grows with n log n, memory with about 200 bytes a
    word of the longest text, as a row's runs must be found in one place.
    """

    @F.arrow_udf(f"struct<runs:{RUNS},collapsed:string>")
    def column(values: pa.Array, *given: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy())
        parts, at = [], 0
        while at < len(values):
            till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            parts.append(_chunk(values.slice(at, till - at), [g.slice(at, till - at) for g in given], min_length, exponent))
            at = till
        return pa.concat_arrays(parts) if parts else _chunk(values, given, min_length, exponent)

    # As a deterministic one, Spark would move it into what reads its fields, and lambdas cannot hold it.
    return column.asNondeterministic()(text, *([] if repeat is None else repeat))
