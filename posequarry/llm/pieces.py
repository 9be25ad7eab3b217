"""SentencePiece encoding and decoding with the n best segmentations.

A text becomes a lattice of vocabulary pieces. A forward Viterbi pass scores
every prefix; those scores are the exact distance left for an A-star search that
walks back from the end, so it takes complete paths off its queue best first.

No piece crosses from a character into a space mark, so the lattice of a text is
a chain of the lattices of its words. The forward pass runs once per word and also
tells what its second best path loses; the n best of the text differ from the
best only in the words that lose least, and the search runs for those.

Texts are taken in blocks. The forward pass runs over all new words of a block at once, arc by
arc of their lattices, and ids of the texts are gathered from those of their words.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, tee

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
# Words a worker keeps in each half (searched ones too), and the longest that is kept and walked with others.
CACHED, SEARCHED, LONGEST = 300_000, 20_000, 64
# Characters of the texts of a block, and of the words that are walked at once.
BLOCK, WALKED = 1 << 20, 1 << 17


class Lattice:
    """Pieces with log scores, and searches over the lattice of a string."""

    def __init__(self, scores: dict[str, tuple[int, float]], bytes_at: list[int], byte_score: float):
        self.scores = scores
        self.bytes_at = bytes_at
        self.byte_score = byte_score
        # Every beginning of a piece; those that are no piece themselves have None.
        self.begun: dict[str, tuple | None] = {p[:k]: None for p in scores for k in range(1, len(p))}
        self.begun.update({p: ((i,), score) for p, (i, score) in scores.items()})
        self._trie()

    def _trie(self) -> None:
        """The beginnings as nodes from 0 (nothing begun): a child is at its parent's base plus the kind of its character."""
        node = {"": 0} | {p: k for k, p in enumerate(self.begun, 1)}
        self.piece, self.gain = np.full(len(node), -1, np.int32), np.full(len(node), -math.inf)
        for p, (i, score) in self.scores.items():
            self.piece[node[p]], self.gain[node[p]] = i, score
        kind = {c: k for k, c in enumerate(sorted({p[-1] for p in self.begun}), 1)}
        # 0 are characters that no piece has.
        self.kinds = np.zeros(0x110000, np.int32)
        self.kinds[[ord(c) for c in kind]] = list(kind.values())
        children: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in self.begun:
            children[node[p[:-1]]].append((kind[p[-1]], node[p]))
        self.base = np.zeros(len(node), np.int32)
        spread, rows = 4 * len(node), []
        taken = bytearray(spread + len(kind) + 1)
        for parent, mine in sorted(children.items(), key=lambda x: -len(x[1])):
            # Some places are tried, the end is always free.
            for at in chain(((parent * 40503 + k * 65537) % spread for k in range(1000)), [len(taken)]):
                if not any([taken[at + k] for k, _ in mine] if at < spread else ()):
                    break
            taken.extend(bytes(max(0, at + len(kind) + 1 - len(taken))))
            self.base[parent] = at
            for k, child in mine:
                taken[at + k] = 1
                rows.append((at + k, parent, child))
        self.owner, self.child = np.full(len(taken), -1, np.int32), np.zeros(len(taken), np.int32)
        if rows:
            at, parents, nodes = np.array(rows).T
            self.owner[at], self.child[at] = parents, nodes

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """(start, ids, score) of the pieces that end at each place; bytes only for a character no piece is."""
        found: list[list] = [[] for _ in range(len(word) + 1)]
        begun, size = self.begun, len(word)
        for start in range(size):
            for end in range(start + 1, size + 1):
                hit = begun.get(word[start:end], 0)
                if hit:
                    found[end].append((start, *hit))
                elif hit == 0:
                    break
            if word[start] not in self.scores:
                ids = tuple(self.bytes_at[b] for b in word[start].encode("utf-8"))
                found[start + 1].append((start, ids, self.byte_score * len(ids)))
        return found

    def forward(self, arcs: list[list[tuple[int, tuple[int, ...], float]]]) -> list[float]:
        """Viterbi score of every prefix."""
        best = [0.0]
        for ending in arcs[1:]:
            best.append(max([best[start] + score for start, _, score in ending]))
        return best

    def first_best(self, word: str) -> tuple[tuple[int, ...], float, float]:
        """ids and score of the best path, and what the second best loses (infinite without one).

        The second best leaves the best path, going back, at one place and goes on
        from there by the best prefix; the forward scores give its loss.
        """
        size, get = len(word), self.begun.get
        best, second, back = [0.0] + [-math.inf] * size, [-math.inf] * (size + 1), [(0, ())] * (size + 1)
        for start in range(size):
            so_far = best[start]
            hit = get(word[start])
            if hit is None and word[start] not in self.scores:
                raw = tuple(self.bytes_at[b] for b in word[start].encode("utf-8"))
                hit = (raw, self.byte_score * len(raw))
            end = start
            while True:
                end += 1
                if hit:
                    reached = so_far + hit[1]
                    if reached > best[end]:
                        second[end], best[end], back[end] = best[end], reached, (start, hit[0])
                    elif reached > second[end]:
                        second[end] = reached
                elif hit == 0:
                    break
                if end == size:
                    break
                hit = get(word[start : end + 1], 0)
        at, ids, loss = size, [], math.inf
        while at:
            loss = min(loss, best[at] - second[at])
            at, piece = back[at]
            ids.append(piece)
        ids.reverse()
        return tuple(chain.from_iterable(ids)), best[size], loss

    def first_bests(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``first_best`` of many words of 1 to LONGEST characters: number of ids, all ids, scores, losses."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        row, column, length, score, piece = self._all_arcs(words, size)
        # Arcs by start, then length, so that each place is reached in the order of first_best.
        key = (column * (LONGEST + 1) + length).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        key, row, length, score, piece = key[order], row[order], length[order], score[order], piece[order]
        best = np.full((int(size.max(initial=0)) + 1, len(words)), -math.inf)
        second, back = best.copy(), np.zeros(best.shape, np.int32)
        best[0] = 0.0
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for low, high in zip(cuts, cuts[1:]):
            start, more = divmod(int(key[low]), LONGEST + 1)
            at, end = row[low:high], start + more
            reached, old = best[start, at] + score[low:high], best[end, at]
            second[end, at] = np.maximum(second[end, at], np.minimum(old, reached))
            better = np.flatnonzero(reached > old)
            best[end, at[better]], back[end, at[better]] = reached[better], low + better
        place, rows, loss, steps = size.copy(), np.arange(len(words)), np.full(len(words), math.inf), []
        while len(rows):
            here = place[rows]
            loss[rows] = np.minimum(loss[rows], best[here, rows] - second[here, rows])
            arc = back[here, rows]
            steps.append((rows, arc))
            place[rows] = here - length[arc]
            rows = rows[place[rows] > 0]
        count = np.bincount(np.concatenate([r for r, _ in steps]), minlength=len(words))
        ends, arcs = np.cumsum(count), np.empty(int(count.sum()), np.int64)
        for k, (rows, arc) in enumerate(steps):
            arcs[ends[rows] - 1 - k] = arc
        ids = piece[arcs]
        raw = ids < 0
        if raw.any():
            points, which = np.unique(-1 - ids[raw], return_inverse=True)
            spelled = [[self.bytes_at[b] for b in chr(p).encode("utf-8")] for p in points.tolist()]
            width = np.ones(len(ids), np.int64)
            width[raw] = np.array([len(x) for x in spelled])[which]
            count = np.bincount(np.repeat(np.arange(len(words)), count), weights=width, minlength=len(words)).astype(np.int64)
            ids = np.repeat(ids, width)
            ids[ids < 0] = list(chain.from_iterable(spelled[k] for k in which.tolist()))
        return count, ids, best[size, np.arange(len(words))], loss

    def _all_arcs(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Word, start, length, score and id of every arc; a character spelled in bytes has minus its code point less 1."""
        # An empty place follows each word.
        first = np.cumsum(size + 1) - size - 1
        points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        kinds = self.kinds[points]
        kinds[first + size] = 0
        row = np.repeat(np.arange(len(words)), size)
        start = np.delete(np.arange(len(points)), first + size)
        column = start - first[row]
        live, node, found = np.arange(len(start)), np.zeros(len(start), np.int32), []
        for k in range(1, LONGEST + 1):
            slot = self.base[node] + kinds[start[live] + (k - 1)]
            hit = np.flatnonzero(self.owner[slot] == node)
            live, node = live[hit], self.child[slot[hit]]
            whole = np.flatnonzero(self.piece[node] >= 0)
            found.append((live[whole], np.full(len(whole), k), self.gain[node[whole]], self.piece[node[whole]]))
            if k == 1:
                none = np.ones(len(start), bool)
                none[live[whole]] = False
                none = np.flatnonzero(none)
                p = points[start[none]]
                width = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
                found.append((none, np.ones(len(none), np.int64), self.byte_score * width, (-1 - p).astype(np.int32)))
            if not len(live):
                break
        live, length, score, piece = (np.concatenate(x) for x in zip(*found))
        return row[live], column[live], length, score, piece

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids), best first; equal scores in the order found."""
        size = len(word)
        arcs = self.arcs(word)
        best = self.forward(arcs)
        found: list[tuple[float, tuple[int, ...]]] = []
        queue: list[tuple] = [(-best[size], 0, size, 0.0, None)]
        made = 0
        # A position left n times already lies on n better paths.
        left = [0] * (size + 1)
        while queue and len(found) < n:
            cost, _, at, behind, path = heapq.heappop(queue)
            if left[at] >= n:
                continue
            left[at] += 1
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for start, ids, score in arcs[at]:
                made += 1
                total = behind + score
                heapq.heappush(queue, (-(total + best[start]), made, start, total, (ids, path)))
        return found


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """The lattice of a model file.

    A unigram model stores log probabilities. A merge model stores minus the
    rank of a merge, which becomes one by Zipf's law: -log(1 + rank).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw, bytes_at = {}, [0] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_at[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            raw[piece] = (i, model.get_score(i))
    # Ranks are whole numbers; log probabilities are not.
    ranks = all(float(s).is_integer() for _, s in raw.values())
    scores = {p: (i, -math.log1p(-s) if ranks else s) for p, (i, s) in raw.items()}
    made = Lattice(scores, bytes_at, min((s for _, s in scores.values()), default=0.0) - 1.0)
    # Words can be searched one by one only where no piece reaches into the next.
    made.crosses = any(SPACE in p.lstrip(SPACE) for p in raw)
    return made


class _Recent:
    """What is known of words, kept for the recent ones: the older half goes when the newer is full."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, word: str):
        hit = self.new.get(word)
        if hit is None:
            hit = self.old.get(word)
            if hit is not None:
                self.put(word, hit)
        return hit

    def put(self, word: str, value) -> None:
        if len(word) <= LONGEST:
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            self.new[word] = value


@lru_cache(maxsize=4)
def _searched(path: str, n: int) -> _Recent:
    return _Recent(SEARCHED)


class _Words:
    """First best paths of words, numbered as they come; all go when they are too many."""

    def __init__(self, model: Lattice, size: int):
        self.model, self.size = model, size
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.ids, self.start, self.count = array("i"), array("q"), array("q")
        self.score, self.loss = array("d"), array("d")

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, which hold until the next call."""
        if len(self.number) > 2 * self.size or self.held > 2 * self.size * LONGEST:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        new.sort(key=len)
        low, chars = 0, 0
        for k, word in enumerate(new):
            if len(word) > LONGEST:
                if low < k:
                    self._add(new[low:k], *self.model.first_bests(new[low:k]))
                low = k + 1
                ids, score, loss = self.model.first_best(word)
                self._add([word], np.array([len(ids)]), np.array(ids, np.int32), np.array([score]), np.array([loss]))
                continue
            chars += len(word) + 1
            if chars >= WALKED:
                self._add(new[low : k + 1], *self.model.first_bests(new[low : k + 1]))
                low, chars = k + 1, 0
        if low < len(new):
            self._add(new[low:], *self.model.first_bests(new[low:]))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _add(self, words: list[str], count: np.ndarray, ids: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.held += sum(map(len, words))
        self.start.frombytes((len(self.ids) + np.cumsum(count) - count).astype(np.int64).tobytes())
        self.count.frombytes(count.astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        self.score.frombytes(score.tobytes())
        self.loss.frombytes(loss.tobytes())

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each of the words, and the ids of all in a row."""
        count = np.frombuffer(self.count, np.int64)[numbers]
        shift = np.frombuffer(self.start, np.int64)[numbers] - (np.cumsum(count) - count)
        return count, np.frombuffer(self.ids, np.int32)[np.repeat(shift, count) + np.arange(int(count.sum()))]

    def valued(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and losses of the words."""
        return np.frombuffer(self.score)[numbers], np.frombuffer(self.loss)[numbers]


@lru_cache(maxsize=4)
def _known(path: str, size: int) -> _Words:
    return _Words(lattice(path), size)


def split_words(text: str) -> list[str]:
    """Words with their leading space marks; concatenated they are the marked text."""
    text = text.replace(SPACE, " ")
    if text[:1] != " " != text[-1:] and "  " not in text:
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")
    words, held = [], ""
    for part in text.split(" "):
        held += SPACE
        if part:
            words.append(held + part)
            held = ""
    return words + [held] if held else words


def encode(text: str | None, path: str, n: int = 3, kept_words: int = CACHED) -> list[tuple[float, np.ndarray]]:
    """The n best segmentations (score, ids) of a text, best first; an empty text has none."""
    return next(encode_all([text], path, n, kept_words))


def encode_all(
    texts: Iterable[str | None], path: str, n: int = 3, kept_words: int = CACHED
) -> Iterator[list[tuple[float, np.ndarray]]]:
    """``encode`` of each text, worked out for blocks of them."""
    held, chars = [], 0
    for text in texts:
        held.append(text or "")
        chars += len(held[-1])
        if chars >= BLOCK:
            yield from _encoded(held, path, n, kept_words)
            held, chars = [], 0
    yield from _encoded(held, path, n, kept_words)


def _encoded(texts: list[str], path: str, n: int, kept_words: int) -> Iterator[list[tuple[float, np.ndarray]]]:
    model, known = lattice(path), _known(path, kept_words)
    split = [([SPACE + t.replace(" ", SPACE)] if model.crosses else split_words(t)) if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = list(chain.from_iterable(split))
    number = known.numbers(words)
    count, ids = known.gathered(number)
    # Where a text's words start, a word's ids, and a text's distinct words, of which the first places are known.
    text_at, ids_at = np.append(0, np.cumsum(sizes)).tolist(), np.append(0, np.cumsum(count))
    text = np.repeat(np.arange(len(texts)), sizes)
    _, first, often = np.unique(text * len(known.number) + number, return_index=True, return_counts=True)
    distinct_at = np.searchsorted(text[first], np.arange(len(texts) + 1)).tolist()
    score, loss = known.valued(number[first])
    total = score * often
    for k in range(len(texts)):
        if not sizes[k]:
            yield []
            continue
        low, high, begin, stop = distinct_at[k], distinct_at[k + 1], text_at[k], text_at[k + 1]
        # A segmentation is a choice per word; its loss is the sum of the losses of the
        # choices. Only the n - 1 words with the smallest first loss can matter, each
        # at its first n - 1 places.
        near = low + np.flatnonzero(loss[low:high] < math.inf)
        if len(near) > n - 1 > 0:
            near = near[loss[near] <= np.partition(loss[near], n - 2)[n - 2]]
        sites = []
        for _, word, at in sorted((loss[i], words[first[i]], first[i]) for i in near.tolist())[: n - 1]:
            got = _n_best(word, path, n)
            sites += [(begin + p, got) for p in np.flatnonzero(number[begin:stop] == number[at])[: n - 1].tolist()]
        sites.sort(key=lambda x: x[0])
        combined: list[tuple[float, tuple]] = [(0.0, ())]
        for site, (_, got) in enumerate(sites):
            combined = heapq.nsmallest(
                n,
                [
                    (lost + got[0][0] - score, (*choice, (site, r)) if r else choice)
                    for lost, choice in combined
                    for r, (score, _) in enumerate(got)
                ],
            )
        cuts = [begin, *chain.from_iterable((at, at + 1) for at, _ in sites), stop]
        cuts = ids_at[cuts].tolist()
        parts = [ids[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
        best, out = math.fsum(total[low:high].tolist()), []
        for lost, choice in combined:
            rank = dict(choice)
            mine = [parts[0]]
            for site, (_, got) in enumerate(sites):
                mine += got[rank.get(site, 0)][1], parts[site + 1]
            out.append((best - lost, np.concatenate(mine)))
        yield out


def _n_best(word: str, path: str, n: int) -> list[tuple[float, np.ndarray]]:
    searched = _searched(path, n)
    got = searched.get(word)
    if got is None:
        got = [(score, np.array(ids, np.int32)) for score, ids in lattice(path).n_best(word, n)]
        searched.put(word, got)
    return got


def decode(ids: Iterable[int], path: str) -> str:
    """The text of the ids; byte pieces join to characters, the leading space mark goes."""
    text = "".join(_names(path)[np.asarray(ids, np.int32)].tolist())[1:]
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:  # bytes beyond ASCII
        return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _names(path: str) -> np.ndarray:
    """String of every id, with blanks for space marks; a byte beyond ASCII is the lone surrogate that stands for it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    names = [
        bytes([int(name[3:5], 16)]).decode("ascii", "surrogateescape") if model.is_byte(i) else name.replace(SPACE, " ")
        for i, name in enumerate(names)
    ]
    return np.array(names, object)


RESULT = "struct<ids: array<int>, n_ids: bigint, ids_sha256: string, scores: array<double>, n_best_ids: array<bigint>, n_best_sha256: array<string>, decoded_sha256: string, lossless: boolean>"


def segment(text: Column, path: str, n: int = 3, keep_ids: bool = True, kept_words: int = CACHED) -> Column:
    """The n best segmentations of a text column, decoded again; struct as in ``RESULT``.

    ids are the best segmentation's (null unless ``keep_ids``); digests are of the ids
    as little-endian 32-bit integers; lossless says whether the decoded text is
    the text with space marks read as spaces. Null and empty texts have no ids
    and no scores, and decode to the empty text. The path must be readable on every executor.
    ``kept_words`` bounds the words a worker remembers (twice as many and a block's), some 300 bytes each; results do not depend on it.
    """
    listed = {"ids": pa.list_(pa.int32()), "n_ids": pa.int64(), "ids_sha256": pa.string()}
    listed |= {"scores": pa.list_(pa.float64()), "n_best_ids": pa.list_(pa.int64()), "n_best_sha256": pa.list_(pa.string())}
    listed |= {"decoded_sha256": pa.string(), "lossless": pa.bool_()}

    @F.arrow_udf(RESULT)
    def column(values: pa.Array) -> pa.Array:
        out: dict[str, list] = {name: [] for name in listed}
        # One buffer for the ids of all texts, which Arrow takes over as it is.
        flat, ends = array("i"), [0]
        texts, same = tee(value.as_py() or "" for value in values)
        for text, best in zip(texts, encode_all(same, path, n, kept_words)):
            ids = best[0][1] if best else np.zeros(0, np.int32)
            digests = [hashlib.sha256(x.tobytes()).hexdigest() for _, x in best]
            decoded = decode(ids, path)
            if keep_ids:
                flat.frombytes(ids.tobytes())
                ends.append(len(flat))
            out["n_ids"].append(len(ids))
            out["ids_sha256"].append(digests[0] if digests else hashlib.sha256(b"").hexdigest())
            out["scores"].append([s for s, _ in best])
            out["n_best_ids"].append([len(x) for _, x in best])
            out["n_best_sha256"].append(digests)
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
            out["lossless"].append(decoded == text.replace(SPACE, " "))
        out["ids"] = [None] * len(values)
        columns = [pa.array(out[k], t) for k, t in listed.items()]
        if keep_ids:
            items = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
            columns[0] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
        return pa.StructArray.from_arrays(columns, names=list(listed))

    return column(text)
