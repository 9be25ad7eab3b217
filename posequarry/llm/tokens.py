"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are cut where no token can span: between a character that is no white
space and ASCII white space after it. The vocabulary's pattern ends every token
before such a place, and the text behind it starts a new match, so counts add
up. Pieces that repeat are encoded once; the rest goes to the encoder in batches of about
equal bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of one call of the encoder; pieces kept by a worker, and the longest kept.
BATCH_BYTES, CACHED, LONGEST = 1 << 18, 300_000, 64

_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# White space beyond ASCII: next to it a cut may change what a run of white space becomes.
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def safe_pieces(text: str) -> list[str]:
    """The text cut at safe boundaries; concatenated they are the text."""
    if not text.isascii() and _OTHER_SPACE.search(text):
        pieces, held = [], ""
        for piece in _PIECE.findall(text):
            held += piece
            if not held[-1].isspace():
                pieces.append(held)
                held = ""
        return pieces + [held] if held else pieces
    return _PIECE.findall(text)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made, {}


def count_batch(texts: list[str | None], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Tokens of each text (null: 0)."""
    tokenizer, known = _tokenizer(path)
    counts = []
    waiting: list[tuple[int, str, int]] = []  # (text, piece, times)
    for k, text in enumerate(texts):
        total = 0
        for piece, times in Counter(safe_pieces(text or "")).items():
            n = known.get(piece)
            if n is None:
                waiting.append((k, piece, times))
            else:
                total += n * times
        counts.append(total)
    new = list(dict.fromkeys(p for _, p, _ in waiting))
    lengths: dict[str, int] = {}
    start = 0
    while start < len(new):
        stop, size = start, 0
        while stop < len(new) and (stop == start or size + len(new[stop]) <= batch_bytes):
            size += len(new[stop])
            stop += 1
        part = new[start:stop]
        for piece, encoded in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            lengths[piece] = len(encoded)
        start = stop
    for k, piece, times in waiting:
        counts[k] += lengths[piece] * times
    if len(known) + len(lengths) > CACHED:
        known.clear()
    known.update(x for x in list(lengths.items())[:CACHED] if len(x[0]) <= LONGEST)
    return counts


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text column as the tokenizer file at ``path`` gives them, as a long.

    Nothing is added, cut off or padded; strings of special tokens inside a text
    count as the library's default has it. Null and empty texts have 0 tokens.
    The path must be readable on every executor.
    """

    @F.arrow_udf("bigint")
    def column(values: pa.Array) -> pa.Array:
        counts, held, size = [], [], 0
        for value in values:  # lists of texts of about 8 MB, whatever the rows of a batch
            text = value.as_py()
            held.append(text)
            size += len(text or "")
            if size > 8 << 20:
                counts += count_batch(held, path)
                held, size = [], 0
        return pa.array(counts + count_batch(held, path), pa.int64())

    return column(text)
