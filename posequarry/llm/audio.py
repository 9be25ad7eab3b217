"""Audio features of media columns.

A payload is stored as a wave file of 8-bit samples and read back from it. Features are
taken from what was read: polyphase resampling, log-mel energies of overlapping
frames, and segments where the energy rises over one level and has not yet
fallen below a lower one. Every segment gives a tensor of one fixed shape with
its time span; a document's tensors are one Arrow stream.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posequarry.llm.common import saved

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 8
FRAME, HOP, MELS, BINS = 256, 128, 20, 4
# Samples resampled, and frames transformed, at a time.
BLOCK, FRAMES = 1 << 16, 1 << 12


def payload(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def to_wave(data: bytes, rate: int = RATE) -> bytes:
    """A RIFF wave file of one channel of unsigned 8-bit samples."""
    pad = len(data) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(data))
    return head + data + bytes(pad)


def from_wave(stored: bytes) -> bytes:
    """The samples of a wave file, found by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at = 12
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=4)
def _branches(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc filter as one column per output of a block: (window, up)."""
    half = taps * max(up, down) // 2
    t = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    full = np.sinc(t * cut) * cut * np.hamming(len(t)) * up
    reach = half // up + 1
    window = 2 * reach + down
    out = np.zeros((window, up), np.float32)
    for p in range(up):  # output p of a block lies at input place p * down / up
        for k in range(window):
            place = (k - reach) * up - p * down
            if -half <= place <= half:
                out[k, p] = full[place + half]
    return out


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase change of rate by up / down; blocks of ``down`` inputs give ``up`` outputs."""
    bank = _branches(up, down, taps)
    reach = (len(bank) - down) // 2
    blocks = -(-len(x) // down)
    padded = np.zeros(blocks * down + 2 * reach, np.float32)
    padded[reach : reach + len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(bank))[::down]
    parts = [np.ascontiguousarray(windows[s : s + BLOCK]) @ bank for s in range(0, blocks, BLOCK)]
    return np.concatenate(parts).reshape(-1)[: -(-len(x) * up // down)]


@lru_cache(maxsize=4)
def _filterbank(rate: float, frame: int, mels: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: float) -> np.ndarray:
    """Log-mel energies (frames, mels) of overlapping Hann frames, the last padded with zeros."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(y)] = y
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    hann, bank = np.hanning(FRAME).astype(np.float32), _filterbank(rate, FRAME, MELS)
    out = np.empty((n, MELS), np.float32)
    for s in range(0, n, FRAMES):
        power = np.abs(np.fft.rfft(frames[s : s + FRAMES] * hann, axis=1)) ** 2
        out[s : s + FRAMES] = np.log(power.astype(np.float32) @ bank + 1e-6)
    return out


def segments(energy: np.ndarray, high: float, low: float) -> np.ndarray:
    """(start, stop) frames from where the energy exceeds ``high`` to where it falls below ``low``."""
    mark = np.where(energy > high, 1, np.where(energy < low, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = (known >= 0) & (mark[np.maximum(known, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def pooled(mel: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Mean log-mel of ``BINS`` equal parts of every span: (spans, BINS, MELS)."""
    total = np.concatenate((np.zeros((1, mel.shape[1])), np.cumsum(mel, axis=0, dtype=np.float64)))
    start, stop = spans[:, :1], spans[:, 1:]
    k = np.arange(BINS)
    lo = start + (stop - start) * k // BINS
    hi = np.maximum(start + -(-(stop - start) * (k + 1) // BINS), lo + 1)
    return ((total[hi] - total[lo]) / (hi - lo)[:, :, None]).astype(np.float32)


def tensor_stream(tensors: np.ndarray, spans_ms: np.ndarray) -> bytes:
    """Arrow stream of start_ms, end_ms and a fixed-shape tensor per segment."""
    kind = pa.fixed_shape_tensor(pa.float32(), (BINS, MELS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1), pa.float32()), BINS * MELS)
    column = pa.ExtensionArray.from_storage(kind, flat)
    batch = pa.record_batch(
        [pa.array(spans_ms[:, 0]), pa.array(spans_ms[:, 1]), column], names=["start_ms", "end_ms", "tensor"]
    )
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tensors (segments, BINS, MELS) and spans in ms (segments, 2) of a stream."""
    table = pa.ipc.open_stream(stream).read_all()
    chunk = table["tensor"].combine_chunks()
    chunk = chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) else chunk
    tensors = chunk.to_numpy_ndarray() if len(chunk) else np.zeros((0, BINS, MELS), np.float32)
    return tensors, np.stack([table["start_ms"].to_numpy(), table["end_ms"].to_numpy()], axis=1)


def analyse(samples: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-mel, spans in frames, pooled tensors) of 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x), RATE * UP / DOWN)
    energy = mel.mean(axis=1)
    centre, spread = float(energy.mean()), float(energy.std())
    spans = segments(energy, centre + 0.5 * spread, centre - 0.25 * spread)
    return mel, spans, pooled(mel, spans)


def summary(tensors: np.ndarray, ms: np.ndarray) -> str:
    """Number and length of the segments, and the mean of each mel band over their tensors."""
    found = {
        "segments": len(tensors),
        "active_ms": int((ms[:, 1] - ms[:, 0]).sum()),
        "mel": [round(float(m), 1) + 0.0 for m in tensors.mean(axis=(0, 1), dtype=np.float64)] if len(tensors) else [],
    }
    return json.dumps(found, separators=(",", ":"))


def _struct(values: Iterable[dict], kinds: dict[str, pa.DataType]) -> pa.StructArray:
    out: dict[str, list] = {k: [] for k in kinds}
    for row in values:
        for k in kinds:
            out[k].append(row[k])
    return pa.StructArray.from_arrays([pa.array(out[k], kind) for k, kind in kinds.items()], names=list(kinds))


def stored_media(docs: DataFrame) -> DataFrame:
    """Each row's text as a wave file, written: all columns but text, and n_bytes and media.

    Null and empty texts are 64 zero bytes. Columns of these names are replaced. An empty table gives an empty one.
    """

    @F.arrow_udf("struct<n_bytes: bigint, media: binary>")
    def column(values: pa.Array) -> pa.Array:
        texts = (v.as_py() for v in values)
        rows = ({"n_bytes": len((t or "").encode("utf-8")), "media": to_wave(payload(t))} for t in texts)
        return _struct(rows, {"n_bytes": pa.int64(), "media": pa.binary()})

    kept = [c for c in docs.columns if c.lower() not in ("text", "n_bytes", "media", "_r")]
    rows = docs.select(*kept, column.asNondeterministic()(F.col("text")).alias("_r"))
    return saved(rows.select(*kept, "_r.*"), "media")


def stored_tensors(media: DataFrame) -> DataFrame:
    """What the media read back hold, written: payload and media digests, and tensors with time spans in place of media.

    ``tensors`` is an Arrow stream of one row per segment (start_ms, end_ms, a tensor of fixed shape).
    Long payloads are resampled and transformed in blocks. Equal media give equal values.
    """
    kinds = {
        "payload_bytes": pa.int64(),
        "payload_sha256": pa.string(),
        "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(),
        "media_sha256": pa.string(),
        "tensors": pa.binary(),
    }

    def read(stored: bytes) -> dict:
        back = from_wave(stored)
        _, spans, tensors = analyse(back)
        ms = np.rint(spans * (HOP * 1000 / (RATE * UP / DOWN))).astype(np.int64)
        return {
            "payload_bytes": len(back),
            "payload_sha256": hashlib.sha256(back).hexdigest(),
            "tail_crc32": zlib.crc32(back[-64:]),
            "media_bytes": len(stored),
            "media_sha256": hashlib.sha256(stored).hexdigest(),
            "tensors": tensor_stream(tensors, ms),
        }

    sql = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}

    @F.arrow_udf("struct<" + ", ".join(f"{k}: {sql[kind]}" for k, kind in kinds.items()) + ">")
    def column(values: pa.Array) -> pa.Array:
        return _struct((read(v.as_py()) for v in values), kinds)

    kept = [c for c in media.columns if c not in ("media", "_r", *kinds)]
    rows = media.select(*kept, column.asNondeterministic()(F.col("media")).alias("_r"))
    return saved(rows.select(*kept, "_r.*"), "tensors")


def feature(tensors: Column) -> Column:
    """The summary of each stream of tensors."""

    @F.arrow_udf("string")
    def column(values: pa.Array) -> pa.Array:
        return pa.array((summary(*read_tensors(v.as_py())) for v in values), pa.string())

    return column(tensors)
