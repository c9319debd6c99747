"""Media columns: texts as 8-bit audio, and features of audio as fixed-shape tensors with time spans.

``stored`` puts bytes losslessly into a media column, a mono 8-bit PCM WAV file a row. ``features`` reads such
files back and computes, for each whole file:

- polyphase resampling by UP/DOWN with a Kaiser-windowed sinc, one short filter a phase, no zero-stuffed signal;
- log-mel energies of overlapped Hann frames, every sample in a frame (the last is padded with silence);
- segments by hysteresis: a segment opens when a frame's energy reaches the upper threshold and lasts until it
  falls below the lower one; both are quantiles of the file's own frame energies.

The log-mel frames are cut into tensors of TENSOR_FRAMES x MELS, the last padded with zeros. A row holds them as an
Arrow IPC stream of the canonical fixed-shape tensor type, with the first and last second of each tensor and its
number of real frames; ``tensors_of`` reads it. Values are rounded to three decimals. Equal bytes give equal
features: nothing depends on the row's neighbours.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenqa.llm.workspace import bounded_batches, extended, text_slices

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 16
FRAME, HOP, FFT, MELS = 300, 120, 512, 24
TENSOR_FRAMES = 32
UPPER, LOWER = 0.7, 0.4
RATE_OUT = RATE * UP // DOWN


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(payload) + len(pad)) + b"WAVE" + head + payload + pad


def samples_of(file: bytes) -> bytes:
    """The samples of such a file, found by walking its chunks."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(file):
        name, size = struct.unpack_from("<4sI", file, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", file, at + 8)
        if name == b"data":
            if form is None or (form[0], form[1], form[5]) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
            return file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def phases() -> np.ndarray:
    """The polyphase filters, UP x TAPS, each reversed and of unit gain."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cutoff = 1 / max(UP, DOWN)
    h = np.sinc(n * cutoff) * np.kaiser(len(n), 8.0)
    bank = h.reshape(TAPS, UP).T
    return (bank / bank.sum(axis=1, keepdims=True))[:, ::-1].copy()


def resampled(x: np.ndarray) -> np.ndarray:
    """x at RATE to RATE * UP / DOWN; output m is at input time m * DOWN / UP."""
    n = -(-len(x) * UP // DOWN)
    half = TAPS // 2
    padded = np.concatenate([np.zeros(TAPS - 1 - half), x, np.zeros(half + DOWN)])
    windows = sliding_window_view(padded, TAPS)
    out = np.empty(n)
    for r in range(min(UP, n)):
        base, phase = divmod(r * DOWN, UP)
        count = len(range(r, n, UP))
        out[r::UP] = windows[base : base + DOWN * (count - 1) + 1 : DOWN] @ phases()[phase]
    return out


@cache
def mel_bank() -> np.ndarray:
    """Triangular filters, equally wide in mel, FFT bins x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE_OUT / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / RATE_OUT)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])))


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, log energy of each frame)."""
    n = 1 + -(-max(0, len(y) - FRAME) // HOP)
    padded = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y))])
    frames = sliding_window_view(padded, FRAME)[::HOP]
    mel, energy = np.empty((n, MELS)), np.empty(n)
    window = np.hanning(FRAME)
    for at in range(0, n, 2048):
        part = frames[at : at + 2048]
        power = np.abs(np.fft.rfft(part * window, FFT)) ** 2
        mel[at : at + 2048] = np.log(power @ mel_bank() + 1e-6)
        energy[at : at + 2048] = np.log((part**2).mean(axis=1) + 1e-9)
    return np.round(mel, 3), np.round(energy, 3)


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """(first, last second) of the active stretches, by hysteresis."""
    high, low = np.quantile(energy, [UPPER, LOWER])
    mark = np.where(energy >= high, 1, np.where(energy < low, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[at], -1) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    second = HOP / RATE_OUT
    return [(round(a * second, 3), round((b - 1) * second + FRAME / RATE_OUT, 3)) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
TENSOR_SCHEMA = pa.schema([("logmel", TENSOR), ("start", pa.float64()), ("end", pa.float64()), ("frames", pa.int32())])


def tensors(mel: np.ndarray) -> bytes:
    n = -(-len(mel) // TENSOR_FRAMES)
    block = np.zeros((n, TENSOR_FRAMES, MELS), np.float32)
    block.reshape(-1, MELS)[: len(mel)] = mel
    first = np.arange(n) * TENSOR_FRAMES
    real = np.minimum(len(mel) - first, TENSOR_FRAMES).astype(np.int32)
    values = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(block.ravel()), TENSOR_FRAMES * MELS))
    start = first * HOP / RATE_OUT
    batch = pa.RecordBatch.from_arrays([values, pa.array(start), pa.array(((first + real - 1) * HOP + FRAME) / RATE_OUT), pa.array(real)], schema=TENSOR_SCHEMA)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR_SCHEMA) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors_of(stored: bytes) -> pa.Table:
    """The tensors of a row: logmel (fixed-shape), start, end, frames."""
    with pa.ipc.open_stream(stored) as found:
        return found.read_all()


def analysed(payload: bytes) -> tuple[bytes, list[tuple[float, float]], list[float], int]:
    """(tensors, segments, mean of each log-mel band, frames) of 8-bit samples."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    mel, energy = log_mel(resampled(x))
    return tensors(mel), segments(energy), np.round(mel.mean(axis=0), 2).tolist(), len(mel)


def stored(docs: DataFrame, unit: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media) of ``docs`` (doc_id, text): the UTF-8 bytes, filled with bytes 0 to a positive multiple of ``unit``.

    A null text is empty. Every row gives one; repeated rows and null doc_ids are rows like any other. Other columns
    are ignored.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = extended(docs.select("doc_id"), n_bytes="long", media="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                files = [wav(b + b"\0" * (-len(b) % unit if b else unit)) for b in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return slim.mapInArrow(run, out)


FEATURES = {
    "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string",
    "frames": "int", "mean_mel": "array<double>", "spans": "array<struct<start:double,end:double>>", "tensors": "binary",
}


def features(media: DataFrame, tail: int = 64) -> DataFrame:
    """``media`` (media, ...) with the columns of FEATURES in place of the files."""
    bounded_batches(media.sparkSession)
    kept = [c for c in media.columns if c != "media" and c not in FEATURES]
    media = media.select(*kept, "media")
    spans = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "media"):
                files = part.column("media").to_pylist()
                payloads = [samples_of(f) for f in files]
                found = [analysed(p) for p in payloads]
                made = [
                    pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    pa.array([zlib.crc32(p[-tail:]) for p in payloads], pa.int64()), pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()), pa.array([f[3] for f in found], pa.int32()),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())), pa.array([[{"start": a, "end": b} for a, b in f[1]] for f in found], spans),
                    pa.array([f[0] for f in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, *FEATURES])

    return media.mapInArrow(run, extended(media.select(*kept), **FEATURES))
