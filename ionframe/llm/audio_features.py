"""Audio features of media columns.

Media are WAV files (PCM, one channel, unsigned 8-bit samples) in a binary column.
:func:`features` reads the stored bytes and gives, for each file, the log-mel energies of
overlapping frames after polyphase resampling, cut into clips of a fixed shape and stored as
an Arrow stream whose ``mel`` column is a fixed-shape tensor of FRAMES x MELS float32 beside
the clips' time spans, and the spans of activity that a two-threshold (hysteresis) energy
detector finds.  Files of any sample rate are brought to RATE_OUT.  One file at a time is held
in memory, with some ten bytes for each of its samples; filters and transforms work in blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The padded payload is a multiple of this.
UNIT, FILLER = 576, b"\xff"
RATE_IN, RATE_OUT = 12000, 8000
#: Taps of the resampler on either side of a point, in periods of the lower of the two rates.
REACH = 16
FRAME, HOP, MELS, FRAMES = 256, 128, 40, 64
#: Rates above this are taken for damage.
MOST_RATE = 1 << 20
#: Decibels above the file's floor at which activity begins and goes on, and least frames.
ENTER_DB, STAY_DB, LEAST_FRAMES = 12.0, 6.0, 3
#: Frames that are transformed together.
BLOCK = 4096


def pad(text: bytes | None) -> bytes:
    """UTF-8 bytes with bytes 255 up to a positive multiple of UNIT; null counts as empty."""
    b = text or b""
    return b + FILLER * (max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b))


def to_wav(samples: bytes, rate: int = RATE_IN) -> bytes:
    """A WAV file whose samples are the given bytes, unchanged."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a WAV file; raises ValueError for other contents."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            if at + 24 > len(media):
                break
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8) or not 0 < rate <= MOST_RATE:
                raise ValueError("only one channel of 8-bit PCM is read")
        elif name == b"data" and rate is not None:
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


@lru_cache
def _phases(up: int, down: int) -> np.ndarray:
    """The windowed low-pass filter of the resampler, a row for each of the up phases: row p
    weighs the samples around a point that lies p / up after the middle one of its taps."""
    half = ceil(REACH * max(1, down / up))
    t = np.arange(2 * half) - half - np.arange(up)[:, None] / up
    cut = min(1, up / down)
    h = cut * np.sinc(cut * t) * np.cos(np.pi * np.clip(t / (2 * half), -0.5, 0.5)) ** 2
    return (h / h.sum(1, keepdims=True)).astype(np.float32)


@lru_cache
def _mel() -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale, of the FRAME // 2 + 1 bins."""
    def mel(f):
        return 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE_OUT / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * RATE_OUT / FRAME
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


def resample(x: np.ndarray, rate: int = RATE_IN) -> np.ndarray:
    """Polyphase resampling from rate to RATE_OUT with zero ends: with their ratio up / down in
    lowest terms, output i is at input i * down / up, which phase i * down % up interpolates."""
    up, down = RATE_OUT // gcd(RATE_OUT, rate), rate // gcd(RATE_OUT, rate)
    h = _phases(up, down)
    taps = h.shape[1]
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for phase in range(min(up, n)):
        first, count = phase * down // up, len(range(phase, n, up))
        for lo in range(0, count, 16 * BLOCK):
            hi = min(count, lo + 16 * BLOCK)
            out[phase::up][lo:hi] = windows[first + lo * down : first + (hi - 1) * down + 1 : down] @ h[phase * down % up]
    return out


def log_mel(y: np.ndarray) -> np.ndarray:
    """Log-mel energies of overlapping windowed frames; the end is filled with zeros."""
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)]) if (n - 1) * HOP + FRAME > len(y) else y
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((n, MELS), np.float32)
    for lo in range(0, n, BLOCK):
        power = np.abs(np.fft.rfft(frames[lo : lo + BLOCK] * window, axis=1)) ** 2
        out[lo : lo + BLOCK] = np.log(power.astype(np.float32) @ _mel() + 1e-10)
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [from, to) whose energy stays at least STAY_DB above the floor (the
    10th percentile) and reaches ENTER_DB; runs shorter than LEAST_FRAMES are dropped."""
    energy = 10 * np.log10(np.exp(mel).sum(1) + 1e-12)
    floor = np.quantile(energy, 0.1)
    stay = np.concatenate([[False], energy >= floor + STAY_DB, [False]])
    edges = np.flatnonzero(stay[1:] != stay[:-1]).reshape(-1, 2)
    enter = np.concatenate([[0], np.cumsum(energy >= floor + ENTER_DB)])
    return [(int(a), int(b)) for a, b in edges if b - a >= LEAST_FRAMES and enter[b] > enter[a]]


def tensors(mel: np.ndarray) -> bytes:
    """The clips as an Arrow stream: start_s, end_s, frames (used ones) and mel, a fixed-shape
    tensor; the last clip is filled with zeros."""
    n = max(1, -(-len(mel) // FRAMES))
    cube = np.zeros((n * FRAMES, MELS), np.float32)
    cube[: len(mel)] = mel
    first = np.arange(n) * FRAMES
    used = np.minimum(len(mel) - first, FRAMES)
    batch = pa.record_batch(
        [pa.array(first * HOP / RATE_OUT), pa.array(((first + used - 1) * HOP + FRAME) / RATE_OUT), pa.array(used.astype(np.int32)), pa.FixedShapeTensorArray.from_numpy_ndarray(cube.reshape(n, FRAMES, MELS))],
        names=["start_s", "end_s", "frames", "mel"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def analyse(samples: bytes, rate: int = RATE_IN) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Log-mel energies and the spans of activity in seconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, rate))
    return mel, [(a * HOP / RATE_OUT, ((b - 1) * HOP + FRAME) / RATE_OUT) for a, b in segments(mel)]


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WAV file; null text counts as empty."""

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame, keep_tensors: bool = True) -> DataFrame:
    """media (doc_id, n_bytes, media) with clips (the Arrow stream; null unless kept), spans,
    feature and the digests of the samples and of the file that were read.

    feature names frames, clips and spans and a digest of the energies in whole 1/8 nepers, so
    equal samples have equal features; clips_sha256 is the digest of the Arrow stream of clips.
    Media that are null or anything else than WAV files of one channel of 8-bit PCM keep
    doc_id and n_bytes and have null in all other columns.  Rows are independent; repeated
    rows come back as often; other columns are ignored.
    """

    def one(m: bytes | None) -> tuple:
        try:
            rate, samples = from_wav(m or b"")
        except ValueError:
            return (None,) * 9
        mel, spans = analyse(samples, rate)
        clips = tensors(mel)
        digest = hashlib.sha256(np.rint(mel * 8).astype("<i2").tobytes() + np.rint(np.array(spans).ravel() * 1000).astype("<i8").tobytes()).hexdigest()
        return (
            len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(m), hashlib.sha256(m).hexdigest(),
            f"frames={len(mel)};clips={-(-len(mel) // FRAMES)};spans={len(spans)};mel={digest}", hashlib.sha256(clips).hexdigest(), clips if keep_tensors else None, [{"start_s": a, "end_s": z} for a, z in spans],
        )

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.slice(lo, 64)
                out = [one(m) for m in part.column(2).to_pylist()]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips_sha256", "clips", "spans"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips_sha256 string, clips binary, spans array<struct<start_s: double, end_s: double>>"
    )
