"""Media columns: texts as WAV clips that are read by the wave module, and spectral fingerprints as time-coded arrays.

A payload is the UTF-8 text, filled with blanks to a positive multiple of 192 bytes, and stored as 8-bit samples. Of a
clip that is read back, short-time Fourier transforms over blocks of overlapping frames give a spectrogram. Its peaks are
the places that exceed all around them, by up to REACH frequencies in their own frame and the two beside it. A peak and
each of the next FAN peaks, up to ZONE frames on, are a pair, coded as both frequencies, their distance in time and the
ratio of their magnitudes in STEPS to an octave, at the first one's time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

UNIT, RATE, TAIL = 192, 8000, 16

#: Samples of a frame and from one to the next, reach of a peak in frequency, later peaks that a peak is paired with, frames
#: between the two at most, steps of an octave of magnitude, and frames that are transformed at once.
FRAME, HOP, REACH, FAN, ZONE, STEPS, BLOCK = 64, 32, 2, 2, 63, 4, 16_384

_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectrogram(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Magnitudes of `count` frames from the `first` on, the constant left out; frames go past the end in silence."""
    part = samples[first * HOP : (first + count - 1) * HOP + FRAME]
    padded = np.full((count - 1) * HOP + FRAME, 128, np.float32)
    padded[: len(part)] = part
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP] - np.float32(128)
    frames -= frames.mean(axis=1, keepdims=True)
    frames *= _WINDOW
    return np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32).round(1)[:, 1:]


def peaks(samples: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times (frames) and frequencies (bins from 0) of all peaks, in this order, and their levels (STEPS to an octave).
    Equal neighbours are all peaks. Frames that are not marked as own are silent."""
    times, bins, levels = [], [], []
    for at in range(0, len(own), BLOCK):
        lo, hi = max(at - 1, 0), min(at + BLOCK + 1, len(own))
        power = spectrogram(samples, lo, hi - lo) * own[lo:hi, None]
        wide = np.pad(power, ((1, 1), (REACH, REACH)))
        across = wide[:, : power.shape[1]]
        for k in range(1, 2 * REACH + 1):
            across = np.maximum(across, wide[:, k : k + power.shape[1]])
        most = np.maximum(np.maximum(across[:-2], across[2:]), across[1:-1])
        here = slice(at - lo, min(at + BLOCK, len(own)) - lo)
        t, f = np.nonzero((power[here] > 0) & (power[here] == most[here]))
        times.append(t + at)
        bins.append(f)
        levels.append(np.rint(STEPS * np.log2(power[here][t, f])).astype(np.int64))
    return np.concatenate(times), np.concatenate(bins), np.concatenate(levels)


def fingerprint(payloads: list[bytes], fan: int = FAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each clip the times (frames) and codes of all pairs, in order of time, then of the first and the second peak.

    The clips are transformed as one stream with silence between them, which changes none of them."""
    frames = np.array([max(1, -(-len(p) // HOP)) for p in payloads], np.int64)
    gap = -(-FRAME // HOP)
    starts = np.cumsum(frames + gap) - frames - gap
    owner = np.repeat(np.arange(len(payloads)), frames + gap)
    stream = np.full(len(owner) * HOP, 128, np.uint8)
    for p, at in zip(payloads, (starts * HOP).tolist()):
        stream[at : at + len(p)] = np.frombuffer(p, np.uint8)
    time, freq, level = peaks(stream, np.arange(len(owner)) - starts[owner] < frames[owner])
    clip = owner[time]
    found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
    for d in range(1, min(fan, len(time) - 1) + 1):
        later = time[d:] - time[:-d]
        near = np.flatnonzero((later <= ZONE) & (clip[d:] == clip[:-d]))
        ratio = np.clip(level[near + d] - level[near], -32, 31) + 32
        for column, value in zip(found, (near, freq[near] << 17 | freq[near + d] << 12 | later[near] << 6 | ratio, near * (fan + 1) + d)):
            column.append(value)
    first, code, place = map(np.concatenate, found)
    order = np.argsort(place)
    first, code = first[order], code[order]
    cuts = np.searchsorted(clip[first], np.arange(1, len(payloads)))
    return list(zip(np.split(time[first] - starts[clip[first]], cuts), np.split(code, cuts)))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the WAV clip of each whole text. Null texts are empty: one unit of blanks."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(cols: list[list]) -> list[list]:
        data = [t or b"" for t in cols[1]]
        return [cols[0], [len(t) for t in data], [to_wav(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT)) for t in data]]

    return map_batches(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").cast("binary")), work, f"doc_id {kind}, n_bytes long, media binary", 64)


def read(clips: DataFrame) -> DataFrame:
    """clips with what their stored bytes give: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, and
    the fingerprint as time-coded arrays fp_times and fp_codes. Equal clips give equal values; repeated rows stay."""
    kind = clips.schema["doc_id"].dataType.simpleString()

    def work(cols: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(9)]
        payloads = list(map(from_wav, cols[2]))
        for doc_id, n, media, payload, (t, c) in zip(*cols, payloads, fingerprint(payloads)):
            for column, value in zip(out, (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), t, c)):
                column.append(value)
        return out

    return map_batches(clips.select("doc_id", "n_bytes", "media"), work, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fp_times array<int>, fp_codes array<int>", 64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df, in terms of store() and read(). Empty table: no rows. Other columns are not read."""
    return read(store(df, id_col, text_col))
