"""Media columns: bytes kept losslessly as 8-bit WAV audio, with spectral fingerprints.

A payload is written as the samples of a mono 8-bit WAV file by the `wave` module and read back from
it. Short-time Fourier transforms of what was read give spectral peaks; pairs of near peaks (two
frequencies and the time between them), each with its time code, form the fingerprint.

Frames overlap by half, from half a frame before the first sample to half a frame or more after the last, where the
samples are mirrored: each sample lies in two frames, in one of them well inside the window, and no step at an end
outweighs them. For the same reason the zero bytes that fill up a payload are stored but not transformed.

Defined results: null and empty texts have a payload of 64 zero bytes, which is transformed. Long payloads are transformed
in blocks of frames, so memory beyond the payload itself is bounded. Repeated rows give repeated
rows; extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.textops import bounded_slices

RATE, FRAME, HOP, BLOCK, FAN = 8000, 256, 128, 4096, 3
WINDOW = np.hanning(FRAME).astype(np.float32)


def pad(data: bytes, unit: int = 64) -> bytes:
    """data with zero bytes up to a positive multiple of unit."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as the samples of a mono 8-bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def spectra(samples: np.ndarray) -> Iterator[np.ndarray]:
    """The strength of each frequency in each frame, in blocks of frames."""
    n = -(-len(samples) // HOP) + 1
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        place = np.arange((at - 1) * HOP, (at + m) * HOP) % (2 * len(samples))
        part = samples[np.minimum(place, 2 * len(samples) - 1 - place)].astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        yield np.abs(np.fft.rfft(frames * WINDOW, axis=1))


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """The frequency bin of the strongest component of each frame, the mean aside."""
    return np.concatenate([power[:, 2:].argmax(axis=1) + 2 for power in spectra(samples)])


def fingerprint(samples: np.ndarray, fan: int = FAN) -> tuple[np.ndarray, np.ndarray]:
    """Codes (frequency, frequency, frames between) of peak pairs, and the frame of each."""
    peaks, codes, times = spectral_peaks(samples), [], []
    for gap in range(1, fan + 1):
        if len(peaks) > gap:
            codes.append((peaks[:-gap] << 16) | (peaks[gap:] << 4) | gap)
            times.append(np.arange(len(peaks) - gap))
    if not codes:
        return peaks << 16, np.zeros(1, dtype=np.int64)
    codes, times = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((codes, times))
    return codes[order], times[order]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bounded_slices(batch, 1, 256):
            media, codes, times, sizes = [], [], [], []
            for text in part.column(1).to_pylist():
                data = (text or "").encode()
                media.append(to_wav(pad(data)))
                sizes.append(len(data))
                c, t = fingerprint(np.frombuffer(from_wav(media[-1]), dtype=np.uint8)[: len(data) or None])
                codes.append(c)
                times.append(t)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(codes, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], names=["id", "n_bytes", "media", "codes", "times"])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, media (the WAV file) and its fingerprint as codes and times."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(_rows, f"id {kind}, n_bytes long, media binary, codes array<long>, times array<long>").withColumnRenamed("id", id_col)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for n, stored, codes, times in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4), strict=True):
            raw = stored.as_py()
            payload = from_wav(raw)
            pairs = np.stack([codes.values.to_numpy(), times.values.to_numpy()])
            feature = f"{pairs.shape[1]}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()[:32]}"
            out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored media hold: sizes, digests of the payload read back and of the file, and a digest of the fingerprint."""
    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", "media", "codes", "times").mapInArrow(_digests, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
