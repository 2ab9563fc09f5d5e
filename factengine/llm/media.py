"""Media columns: texts as WAV files, short-time Fourier transforms and spectral-peak pair fingerprints.

``to_wav`` stores bytes, zero-padded to a positive multiple of 64, as 8-bit mono
samples by the wave module; ``wav_features`` reads the stored file back. Both map
row by row without a shuffle; a worker holds one batch and transforms long
samples in blocks of BLOCK frames.

Fingerprints are arrays of longs, ``time << 32 | f1 << 18 | f2 << 8 | dt``: each
spectral peak paired with the FAN next peaks in time.

Defined results: null and empty texts give 64 zero samples; those have no peaks
and an empty fingerprint; equal texts give equal values; ids may be null or repeat.
"""

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fields, map_rows, utf8

RATE, FRAME, HOP, BLOCK, FAN, REACH = 8000, 512, 256, 2048, 2, 63
BANDS = ((1, 16), (16, 64), (64, 257))


def wav_bytes(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data + bytes(-len(data) % 64 if data else 64))
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectrogram(samples: np.ndarray):
    """Power spectra of Hann frames, in blocks of at most BLOCK frames."""
    x = samples.astype(np.float32) - 128
    short = FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP
    x = np.pad(x, (0, short), mode="edge")  # the last frame covers the end
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    hann = np.hanning(FRAME).astype(np.float32)
    for k in range(0, len(frames), BLOCK):
        part = frames[k : k + BLOCK]
        part = np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * hann, axis=1)
        yield part.real**2 + part.imag**2


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of each band's maxima that exceed the same band in both neighbouring frames."""
    best, power = [], []
    for block in spectrogram(samples):
        arg = [lo + block[:, lo:hi].argmax(axis=1) for lo, hi in BANDS]
        best.append(np.stack(arg, axis=1))
        power.append(np.stack([block[np.arange(len(block)), a] for a in arg], axis=1))
    best, power = np.concatenate(best), np.concatenate(power)
    edge = np.pad(power, ((1, 1), (0, 0)))
    t, b = np.nonzero((power > edge[:-2]) & (power >= edge[2:]) & (power > 1e-3))
    return t, best[t, b]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    t, f = (a.astype(np.int64) for a in peaks(samples))
    pairs = []
    for step in range(1, FAN + 1):
        dt = t[step:] - t[:-step]
        near = dt <= REACH
        pairs.append(((t[:-step] << 32) | (f[:-step] << 18) | (f[step:] << 8) | dt)[near])
    return np.sort(np.concatenate(pairs))


def to_wav(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep + (n_bytes, media): the text's UTF-8 bytes as a WAV file."""
    keep = list(keep)

    def make():
        return lambda r: (len(r[0]), wav_bytes(r[0]))

    return map_rows(docs.select(*keep, utf8().alias("__raw")), make, fields(docs, keep) + "n_bytes bigint, media binary", kept=len(keep))


def wav_features(media: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep + payload digests read back from the stored file + the fingerprint; media's own size and digest are JVM-side."""
    keep = list(keep)

    def make():
        def row(r):
            payload = wav_samples(r[0])
            codes = fingerprint(np.frombuffer(payload, np.uint8))
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), codes

        return row

    out = media.select(*keep, F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    head = fields(out, [*keep, "media_bytes", "media_sha256"])
    return map_rows(out, make, head + "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, fingerprint array<bigint>", kept=len(keep) + 2)
