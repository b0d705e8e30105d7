"""Audio features of 8-bit mono samples: polyphase resampling, log-mel filterbanks and hysteresis segments.

All arithmetic up to the logarithm is on whole numbers that float32 or float64 hold exactly, and the logarithm is a fixed
function of exponent and mantissa, so that equal samples give equal features wherever they stand in a batch.
Null and empty texts become one block of spaces. Rows are handled each on its own: no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import cut, give_back, of_text

RATE, DOWN, BLOCK, TAPS = 48_000, 3, 192, 48
FRAME, HOP, MELS = 64, 32, 16
TENSOR_FRAMES = 32
STRIDE = 8192  # blocks worked on at a time
STEPS = 16  # steps of the fixed-point logarithm to an octave


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """payload as the samples of an unsigned 8-bit mono WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a WAV file."""
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: bytes) -> bytes:
    """text, with spaces up to a positive multiple of BLOCK."""
    return text + b" " * ((-len(text)) % BLOCK if text else BLOCK)


def _low_pass() -> np.ndarray:
    n = np.arange(TAPS) - (TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(TAPS)
    return np.rint(h / h.sum() * 256)


def _resampler() -> np.ndarray:
    """(BLOCK + TAPS) samples to the BLOCK / DOWN outputs of a block: the polyphase branches, side by side."""
    m, h = np.zeros((BLOCK + TAPS, BLOCK // DOWN), np.float32), _low_pass()
    for k in range(BLOCK // DOWN):
        m[k * DOWN : k * DOWN + TAPS, k] = h
    return m


def _spectra() -> np.ndarray:
    """FRAME samples to the real and imaginary parts of the windowed transform, in whole numbers."""
    n, k = np.arange(FRAME)[:, None], np.arange(FRAME // 2 + 1)[None]
    window = np.hanning(FRAME)[:, None]
    return np.rint(64 * np.hstack([np.cos(2 * np.pi * n * k / FRAME), np.sin(2 * np.pi * n * k / FRAME)]) * window).astype(np.float32)


def _mel_bank(rate: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    bank = np.rint(16 * np.clip(np.minimum(up, down), 0, None))
    bank[np.argmin(np.abs(f[:, None] - edges[None, 1:-1]), axis=0), np.arange(MELS)] += 1  # no filter is empty
    return bank


RESAMPLE, SPECTRA, MEL = _resampler(), _spectra(), _mel_bank(RATE // DOWN)


def fixed_log2(x: np.ndarray) -> np.ndarray:
    """log2(1 + x) in sixteenths, linear within each octave."""
    mantissa, exponent = np.frexp(x + 1.0)
    return ((exponent - 1) * STEPS + np.floor((mantissa - 0.5) * 2 * STEPS)).astype(np.int16)


def features(payloads: list[bytes]) -> list[dict]:
    """Log-mel frames (n x MELS, in sixteenths of an octave), frame energies and segments of each payload."""
    blocks = np.array([len(p) // BLOCK for p in payloads])
    first = np.cumsum(blocks + 1) - blocks  # a silent block stands before each payload
    flat = np.full((int((blocks + 1).sum()) + 1) * BLOCK + TAPS, 128, np.uint8)
    for at, payload in zip(first, payloads, strict=True):
        start = TAPS // 2 + at * BLOCK
        flat[start : start + len(payload)] = np.frombuffer(payload, np.uint8)
    n_blocks = (len(flat) - TAPS) // BLOCK
    mel, energy = np.zeros((2 * n_blocks, MELS), np.int16), np.zeros(2 * n_blocks, np.int16)
    for a in range(0, n_blocks - 1, STRIDE):  # so many blocks at a time, whatever the length of a payload
        b = min(a + STRIDE + 1, n_blocks)
        x = flat[a * BLOCK : b * BLOCK + TAPS].astype(np.float32) - 128
        windows = np.lib.stride_tricks.as_strided(x, (b - a, BLOCK + TAPS), (BLOCK * 4, 4))
        y = np.rint(windows @ RESAMPLE / 256).ravel()
        frames = np.lib.stride_tricks.as_strided(y, (len(y) // HOP - 1, FRAME), (HOP * y.itemsize, y.itemsize))
        parts = (frames @ SPECTRA).astype(np.float64)
        power = np.square(parts[:, : FRAME // 2 + 1]) + np.square(parts[:, FRAME // 2 + 1 :])
        mel[2 * a : 2 * a + len(frames)], energy[2 * a : 2 * a + len(frames)] = fixed_log2(power @ MEL), fixed_log2(power.sum(1))
    spans = [slice(2 * at, 2 * (at + n) - 1) for at, n in zip(first, blocks, strict=True)]
    return [{"mel": mel[s], "energy": energy[s], "segments": segments(energy[s])} for s in spans]


def segments(energy: np.ndarray, up: int = STEPS // 2, down: int = STEPS // 2) -> np.ndarray:
    """(start, end) frames of the stretches that begin `up` above the mean energy and last until `down` below it."""
    mean = int(energy.sum(dtype=np.int64)) // len(energy)
    event = np.where(energy >= mean + up, 1, np.where(energy < mean - down, -1, 0))
    event[0] = event[0] or -1
    at = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), 0))
    on = np.concatenate([[0], event[at] == 1, [0]])
    return np.stack([np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)], axis=1)


TENSOR = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS])


def tensors(mels: list[np.ndarray]) -> tuple[pa.ExtensionArray, np.ndarray, np.ndarray, np.ndarray]:
    """The frames of every payload as fixed-shape tensors, with the n + 1 offsets of the payloads in them and their time spans.

    A payload's last tensor is filled up with zeros; its span ends with its frames.
    """
    n = np.array([len(m) for m in mels])
    count = -(-n // TENSOR_FRAMES)
    offsets = np.append(0, np.cumsum(count))
    values = np.zeros((int(offsets[-1]) * TENSOR_FRAMES, MELS), np.float32)
    for at, mel in zip(offsets[:-1] * TENSOR_FRAMES, mels, strict=True):
        values[at : at + len(mel)] = mel
    values /= STEPS
    first = (np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)) * TENSOR_FRAMES
    last = np.minimum(first + TENSOR_FRAMES, np.repeat(n, count)) - 1
    made = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), TENSOR_FRAMES * MELS))
    return made, offsets, first * HOP * DOWN / RATE, (last * HOP + FRAME) * DOWN / RATE


def as_arrow_tensors(values: pa.Array) -> pa.ExtensionArray:
    """A column of tensors' values, as Spark gives it (lists of one length), as Arrow fixed-shape tensors again."""
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(values.flatten().cast(pa.float32()), TENSOR_FRAMES * MELS))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FULL = DIGEST + (
    ", media binary, tensors array<struct<start_s: double, end_s: double, values: array<float>>>, segments array<struct<start_s: double, end_s: double>>"
)


def audio_features(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """The whole texts of docs (doc_id, text, ...) stored as WAV samples, read back, and their features.

    Returns the columns of DIGEST and, with_media, the stored file, the log-mel tensors (TENSOR_FRAMES x MELS values each)
    and the segments with their time spans in seconds. feature is made from the tensors. Null and empty texts are one block
    of spaces; repeated rows and rows without a doc_id are rows like any other; other columns of docs are not read; an empty
    docs gives no rows. A text of any length is worked on STRIDE blocks at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", 2 << 20):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = [wav(padded(t)) for t in texts]
            payloads = [samples(m) for m in media]
            found = features(payloads)
            made, offsets, starts, ends = tensors([f["mel"] for f in found])
            stored = made.to_numpy_ndarray() if len(made) else np.zeros((0, TENSOR_FRAMES, MELS), np.float32)
            spans = [f["segments"] for f in found]
            digests = []
            for f, own, a, b in zip(found, spans, offsets[:-1], offsets[1:], strict=True):
                edges = f"{own[0, 0]}-{own[-1, 1]}" if len(own) else "-"
                digests.append(f"{len(f['mel'])}x{MELS}:{zlib.crc32(stored[a:b].tobytes()):08x}:{len(own)}:{int((own[:, 1] - own[:, 0]).sum())}:{edges}")
            columns = [
                batch.column("doc_id"), pa.array([len(t) for t in texts]), pa.array([len(p) for p in payloads]), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), pa.array([len(m) for m in media]), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(digests),
            ]
            if with_media:
                flat = np.concatenate(spans)
                at = np.append(0, np.cumsum([len(s) for s in spans])).astype(np.int32)
                values = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * TENSOR_FRAMES * MELS, made.storage.flatten())
                timed = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends), values], ["start_s", "end_s", "values"])
                loud = pa.StructArray.from_arrays([pa.array(flat[:, 0] * HOP * DOWN / RATE), pa.array(((flat[:, 1] - 1) * HOP + FRAME) * DOWN / RATE)], ["start_s", "end_s"])
                columns += [pa.array(media, pa.binary()), pa.ListArray.from_arrays(offsets.astype(np.int32), timed), pa.ListArray.from_arrays(at, loud)]
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    schema = FULL if with_media else DIGEST
    names = [c.split()[0] for c in DIGEST.split(", ")] + (["media", "tensors", "segments"] if with_media else [])
    return of_text(docs, "doc_id", "text").mapInArrow(run, schema)
