"""Media columns: bytes stored as audio, and audio features of what is read back.

A payload is stored as 8-bit PCM in a WAV container, read back from the stored
bytes and analysed: polyphase resampling by ``UP / DOWN``, overlapped log-mel
filterbanks, and energy segmentation with hysteresis (a segment starts above the
upper threshold and lasts while the lower one is exceeded).  The filterbank is
pooled over time to a tensor of the fixed shape ``SHAPE``.

Edge cases: null texts count as empty and are stored as padding alone; equal
texts give equal values, whatever they are batched with; columns beyond the id
and the text are ignored.  Memory follows the longest single text.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import released

RATE = 16_000
UP, DOWN = 3, 4
TAPS = 12
BLOCK = 192
FRAME, HOP, FFT, MELS = 300, 120, 512, 40
SHAPE = (16, MELS)
UPPER, LOWER = 0.75, 0.25
#: Frames that are transformed at a time.
CHUNK = 2048


def store(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit mono samples; the payload's length is even."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def read_back(media: bytes) -> tuple[bytes, int]:
    """Samples and rate from the container's own chunks."""
    at, rate = 12, 0
    while at < len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def bank(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """The polyphase bank: column r makes the r-th of each ``up`` outputs from 2 * taps inputs around its place."""
    width = 2 * taps + down
    out = np.zeros((width, up), np.float32)
    cut = min(1.0, up / down)
    for r in range(up):
        t = np.arange(width) - taps - r * down / up
        w = np.where(np.abs(t) < taps, 0.5 + 0.5 * np.cos(np.pi * t / taps), 0.0)
        h = cut * np.sinc(cut * t) * w
        out[:, r] = h / h.sum()
    return out


def mel_bank(rate: float, n_fft: int = FFT, n: int = MELS) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), n + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


class Analyser:
    def __init__(self, rate: int = RATE):
        self.poly, self.rate = bank(), rate * UP / DOWN
        self.mel = mel_bank(self.rate)
        self.window = np.hanning(FRAME).astype(np.float32)

    def resample(self, x: np.ndarray) -> np.ndarray:
        blocks = -(-len(x) // DOWN)
        padded = np.zeros(blocks * DOWN + 2 * TAPS + DOWN, np.float32)
        padded[TAPS : TAPS + len(x)] = x
        rows = np.lib.stride_tricks.sliding_window_view(padded, len(self.poly))[::DOWN][:blocks]
        return (rows @ self.poly).reshape(-1)[: len(x) * UP // DOWN]

    def log_mel(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(frames, MELS) and each frame's energy in decibels."""
        if len(y) < FRAME:
            y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        mels, energy = [], []
        for k in range(0, len(frames), CHUNK):
            f = frames[k : k + CHUNK] * self.window
            power = np.fft.rfft(f, FFT)
            power = power.real**2 + power.imag**2
            mels.append(np.log(power @ self.mel + np.float32(1e-6)))
            energy.append(10 * np.log10(np.einsum("ij,ij->i", f, f) / FRAME + np.float32(1e-9)))
        return np.concatenate(mels), np.concatenate(energy)

    def segments(self, energy: np.ndarray) -> np.ndarray:
        """Frames [start, end) of each segment."""
        low, high = (np.quantile(energy, q) for q in (LOWER, UPPER))
        on = np.concatenate([[False], energy > low, [False]])
        edge = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
        loud = np.concatenate([[0], np.cumsum(energy > high)])
        return edge[loud[edge[:, 1]] > loud[edge[:, 0]]]

    def __call__(self, samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """The pooled tensor, the spans in milliseconds, and the number of frames."""
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        mel, energy = self.log_mel(self.resample(x))
        cuts = np.arange(SHAPE[0]) * len(mel) // SHAPE[0]
        if len(mel) >= SHAPE[0]:
            sums = np.add.reduceat(mel, cuts, axis=0)
            tensor = sums / np.diff(np.append(cuts, len(mel)))[:, None].astype(np.float32)
        else:
            tensor = mel[np.minimum(cuts, len(mel) - 1)]
        spans = self.segments(energy)
        ms = np.stack([spans[:, 0] * HOP, (spans[:, 1] - 1) * HOP + FRAME], 1) * 1000 / self.rate
        return tensor.astype(np.float32), ms, len(mel)


SPANS = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))


def tensor_batch(tensors: np.ndarray, spans: list[np.ndarray]) -> pa.RecordBatch:
    """A column of fixed-shape tensors and one of their time spans."""
    kind = pa.fixed_shape_tensor(pa.float32(), list(tensors.shape[1:]))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), int(np.prod(tensors.shape[1:])))
    times = pa.array([[{"start_ms": float(a), "end_ms": float(b)} for a, b in s] for s in spans], SPANS)
    return pa.record_batch([pa.ExtensionArray.from_storage(kind, flat), times], names=["log_mel", "spans"])


def to_stream(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


def from_stream(stream: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tensors and spans of a stored batch."""
    t = pa.ipc.open_stream(stream).read_all().combine_chunks()
    tensors = t["log_mel"].chunk(0).to_numpy_ndarray()
    return tensors, [np.array([(x["start_ms"], x["end_ms"]) for x in s]).reshape(-1, 2) for s in t["spans"].to_pylist()]


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
KEPT = "media binary, log_mel array<float>, spans array<struct<start_ms:double,end_ms:double>>"
#: Texts, and bytes of them, whose features are stored as one batch; a longer text is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def audio_features(docs: DataFrame, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what was stored and read back; with ``keep`` also the media, the tensor's values and its time spans.

    The features of a batch are stored as an Arrow stream with a fixed-shape tensor
    column and a column of spans, and the digest is taken of what is read back from it.
    """

    def run(batches):
        analyse = Analyser()

        def done(rows, tensors, spans, frames):
            tensors, spans = from_stream(to_stream(tensor_batch(np.stack(tensors), spans)))
            out = []
            for (*row, media), tensor, ms, n in zip(rows, tensors, spans, frames, strict=True):
                digest = hashlib.sha256(np.round(tensor, 2).tobytes() + np.round(ms).astype("<i8").tobytes()).hexdigest()[:32]
                row.append(f"{n}:{len(ms)}:{tensor.mean():.3f}:{digest}")
                out.append((*row, media, tensor.reshape(-1), [{"start_ms": a, "end_ms": b} for a, b in ms]) if keep else row)
            kinds = KINDS + [pa.binary(), pa.list_(pa.float32()), SPANS] * keep
            names = [f.split(" ")[0] for f in DIGEST.split(", ")] + ["media", "log_mel", "spans"] * keep
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            held, size = ([], [], [], []), 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                payload = raw + b" " * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))
                media = store(payload)
                back, _ = read_back(media)
                row = (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), media if keep else None)
                for h, x in zip(held, (row, *analyse(back)), strict=True):
                    h.append(x)
                size += len(raw)
                if size >= BATCH_BYTES or len(held[0]) == BATCH_ROWS:
                    yield done(*held)
                    held, size = ([], [], [], []), 0
            if held[0]:
                yield done(*held)

    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return t.mapInArrow(released(run), DIGEST + (f", {KEPT}" if keep else ""))


def tensor_streams(features: DataFrame) -> DataFrame:
    """doc_ids and stream: what ``audio_features`` kept, an Arrow stream with a fixed-shape tensor column for each batch of rows."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                spans = [np.array([(x["start_ms"], x["end_ms"]) for x in s]).reshape(-1, 2) for s in part.column(2).to_pylist()]
                tensors = np.array(part.column(1).to_pylist(), np.float32).reshape(-1, *SHAPE)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([to_stream(tensor_batch(tensors, spans))], pa.binary())], ["doc_ids", "stream"])

    return features.select("doc_id", "log_mel", "spans").mapInArrow(released(run), "doc_ids array<long>, stream binary")


def op6_audio_features(spark, sf_dir: str) -> DataFrame:
    """Store every whole document as audio and its features as tensors, read both back, and digest them."""
    return audio_features(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)
