"""Audio features of media columns: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segments.

Samples are 8-bit unsigned PCM, stored losslessly as WAV. Features are cut into tensors of one fixed shape (frames x
bands) with their time spans, so that Arrow and trainers can map them without looking at lengths. Spark has no type of fixed shape:
the values are arrays whose field carries the name and shape of Arrow's tensor type as metadata, in the schema and in written Parquet.
"""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandflow.llm.shared import drop_columns, mapped, named, slices

#: Frames of a tensor.
TENSOR_FRAMES = 64
#: Resampled samples that are turned into frames at once; bounds the memory of a long recording.
BLOCK_FRAMES = 4096


def wav_bytes(samples: bytes, rate: int) -> bytes:
    """A mono 8-bit PCM WAV file of the samples."""
    pad = len(samples) % 2  # RIFF chunks have even sizes
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """The samples and rate of a mono 8-bit PCM WAV file; chunks of other kinds are passed over."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


class LogMel:
    """Resampler and filterbank of one setting."""

    def __init__(self, rate_in: int, rate: int, window: int, hop: int, bands: int, taps_per_phase: int = 16):
        self.rate, self.window, self.hop, self.bands = rate, window, hop, bands
        g = gcd(rate_in, rate)
        self.up, self.down = rate // g, rate_in // g
        cut = 1 / max(self.up, self.down)
        n = taps_per_phase * self.up * max(1, -(-self.down // self.up))
        t = np.arange(n) - (n - 1) / 2
        taps = np.sinc(t * cut) * cut * np.hamming(n) * self.up
        #: Row p: the taps that meet the input for outputs of phase p, newest sample last.
        self.phases = np.stack([np.pad(taps[p :: self.up], (0, -(-n // self.up) - len(taps[p :: self.up])))[::-1] for p in range(self.up)])
        self.hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        self.bank = self.filters()

    def filters(self) -> np.ndarray:
        """Triangles evenly spaced on the mel scale, bins x bands."""
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(self.rate / 2), self.bands + 2) / 2595) - 1)
        f = np.arange(self.window // 2 + 1) * self.rate / self.window
        low, mid, high = edges[:-2], edges[1:-1], edges[2:]
        return np.maximum(0, np.minimum((f[:, None] - low) / (mid - low), (high - f[:, None]) / (high - mid)))

    def size(self, n: int) -> int:
        """Outputs of n inputs."""
        return -(-n * self.up // self.down)

    def resampled(self, x: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        """Outputs first to end - 1. Polyphase: output i is one phase's taps over the input around i * down // up; no zero-stuffed signal is
        formed, and only the inputs that these outputs meet are read."""
        end = self.size(len(x)) if end is None else end
        if self.up == self.down:
            return x[first:end]
        width = self.phases.shape[1]
        low, high = first * self.down // self.up - width // 2, (end - 1) * self.down // self.up - width // 2 + width
        part = x[max(0, low) : max(0, high)]
        part = np.r_[np.zeros(max(0, -low)), part, np.zeros(max(0, high - low - len(part) - max(0, -low)))]
        views = np.lib.stride_tricks.sliding_window_view(part, width)
        i = np.arange(first, end)
        start, phase = i * self.down // self.up - (low + width // 2), i * self.down % self.up
        out = np.empty(len(i))
        for p in np.unique(phase):
            of = np.flatnonzero(phase == p)
            step = (start[of[1]] - start[of[0]]) if len(of) > 1 else 1
            out[of] = np.einsum("ij,j->i", views[start[of[0]] :: step][: len(of)], self.phases[p])
        return out

    def blocks(self, samples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Log-mel rows (frames x bands, float32) and frame energies in dB of 8-bit samples, block by block: beside the samples
        only a block is held as floats. The tail is padded with silence to a whole frame."""
        size = self.size(len(samples))
        n = 1 + max(0, -(-(size - self.window) // self.hop))
        for k in range(0, n, BLOCK_FRAMES):
            count = min(BLOCK_FRAMES, n - k)
            first, end = k * self.hop, (k + count - 1) * self.hop + self.window
            yield self.frames(np.r_[self.heard(samples, first, min(end, size)), np.zeros(max(0, end - max(first, size)))], count)

    def heard(self, samples: np.ndarray, first: int, end: int) -> np.ndarray:
        """Resampled outputs first to end - 1 of 8-bit samples, as floats of -1 to 1."""
        if end <= first:
            return np.zeros(0)
        low = max(0, first * self.down // self.up - self.phases.shape[1])
        high = end * self.down // self.up + self.phases.shape[1] + 1
        # cut at a multiple of down, so that the part's outputs have the phases of the whole
        low -= low % self.down
        x = (samples[low:high].astype(np.float64) - 128) / 128
        skip = low // self.down * self.up
        if low:
            return self.resampled(x, first - skip, end - skip)
        return self.resampled(x, first, end)

    def frames(self, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        part = np.lib.stride_tricks.sliding_window_view(y, self.window)[:: self.hop][:count]
        power = np.abs(np.fft.rfft(part * self.hann)) ** 2
        return np.log(power @ self.bank + 1e-10).astype(np.float32), 10 * np.log10((part * part).mean(axis=1) + 1e-12)


@functools.lru_cache(maxsize=4)
def log_mel(rate_in: int, rate: int, window: int, hop: int, bands: int) -> LogMel:
    return LogMel(rate_in, rate, window, hop, bands)


def hysteresis_segments(energy: np.ndarray, above: float = 3.0, below: float = 0.0, least: int = 3) -> np.ndarray:
    """(first, end) frames of the active stretches: one opens where the energy reaches the median + above dB and closes where it falls under the median + below dB; stretches under least frames go."""
    level = float(np.median(energy))
    mark = np.where(energy >= level + above, 1, np.where(energy < level + below, 0, -1))
    # a frame between the thresholds keeps the state of the last decided frame before it
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    state = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    turns = np.diff(np.r_[0, state, 0])
    spans = np.c_[np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)]
    return spans[spans[:, 1] - spans[:, 0] >= least]


def store_samples(df: DataFrame, payload: str, rate: int = 16000, block: int = 64) -> DataFrame:
    """df with media, the payload's bytes as 8-bit samples of a WAV file. Payloads are padded by zero bytes to a positive multiple of
    block; a null one is empty; equal ones give equal files. A column of df named media is replaced; an empty df gives no rows.
    WAV holds up to 4 GB; Spark's binaries are smaller."""
    df = df if payload.lower() == "media" else drop_columns(df, "media")
    kept = [c for c in df.columns if c.lower() != "media"]
    given = df.select(*[named(c) for c in kept], F.col(payload).alias("_payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_payload"):
            media = []
            for raw in part.column("_payload"):
                raw = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                media.append(wav_bytes(raw.ljust(max(block, -(-len(raw) // block) * block), b"\0"), rate))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(media, pa.binary())], [*part.schema.names[:-1], "media"])

    return mapped(given, run, "media binary", without="_payload")


SPAN = "struct<start_s:double,end_s:double>"


def feature_fields(frames: int, bands: int) -> T.StructType:
    """The new columns. The tensor values' field carries the name and shape of Arrow's fixed-shape tensor type, which as_tensor_array reads."""
    plain = T.StructType.fromDDL(f"payload binary, n_samples bigint, n_frames bigint, segments array<{SPAN}>")
    shape = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": [frames, bands]})}
    values = T.StructField("log_mel", T.ArrayType(T.FloatType(), False), False, shape)
    cell = T.StructType([*T.StructType.fromDDL("start_s double, end_s double, n_frames int").fields, values])
    return plain.add("tensors", T.ArrayType(cell))


def audio_features(df: DataFrame, media: str = "media", rate: int = 8000, window: int = 256, hop: int = 128, bands: int = 24, frames: int = TENSOR_FRAMES) -> DataFrame:
    """df with payload (the samples read back), n_samples, n_frames, segments and tensors of each WAV file.

    A tensor holds frames x bands log-mel values of its time span, the last one filled up with zeros behind its n_frames.
    Equal files give equal values whatever else is in the batch: no operation spans two files. A null file gives nulls;
    one without samples is one silent frame; a file that isn't WAV is an error. Long files are resampled and framed in blocks, so that
    floats of a block alone are held. Columns of df with the new names are replaced; an empty df gives no rows.
    """
    new = feature_fields(frames, bands)
    df = drop_columns(df, *[f.name for f in new.fields if f.name != media.lower()])
    types = to_arrow_schema(T.StructType([new["segments"], new["tensors"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media, 1 << 20):
            payloads, samples, counts, segments, spans, mels, offsets = [], [], [], [], [], [], [0]
            for raw in part.column(media):
                if not raw.is_valid:
                    payloads.append(None), samples.append(None), counts.append(None), segments.append(None), offsets.append(offsets[-1])
                    continue
                data, rate_in = wav_samples(raw.as_buffer().to_pybytes())
                own = log_mel(rate_in, rate, window, hop, bands)
                mel, energy = (np.concatenate(x) for x in zip(*own.blocks(np.frombuffer(data, np.uint8)), strict=True))
                second = hop / rate
                segments.append([{"start_s": a * second, "end_s": ((b - 1) * hop + window) / rate} for a, b in hysteresis_segments(energy).tolist()])
                whole = -(-len(mel) // frames)
                mels.append(np.pad(mel, ((0, whole * frames - len(mel)), (0, 0))).reshape(whole, frames, bands))
                for k in range(whole):
                    held = min(frames, len(mel) - k * frames)
                    spans.append((k * frames * second, ((k * frames + held - 1) * hop + window) / rate, held))
                payloads.append(data), samples.append(len(data)), counts.append(len(mel)), offsets.append(offsets[-1] + whole)
            values = np.concatenate(mels).ravel() if mels else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(spans) + 1, dtype=np.int32) * frames * bands), pa.array(values))
            cell = types.field("tensors").type.value_type
            cells = pa.StructArray.from_arrays([*(pa.array([s[k] for s in spans], cell.field(k).type) for k in range(3)), lists], names=[cell.field(k).name for k in range(4)])
            null = pa.array([p is None for p in payloads])
            tensors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells, mask=null)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(payloads, pa.binary()), pa.array(samples, pa.int64()), pa.array(counts, pa.int64()), pa.array(segments, types.field("segments").type), tensors],
                [*part.schema.names, "payload", "n_samples", "n_frames", "segments", "tensors"],
            )

    return mapped(df, run, new)


def tensor_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tensor_no, start_s, end_s, n_frames, log_mel: one row a tensor, a flat table whose log_mel is a fixed-shape tensor column to Arrow."""
    shape = df.schema["tensors"].dataType.elementType["log_mel"].metadata
    each = df.select(*keys, F.posexplode("tensors").alias("tensor_no", "_t"))
    return each.select(*keys, "tensor_no", "_t.start_s", "_t.end_s", "_t.n_frames", F.col("_t.log_mel").alias("log_mel", metadata=shape))


def as_tensor_table(rows: DataFrame) -> pa.Table:
    """tensor_rows exported to Arrow, log_mel as Arrow's fixed-shape tensor type with the shape that the column's metadata tells. For a part that fits the caller."""
    frames, bands = json.loads(rows.schema["log_mel"].metadata["ARROW:extension:metadata"])["shape"]
    table = rows.toArrow().combine_chunks()
    at = table.schema.get_field_index("log_mel")
    values = table.column(at).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float32()))
    return table.set_column(at, "log_mel", as_tensor_array(values, frames, bands))


def as_tensor_array(lists: pa.Array, frames: int = TENSOR_FRAMES, bands: int = 24) -> pa.FixedShapeTensorArray:
    """The log_mel lists of collected or exported tensors as Arrow's fixed-shape tensor type, without a copy of the values."""
    flat = lists.flatten()
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (frames, bands)), pa.FixedSizeListArray.from_arrays(flat, frames * bands))
