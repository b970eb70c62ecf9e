"""Media columns: texts' bytes kept as WAV sound, with spectral fingerprints.

A payload is a text's UTF-8 bytes, zero-padded to a positive multiple of 64, stored as 8-bit mono samples by the wave
module. What is read back is cut into overlapping windows; the strongest frequencies of a window's short-time Fourier
transform are its peaks, and pairs of peaks in neighbouring windows are the fingerprint, as arrays of (time, code).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textkit import column_bytes

#: Bytes that a payload is a multiple of; samples a second; samples of a window and between windows; peaks of a window;
#: windows that a pair of peaks reaches over; windows transformed at a time.
UNIT, RATE, WINDOW, HOP, PEAKS, REACH, BLOCK = 64, 8000, 256, 128, 2, 2, 4096

_taper = np.hanning(WINDOW + 1)[:WINDOW].astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def n_windows(n: int) -> int:
    """Windows of n samples: as many as reach the last one, where silence fills up the last window."""
    return max(1, -(-(n - WINDOW) // HOP) + 1)


def peaks(samples: bytes) -> np.ndarray:
    """Window by PEAKS: frequency bins of the strongest local maxima, by strength; -1 where a window has fewer."""
    x = np.frombuffer(samples, dtype=np.uint8)
    x = np.concatenate((x, np.full(WINDOW + (n_windows(len(x)) - 1) * HOP - len(x), 128, dtype=np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    out = np.empty((len(windows), PEAKS), dtype=np.int16)
    for at in range(0, len(windows), BLOCK):
        part = (windows[at : at + BLOCK].astype(np.float32) - 128) * _taper
        bins = np.fft.rfft(part, axis=1)
        power = bins.real**2 + bins.imag**2
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        for k in range(PEAKS):
            best = inner.argmax(axis=1)
            row = np.arange(len(inner))
            out[at : at + len(inner), k] = np.where(inner[row, best] > 1e-3, best + 1, -1)
            inner[row, best] = 0
    return out


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time, code): the window of a pair's first peak, and bin, bin and distance of the pair in one number."""
    p = peaks(samples).astype(np.int64)
    times, codes = [], []
    for step in range(1, REACH + 1):
        for a in range(PEAKS):
            for b in range(PEAKS):
                first, second = p[:-step, a], p[step:, b]
                ok = np.flatnonzero((first >= 0) & (second >= 0))
                times.append(ok), codes.append((first[ok] << 16 | second[ok] << 4 | step))
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


CODED = "n_bytes long, media binary, times array<int>, codes array<int>"
_arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _batch(doc: pa.Array, out: list[dict], fields: list[T.StructField]) -> pa.RecordBatch:
    cols = [pa.array([r[f.name] for r in out], _arrow[f.dataType.simpleString()]) for f in fields]
    return pa.RecordBatch.from_arrays([doc, *cols], names=["doc", *[f.name for f in fields]])


def code_media(rows: DataFrame) -> DataFrame:
    """(doc, CODED) for `rows` (doc, text): the WAV file of the padded text, and the fingerprint of the samples read back."""
    fields = T.StructType.fromDDL(CODED).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = column_bytes(b.column(1))
            for at in range(0, b.num_rows, 64):
                out = []
                for i in range(at, min(at + 64, b.num_rows)):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    media = to_wav(raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)))
                    times, codes = fingerprint(from_wav(media))
                    out.append({"n_bytes": len(raw), "media": media, "times": times, "codes": codes})
                yield _batch(b.column(0).slice(at, 64), out, fields)

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *fields]))


def digest_media(coded: DataFrame, keep_media: bool) -> DataFrame:
    """(doc, FIELDS) of `coded` (doc, CODED), made from its columns alone, with these columns too if `keep_media`."""
    fields = T.StructType.fromDDL(FIELDS + (", media binary, times array<int>, codes array<int>" if keep_media else "")).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                n_bytes, files, times, codes = (part.column(i) for i in range(1, 5))
                for n, media, time, code in zip(n_bytes.to_pylist(), files.to_pylist(), times, codes):
                    back = from_wav(media)
                    time, code = time.values.to_numpy(), code.values.to_numpy()
                    feature = f"{n_windows(len(back))}:{len(time)}:{zlib.crc32(code.tobytes(), zlib.crc32(time.tobytes())):08x}"
                    one = {
                        "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-UNIT:]),
                        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature,
                    }
                    out.append(one | ({"media": media, "times": time, "codes": code} if keep_media else {}))
                yield _batch(part.column(0), out, fields)

    return coded.mapInArrow(run, T.StructType([coded.schema["doc"], *fields]))


def add_media(docs: DataFrame, text: str = "text", keep_media: bool = False) -> DataFrame:
    """`docs` without `text`, with FIELDS and, if `keep_media`, media (the WAV file), times and codes (its fingerprint).

    A null text counts as empty; an empty text's payload is UNIT zero bytes. feature sums the fingerprint up: windows,
    pairs, and a checksum of times and codes. Columns with those names are replaced; rows and the other columns stay.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    rest = [c for c in docs.columns if c != text and c not in (*names, "media", "times", "codes")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col(text).cast("string").alias("text"))
    out = digest_media(code_media(rows), keep_media)
    return out.select("doc.*", *out.columns[1:])


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
