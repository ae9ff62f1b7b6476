"""Media columns: WAV bytes in a column, frequencies by short-time Fourier transform, and fingerprints of spectral-peak pairs.

``encode_wav`` stores bytes losslessly as unsigned 8-bit mono samples; ``read_wav`` reads stored bytes by the wave
module; ``fingerprint_wav`` adds an array of time-coded peak pairs. All are maps over Arrow batches, without a
shuffle. Memory is bounded by one row and FRAMES frames of its transform.

Defined results: null or empty bytes are stored as one unit of zeros; a media column that is null, or no 8-bit mono
WAV, gives nulls in every column read from it; equal bytes give equal rows; input columns are kept, and one whose name
clashes with an added column is replaced.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

UNIT, RATE, WINDOW, HOP, PEAKS, REACH, FRAMES = 64, 8000, 256, 128, 2, 2, 8192


def to_wav(raw: bytes | None, unit: int = UNIT, rate: int = RATE) -> bytes:
    raw = raw or b""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(raw + bytes(-len(raw) % unit if raw else unit))
    return out.getvalue()


def from_wav(media: bytes | None) -> bytes | None:
    if media is None:
        return None
    try:
        with wave.open(io.BytesIO(media), "rb") as w:
            if (w.getnchannels(), w.getsampwidth()) != (1, 1):
                return None
            return w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None


def frequency_peaks(payload: bytes) -> np.ndarray:
    """(frames, PEAKS) frequency bins: the strongest local maxima of each frame, -1 where there are fewer."""
    x = np.frombuffer(payload, np.uint8)
    # Silence up to one window, or to a whole number of hops, so that the last samples are in a frame too.
    short = max(WINDOW - len(x), -len(x) % HOP)
    if short:
        x = np.concatenate([x, np.full(short, 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    taper = np.hanning(WINDOW).astype(np.float32)
    found = []
    for at in range(0, len(frames), FRAMES):
        spec = np.abs(np.fft.rfft((frames[at : at + FRAMES].astype(np.float32) - 128) * taper, axis=1))
        power = np.rint(spec * 4).astype(np.int64)  # whole numbers: ties don't hang on the last bits of a float
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner * 256 + np.arange(inner.shape[1])[::-1], -1)
        best = np.sort(np.partition(top, -PEAKS, axis=1)[:, -PEAKS:], axis=1)[:, ::-1]
        found.append(np.where(best >= 0, inner.shape[1] - (best & 255), -1))
    return np.concatenate(found)


def peak_pairs(peaks: np.ndarray) -> np.ndarray:
    """Codes time << 24 | first bin << 16 | second bin << 8 | frames between, in ascending order."""
    codes = []
    for gap in range(1, REACH + 1):
        if len(peaks) <= gap:
            break
        a, b = peaks[:-gap], peaks[gap:]
        t = np.arange(len(a), dtype=np.int64)[:, None, None]
        code = (t << 24) | (a[:, :, None] << 16) | (b[:, None, :] << 8) | gap
        codes.append(code[(a[:, :, None] >= 0) & (b[:, None, :] >= 0)])
    return np.sort(np.concatenate(codes)) if codes else np.empty(0, np.int64)


def _mapped(df: DataFrame, source: str, added: list[tuple[str, T.DataType, pa.DataType]], row) -> DataFrame:
    """``df`` with the columns ``added``, of which ``row(bytes)`` gives the values."""
    ship(df.sparkSession)
    names = {n for n, _, _ in added}
    kept = [f.name for f in df.schema.fields if f.name not in names]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, t) for n, t, _ in added])

    def run(batches):
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 512):
                b = whole.slice(at, 512)
                rows = [row(x.as_py()) for x in b.column(b.schema.get_field_index(source))]
                new = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + new, names=kept + [n for n, _, _ in added])

    return df.mapInArrow(run, schema)


def encode_wav(df: DataFrame, source: str, media: str = "media", unit: int = UNIT, rate: int = RATE) -> DataFrame:
    """Adds ``media``: the bytes of column ``source`` as a WAV file, padded by bytes 0 to a positive multiple of unit."""
    return _mapped(df, source, [(media, T.BinaryType(), pa.binary())], lambda raw: (to_wav(raw, unit, rate),))


def read_wav(df: DataFrame, media: str = "media", unit: int = UNIT) -> DataFrame:
    """Adds what the stored samples give: payload_bytes, payload_sha256, tail_crc32 (of the last unit) and
    ``fingerprint``, the array of time-coded spectral peak pairs."""

    def row(stored):
        payload = from_wav(stored)
        if payload is None:
            return None, None, None, None
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-unit:]), peak_pairs(frequency_peaks(payload))

    added = [("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("fingerprint", T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    return _mapped(df, media, added, row)


def media_query(docs: DataFrame) -> DataFrame:
    """One row per document, of the digests of its stored media and its fingerprint."""
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    stored = encode_wav(raw, "raw").select("doc_id", F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    feature = F.concat(F.size("fingerprint").cast("string"), F.lit(":"), F.sha2(F.array_join("fingerprint", ",").cast("binary"), 256))
    return read_wav(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
