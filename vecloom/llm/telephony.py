"""Operator 5: media columns of telephony audio.

Three codecs in WAVE containers: mu-law and A-law (8 bits a sample, expanded
by lookup tables made from their rule) and IMA ADPCM (4 bits a sample in
blocks, decoded with numpy for all blocks of a file at once: the loop runs over
the samples of a block, each step over all blocks).  Decoded PCM is resampled
by linear interpolation and stored as 16-bit samples.

Files live in a binary column; a table of them is written to the shared folder
and read back, and so is a table of their PCM, so tasks that lose their
executor find what was stored.  Which codec a text gets is dealt by a checksum
of the text, unless one is asked for; dealt files of mu-law and A-law have the
8 kHz of telephone lines, those of ADPCM 16 kHz, and their PCM is brought to
one rate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import scope, stored

RATE, OUT_RATE = 8000, 16000
#: Rates of dealt files, and the rate to which they are brought.
DEALT_RATES, COMMON_RATE = {"alaw": 8000, "mulaw": 8000, "ima": 16000}, 8000
TAGS = {"alaw": 6, "mulaw": 7, "ima": 17}
#: Bytes of a block in files of one codec, and where codecs are dealt: there a payload's unit is one block.
IMA_BLOCK, DEALT_BLOCK = 256, 64
#: Bytes of files, and of PCM, that a worker holds at once, about.
HELD = 1 << 22
#: Stored tables are compressed: PCM takes several times the room of its file.
COMPRESSED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(1 << 22)}

# Step sizes and index changes of IMA ADPCM.
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    """int16 value of each mu-law byte (G.711)."""
    u = ~np.arange(256) & 255
    magnitude = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
    return np.where(u & 128, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """int16 value of each A-law byte (G.711)."""
    a = np.arange(256) ^ 0x55
    exponent = a >> 4 & 7
    mantissa = (a & 15) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(a & 128, magnitude, -magnitude).astype(np.int16)


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks: uint8 (n, block) -> int16 (n, samples)."""
    n, width = blocks.shape
    steps, moves = np.array(IMA_STEPS), np.array(IMA_MOVES)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((n, 1 + 2 * (width - 4)), np.int16)
    out[:, 0] = value
    for k in range(2 * (width - 4)):
        code = blocks[:, 4 + k // 2] >> (4 * (k & 1)) & 15
        step = steps[index]
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + moves[code & 7], 0, 88)
        out[:, 1 + k] = value
    return out


def wave(payload: bytes, codec: str, rate: int = RATE, block: int = IMA_BLOCK) -> bytes:
    """A WAVE file whose data chunk is the payload, untouched."""
    tag = TAGS[codec]
    if codec == "ima":
        per = 1 + 2 * (block - 4)
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per, block, 4, 2, per)
        samples = len(payload) // block * per
    else:
        fmt, samples = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0), len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[str, int, memoryview, int]:
    """Codec, rate, payload (a view, not a copy) and bytes of a block of a WAVE file."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate, block = 12, None, RATE, 1
    while at + 8 <= len(view):
        name, size = bytes(view[at:at + 4]), int.from_bytes(view[at + 4:at + 8], "little")
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", view, at + 8)
            codec = {v: k for k, v in TAGS.items()}[tag]
        elif name == b"data":
            return codec, rate, view[at + 8:at + 8 + size], block
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


class Decoder:
    """PCM of files; the tables are made once for a worker."""

    def __init__(self):
        self.tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}

    def pcm(self, files: list[tuple[str, memoryview, int]]) -> list[np.ndarray]:
        """Samples of (codec, payload, block) files; blocks of all files of one size are decoded together."""
        out: list = [None] * len(files)
        ima: dict[int, list[int]] = {}
        for k, (codec, payload, block) in enumerate(files):
            raw = np.frombuffer(payload, np.uint8)
            if codec == "ima":
                ima.setdefault(block, []).append(k)
                out[k] = raw[:len(raw) // block * block].reshape(-1, block)
            else:
                out[k] = self.tables[codec][raw]
        for own in ima.values():
            samples = ima_decode(np.concatenate([out[k] for k in own]))
            for k, part in zip(own, np.split(samples, np.cumsum([len(out[k]) for k in own])[:-1])):
                out[k] = part.ravel()
        return out


def resampled(pcm: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """Linear interpolation to another rate; the mean of two samples for half the rate."""
    if rate == out_rate or not len(pcm):
        return pcm
    if out_rate == 2 * rate:
        wide = pcm.astype(np.int32)
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    if rate == 2 * out_rate:
        wide = pcm[:len(pcm) // 2 * 2].astype(np.int32)
        return ((wide[::2] + wide[1::2]) >> 1).astype(np.int16)
    at = np.arange(len(pcm) * out_rate // rate) * (rate / out_rate)
    return np.round(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def padded(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def dealt(payload: bytes) -> str:
    """The codec that a payload gets."""
    return sorted(TAGS)[zlib.crc32(payload) % len(TAGS)]


def _runs(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a batch of some HELD bytes each, with their starts; a larger row is a slice of its own."""
    first = held = 0
    for k, n in enumerate(sizes):
        if k > first and held + n > HELD:
            yield first, batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if len(batch):
        yield first, batch.slice(first)


def _sizes(column: pa.Array) -> list[int]:
    return [n or 0 for n in pa.compute.binary_length(column).to_pylist()]


def store_media(docs: DataFrame, *, codec: str | None = "mulaw", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's UTF-8 bytes, padded, as the samples of a
    WAVE file, written to the shared folder and read back.

    Null and empty texts are 64 zero bytes.  Rows stay one for one, repeated
    rows and null ids included; other columns are not read; an empty table
    stays empty.  A very long text is one file.  For ``ima`` the padding goes
    to whole blocks of 256 bytes; where ``codec`` is None it is dealt by the
    payload, and ADPCM blocks have 64 bytes.
    """
    unit = IMA_BLOCK if codec == "ima" else 64

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _runs(batch, _sizes(batch.column(1))):
                texts = part.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
                whole = [padded(t, unit) for t in texts]
                media = [wave(p, codec) if codec else wave(p, d := dealt(p), DEALT_RATES[d], DEALT_BLOCK) for p in whole]
                yield pa.record_batch([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    body = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    schema = T.StructType([body.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return stored(body.mapInArrow(rows, schema), "media", **COMPRESSED)


def decode_media(media: DataFrame, *, out_rate: int = OUT_RATE, media_col: str = "media") -> DataFrame:
    """All columns of ``media``, plus sample_rate and pcm (little-endian 16-bit
    samples at ``out_rate``; existing columns of these names are replaced).

    A null file has a null pcm.  Rows stay one for one; an empty table stays
    empty.  A file that is no WAVE file fails the job.
    """
    kept = [c for c in media.columns if c not in (media_col, "sample_rate", "pcm")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder()
        for batch in batches:
            for _, part in _runs(batch, _sizes(batch.column(len(kept)))):
                files = [m and read_wave(m) for m in part.column(len(kept)).to_pylist()]
                samples = iter(decoder.pcm([(c, p, n) for c, _, p, n in filter(None, files)]))
                pcm = [f and resampled(next(samples), f[1], out_rate).tobytes() for f in files]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([out_rate] * len(part), pa.int32()), pa.array(pcm, pa.binary())], names=[*kept, media_col, "sample_rate", "pcm"])

    body = media.select(*[F.col(f"`{c}`") for c in [*kept, media_col]])
    schema = T.StructType([*body.schema.fields, T.StructField("sample_rate", T.IntegerType()), T.StructField("pcm", T.BinaryType())])
    return body.mapInArrow(rows, schema)


def features(pcm: np.ndarray) -> str:
    """Peak, root mean square, mean, zero crossings and crc32 of samples, all from whole numbers."""
    wide = pcm.astype(np.int64)
    n = max(len(wide), 1)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return (f"n={len(wide)};peak={int(np.abs(wide).max(initial=0))};rms={int((wide * wide).sum() // n) ** 0.5:.3f};"
            f"mean={int(wide.sum()) // n};zc={crossings};crc={zlib.crc32(pcm.tobytes())}")


def store_pcm(media: DataFrame, *, id_col: str = "doc_id", out_rate: int = COMMON_RATE) -> DataFrame:
    """id, n_bytes, digests of each stored file and of the payload read back from it, codec, sample_rate, pcm: written to the shared folder and read back.

    Rows stay one for one, an empty table stays empty.  A null file, or one
    that is no WAVE file, fails the job.
    """
    digests = (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()),
               ("codec", T.StringType()), ("sample_rate", T.IntegerType()), ("pcm", T.BinaryType()))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder()
        for batch in batches:
            for _, part in _runs(batch, _sizes(batch.column(2))):
                held = part.column(2).to_pylist()
                files = [read_wave(m) for m in held]
                samples = decoder.pcm([(c, p, n) for c, _, p, n in files])
                out = [
                    (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), c, out_rate, resampled(x, rate, out_rate).tobytes())
                    for m, (c, rate, p, _), x in zip(held, files, samples)]
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(v, t) for v, t in zip(zip(*out), kinds))], [id_col, "n_bytes", *(n for n, _ in digests)])

    body = media.select(F.col(f"`{id_col}`"), "n_bytes", "media")
    schema = T.StructType([*body.schema.fields[:2], *(T.StructField(n, t) for n, t in digests)])
    return stored(body.mapInArrow(rows, schema), "pcm", **COMPRESSED)


def describe_pcm(pcm: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The digests of ``store_pcm`` with features of the stored samples.  Rows stay one for one, an empty table stays empty."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            about = [f"codec={c};rate={r};{features(np.frombuffer(x.as_buffer(), '<i2'))}" for c, r, x in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), batch.column(9))]
            yield pa.record_batch([*batch.columns[:7], pa.array(about, pa.string())], [id_col, *names, "feature"])

    body = pcm.select(F.col(f"`{id_col}`"), *names, "codec", "sample_rate", "pcm")
    schema = T.StructType([*body.schema.fields[:7], T.StructField("feature", T.StringType())])
    return body.mapInArrow(rows, schema)


def op5_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as samples of a dealt codec, read back, decoded, stored as PCM, read back and described."""
    with scope(spark) as own:
        pcm = store_pcm(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), codec=None))
        own.keep(pcm)
        return describe_pcm(pcm)
