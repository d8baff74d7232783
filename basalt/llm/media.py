"""Telephony audio columns: G.711 and IMA ADPCM samples in WAV containers.

mu-law and A-law expand by 256-entry lookup tables; ADPCM blocks of many
recordings decode together, one numpy step for each nibble position; decoded
audio is stored as resampled 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from basalt.llm._text import BATCH_BYTES, map_texts, slices, small_batches

RATE, RESAMPLED = 8000, 16000
UNIT = 1 << 15  # of a filter's coefficients
BLOCK = 576  # payload bytes are padded to a positive multiple of this
PAD = b"\xff"
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = tuple(sorted(FORMATS))
PCM_ROWS = 256  # in a Parquet row group: Spark reads up to 4,096 rows of one into an array below 2 GB, and samples are eight times their payload
LEVEL, PAGE_BYTES = 7, 8 << 20  # of zstd; a page is compressed by itself, so a whole row group of short texts goes into one


def mulaw_table() -> np.ndarray:
    """Linear 16-bit value of each mu-law byte (G.711)."""
    code = ~np.arange(256) & 0xFF
    magnitude = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit value of each A-law byte (G.711)."""
    code = np.arange(256) ^ 0x55
    exponent = (code >> 4) & 7
    base = ((code & 0x0F) << 4) + 8
    magnitude = np.where(exponent > 0, (base + 0x100) << np.maximum(exponent - 1, 0), base)
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


# Fixed values of the IMA ADPCM format.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
     209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
     2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
     24623, 27086, 29794, 32767]
)
INDEX_SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8])

MULAW, ALAW = mulaw_table(), alaw_table()


def _step_tables() -> tuple[np.ndarray, np.ndarray]:
    """Signed difference and next index for each (index, nibble), flattened."""
    nibble = np.arange(16)
    step = STEPS[:, None]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    move = np.clip(np.arange(len(STEPS))[:, None] + INDEX_SHIFT[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).ravel().astype(np.int32), (move * 16).ravel().astype(np.int32)


DIFFERENCE, NEXT_INDEX = _step_tables()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """int16 samples of mono IMA blocks, given as a ``(blocks, bytes)`` array.

    A block is a 16-bit predictor, an index, a zero byte, and then nibbles, low
    nibble first; its first sample is the predictor.  All blocks advance
    together, one nibble at a time.
    """
    n, width = blocks.shape
    predictor = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    nibbles = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = predictor
    for i, byte in enumerate(nibbles):
        for k, nibble in enumerate((byte & 15, byte >> 4)):
            at = index + nibble
            predictor = np.clip(predictor + DIFFERENCE[at], -32768, 32767)
            index = NEXT_INDEX[at]
            out[1 + 2 * i + k] = predictor
    return np.ascontiguousarray(out.T)


@cache
def resampling_filter(up: int, down: int, zeros: int = 8) -> np.ndarray:
    """Coefficients of each of ``up`` phases: a sinc that ends below half of the
    lower rate, with ``zeros`` zero crossings on either side, under a Hann window.
    They are whole numbers that sum to ``UNIT``, so that sums are exact in any order."""
    cut = min(1.0, up / down)
    half = math.ceil(zeros / cut)
    away = np.arange(1 - half, half + 1) - np.arange(up)[:, None] / up
    shape = np.sinc(away * cut) * np.where(abs(away) < half, 0.5 + 0.5 * np.cos(np.pi * away / half), 0)
    whole = np.rint(shape / shape.sum(axis=1, keepdims=True) * UNIT)
    whole[np.arange(up), whole.argmax(axis=1)] += UNIT - whole.sum(axis=1)
    return whole


def resample(pcm: np.ndarray, rate: int = RATE, to: int = RESAMPLED) -> np.ndarray:
    """16-bit samples at another rate, by a polyphase filter.  The ends are
    continued by their own value; n samples give ``ceil(n * to / rate)``."""
    shared = math.gcd(rate, to)
    up, down = to // shared, rate // shared
    if up == down or not len(pcm):
        return pcm.astype(np.int16)
    phases = resampling_filter(up, down)
    half = phases.shape[1] // 2
    wide = np.pad(pcm.astype(np.float64), (half - 1, half), mode="edge")
    n = -(-len(pcm) * up // down)
    out = np.empty(n)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        at = np.arange(first, n, up) * down
        phase, base = at[0] % up, at // up
        if down == 1:
            out[first::up] = np.correlate(wide, phases[phase], "valid")[base[0] : base[0] + len(base)]
        else:
            out[first::up] = np.lib.stride_tricks.sliding_window_view(wide, 2 * half)[base] @ phases[phase]
    return np.clip(np.floor(out / UNIT + 0.5), -32768, 32767).astype(np.int16)


def to_wav(codec: str, payload: bytes) -> bytes:
    """A WAV file that holds ``payload`` (a multiple of ``BLOCK`` bytes) as it is.

    G.711 payload bytes are samples.  ADPCM payload bytes are the nibbles of
    blocks of ``BLOCK`` bytes behind neutral four-byte block headers.
    """
    if codec == "adpcm":
        rows = np.zeros((len(payload) // BLOCK, BLOCK + 4), np.uint8)
        rows[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        data, align, bits, samples = rows.tobytes(), BLOCK + 4, 4, len(rows) * (1 + 2 * BLOCK)
        extra = struct.pack("<HH", 2, 1 + 2 * BLOCK)
        rate = RATE * align // (1 + 2 * BLOCK)
    else:
        data, align, bits, samples, extra, rate = payload, 1, 8, len(payload), struct.pack("<H", 0), RATE
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, RATE, rate, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(wav: bytes) -> tuple[str, np.ndarray, int]:
    """Codec, bytes of the data chunk and block width of a stored WAV file."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, align, data = 12, "", 1, np.zeros(0, np.uint8)
    while at + 8 <= len(wav):
        name, (size,) = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)
        if name == b"fmt ":
            kind, _, _, _, align = struct.unpack_from("<HHIIH", wav, at + 8)
            codec = next(k for k, v in FORMATS.items() if v == kind)
        elif name == b"data":
            data = np.frombuffer(wav, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    return codec, data, align


def read_payloads(wavs: list[bytes]) -> tuple[list[str], list[bytes], list[np.ndarray]]:
    """Codec, payload and decoded 16-bit samples of each file; the ADPCM blocks
    of all files decode in one call."""
    parsed = [from_wav(w) for w in wavs]
    payloads, pcm = [], [np.zeros(0, np.int16)] * len(wavs)
    blocks: list[np.ndarray] = []
    owner: list[int] = []
    for i, (codec, data, align) in enumerate(parsed):
        if codec == "adpcm":
            rows = data.reshape(-1, align)
            payloads.append(rows[:, 4:].tobytes())
            blocks.append(rows)
            owner.append(i)
        else:
            payloads.append(data.tobytes())
            pcm[i] = (MULAW if codec == "mulaw" else ALAW)[data]
    if blocks:
        decoded = adpcm_decode(np.concatenate(blocks))
        at = 0
        for i, rows in zip(owner, blocks):
            pcm[i] = decoded[at : at + len(rows)].ravel()
            at += len(rows)
    return [codec for codec, _, _ in parsed], payloads, pcm


def pad(raw: bytes) -> bytes:
    return raw + PAD * (-len(raw) % BLOCK if raw else BLOCK)


def describe(pcm: np.ndarray) -> str:
    """Length, root mean square, zero crossings and peak of 16-bit samples."""
    wide = pcm.astype(np.int64)
    power = int(wide @ wide)
    signs = pcm < 0
    return f"n={len(pcm)};rms={(power / max(1, len(pcm))) ** 0.5:.3f};zc={int(np.count_nonzero(signs[1:] != signs[:-1]))};peak={int(np.abs(wide).max(initial=0))}"


def stored(raw: bytes, codec: str | None = None) -> bytes:
    """The WAV file of a text's bytes; without a codec its content picks one."""
    payload = pad(raw)
    return to_wav(codec or CODECS[zlib.crc32(payload) % len(CODECS)], payload)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, media binary``: every text's bytes as a WAV file.

    Null and empty texts are 576 bytes of 255.  Repeated rows give repeated
    results; null ids pass through; other columns are not read.
    """

    def make():
        def work(ids, texts):
            raw = [(t or "").encode() for t in texts.to_pylist()]
            return [ids, list(map(len, raw)), pa.array([stored(x, codec) for x in raw], pa.binary())]

        return work

    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs, id_col, text_col, f"doc_id {kind}, n_bytes bigint, media binary", make, 2 << 20)


def store(media: DataFrame, folder: str) -> DataFrame:
    """Writes rows of ``media_column``, ``with_pcm`` or ``decoded`` and returns them as read back."""
    out = media.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).option("parquet.page.size", PAGE_BYTES)
    if "pcm" in media.columns:
        out = out.option("parquet.block.row.count.limit", PCM_ROWS)
    out.parquet(folder)
    return media.sparkSession.read.parquet(folder)


def _alike_together(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows in order of their files' format and first samples, where ``to_wav``
    places them: samples that repeat each other take less room when compressed."""
    files = batch.column("media")
    keys = pa.table({"format": pc.binary_slice(files, 20, 22), "samples": pc.binary_slice(files, 64, 128)})
    return batch.take(pc.sort_indices(keys, sort_keys=[("format", "ascending"), ("samples", "ascending")]))


def _map_media(media: DataFrame, columns: str, work, column: str = "media", limit: int = 2 << 20) -> DataFrame:
    """Columns that ``work(rows, list of column's values)`` makes, behind all of ``media``'s."""
    small_batches(media.sparkSession)
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches):
        for batch in batches:
            for part in slices(_alike_together(batch) if column == "media" else batch, column, limit):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(part, part.column(column).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])
            pa.default_memory_pool().release_unused()

    schema = ", ".join([*(f"`{n}` {k}" for n, k in media.dtypes), columns])
    return media.mapInArrow(run, schema)


def _samples(pcm: list[np.ndarray], to: int) -> pa.Array:
    """Decoded samples as stored: at the rate ``to``, little-endian, 16 bits."""
    return pa.array([resample(x, to=to).astype("<i2").tobytes() for x in pcm], pa.binary())


def with_pcm(media: DataFrame, to: int = RESAMPLED) -> DataFrame:
    """Rows of ``media_column`` with ``pcm binary``: the decoded samples of each
    WAV file at the rate ``to`` (little-endian, 16 bits)."""
    return _map_media(media, "pcm binary", lambda _, wavs: [_samples(read_payloads(wavs)[2], to)])


def _sha(values: list[bytes]) -> list[str]:
    return [hashlib.sha256(x).hexdigest() for x in values]


def decoded(media: DataFrame, to: int = RESAMPLED) -> DataFrame:
    """Rows of ``media_column`` with, in place of the files, sizes and hashes of
    their payloads, their codec, and ``pcm binary`` as in ``with_pcm``."""

    def work(_, wavs):
        codecs, payloads, pcm = read_payloads(wavs)
        tails = [zlib.crc32(p[-32:]) for p in payloads]
        return [list(map(len, payloads)), _sha(payloads), tails, list(map(len, wavs)), _sha(wavs), codecs, _samples(pcm, to)]

    columns = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, codec string, pcm binary"
    return _map_media(media, columns, work).drop("media")


def features(rows: DataFrame) -> DataFrame:
    """Rows of ``decoded`` with features and a hash of their samples in place of
    codec and samples."""

    def work(part, pcm):
        codecs = part.column("codec").to_pylist()
        return [[f"{c};{describe(np.frombuffer(x, '<i2'))}" for c, x in zip(codecs, pcm)], _sha(pcm)]

    return _map_media(rows, "feature string, pcm_sha256 string", work, "pcm", BATCH_BYTES).drop("codec", "pcm")


def digests(media: DataFrame, to: int = RESAMPLED) -> DataFrame:
    """Sizes and hashes of the payloads of stored media, and features and a hash
    of their resampled samples."""
    return features(decoded(media, to))
