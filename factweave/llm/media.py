"""Media columns: texts' bytes kept as telephony audio, read back, expanded, resampled and described."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.llm.bpe import slices
from factweave.llm.shared import for_python

UNIT, RATE = 64, 8000
PCM, ALAW, MULAW = 1, 6, 7

# The IMA ADPCM step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253,
    279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026,
    4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


@functools.cache
def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law byte (G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@functools.cache
def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law byte (G.711)."""
    code = np.arange(256) ^ 0x55
    part, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, step + 8, (step + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 * (width - 4)) of n IMA ADPCM blocks of equal width, all decoded side by side.

    A block begins with its first sample (signed, little-endian), the step index (over 88 counts as 88) and an
    unused byte; then come 4-bit codes, the low half of each byte first.
    """
    n, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    codes = np.empty((2 * (width - 4), n), np.uint8)
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    for k, code in enumerate(codes, 1):
        step = STEPS[index]
        change = (step * (2 * (code & 7).astype(np.int32) + 1)) >> 3
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + MOVES[code], 0, 88)
        out[k] = value
    return out.T


#: Neighbours on either side that a sample between two is made of.
REACH = 8


@functools.cache
def between_taps() -> np.ndarray:
    """The half-band low-pass filter that gives the samples between: a sinc under a Hann window, in 32,768ths."""
    at = np.arange(REACH) + 0.5
    taps = np.sinc(at) * np.cos(np.pi * at / (2 * REACH + 1)) ** 2
    half = np.rint(taps / taps.sum() * 16384).astype(np.int64)
    half[0] += 16384 - half.sum()
    return np.concatenate([half[::-1], half])


def doubled(pcm: np.ndarray) -> np.ndarray:
    """Samples at twice the rate, low-pass filtered: the samples themselves, and between any two what the filter makes of
    the REACH samples on either side (beyond the ends the first and last sample go on). Whole numbers throughout."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    wide = np.pad(pcm.astype(np.int64), (REACH - 1, REACH), mode="edge")
    made = np.convolve(wide, between_taps()[::-1], mode="valid")
    out[1::2] = np.clip((made + 16384) >> 15, -32768, 32767)
    return out


def wave(data: bytes, codec: int, rate: int = RATE) -> bytes:
    """A mono RIFF WAVE file; 8-bit samples for mu-law and A-law, 16-bit ones for PCM."""
    width = 2 if codec == PCM else 1
    layout = struct.pack("<HHIIHHH", codec, 1, rate, rate * width, width, 8 * width, 0)
    count = struct.pack("<4sII", b"fact", 4, len(data) // width)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(layout)) + layout + count + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unwave(media: bytes) -> tuple[int, int, bytes]:
    """Codec, rate and data of a RIFF WAVE file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, codec, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _sums(pcm: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """Energy, peak and sign changes of each run of samples."""
    wide = pcm.astype(np.int64)
    energy, peak = np.add.reduceat(wide * wide, starts), np.maximum.reduceat(np.abs(wide), starts)
    turns = np.zeros(len(pcm), np.int64)
    turns[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turns[starts] = 0
    return list(zip(energy.tolist(), peak.tolist(), np.add.reduceat(turns, starts).tolist(), strict=True))


def described(payloads: list[bytes]) -> tuple[list[str], list[np.ndarray]]:
    """A line of features for each payload (a positive multiple of 64 bytes), and its PCM at 16 kHz.

    The bytes are expanded as mu-law and as A-law and decoded as ADPCM blocks of 64 bytes; for each reading the
    line has energy, peak and sign changes, and for the resampled mu-law PCM its length and crc32.
    """
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    starts = np.cumsum([0, *map(len, payloads)])[:-1]
    heard = mulaw_table()[raw]
    blocks = adpcm(raw.reshape(-1, UNIT))
    readings = [_sums(heard, starts), _sums(alaw_table()[raw], starts), _sums(blocks.ravel(), starts // UNIT * blocks.shape[1])]
    lines, sound = [], []
    for i, (start, payload) in enumerate(zip(starts, payloads, strict=True)):
        pcm = doubled(heard[start : start + len(payload)])
        sound.append(pcm)
        told = " ".join(f"{name}={r[i][0]},{r[i][1]},{r[i][2]}" for name, r in zip(("mulaw", "alaw", "adpcm"), readings, strict=True))
        lines.append(f"{told} pcm={len(pcm)},{zlib.crc32(pcm.tobytes()):08x}")
    return lines, sound


def telephony(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_pcm: bool = True) -> DataFrame:
    """(id, n_bytes, media, payload, feature, pcm) for every row.

    The text's UTF-8 bytes, with zeros up to a positive multiple of 64, are stored as the 8-bit samples of a
    mu-law WAVE file (``media``). The file is read back: ``payload`` are its samples, ``feature`` describes them,
    and ``pcm`` is a 16-bit WAVE file at 16 kHz (null without ``keep_pcm``). Null text counts as empty; ids may be null
    or repeat, and rows that repeat give equal rows; other columns are ignored; no rows give no rows; nothing is shuffled.
    """
    for_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [wave(t + bytes(UNIT * max(1, -(-len(t) // UNIT)) - len(t)), MULAW) for t in texts]
            payloads = [unwave(m)[2] for m in media]
            lines, sound = described(payloads)
            pcm = [wave(s.tobytes(), PCM, 2 * RATE) if keep_pcm else None for s in sound]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), pa.array(lines, pa.string()), pa.array(pcm, pa.binary())],
                ["doc_id", "n_bytes", "media", "payload", "feature", "pcm"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, feature string, pcm binary").withColumnRenamed("doc_id", id_column)
