"""Media columns: telephony audio stored losslessly and turned into PCM.

Method: 8-bit samples are kept in a WAV container with the mu-law or A-law tag, 4-bit ones
as IMA ADPCM blocks. Mu-law and A-law expand through lookup tables of 256 values; ADPCM
blocks decode sample by sample with numpy across all blocks at once; PCM is resampled by
linear interpolation and stored as 16-bit WAV.

The payload of a text is its UTF-8 bytes, padded with bytes 255 to a positive multiple of
576, so that it is a whole number of samples and of ADPCM blocks. The codec of a payload
follows from its crc32, and equal texts have equal values throughout.

Results by case: a null text counts as empty, and its payload is 576 bytes 255; repeated
rows each get a row; a null doc_id stays null; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, text_buffers

UNIT = 576
RATE = 8000
RESAMPLED = 16000
#: Bytes of an ADPCM block: a header of 4 (first sample, step index, reserve) and two samples a byte.
BLOCK = 64
#: WAV format tags.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    exponent, mantissa = (code >> 4) & 7, code & 15
    level = ((mantissa << 3) + 132 << exponent) - 132
    return np.where(code & 128, -level, level).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 85
    exponent, mantissa = (code >> 4) & 7, code & 15
    level = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, level, -level).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
#: IMA ADPCM step sizes and step index changes.
STEPS = np.array(
    [
        7,
        8,
        9,
        10,
        11,
        12,
        13,
        14,
        16,
        17,
        19,
        21,
        23,
        25,
        28,
        31,
        34,
        37,
        41,
        45,
        50,
        55,
        60,
        66,
        73,
        80,
        88,
        97,
        107,
        118,
        130,
        143,
        157,
        173,
        190,
        209,
        230,
        253,
        279,
        307,
        337,
        371,
        408,
        449,
        494,
        544,
        598,
        658,
        724,
        796,
        876,
        963,
        1060,
        1166,
        1282,
        1411,
        1552,
        1707,
        1878,
        2066,
        2272,
        2499,
        2749,
        3024,
        3327,
        3660,
        4026,
        4428,
        4871,
        5358,
        5894,
        6484,
        7132,
        7845,
        8630,
        9493,
        10442,
        11487,
        12635,
        13899,
        15289,
        16818,
        18500,
        20350,
        22385,
        24623,
        27086,
        29794,
        32767
    ],
    np.int32
)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _adpcm_change() -> np.ndarray:
    """The change of the sample for each (step index, code), by the sum of halved steps."""
    code = np.arange(16)[None]
    step = STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32)


CHANGE = _adpcm_change()


def decode_adpcm(stored: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples of whole blocks, decoded side by side: blocks x (1 + 2 * (block - 4))."""
    grid = stored.reshape(-1, block)
    out = np.empty((1 + 2 * (block - 4), len(grid)), np.int16)
    sample = np.ascontiguousarray(grid[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(grid[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = sample
    codes = np.ascontiguousarray(grid[:, 4:].T)
    for k in range(block - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            sample = np.clip(sample + CHANGE[index, code], -32768, 32767)
            index = np.clip(index + INDEX[code], 0, len(STEPS) - 1)
            out[1 + 2 * k + half] = sample
    return np.ascontiguousarray(out.T)


def expand(codec: str, stored: np.ndarray) -> np.ndarray:
    """16-bit PCM of stored bytes."""
    if codec == "adpcm":
        return decode_adpcm(stored).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[stored]


def resample(pcm: np.ndarray, source: int = RATE, target: int = RESAMPLED) -> np.ndarray:
    """Linear interpolation to another rate; twofold rates by halving sums of neighbours."""
    if not len(pcm) or source == target:
        return pcm
    if target == 2 * source:
        out = np.empty(2 * len(pcm), np.int16)
        out[0::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * target // source) * (source / target)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def wav(codec: str, stored: bytes, rate: int = RATE) -> bytes:
    """A one-channel WAV file with the codec's format tag."""
    bits, align = {"pcm": (16, 2), "adpcm": (4, BLOCK)}.get(codec, (8, 1))
    per_block = 1 + 2 * (BLOCK - 4)
    second = rate * align // per_block if codec == "adpcm" else rate * align
    extra = struct.pack("<HH", 2, per_block) if codec == "adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, second, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(form)) + form
    if codec != "pcm":
        samples = len(stored) // BLOCK * per_block if codec == "adpcm" else len(stored)
        chunks += b"fact" + struct.pack("<II", 4, samples)
    chunks += b"data" + struct.pack("<I", len(stored)) + stored + b"\0" * (len(stored) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(file: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, stored bytes) of a WAV file; raises ValueError on another format."""
    stream = io.BytesIO(file)
    head = stream.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    codec, rate = None, 0
    while len(head := stream.read(8)) == 8:
        size = struct.unpack("<I", head[4:])[0]
        body = stream.read(size + size % 2)
        if head[:4] == b"fmt ":
            tag, _, rate = struct.unpack("<HHI", body[:8])
            codec = {v: k for k, v in TAGS.items()}.get(tag)
        elif head[:4] == b"data":
            if codec is None:
                raise ValueError("unknown WAV format")
            return codec, rate, body[:size]
    raise ValueError("no data chunk")


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def codec_of(payload: bytes) -> str:
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def features(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, peak, integer mean square and sign changes of the PCM."""
    wide = pcm.astype(np.int64)
    negative = pcm < 0
    return f"{codec};samples={len(pcm)};peak={int(np.abs(wide).max())};power={int((wide * wide).sum() // len(pcm))};crossings={int((negative[1:] != negative[:-1]).sum())}"


def stored_media(text: bytes) -> tuple[str, bytes]:
    """(codec, WAV file) of a text's payload."""
    payload = payload_of(text)
    codec = codec_of(payload)
    return codec, wav(codec, payload)


def _rows(media: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 20):
            data, where = text_buffers(block["text"])
            data = data.tobytes()
            out: dict[str, list] = {
                k: [] for k in (
                    "n_bytes",
                    "payload_bytes",
                    "payload_sha256",
                    "tail_crc32",
                    "media_bytes",
                    "media_sha256",
                    "feature",
                    "pcm_bytes",
                    "pcm_sha256"
                )
            }
            if media:
                out |= {"media": [], "pcm": []}
            files = [stored_media(data[a:b]) for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
            read = [read_wav(file) for _, file in files]
            # all ADPCM blocks of the block of rows at once
            spoken = [np.frombuffer(stored, np.uint8) for codec, _, stored in read if codec == "adpcm"]
            decoded = iter(
                np.split(decode_adpcm(np.concatenate(spoken)), np.cumsum([len(x) // BLOCK for x in spoken])[:-1])
            ) if spoken else iter(())
            for size, (_, file), (codec, rate, stored) in zip(np.diff(where).tolist(), files, read, strict=True):
                pcm = next(decoded).ravel() if codec == "adpcm" else expand(codec, np.frombuffer(stored, np.uint8))
                again = wav("pcm", resample(pcm, rate).astype("<i2").tobytes(), RESAMPLED)
                out["n_bytes"].append(size)
                out["payload_bytes"].append(len(stored))
                out["payload_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["tail_crc32"].append(zlib.crc32(stored[-32:]))
                out["media_bytes"].append(len(file))
                out["media_sha256"].append(hashlib.sha256(file).hexdigest())
                out["feature"].append(features(codec, pcm))
                out["pcm_bytes"].append(len(again))
                out["pcm_sha256"].append(hashlib.sha256(again).hexdigest())
                if media:
                    out["media"].append(file)
                    out["pcm"].append(again)
            yield pa.RecordBatch.from_pydict({"doc_id": block["doc_id"], **out})

    return rows


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def media_columns(docs: DataFrame, media: bool = False) -> DataFrame:
    """Digests of each document's stored audio; with ``media`` also the files (``media``, ``pcm``: binary)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_rows(media), DIGEST + ", media binary, pcm binary" * media)
