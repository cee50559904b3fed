"""MPEG audio columns: writing payloads into Layer III streams and reading any stream back.

``read_audio`` resynchronises on frame headers, parses ID3 tags and Xing, Info or VBRI
tables, verifies checksums of all three layers, gives exact durations (samples over rate,
and without the silence that encoders note in the table) and the byte offset of every
frame, and says whether the table's number of frames is the one found. ``write_audio`` stores a payload without loss: mono MPEG-2 Layer III
at 16 kHz, where a frame is 576 samples and carries 576 payload bytes in its ancillary
data behind an empty side information, so that players hear silence. Frames with bytes
above 127 take the higher bit rate; the Xing table in front serves for seeking.

Defined cases: a null or empty text gives one block of padding; null or foreign bytes give
a result without frames; bytes between frames are skipped and counted; a frame with a bad
checksum is counted and still stands in the offsets; equal bytes give equal results; an
empty table gives an empty result; ``audio_column`` replaces a column named media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text

BLOCK = 576
PAD = b"\xff"
OWNER = b"tidemark\0"

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bit rate index, Hz by rate index.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Bits that name the allocation of a subband in Layer II, as (subbands, bits); the last table is that of MPEG-2.
ALLOCATION = (((11, 4), (12, 3), (4, 2)), ((11, 4), (12, 3), (7, 2)), ((2, 4), (6, 3)), ((2, 4), (10, 3)), ((4, 4), (7, 3), (19, 2)))
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

READ = (
    "struct<version:string,layer:int,rate:int,channels:int,frames:long,samples:long,bad_checksums:long,skipped:long,tag_bytes:long,"
    "table_frames:long,table_bytes:long,table_agrees:boolean,delay:int,padding:int,offsets:array<long>,payload_bytes:long,payload_sha256:string,tail_crc32:long,intact:boolean>"
)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def covered_bits(data: bytes, version: int, layer: int, rate: int) -> int:
    """How many bits behind the checksum it covers in a frame of Layer I or II: the allocation and, in II, what selects scale factors."""
    mode, extension = data[3] >> 6, data[3] >> 4 & 3
    channels = 1 if mode == 3 else 2
    bound = 4 * (extension + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * (channels * bound + 32 - bound)
    kbps = KBPS[1 if version == 3 else 2, 2][data[2] >> 4] // channels
    table = 4 if version != 3 else (2 if rate != 32000 else 3) if kbps <= 48 else 0 if rate == 48000 or kbps <= 80 else 1
    widths = [w for n, w in ALLOCATION[table] for _ in range(n)]
    bits = int.from_bytes(data[6:], "big")
    total = at = 8 * (len(data) - 6)
    allocated = 0
    for band, w in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            at -= w
            if at < 0:
                return total
            used = bits >> at & ((1 << w) - 1)
            allocated += (used > 0) * (channels if band >= bound else 1)
    return min(total, total - at + 2 * allocated)


def crc16_bits(data: bytes, bits: int, crc: int) -> int:
    """CRC-16 over whole bytes and then the leading bits of the next."""
    crc = crc16(data[: bits // 8], crc)
    for i in range(bits % 8):
        top = crc >> 15 ^ data[bits // 8] >> (7 - i) & 1
        crc = crc << 1 & 0xFFFF ^ 0x8005 * top
    return crc


def header(word: int) -> tuple[int, int, int, int, int, int, bool] | None:
    """Version bits, layer, frame bytes, samples, Hz, side information bytes and protection; None if it is no header."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, index, hz = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or index in (0, 15) or hz == 3:
        return None
    rate, pad, mono = HZ[version][hz], word >> 9 & 1, word >> 6 & 3 == 3
    bits = KBPS[1 if version == 3 else 2, layer][index] * 1000
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12 * bits // rate + pad) * 4 if layer == 1 else samples // 8 * bits // rate + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return version, layer, size, samples, rate, side, not word >> 16 & 1


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of a protected mono MPEG-2 Layer III frame at 16 kHz."""
    head = struct.pack(">I", 0x7FF << 21 | 2 << 19 | 1 << 17 | index << 12 | 2 << 10 | 3 << 6)
    return head + struct.pack(">H", crc16(head[2:] + bytes(9))) + bytes(9)


LOW, HIGH = 13, 14
_FRAMES = {i: (frame_head(i), header(int.from_bytes(frame_head(i)[:4], "big"))[2]) for i in (LOW, HIGH)}


def write_audio(payload: bytes) -> bytes:
    """A stream that carries ``payload``, whose length is a positive multiple of 576."""
    frames = []
    for at in range(0, len(payload), BLOCK):
        block = payload[at : at + BLOCK]
        head, size = _FRAMES[LOW if block.isascii() else HIGH]
        frames.append((head + block).ljust(size, b"\0"))
    sizes = [len(f) for f in frames]
    total, ends, run = sum(sizes) + _FRAMES[LOW][1], [], _FRAMES[LOW][1]
    for s in sizes:
        ends.append(run)
        run += s
    seek = bytes(min(255, ends[len(sizes) * i // 100] * 256 // total) for i in range(100))
    table = (_FRAMES[LOW][0] + b"Xing" + struct.pack(">III", 7, len(frames), total) + seek).ljust(_FRAMES[LOW][1], b"\0")
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    length = str(len(frames) * BLOCK * 1000 // 16000).encode()
    tag = b"".join(k + struct.pack(">IH", len(v), 0) + v for k, v in ((b"TLEN", b"\0" + length), (b"PRIV", private)))
    return b"ID3\x03\0\0" + synchsafe(len(tag)) + tag + table + b"".join(frames)


def tags(data: bytes) -> tuple[int, dict[bytes, bytes]]:
    """Length of the ID3v2 tags in front, and their frames (the last of a name); versions 2 to 4, unsynchronised or not."""
    at, found = 0, {}
    synchsafe_int = lambda b: sum((x & 0x7F) << s for x, s in zip(b, (21, 14, 7, 0)))
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        version, flags, size = data[at + 3], data[at + 5], synchsafe_int(data[at + 6 : at + 10])
        end = at + 10 + size
        body = data[at + 10 : end]
        if flags & 0x80 and version < 4:
            body = body.replace(b"\xff\0", b"\xff")
        name, head = (3, 6) if version == 2 else (4, 10)
        p = 0
        if flags & 0x40 and version > 2:  # an extended header; version 4 counts itself in its size
            p = int.from_bytes(body[:4], "big") + 4 if version == 3 else synchsafe_int(body[:4])
        while version in (2, 3, 4) and p + head <= len(body) and body[p]:
            size_bytes = body[p + name : p + 2 * name]
            n = synchsafe_int(size_bytes) if version == 4 else int.from_bytes(size_bytes, "big")
            value = body[p + head : p + head + n]
            if version == 4 and body[p + 9] & 2:
                value = value.replace(b"\xff\0", b"\xff")
            found[body[p : p + name]] = value
            p += head + n
        at = end + (10 if flags & 0x10 else 0)
    return at, found


def rate_table(frame: bytes, side: int, protected: bool) -> tuple[int | None, int | None, int, int] | None:
    """Frames and bytes by a Xing, Info or VBRI table in the first frame, and the encoder's delay and padding in samples."""
    for at in (4 + 2 * protected + side, 4 + side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            values: list[int | None] = []
            for bit in (1, 2):
                values.append(int.from_bytes(frame[p : p + 4], "big") if flags & bit else None)
                p += 4 * bool(flags & bit)
            p += 100 * bool(flags & 4) + 4 * bool(flags & 8)
            silence = int.from_bytes(frame[p + 21 : p + 24], "big") if frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") else 0
            return values[0], values[1], silence >> 12, silence & 0xFFF
    if frame[36:40] == b"VBRI":
        return int.from_bytes(frame[50:54], "big"), int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[42:44], "big"), 0
    return None


def read_audio(data: bytes | None) -> dict:
    """What a stream holds; see ``READ``."""
    data = data or b""
    start, found = tags(data)
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    out = {"version": None, "layer": None, "rate": None, "channels": None, "samples": 0, "bad_checksums": 0, "skipped": 0, "table_frames": None, "table_bytes": None, "table_agrees": None, "delay": 0, "padding": 0}
    offsets, parts, kind, p, checked, locked = [], [], None, start, {}, False
    while p + 4 <= end:
        h = header(int.from_bytes(data[p : p + 4], "big"))
        fits = h and (kind is None or (h[0], h[1], h[4]) == kind) and p + h[2] <= end
        if fits and not locked and p + h[2] + 4 <= end:  # out of step, the frame behind must be of the same kind
            after = header(int.from_bytes(data[p + h[2] : p + h[2] + 4], "big"))
            fits = after is not None and (after[0], after[1], after[4]) == (h[0], h[1], h[4])
        if not fits:
            q = data.find(b"\xff", p + 1, end)
            q = end if q < 0 else q
            out["skipped"] += q - p
            p, locked = q, False
            continue
        version, layer, size, samples, rate, side, protected = h
        first, kind = kind is None, (version, layer, rate)
        if protected:
            bits = 8 * side if layer == 3 else covered_bits(data[p : p + size], version, layer, rate)
            covered = data[p + 2 : p + 4] + data[p + 6 : p + 6 + -(-bits // 8)]
            if (covered, bits) not in checked:
                checked[covered, bits] = crc16_bits(covered[2:], bits, crc16(covered[:2]))
            out["bad_checksums"] += checked[covered, bits] != int.from_bytes(data[p + 4 : p + 6], "big")
        table = rate_table(data[p : p + size], side, protected) if first else None
        if first:
            out |= {"version": {3: "1", 2: "2", 0: "2.5"}[version], "layer": layer, "rate": rate, "channels": 1 if data[p + 3] >> 6 == 3 else 2}
        if table:
            out["table_frames"], out["table_bytes"], out["delay"], out["padding"] = table
        else:
            offsets.append(p)
            out["samples"] += samples
            if layer == 3:
                body = p + 4 + 2 * protected + side
                parts.append(data[body : min(body + BLOCK, p + size)])
        p, locked = p + size, True
    if out["table_frames"] is not None:
        out["table_agrees"] = out["table_frames"] == len(offsets)
    payload = b"".join(parts)
    private = found.get(b"PRIV", b"")
    intact = private.startswith(OWNER) and private[len(OWNER) :] == struct.pack(">QI", len(payload), zlib.crc32(payload))
    return out | {
        "frames": len(offsets), "offsets": offsets, "tag_bytes": start, "intact": intact, "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
    }


def payload_of(text: str | None) -> bytes:
    """The text as UTF-8, filled up with bytes 255 to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def encoded(text: Column) -> Column:
    """The stream that carries each text."""

    @F.pandas_udf("binary")
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: write_audio(payload_of(t)))

    return write(text)


def decoded(media: Column) -> Column:
    """What each stream holds, as the struct ``READ``."""

    @F.pandas_udf(READ)
    def read(streams: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_audio(m) for m in streams]) if len(streams) else pd.DataFrame({k: [] for k in read_audio(None)})

    return read(media)


def audio_column(docs: DataFrame, text: Column) -> DataFrame:
    """The rows with the binary column ``media`` that carries the text."""
    return docs.withColumn("media", encoded(text))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an audio stream, read back."""
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), whole_text().alias("text"))
    read = audio_column(docs, F.col("text")).withColumn("read", decoded(F.col("media")))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("mpeg"), F.col("read.version")),
        *[F.concat(F.lit(f"{k}="), F.col(f"read.{k}").cast("string")) for k in ("layer", "rate", "channels", "frames", "samples", "bad_checksums", "skipped", "tag_bytes", "table_frames", "table_bytes", "table_agrees", "intact")],
    )
    return read.select(
        "doc_id", "n_bytes", "read.payload_bytes", "read.payload_sha256", "read.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        F.expr("(read.samples - read.delay - read.padding) * 1000000 div read.rate").alias("duration_us"), F.col("read.offsets").alias("seek_offsets"),
    )
