import hashlib
import zlib

from helpers import docs, store
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import media as M


def test_crc16_of_a_known_string():
    # Check value of CRC-16/CMS: polynomial 0x8005, start 0xFFFF, not reflected.
    assert M.crc16(b"123456789") == 0xAEE7


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(raw):
    payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
    read = M.read_audio(M.write_audio(payload))
    assert read["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert read["payload_bytes"] == len(payload) and read["tail_crc32"] == zlib.crc32(payload[-32:])
    assert read["intact"] and read["bad_checksums"] == 0 and read["skipped"] == 0
    assert read["frames"] == len(payload) // 576 == read["table_frames"] and read["samples"] == len(payload)


def test_resynchronises_behind_junk_and_counts_it():
    stream = M.write_audio(M.payload_of("a" * 2000))
    start = M.read_audio(stream)["tag_bytes"]
    whole = M.read_audio(stream)
    cut = whole["offsets"][1]
    broken = stream[:cut] + b"junk \xff\xfb" + stream[cut:]
    read = M.read_audio(broken)
    assert read["skipped"] == 7 and read["frames"] == whole["frames"] and read["payload_sha256"] == whole["payload_sha256"]
    assert read["offsets"][1] == cut + 7 and start == read["tag_bytes"]


def test_finds_a_bad_checksum():
    stream = bytearray(M.write_audio(M.payload_of("text")))
    at = M.read_audio(bytes(stream))["offsets"][0]
    stream[at + 8] ^= 1  # in the side information
    read = M.read_audio(bytes(stream))
    assert read["bad_checksums"] == 1 and read["frames"] == 1


def test_reads_tables_and_tags_of_other_writers():
    # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, joint stereo, no checksum: 417 bytes a frame.
    frame = bytes.fromhex("fffb9064").ljust(417, b"\0")
    vbri = bytearray(frame)
    vbri[36:54] = b"VBRI" + bytes(6) + (9999).to_bytes(4, "big") + (2).to_bytes(4, "big")
    tag = b"ID3\x04\0\0\0\0\0\x0bTIT2\0\0\0\x01\0\0x"
    read = M.read_audio(tag + bytes(vbri) + frame * 2 + b"TAG".ljust(128, b"\0"))
    assert (read["version"], read["layer"], read["rate"], read["channels"]) == ("1", 3, 44100, 2)
    assert (read["frames"], read["samples"], read["table_frames"], read["table_bytes"]) == (2, 2304, 2, 9999)
    assert read["tag_bytes"] == 21 and read["skipped"] == 0
    assert M.read_audio(None)["frames"] == 0 and M.read_audio(b"no audio at all")["frames"] == 0


def plain_frames(data):
    """A second reader, of this writer's streams only: fixed header fields, sizes from the two bit rates in use."""
    assert data[:3] == b"ID3"
    at = 10 + int("".join(f"{b:07b}" for b in data[6:10]), 2)
    parts, first = [], True
    while at < len(data):
        bits = f"{int.from_bytes(data[at : at + 4], 'big'):032b}"
        assert bits[:16] == "1111111111110010" and bits[24:26] == "11"  # sync, MPEG-2, Layer III, protected; mono
        size = 72 * {13: 144, 14: 160}[int(bits[16:20], 2)] * 1000 // 16000
        crc = 0xFFFF
        for bit in bits[16:] + "0" * 72:
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 != int(bit) else 0)
        assert crc == int.from_bytes(data[at + 4 : at + 6], "big")
        if not first:
            parts.append(data[at + 15 : at + 15 + 576])
        at, first = at + size, False
    return b"".join(parts)


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000))
def test_a_second_reader_agrees(raw):
    payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
    assert plain_frames(M.write_audio(payload)) == payload


def test_checksums_of_layers_one_and_two():
    # Layer I, 256 kbit/s, 44.1 kHz, mono: allocations of 32 subbands, 4 bits each.
    for layer, first, covered in ((1, 0xFFFE80C0, 128), (2, 0xFFFC80C0, None)):
        head = first.to_bytes(4, "big")
        h = M.header(first)
        body = bytes(range(7, 7 + 40)).ljust(h[2] - 6, b"\0")
        bits = M.covered_bits(head + b"\0\0" + body, h[0], layer, h[4])
        assert covered in (None, bits)
        text = "".join(f"{b:08b}" for b in head[2:]) + "".join(f"{b:08b}" for b in body)[:bits]
        crc = 0xFFFF
        for bit in text:
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 != int(bit) else 0)
        good = head + crc.to_bytes(2, "big") + body
        bad = head + (crc ^ 1).to_bytes(2, "big") + body
        read = M.read_audio(good + bad + good)
        assert (read["layer"], read["frames"], read["bad_checksums"]) == (layer, 3, 1)


def test_older_tags_silence_and_wrong_tables():
    frame = bytes.fromhex("fffb9064").ljust(417, b"\0")
    lame = (3).to_bytes(4, "big") + (5).to_bytes(4, "big") + (999).to_bytes(4, "big") + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    first = bytearray(frame)
    first[36 : 36 + 4 + len(lame)] = b"Info" + lame
    tag = b"ID3\x02\0\x80\0\0\0\x09TT2\0\0\x02\xff\0a"
    read = M.read_audio(tag + bytes(first) + frame * 4)
    assert M.tags(tag)[1] == {b"TT2": b"\xffa"}
    assert (read["delay"], read["padding"], read["table_frames"], read["frames"], read["table_agrees"]) == (576, 1000, 5, 4, False)


def test_query(spark, tmp_path):
    texts = [None, "", "a", "ü" * 288, "x" * 577, "long " * 60_000, "a"]
    sf = store(tmp_path, documents=docs(spark, texts))
    rows = {r.doc_id: r for r in M.op1(spark, sf).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        stream = M.write_audio(payload)
        assert r.media_bytes == len(stream) and r.media_sha256 == hashlib.sha256(stream).hexdigest()
        assert r.duration_us == len(payload) * 1_000_000 // 16_000
    assert rows[2].feature == rows[6].feature
    assert M.op1(spark, store(tmp_path / "none", documents=docs(spark, []))).count() == 0
