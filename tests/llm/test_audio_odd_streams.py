"""Layer II checksums, tables that lie, and streams that once broke the parser."""

import random

import pytest

from leaksieve.llm import mpeg_audio


def crc_of(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15 ^ int(b)
        c = c << 1 & 0xFFFF
        c ^= 0x8005 * top
    return c


# word, allocation bits by subband; 0xFFFC: MPEG-1 layer II, protected; 0xFFF4: MPEG-2
CASES = [
    (0xFFFC10C0, [4] * 2 + [3] * 6),  # mono, 32 kbit/s, 44.1 kHz
    (0xFFFC18C0, [4] * 2 + [3] * 10),  # mono, 32 kbit/s, 32 kHz
    (0xFFFC84C0, [4] * 11 + [3] * 12 + [2] * 4),  # mono, 128 kbit/s, 48 kHz
    (0xFFFC80C0, [4] * 11 + [3] * 12 + [2] * 7),  # mono, 128 kbit/s, 44.1 kHz
    (0xFFF480C0, [4] * 4 + [3] * 7 + [2] * 19),  # MPEG-2, mono, 64 kbit/s
]


@pytest.mark.parametrize("word,widths", CASES)
def test_layer_two_checksums(word, widths):
    rng = random.Random(word)
    size = mpeg_audio.header(word)[4]
    bits = ""
    used = 0
    for w in widths:
        value = rng.randrange(1 << w) if rng.random() < 0.6 else 0
        bits += f"{value:0{w}b}"
        used += value > 0
    bits += "".join(rng.choice("01") for _ in range(2 * used))
    crc = crc_of(f"{word & 0xFFFF:016b}" + bits)
    rest = bits + "".join(rng.choice("01") for _ in range(8 * (size - 6) - len(bits)))
    frame = word.to_bytes(4, "big") + crc.to_bytes(2, "big") + int(rest, 2).to_bytes(size - 6, "big")
    d = mpeg_audio.describe(frame * 3)
    assert (d["layer"], len(d["frames"]), d["crc_ok"], d["crc_bad"], d["crc_unverified"]) == (2, 3, 3, 0, 0)
    bad = bytearray(frame)
    bad[6] ^= 0x80
    assert mpeg_audio.describe(frame + bytes(bad) + frame)["crc_bad"] == 1


def test_streams_that_broke_the_parser():
    short = 0xFFF310C4  # MPEG-2 layer III, 8 kbit/s, mono: a frame of few bytes
    size = mpeg_audio.header(short)[4]
    frame = (short.to_bytes(4, "big") + bytes(32) + b"VBRI").ljust(size, b"\0")[:size]
    assert len(mpeg_audio.describe(frame * 3)["frames"]) == 3
    for stated in ("²", "9" * 5000, "-1", ""):
        text = b"\x03PAYLOAD_BYTES\0" + stated.encode()
        tag = b"TXXX" + mpeg_audio._syncsafe(len(text)) + b"\0\0" + text
        stream = b"ID3\x04\0\0" + mpeg_audio._syncsafe(len(tag)) + tag + mpeg_audio.store(b"x" * 100)
        assert mpeg_audio.describe(stream)["frames"]


def test_a_table_that_lies_is_seen():
    media = mpeg_audio.store(bytes(9000))
    assert mpeg_audio.describe(media)["table_agrees"] is True
    last = mpeg_audio.describe(media)["frames"][-1]
    assert mpeg_audio.describe(media[:last])["table_agrees"] is False
    assert mpeg_audio.describe(b"")["table_agrees"] is None


def test_random_bytes_never_fail():
    rng = random.Random(5)
    for _ in range(300):
        data = b"".join(rng.choice([rng.randbytes(rng.randrange(80)), b"ID3", b"\xff\xfa\x90\xc4", b"\xff\xf3\x10\xc4", b"VBRI", b"Xing", bytes(36), b"TAG"]) for _ in range(12))
        mpeg_audio.describe(data)
