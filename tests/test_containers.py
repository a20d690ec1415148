import random
import struct

import numpy as np
import pytest

from wavelattice.sources import bits, containers, flac


def test_amf0_round_trip():
    v = {"a": 1.5, "b": True, "c": "x" * 70000, "d": [None, {"e": "ü"}], "f": {}}
    raw = containers.amf0_write(v)
    assert containers.amf0_read(raw) == (v, len(raw))
    with pytest.raises((ValueError, IndexError)):
        containers.amf0_read(raw[:-1])
    deep = b"\x0a\0\0\0\x01" * 40 + b"\x05"
    with pytest.raises(ValueError):
        containers.amf0_read(deep)


def _flv():
    video = lambda key, kind, offset, data: bytes([(0x10 if key else 0x20) | 7, kind]) + offset.to_bytes(3, "big") + data
    near = (1 << 32) - 10
    return containers.flv_file([
        (9, near, video(True, 0, 0, b"cfg1")), (8, near, b"\xaf\x00c"), (9, near, video(True, 1, 40, b"k")), (8, near + 5, b"\xaf\x01a"),
        (9, near + 33, video(False, 1, 0, b"p")), (9, near + 33, video(True, 0, 0, b"cfg2")), (9, near + 66, video(True, 1, 0, b"q")),
    ])


def test_flv_unwraps_times_and_counts_versions():
    near = (1 << 32) - 10
    got = list(containers.flv_packets(_flv()))
    assert [(t, p - near, d - near, k, v, b) for t, _, _, p, d, k, v, b in got] == [
        (0, 40, 0, True, 0, b"k"), (1, 5, 5, True, 0, b"a"), (0, 33, 33, False, 0, b"p"), (0, 66, 66, True, 1, b"q")
    ]


def test_ogg_pages():
    big = bytes(range(256)) * 3
    raw = containers.ogg_page(7, 0, 0, [b"OpusHead"], True) + containers.ogg_page(7, 1, 960, [big, b"x" * 255, b""])
    assert [(s, g, p) for s, g, p in containers.ogg_packets(raw)] == [(7, 0, b"OpusHead"), (7, 960, big), (7, 960, b"x" * 255), (7, 960, b"")]
    broken = bytearray(raw)
    broken[-1] ^= 1
    assert [p for _, _, p in containers.ogg_packets(bytes(broken))] == [b"OpusHead"]


def _box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _mp4():
    full = lambda kind, *v: _box(kind, bytes(4), *v)
    ints = lambda *v: struct.pack(f">{len(v)}I", *v)
    ftyp = _box(b"ftyp", b"isom", bytes(4))

    def moov(at):
        stbl = _box(
            b"stbl", full(b"stsd", ints(1), _box(b"avc1", bytes(8))), full(b"stts", ints(2, 2, 10, 1, 20)), full(b"ctts", ints(1, 3, 5)), full(b"stsc", ints(2, 1, 2, 1, 2, 1, 1)),
            full(b"stsz", ints(0, 3, 1, 2, 3)), full(b"stco", ints(2, at, at + 3)), full(b"stss", ints(1, 1)),
        )
        mdia = _box(b"mdia", full(b"mdhd", ints(0, 0, 600, 40)), _box(b"minf", stbl))
        return _box(b"moov", _box(b"trak", _box(b"edts", full(b"elst", ints(1, 40, 5, 1 << 16))), mdia))

    at = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(at) + _box(b"mdat", b"abbccc")


def test_mp4_sample_tables():
    assert list(containers.mp4_packets(_mp4())) == [
        (0, "h264", 600, 0, -5, True, 0, b"a"), (0, "h264", 600, 10, 5, False, 0, b"bb"), (0, "h264", 600, 20, 15, False, 0, b"ccc")
    ]


def test_matroska_lacing_and_blocks():
    el = lambda kind, body: kind + (0x10000000 | len(body)).to_bytes(4, "big") + body
    track = el(b"\xae", el(b"\xd7", b"\x01") + el(b"\x86", b"A_OPUS"))
    xiph = b"\x81\x00\x05\x82" + bytes([2, 255, 1, 2]) + b"x" * 256 + b"yy" + b"z"
    ebml = b"\x81\x00\x06\x86" + bytes([2, 0x83, 0xBF + 1]) + b"aaabbbb" + b"c"
    fixed = b"\x81\x00\x07\x84" + bytes([1]) + b"ppqq"
    cluster = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + el(b"\xe7", b"\x0a") + b"".join(el(b"\xa3", b) for b in (xiph, ebml, fixed))
    cluster += el(b"\xa0", el(b"\xa1", b"\x81\x00\x08\x00g") + el(b"\xfb", b"\x01"))
    raw = el(b"\x1a\x45\xdf\xa3", b"") + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + el(b"\x16\x54\xae\x6b", track) + cluster
    got = containers.read_packets(raw)
    assert [p[7] for p in got] == [b"x" * 256, b"yy", b"z", b"aaa", b"bbbb", b"c", b"pp", b"qq", b"g"]
    assert {p[1] for p in got} == {"opus"} and got[0][3] == 15000 and got[-1][5] is False


def test_packets_through_spark(spark, tmp_path):
    (tmp_path / "a.flv").write_bytes(_flv())
    (tmp_path / "b.mp4").write_bytes(_mp4())
    got = containers.packets(spark.read.format("binaryFile").load(str(tmp_path))).groupBy("source_id").count().collect()
    assert {(r.source_id, r["count"]) for r in got} == {("a.flv", 4), ("b.mp4", 3)}


def test_random_bytes_end_cleanly():
    rng = random.Random(1)
    for n in range(300):
        raw = bytes(rng.randrange(256) for _ in range(rng.randrange(200)))
        for head in (b"FLV\x01\x05\0\0\0\x09\0\0\0\0", b"OggS", b"\x1a\x45\xdf\xa3\x80", b"\0\0\0\x08ftyp"):
            try:
                containers.read_packets(head + raw)
            except (ValueError, IndexError, struct.error, TypeError):
                pass


def test_nal_units_and_configuration():
    units = [b"\x67\x42\x00\x1e", b"\x68\xce", b"\x65" + b"\x01" * 5]
    annex = b"\0\0\0\x01" + b"\0\0\x01".join(units)
    assert bits.nal_units(annex) == units
    assert bits.to_annex_b(bits.to_length_prefixed(annex)) == b"".join(b"\0\0\0\x01" + u for u in units)
    c = bits.AvcConfig(66, 0, 30, 4, (units[0],), (units[1],))
    assert bits.parse_avcc(bits.build_avcc(c)) == c
    with pytest.raises(ValueError):
        bits.parse_avcc(bits.build_avcc(c)[:-1])
    assert bits.without_emulation(b"\0\0\x03\x01\0\0\x03") == b"\0\0\x01\0\0"


def test_sps_size():
    w = "".join(["01000010", "00000000", "00011110", "1", "1", "1", "1", "010", "0", "00000101000", "0000100100", "1", "0", "0", "1"])
    nal = b"\x67" + int(w + "0" * (-len(w) % 8), 2).to_bytes((len(w) + 7) // 8, "big")
    got = bits.parse_h264_sps(nal)
    assert (got["profile"], got["level"], got["width"] % 16, got["height"] % 16) == (66, 30, 0, 0)


def test_adts_frames():
    raw = b"".join(bits.adts_header(2, 44100, 2, n) + bytes(n) for n in (5, 0, 300))
    assert [(o, r, c, len(p)) for o, r, c, p in bits.adts_frames(raw + b"\xff")] == [(2, 44100, 2, 5), (2, 44100, 2, 0), (2, 44100, 2, 300)]


def test_checksums():
    assert bits.ts_crc(b"123456789") == 0x0376E6E7 and bits.flac_crc8(b"123456789") == 0xF4 and bits.flac_crc16(b"123456789") == 0xFEE8


@pytest.mark.parametrize("width,channels,n", [(16, 2, 5000), (24, 1, 700), (8, 3, 1), (16, 1, 4096)])
def test_flac_round_trip(width, channels, n):
    rng = np.random.default_rng(n)
    hi = 1 << (width - 1)
    t = np.arange(n)[:, None] * np.arange(1, channels + 1)
    x = (0.4 * hi * np.sin(t / 40)).astype(np.int64) + rng.integers(-3, 4, (n, channels))
    x[n // 2 :] = rng.integers(-hi, hi, (n - n // 2, channels))
    head, y = flac.decode(flac.encode(x, 44100, width, 1024))
    assert (head.rate, head.channels, head.bits, head.total) == (44100, channels, width, n) and (x == y).all()


def test_flac_damage_is_seen():
    raw = bytearray(flac.encode(np.arange(300)[:, None], 8000, 16))
    raw[60] ^= 4
    with pytest.raises((ValueError, EOFError)):
        flac.decode(bytes(raw))
