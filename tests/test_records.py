import numpy as np
import pytest

from wavelattice.sources import adpcm, asf, containers, hevc, jpeg, muxers, rtmp, tta, wavpack
from wavelattice.sources.bitio import BitSink, BitTap, Huffman


def _golomb(out, v):
    code = v + 1
    out.put(0, code.bit_length() - 1)
    out.put(code, code.bit_length())


def test_hevc_records():
    profile = hevc.Profile(0, 0, 1, 0x60000000, 0xB00000000000, 93)
    assert profile.codecs() == "hvc1.1.6.L93.B0"
    assert hevc.Profile(1, 1, 4, 0x10000000, 0x900000000008, 120).codecs("hev1") == "hev1.A4.8.H120.90.0.0.0.0.8"
    out = BitSink()
    for value, n in ((33 << 1, 8), (1, 8), (0, 4), (1, 3), (1, 1), (0, 2), (0, 1), (1, 5), (0x60000000, 32), (0xB000, 16), (0, 32), (93, 8), (1, 1), (1, 1), (0, 14), (5, 88), (90, 8)):
        out.put(value, n)
    for v in (0, 1, 1920, 1088):
        _golomb(out, v)
    out.put(1, 1)
    for v in (0, 0, 0, 4, 0, 0):
        _golomb(out, v)
    nal = out.bytes()
    escaped = nal.replace(b"\0\0\0", b"\0\0\3\0").replace(b"\0\0\1", b"\0\0\3\1")
    got = hevc.parse_sps(escaped)
    assert (got["width"], got["height"], got["luma_bits"], got["chroma"]) == (1920, 1080, 8, 1) and got["profile"] == profile
    config = hevc.HevcConfig(profile, 1, 8, 10, 4, ((32, True, (b"vps",)), (33, True, (nal,)), (34, False, (b"p", b"q"))), 7, 2, 30, 1, 3, False)
    assert hevc.parse_hvcc(hevc.build_hvcc(config)) == config
    with pytest.raises(ValueError):
        hevc.parse_hvcc(hevc.build_hvcc(hevc.HevcConfig(profile, 1, 8, 8, 4, ())))


def _decoded(raw):
    """A plain baseline decoder: planes of a 4:2:0 file."""
    at, quant, tables, size, scan = 2, {}, {}, None, b""
    while raw[at + 1] != 0xDA:
        mark, n = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + n]
        if mark == 0xDB:
            quant[body[0]] = np.frombuffer(body[1:], np.uint8).astype(np.float64)
        elif mark == 0xC4:
            tables[body[0]] = Huffman.canonical(body[1:17], body[17:])
        elif mark == 0xC0:
            size = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        at += 2 + n
    at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    scan = raw[at:-2].replace(b"\xff\0", b"\xff")
    bits, before = BitTap(scan), [0, 0, 0]

    def number(n):
        v = bits.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    h, w = size
    rows, columns = -(-h // 16), -(-w // 16)
    out = [np.zeros((rows * 16, columns * 16)), np.zeros((rows * 8, columns * 8)), np.zeros((rows * 8, columns * 8))]
    for r in range(rows):
        for c in range(columns):
            for k, y, x in [(0, 2 * r + i // 2, 2 * c + i % 2) for i in range(4)] + [(1, r, c), (2, r, c)]:
                own, t = np.zeros(64), min(k, 1)
                before[k] += number(tables[t].take(bits))
                own[0], i = before[k], 1
                while i < 64:
                    s = tables[0x10 | t].take(bits)
                    if s == 0:
                        break
                    i += s >> 4
                    if s & 15:
                        own[i] = number(s & 15)
                    i += 1
                flat = np.zeros(64)
                flat[jpeg.ZIGZAG] = own * quant[t]
                out[k][8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = jpeg._BASIS.T @ flat.reshape(8, 8) @ jpeg._BASIS + 128
    return out[0][:h, :w], out[1][: (h + 1) // 2, : (w + 1) // 2], out[2][: (h + 1) // 2, : (w + 1) // 2]


@pytest.mark.parametrize("h,w", [(16, 16), (33, 50), (1, 1), (40, 17)])
def test_jpeg_is_read_back_by_a_plain_decoder(h, w):
    rng = np.random.default_rng(h)
    y = np.clip(128 + 60 * np.sin(np.arange(h)[:, None] / 5) + 40 * np.cos(np.arange(w)[None, :] / 7) + rng.normal(0, 2, (h, w)), 0, 255).astype(np.uint8)
    u, v = y[::2, ::2] // 2 + 40, 255 - y[::2, ::2]
    for quality, most in ((100, 1.5), (75, 8), (10, 30)):
        for got, want in zip(_decoded(jpeg.encode(y, u, v, quality)), (y, u, v), strict=True):
            assert np.abs(got - want.astype(float)).mean() < most
    assert len(jpeg.encode(y, u, v, 10)) <= len(jpeg.encode(y, u, v, 95))
    noise = rng.integers(0, 256, (h, w)).astype(np.uint8)
    got = _decoded(jpeg.encode(noise, u, v, 100))[0]
    assert np.abs(got - noise).max() <= 3


def test_zigzag_and_quality():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG.tolist()) == list(range(64))
    assert (jpeg.quantisers(50)[0] == jpeg.LUMA_QUANT).all() and (jpeg.quantisers(100)[1] == 1).all()
    with pytest.raises(ValueError):
        jpeg.quantisers(0)


def test_huffman_words():
    code = Huffman.canonical(bytes([0, 2, 3]), b"abcde")
    out = BitSink()
    for s in b"abecedab":
        code.put(out, s)
    bits = BitTap(out.bytes())
    assert bytes(code.take(bits) for _ in range(8)) == b"abecedab"
    with pytest.raises(ValueError):
        Huffman.canonical(bytes([3]), b"abc")


def test_asf_packets():
    frames = [(0, b"a" * 100), (20, b"b" * 7000), (40, b""), (60, bytes(range(256)) * 20)]
    head, got = asf.read(asf.write(2, 44100, 0x161, 1486, b"extra", frames))
    assert [(t, d) for _, t, d in got] == frames
    assert (head["channels"], head["rate"], head["tag"], head["align"], head["extra"], head["duration_ms"]) == (2, 44100, 0x161, 1486, b"extra", 60)
    with pytest.raises(ValueError):
        asf.read(b"RIFF" + bytes(60))


def test_rtmp_session():
    mine = rtmp.hello(5, (bytes(range(256)) * 6)[:1528])
    assert rtmp.answered(mine, rtmp.answer(mine, 9)) and not rtmp.answered(mine, bytes(1536))
    tags = [(rtmp.VIDEO, 0, b"\x17\0" + b"x" * 9000), (rtmp.AUDIO, 20, b"\xaf\1abc"), (rtmp.VIDEO, 17_000_000, b"\x27\1z")]
    got = list(rtmp.events(rtmp.publish("app", "key", tags, {"width": 1920.0})))
    assert got[0] == ("control", 0, (1, 4096)) and [v[0] for k, _, v in got if k == "command"] == ["connect", "createStream", "publish"]
    assert [v for k, _, v in got if k == "data"] == [["@setDataFrame", "onMetaData", {"width": 1920.0}]]
    assert [(t, v) for k, t, v in got if k in ("audio", "video")] == [(t, b) for _, t, b in tags]
    assert rtmp.values(rtmp.command("_result", 1, None, {"a": True})) == ["_result", 1.0, None, {"a": True}]


def test_mp4_probe_and_edits():
    packets = [(k * 512, k * 512, k % 10 == 0, b"x" * k) for k in range(50)]
    video = {"codec": "avc1", "timescale": 12800, "packets": packets, "width": 1920, "height": 1080, "rotation": 90, "edits": [(500, -1), (1500, 1024)]}
    raw = muxers.mp4([video, {"codec": "mp4a", "timescale": 48000, "packets": [(k * 1024, k * 1024, True, b"a") for k in range(90)]}])
    got = containers.mp4_probe(raw)
    assert got == {"duration_s": 2.0, "width": 1920, "height": 1080, "codec": "avc1", "frames": 50, "frame_rate": 25.0, "rotation": 90, "has_audio": True}
    first = containers.read_packets(raw)[0]
    assert first[3] == -1024 + 6400  # half a second later, from the third frame on


def test_ms_adpcm_rounds_towards_zero_and_takes_the_files_coefficients():
    state = adpcm.MsState((256, 0), 16, -3, 0)
    assert state.predicted() == -3
    state = adpcm.MsState((240, 0), 16, -3, 0)
    assert state.predicted() == -2  # -720 / 256, not its floor
    head = bytes([0]) + (16).to_bytes(2, "little") + (-3).to_bytes(2, "little", signed=True) + (7).to_bytes(2, "little")
    assert adpcm.ms_block(head + bytes([0x00]), 1, 4)[:, 0].tolist() == [7, -3, -3, -3]
    assert adpcm.ms_block(head + bytes([0x00]), 1, 4, ((240, 0),))[:, 0].tolist() == [7, -3, -2, -1]


def test_nearest_ima_code():
    for predictor, index, sample in ((0, 0, 3), (100, 30, -250), (-32768, 88, 32767), (5, 10, 5)):
        errors = [abs(abs(sample - predictor) - adpcm.ima_size(adpcm.IMA_STEPS[index], n)) for n in range(8)]
        assert adpcm.ima_code(predictor, index, sample) & 7 == errors.index(min(errors))


@pytest.mark.parametrize("channels", [1, 2])
def test_adpcm_round_trips_are_near(channels):
    x = (np.sin(np.arange(5000)[:, None] / 30 * (1 + np.arange(channels))) * 8000).astype(np.int64)
    for kind in ("ima", "ms", "yamaha"):
        per = 0 if kind == "yamaha" else adpcm.frames_per_block(kind, channels)
        y = adpcm.decode(adpcm.encode(x, kind), kind, channels, adpcm.BLOCK_BYTES, per)[:5000]
        assert np.abs(y - x).mean() < 120, kind
    y = adpcm.ima4(adpcm.ima4_encode(x), channels)[:5000]
    assert np.abs(y - x).mean() < 120


def test_broken_files_are_refused():
    x = np.arange(100).reshape(-1, 1)
    for raw, read in ((tta.encode(x, 8000), tta.decode), (wavpack.encode(x, 8000), wavpack.decode)):
        read(raw)
        for bad in (raw[:-3], raw[:60] + bytes([raw[60] ^ 1]) + raw[61:], b"none" + raw[4:]):
            with pytest.raises((ValueError, EOFError)):
                read(bad)
    with pytest.raises(ValueError):
        wavpack.encode(x[:0], 8000)


def test_wavpack_terms_of_both_kinds_and_long_codes():
    rng = np.random.default_rng(5)
    for term in (-1, -2, -3, 1, 5, 8, 17, 18):
        x = rng.integers(-900, 900, (300, 2)).tolist()
        coded = wavpack._Pass(term, 3, 2).run(x, False)
        assert wavpack._Pass(term, 3, 2).run(coded, True) == x
    words = lambda: wavpack._Words([[0, 0, 0], [0, 0, 0]])
    residuals = [0] * 50 + [100_000, -1, 0, 7, -100_000] + [0] * 7 + rng.integers(-3, 4, 400).tolist() + [1 << 22, 0, 0]
    residuals += [0] * (len(residuals) % 2)
    out = BitSink(lsb=True)
    wavpack.put_words(out, residuals, 2, words())
    assert wavpack.take_words(BitTap(out.bytes(), lsb=True), len(residuals), 2, words()) == residuals


def test_matroska_rebuilds_decode_times_and_spreads_laced_frames():
    times = [0, 120, 40, 80, 240, 160, 200, 280]
    raw = muxers.matroska({1: "h264", 2: "opus"}, [(1, t, t == 0, b"v") for t in times] + [(2, 20 * k, True, b"a") for k in range(4)])
    got = containers.read_packets(raw)
    video = [(r[3] // 1000, r[4] // 1000) for r in got if r[0] == 1]
    assert [p for p, _ in video] == times and [d for _, d in video] == sorted(d for _, d in video) and all(d <= p for p, d in video)
    assert all(r[3] == r[4] for r in got if r[0] == 2)
    frames = [b"x", b"yy", b"zzz"]
    laced = bytes([0x82, 0, 5, 0x82, 2, 1, 2]) + b"".join(frames)
    entry = muxers.element(0xAE, muxers.element(0xD7, 2), muxers.element(0x86, "A_OPUS"), muxers.element(0x23E383, 20_000_000))
    body = muxers.element(0x1549A966, muxers.element(0x2AD7B1, 1_000_000)) + muxers.element(0x1654AE6B, entry) + muxers.element(0x1F43B675, muxers.element(0xE7, 100), muxers.element(0xA3, laced))
    got = containers.read_packets(muxers.element(0x1A45DFA3, muxers.element(0x4282, "webm")) + muxers.element(0x18538067, body))
    assert [(r[3] // 1000, r[7]) for r in got] == [(105, b"x"), (125, b"yy"), (145, b"zzz")]


def test_incremental_encoders_give_the_bytes_of_whole_files():
    from wavelattice.sources import clips, flac

    rng = np.random.default_rng(6)
    x = rng.integers(-2000, 2000, (10_000, 2))
    stream, raw = clips.FlacStream(44100, 2), b""
    for a in range(0, len(x), 777):
        raw += stream.push(x[a : a + 777])
    raw += stream.finish()
    assert raw[42:] == flac.encode(x, 44100, 16)[42:]
    assert (flac.decode(raw, check=False)[1] == x).all()
    stream, raw = clips.PacketStream(tta.encode_frame, 2, tta.frame_length(8000)), b""
    for a in range(0, len(x), 777):
        raw += stream.push(x[a : a + 777])
    size = tta.frame_length(8000)
    assert raw + stream.finish() == b"".join(tta.encode_frame(x[a : a + size]) for a in range(0, len(x), size))


def test_blocks_are_handed_to_a_call(spark, tmp_path):
    from wavelattice.sources import clips, pcm

    x = np.arange(10_000) % 3000
    files = spark.createDataFrame([("a.wav", bytearray(pcm.wav_bytes(x, 1, 8000, 16)))], "path string, content binary")
    folder = str(tmp_path)

    def call(name, first, block):
        np.save(f"{folder}/{name}-{first}.npy", block)

    clips.for_each_block(files, call)
    got = np.concatenate([np.load(f"{folder}/a.wav-{a}.npy") for a in range(0, 10_000, 4096)])
    assert (got[:, 0] == x).all()
