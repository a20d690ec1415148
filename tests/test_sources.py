import os

import numpy as np
import pytest

from wavelattice.sources import adpcm, g711, pcm, sniff


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pcm")
    rng = np.random.default_rng(4)
    clips = {}
    for bits in (8, 16, 24, 32):
        hi = 1 << (bits - 1)
        x = rng.integers(-hi, hi, 2 * 5000)
        x[:2] = -hi, hi - 1
        for name, data in ((f"w{bits}.wav", pcm.wav_bytes(x, 2, 44100, bits)), (f"a{bits}.au", pcm.au_bytes(x, 2, 8000, bits, "hello")), (f"f{bits}.aiff", pcm.aiff_bytes(x, 2, 48000, bits))):
            (d / name).write_bytes(data)
            clips[name] = x
    return d, clips


def test_read_all_formats_in_parts(spark, folder):
    d, clips = folder
    pcm.register(spark)
    rows = spark.read.format("pcm").option("path", str(d)).option("blockframes", 512).option("partitionbytes", 4096).load()
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.clip_id, r.block_no)):
        assert r.start_frame == r.block_no * 512
        got.setdefault(r.clip_id, []).extend(r.pcm)
    assert set(got) == set(clips)
    for name, x in clips.items():
        assert got[name] == x.tolist(), name


def test_filter_prunes_files(spark, folder):
    d, clips = folder
    pcm.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("pcm").option("path", str(d)).load().where("clip_id = 'w16.wav'")
    assert sum(len(r.pcm) for r in rows.collect()) == len(clips["w16.wav"])


def test_write_and_read_again(spark, folder, tmp_path):
    d, clips = folder
    pcm.register(spark)
    samples = pcm.to_samples(spark.read.format("pcm").option("path", str(d / "w16.wav")).load())
    pcm.to_blocks(samples, 2, 44100, 16, 1000).write.format("pcm").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "w16.wav").read_bytes() == (d / "w16.wav").read_bytes()
    assert os.listdir(tmp_path / "out") == ["w16.wav"]


def test_headers(spark, folder):
    d, _ = folder
    files = spark.read.format("binaryFile").load(str(d))
    info = {r.clip_id: r for r in pcm.clip_info(files).collect()}
    assert (info["a24.au"].channels, info["a24.au"].sample_rate, info["a24.au"].bits, info["a24.au"].total_frames) == (2, 8000, 24, 5000)
    assert info["a24.au"].tags == {"comment": "hello"} and info["f8.aiff"].sample_rate == 48000
    kinds = {r[0][-8:].split("/")[-1]: r[1] for r in files.select("path", sniff.extension(files.content)).collect()}
    assert {v for k, v in kinds.items() if k.endswith("wav")} == {"wav"} and set(kinds.values()) == {"wav", "au", "aiff"}


def test_g711_goldens():
    codes = np.array([0x00, 0x55, 0xD5, 0xFF, 0x7F, 0x80])
    assert g711.ALAW[codes].tolist() == [-5504, -8, 8, 848, -848, 5504]
    assert g711.MULAW[codes].tolist() == [-32124, -716, 716, 0, 0, 32124]
    for law in (True, False):
        table = g711.ALAW if law else g711.MULAW
        assert (table[g711.encode(table, law)] == table).all()


@pytest.mark.parametrize("channels", [1, 2])
def test_ima_blocks_follow_the_signal(channels):
    t = np.arange(505)
    x = np.stack([(8000 * np.sin(t / (9 + c))).astype(int) for c in range(channels)], axis=1)
    raw = adpcm.ima_encode_block(x, [0] * channels)
    y = adpcm.ima_block(raw, channels, 505)
    assert y.shape == x.shape and (y[0] == x[0]).all() and np.abs(y[60:] - x[60:]).mean() < 250


def test_ms_and_yamaha_decode():
    block = bytes([0]) + (16).to_bytes(2, "little") + (100).to_bytes(2, "little") + (50).to_bytes(2, "little") + bytes([0x10, 0x0F])
    assert adpcm.ms_block(block, 1, 6)[:, 0].tolist()[:3] == [50, 100, 116]
    assert adpcm.yamaha(bytes([0x07]), 1)[:, 0].tolist()[0] == 127 * 15 // 8


def test_tags():
    tags = {"TITLE": "ä b", "ARTIST": "c"}
    assert sniff.vorbis_comments(sniff.vorbis_bytes(tags)) == tags
    assert sniff.vorbis_comments(sniff.vorbis_bytes(tags)[:-3]) == {"TITLE": "ä b"}
    assert sniff.id3v2(sniff.id3v2_bytes({"TIT2": "ä", "TPE1": "x"})) == {"TIT2": "ä", "TPE1": "x"}
    with pytest.raises(ValueError):
        sniff.vorbis_bytes({"a=b": "c"})


def test_extended_floats():
    for x in (1.0, 44100.0, 8000.0, 0.5, 192000.0):
        assert pcm.extended(pcm.to_extended(x)) == x


def test_broken_files(tmp_path):
    import io

    for raw in (b"", b"RIFF\0\0\0\0WAVE", b"nothing at all here"):
        with pytest.raises(ValueError):
            pcm.layout(io.BytesIO(raw))
