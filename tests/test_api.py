import numpy as np
import pytest

from wavelattice import api
from wavelattice.functions import sql
from wavelattice.operators import pipeline as pl
from wavelattice.operators.format import Format
from wavelattice.sources import pcm


def _read(path):
    import io

    raw = path.read_bytes()
    x = pcm.layout(io.BytesIO(raw))
    return pcm.decode(raw[x.start : x.start + x.size], x), x


@pytest.fixture(scope="module")
def wav(tmp_path_factory):
    d = tmp_path_factory.mktemp("api")
    t = np.arange(8000 * 3)
    x = (12000 * np.sin(2 * np.pi * 500 * t / 8000)).astype(int)
    (d / "in").mkdir()
    (d / "in" / "a.wav").write_bytes(pcm.wav_bytes(np.stack([x, -x], axis=1).reshape(-1), 2, 8000, 16))
    return d, x


def test_probe(spark, wav):
    d, x = wav
    r = api.probe(spark, str(d / "in")).first()
    assert (r.clip_id, r.channels, r.sample_rate, r.bits, r.total_frames, r.duration_s) == ("a.wav", 2, 8000, 16, 24000, 3.0)
    assert r.peak == np.abs(x).max() / 32768 and abs(r.rms - np.sqrt(np.mean(x.astype(float) ** 2)) / 32768) < 1e-9
    assert len(r.waveform) == 200 and -12 < r.lufs < -5


def test_convert_and_formats(spark, wav, tmp_path):
    d, x = wav
    fmt = api.convert(spark, str(d / "in"), str(tmp_path), pl.Gain(1.0), pl.Gain(0.5), pl.BitDepth(24), pl.Channels(1))
    got, layout = _read(tmp_path / "a.wav")
    assert fmt == Format(1, 8000, 24) and (layout.channels, layout.bits) == (1, 24) and len(got) == 24000
    assert np.abs(got).max() <= 256


def test_cut_mix_and_concatenate(spark, wav, tmp_path):
    d, x = wav
    src = str(d / "in")
    assert api.cut(spark, src, str(tmp_path / "c"), 1, 2) and not api.cut(spark, src, str(tmp_path / "n"), 9, 12)
    assert (_read(tmp_path / "c" / "a.wav")[0][:, 0] == x[8000:16000]).all()
    api.mix(spark, [(src, 0.5), (str(tmp_path / "c"), 0.25)], str(tmp_path / "m"), "m")
    mixed = _read(tmp_path / "m" / "m.wav")[0][:, 0]
    want = x * 0.5
    want[:8000] += x[8000:16000] * 0.25
    assert (mixed == np.rint(want)).all()
    api.concatenate(spark, [src, str(tmp_path / "c")], str(tmp_path / "k"), "k")
    assert (_read(tmp_path / "k" / "k.wav")[0][:, 0] == np.concatenate([x, x[8000:16000]])).all()


def test_identities_are_left_out(spark):
    s = spark.createDataFrame([("a", 0, 0, 5)], "clip_id string, frame long, channel int, sample int")
    chain = pl.Pipeline([pl.Gain(1.0), pl.Pan(0.0), pl.BitDepth(16), pl.Channels(2), pl.Fade(), pl.Resample(8000)])
    fmt = Format(2, 8000, 16)
    assert chain.is_identity(fmt) and chain.apply(s, fmt) is s and chain.format(fmt) == fmt


def test_sql_functions(spark):
    assert "pcm_gain" in sql.register(spark)
    got = spark.sql("SELECT pcm_gain(30000, 2.0D, 16), pcm_gain(-5, 0.3D, 16), alaw_expand(85), alaw_expand(0), mulaw_expand(0), mulaw_expand(128), frame_slot(1001, 30, 1, 1000), pixel_blend(0, 255, 128), pixel_composite(10, 200, 255)").first()
    assert tuple(got) == (32767, -1, -8, -5504, -32124, 32124, 30, 128, 200)
    plan = spark.range(5).selectExpr("pcm_gain(cast(id as int), 0.5D, 16) AS x")._jdf.queryExecution().optimizedPlan().toString()
    assert "pcm_gain" not in plan.split("Project")[0]
