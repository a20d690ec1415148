"""Many short groups: what they cost beyond their rows, and that batches may end anywhere in them."""

import numpy as np
import pytest

import __spark_entry__
from wavelattice.sources import adpcm, bits, clips

SF = "/root/testdata/sf0.001"


def _steps(monkeypatch, run, name="ima_code", owner=adpcm):
    """How often ``run`` calls a function."""
    calls, real = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a: calls.append(1) or real(*a))
    run()
    return len(calls)


def _ima_by_definition(x):
    """One block of mono frames by plain loops over the step sizes."""
    p, i, out, codes = int(x[0]), 0, [int(x[0])], []
    for v in x[1:].tolist():
        d = v - p
        sizes = [adpcm.ima_size(adpcm.IMA_STEPS[i], n) for n in range(8)]
        n = min(range(8), key=lambda n: abs(abs(d) - sizes[n]))
        p, i = max(-32768, min(32767, p + (-sizes[n] if d < 0 else sizes[n]))), max(0, min(88, i + adpcm.IMA_INDEX[n]))
        out.append(p)
        codes.append(n | 8 * (d < 0))
    return out, codes


def test_filling_up_an_ima_block_costs_no_steps(monkeypatch):
    x = (np.sin(np.arange(66) / 5) * 9000).astype(np.int64).reshape(-1, 1)
    raw = adpcm.encode(x, "ima")
    want, codes = _ima_by_definition(np.concatenate([x[:, 0], np.zeros(2041 - 66, np.int64)]))
    assert raw[4:] == bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2], strict=True))
    assert adpcm.decode(raw, "ima", 1, 1024, 2041)[:, 0].tolist() == want
    assert _steps(monkeypatch, lambda: adpcm.encode(x, "ima")) < 300


def test_filling_up_an_ms_block_costs_no_steps(monkeypatch):
    for level in range(-9, 10):  # the remainder decides whether silence stands still or swings
        x = np.r_[0, 0, np.arange(60) * 300, level].astype(np.int64).reshape(-1, 1)
        silent = np.concatenate([x, np.zeros((2 * 2036 - len(x), 1), np.int64)])
        state, codes = adpcm.MsState(adpcm.MS_COEFFICIENTS[0], 16, 0, 0), []
        heard = [0, 0] + [(codes.append(state.code(v)), state.last)[1] for v in silent[2:2036, 0].tolist()]
        raw = adpcm.encode(x, "ms")
        assert raw[7:] == bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        assert adpcm.decode(raw, "ms", 1, 1024, 2036)[:, 0].tolist() == heard
        assert adpcm.encode(silent, "ms")[1025:1027] == state.delta.to_bytes(2, "little")
        assert _steps(monkeypatch, lambda x=x: adpcm.encode(x, "ms"), "code", adpcm.MsState) < 300
        assert _steps(monkeypatch, lambda raw=raw: adpcm.decode(raw, "ms", 1, 1024, 2036), "expand", adpcm.MsState) < 300


def test_clips_cross_batches_and_take_no_call_each(spark):
    lengths = {f"c{k}": (1, 2, 7, 20, 3)[k % 5] for k in range(40)}
    rows = [(c, f, (f * 997 + len(c)) % 60000 - 30000) for c, n in lengths.items() for f in range(n)]
    df = spark.createDataFrame(rows[::-1], "clip_id string, frame long, sample int")
    files = clips.encode_files(df, "wav", 8000)
    assert "FlatMapGroups" not in files._jdf.queryExecution().toString()
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in clips.decode_files(files).select("clip_id", "frame", "sample").collect()]
        assert files.count() == len(lengths)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert sorted(got) == sorted(rows)


@pytest.mark.parametrize("name", ["checksum_residues", "amf0_values", "roundtrip_flv"])
def test_sources_cross_batches_and_take_no_call_each(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Join" not in plan
    want, key = df.collect(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = __spark_entry__.queries()[name](spark, SF).collect()
    finally:
        spark.conf.set(key, kept)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and want


def test_checksums_of_32_bits_take_no_step_a_byte(monkeypatch):
    for n in (0, 1, 2, 9, 300):
        data = bytes(k * 37 % 256 for k in range(n))
        assert bits.ogg_crc(data) == bits.crc(data, 0x04C11DB7, 32) and bits.ts_crc(data) == bits.crc(data, 0x04C11DB7, 32, 0xFFFFFFFF)
    assert _steps(monkeypatch, lambda: (bits.ogg_crc(b"x" * 99), bits.ts_crc(b"x" * 99)), "crc", bits) == 0
