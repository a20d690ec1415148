import struct

from wavelattice.sources import bits, containers, mp3_probe, muxers


def test_mp4_round_trip(spark, tmp_path):
    rows = [("a", 0, d + 2 * (d % 3), d, d % 5 == 0, bytes([d]) * (d + 1)) for d in range(0, 60, 5)] + [("a", 1, d, d, True, b"s" * 3) for d in range(0, 90, 30)]
    df = spark.createDataFrame(rows, "source_id string, track_id int, pts long, dts long, is_keyframe boolean, payload binary").repartition(4)
    out = muxers.write_files(df, str(tmp_path), {0: ("avc1", 600), 1: ("mp4a", 48000)}).first()
    got = containers.read_packets(open(out.file, "rb").read())
    assert sorted((t, p, d, k, b) for t, _, _, p, d, k, _, b in got) == sorted(r[1:] for r in rows)
    assert {g[1:3] for g in got} == {("h264", 600), ("aac", 48000)}


def test_transport_stream_packets():
    packets = [(0, 9000, 3000, b"v" * 500), (1, 3000, 3000, b"a" * 10), (0, 6000, 6000, b"w" * 183), (1, 5000, 5000, b"b" * 170)]
    raw = muxers.ts_segment({0: "h264", 1: "aac"}, packets)
    assert len(raw) % 188 == 0
    units, counters = {}, {}
    order = []
    for at in range(0, len(raw), 188):
        p = raw[at : at + 188]
        head = int.from_bytes(p[1:3], "big")
        pid, start = head & 0x1FFF, bool(head & 0x4000)
        assert p[0] == 0x47 and p[3] & 15 == counters.get(pid, 0)
        counters[pid] = (counters.get(pid, 0) + 1) & 15
        skip = 4 + (p[4] + 1 if p[3] & 0x20 else 0)
        if start:
            units.setdefault(pid, []).append(b"")
            order.append(pid)
        units[pid][-1] += p[skip:]
    assert order == [0, 4096, 256, 257, 257, 256]
    section = units[0][0][1:]
    size = (struct.unpack(">H", section[1:3])[0] & 0xFFF) + 3
    assert bits.ts_crc(section[:size]) == 0
    assert [u[9 + u[8] :] for u in units[256]] == [b"v" * 500, b"w" * 183] and [u[9 + u[8] :] for u in units[257]] == [b"a" * 10, b"b" * 170]


def test_rtmp_chunks():
    messages = [(9, 1, 5, b"x" * 300), (1, 0, 5, struct.pack(">I", 1000)), (8, 1, 1 << 25, b"y" * 900), (20, 0, 7, b"")]
    raw = muxers.rtmp_chunks(messages[:2]) + muxers.rtmp_chunks(messages[2:], 1000)
    assert list(muxers.rtmp_messages(raw)) == messages
    assert list(muxers.rtmp_messages(raw[:200])) == []


def test_mp3_headers(spark, tmp_path):
    frame = b"\xff\xfb\x90\x64" + bytes(413)
    assert mp3_probe.header(frame, 0)["size"] == 417
    plain = mp3_probe.probe(b"ID3\x04\0\0\0\0\0\x05xxxxx" + frame * 10)
    assert (plain["sample_rate"], plain["channels"], plain["kbps"], plain["frames"], plain["total_samples"]) == (44100, 2, 128, 10, 11520)
    tag = b"Xing" + struct.pack(">II", 1, 200) + b"LAME" + bytes(17) + (576 << 12 | 100).to_bytes(3, "big")
    tagged = frame[:36] + tag + bytes(417 - 36 - len(tag)) + frame
    assert mp3_probe.probe(tagged)["total_samples"] == 200 * 1152 - 676
    assert mp3_probe.probe(b"nothing") is None
    (tmp_path / "a.mp3").write_bytes(frame * 3)
    (tmp_path / "b.mp3").write_bytes(b"?")
    got = {r.clip_id: r.frames for r in mp3_probe.probe_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.mp3": 3, "b.mp3": None}


def test_hls_files_in_a_sink(spark, tmp_path):
    from wavelattice.streaming import sinks

    rows = [(s, t, k * 9000, k * 9000, t == 0 and k % 5 == 0, bytes([k]) * 50) for s in ("a", "b") for k in range(40) for t in (0, 1)]
    packets = spark.createDataFrame(rows, "source_id string, track_id int, pts long, dts long, is_keyframe boolean, payload binary")
    written = sinks.write_hls(packets, sinks.FolderSink(str(tmp_path)), {0: "h264", 1: "aac"}, 0, 1.0).collect()
    for source in ("a", "b"):
        text = (tmp_path / source / "index.m3u8").read_text()
        names = [r.name for r in written if r.source_id == source and r.name.endswith(".ts")]
        assert [line for line in text.splitlines() if line.endswith(".ts")] == sorted(names) and text.endswith("#EXT-X-ENDLIST\n") and len(names) == 4
        for r in written:
            if r.source_id == source:
                raw = (tmp_path / source / r.name).read_bytes()
                assert len(raw) == r.size and (r.name == "index.m3u8" or len(raw) % 188 == 0)
    memory, calls = sinks.MemorySink(), []
    for sink in (memory, sinks.CallSink(lambda name, content: calls.append((name, content)))):
        sink.write("x", b"1")
        sink.write("x", b"2")
    assert memory.files == {"x": b"2"} and calls == [("x", b"1"), ("x", b"2")]
