"""Queries on records, probes, checksums, sessions and joined files."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavelattice.operators import align, analysis, packets as pk
from wavelattice.plans.registry import query
from wavelattice.plans.roundtrips import _ORDERED, _PACKETS, _bytes_query, _files, _packets
from wavelattice.plans.sequences import _k_sql
from wavelattice.plans.tables import read, samples
from wavelattice.sources import asf, bits, containers, hevc, mp3_probe, muxers, pcm, rtmp, tta
from wavelattice.sources.bitio import BitSink, BitTap, Huffman


def _per_row(spark, sf_dir, table: str, columns: list, schema: str, f):
    """A query that calls ``f`` for each row of a table."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([f(*r) for r in pdf.itertuples(index=False, name=None)], columns=names)

    return read(spark, sf_dir, table).select(*columns).mapInPandas(run, schema)


@query("hevc_codecs", """WITH c AS (SELECT p_partkey, p_partkey % 4 AS space, p_partkey % 2 AS tier, p_partkey % 5 + 1 AS idc, p_partkey % 32 AS bit, p_size + 30 AS level, p_partkey * 7 % 256 AS b0, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS b2 FROM part)
    SELECT p_partkey, 'hvc1.' || CASE WHEN space > 0 THEN chr(64 + CAST(space AS INTEGER)) ELSE '' END || idc || '.' || printf('%X', 1::BIGINT << (31 - bit)) || '.' || CASE WHEN tier = 1 THEN 'H' ELSE 'L' END || level ||
      CASE WHEN b2 > 0 THEN '.' || printf('%X', b0) || '.0.' || printf('%X', b2) WHEN b0 > 0 THEN '.' || printf('%X', b0) ELSE '' END AS codecs FROM c""")
def hevc_codecs(spark, sf_dir):
    """The name of a profile that went through its configuration record."""

    def one(k: int, size: int):
        p = hevc.Profile(k % 4, k % 2, k % 5 + 1, 1 << (k % 32), k * 7 % 256 << 40 | (size if k % 3 == 0 else 0) << 24, size + 30)
        config = hevc.HevcConfig(p, 1, 8, 8, 4, ((hevc.SPS, True, (b"sps",)),))
        return k, hevc.parse_hvcc(hevc.build_hvcc(config)).profile.codecs()

    return _per_row(spark, sf_dir, "part", [F.col("p_partkey").cast("long"), F.col("p_size").cast("int")], "p_partkey long, codecs string", one)


@query("extended_floats", "SELECT p_partkey, CAST(p_partkey * 1001 + 8000 AS DOUBLE) / 4 AS value FROM part")
def extended_floats(spark, sf_dir):
    """Sample rates through the 80-bit form that AIFF keeps them in."""
    return _per_row(spark, sf_dir, "part", [F.col("p_partkey").cast("long")], "p_partkey long, value double", lambda k: (k, pcm.extended(pcm.to_extended((k * 1001 + 8000) / 4))))


def _residues(r):
    """A message followed by its checksum leaves nothing."""
    b = r.body.encode()
    checks = ((bits.ogg_crc, 4), (bits.ts_crc, 4), (bits.flac_crc8, 1), (bits.flac_crc16, 2))
    return int(r.event_id), *(check(b + check(b).to_bytes(n, "big")) for check, n in checks)


_bytes_query("checksum_residues", "\n    SELECT source_id, event_id, CAST(0 AS BIGINT) AS ogg, CAST(0 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS crc8, CAST(0 AS BIGINT) AS crc16 FROM p", "event_id long, ogg long, ts long, crc8 long, crc16 long", lambda rows: map(_residues, rows))


@query("mp4_probe", f"""WITH {_PACKETS}, v AS (SELECT source_id, count(*) AS frames, max(ms) - min(ms) AS span, max(ms) AS last FROM p WHERE track = 0 GROUP BY source_id),
    o AS (SELECT source_id, ms - lag(ms) OVER (PARTITION BY source_id ORDER BY ms, event_id) AS step, row_number() OVER (PARTITION BY source_id ORDER BY ms DESC, event_id DESC) AS r FROM p WHERE track = 0)
    SELECT source_id, CAST(1280 AS INTEGER) AS width, CAST(720 AS INTEGER) AS height, 'avc1' AS codec, frames, round(frames * 1000 / (span + coalesce(step, 1))::DOUBLE, 6) AS frame_rate, CAST(270 AS INTEGER) AS rotation FROM v JOIN o USING (source_id) WHERE r = 1""")
def mp4_probe(spark, sf_dir):
    def write(rows) -> bytes:
        own = [r for r in rows if r.track == 0]
        return muxers.mp4([{"codec": "avc1", "timescale": 1000, "width": 1280, "height": 720, "rotation": 270, "packets": [(r.ms, r.ms, r.is_key, r.body.encode()) for r in own]}]) if own else b""

    def run(batches):
        for pdf in batches:
            found = [(p, containers.mp4_probe(bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True) if len(c)]
            yield pd.DataFrame([(p, *(x[k] for k in ("width", "height", "codec", "frames", "frame_rate", "rotation"))) for p, x in found], columns=["source_id", "width", "height", "codec", "frames", "frame_rate", "rotation"])

    out = _files(spark, sf_dir, write).mapInPandas(run, "source_id string, width int, height int, codec string, frames long, frame_rate double, rotation int")
    return out.withColumn("frame_rate", F.round("frame_rate", 6))


@query("edit_lists", """SELECT p_partkey, CAST(p_partkey % 90 * 10 AS BIGINT) - p_size * 48000 // 1000 AS shift FROM part""")
def edit_lists(spark, sf_dir):
    """What an empty edit of some milliseconds and a media start do to a track's times."""
    return _per_row(spark, sf_dir, "part", [F.col("p_partkey").cast("long"), F.col("p_size").cast("int")], "p_partkey long, shift long", lambda k, size: (k, containers.edit_shift([(size, -1, 1), (1000, k % 90 * 10, 1)], 1000, 48000)))


@query("mp3_probe", """WITH c AS (SELECT CAST(n_nationkey AS VARCHAR) AS clip_id, n_nationkey * 3 + 2 AS frames FROM nation) SELECT clip_id, CAST(44100 AS BIGINT) AS sample_rate, CAST(128 AS BIGINT) AS kbps, frames, frames * 1152 AS total_samples FROM c""")
def mp3_probe_query(spark, sf_dir):
    """Streams of empty frames, counted by walking their headers."""
    frame = F.concat(F.unhex(F.lit("FFFB9064")), F.unhex(F.lit("00" * 413)))
    n = F.col("n_nationkey").cast("int") * 3 + 2
    files = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.unhex(F.repeat(F.hex(frame), n)).alias("content"))
    return mp3_probe.probe_files(files).select("clip_id", "sample_rate", "kbps", "frames", "total_samples")


@query("kerning", """WITH g AS (SELECT p_partkey // 20 AS line, p_partkey % 20 AS place, p_size % 7 AS glyph, p_size AS advance FROM part),
    f AS (SELECT *, lead(glyph) OVER (PARTITION BY line ORDER BY place) AS nxt FROM g),
    k AS (SELECT line, place, glyph, advance, CASE WHEN nxt IS NOT NULL AND (glyph + nxt) % 3 = 0 THEN -(glyph * 7 + nxt) ELSE 0 END AS adjust FROM f)
    SELECT line, place, glyph, CAST(adjust AS INTEGER) AS adjust, CAST(coalesce(sum(advance + adjust) OVER (PARTITION BY line ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM k""")
def kerning(spark, sf_dir):
    k = F.col("p_partkey")
    glyphs = read(spark, sf_dir, "part").select(F.floor(k / 20).alias("line"), (k % 20).alias("place"), (F.col("p_size") % 7).cast("int").alias("glyph"), F.col("p_size").cast("long").alias("advance"))
    both = spark.range(49).select((F.col("id") % 7).cast("int").alias("left"), F.floor(F.col("id") / 7).cast("int").alias("right"))
    pairs = both.where("(left + right) % 3 = 0").withColumn("adjust", (-(F.col("left") * 7 + F.col("right"))).cast("int"))
    return align.kerning(glyphs, pairs)


@query("join_files", f"""WITH {_PACKETS}, f AS (SELECT *, event_id % 3 AS file FROM p), n AS (SELECT source_id, file, max(ms + 40) AS length FROM f GROUP BY 1, 2),
    s AS (SELECT source_id, file, coalesce(sum(length) OVER (PARTITION BY source_id ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n)
    SELECT source_id, event_id, CAST(ms + start AS BIGINT) AS pts FROM f JOIN s USING (source_id, file)""")
def join_files(spark, sf_dir):
    p = _packets(spark, sf_dir).select("source_id", "event_id", F.col("ms").alias("pts"), F.col("ms").alias("dts"), F.lit(40).alias("duration"), (F.col("event_id") % 3).alias("file"))
    return pk.join_files(p, "file").select("source_id", "event_id", "pts")


def _session(rows):
    """What a server reads of a publisher's chunk stream: its media tags."""
    tags = [(rtmp.VIDEO if r.track == 0 else rtmp.AUDIO, r.ms, r.body.encode()) for r in rows]
    media = (e for e in rtmp.events(rtmp.publish("app", "key", tags, {"n": float(len(rows))}, 200)) if e[0] in ("video", "audio"))
    for i, (kind, time, payload) in enumerate(media):
        yield i, kind, time, payload.decode()


_bytes_query("rtmp_session", f"\n    SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, CASE WHEN track = 0 THEN 'video' ELSE 'audio' END AS kind, ms AS time, body FROM p", "place long, kind string, time long, body string", _session)


def _asf(rows):
    _, got = asf.read(asf.write(2, 44100, 0x161, 1486, b"", [(r.ms, r.body.encode() * 300) for r in rows]))
    for i, (_, time, data) in enumerate(got):
        yield i, time, len(data), data.decode()[: len(rows[i].body)]


_bytes_query("asf_packets", f"\n    SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, ms AS time, CAST(length(body) * 300 AS BIGINT) AS size, body FROM p", "place long, time long, size long, body string", _asf)


def _huffman(rows):
    """Letters coded by a canonical code with words of every length, and read back."""
    letters = bytes(sorted(set("".join(r.body for r in rows).encode())))
    counts = [0] * max(len(letters) - 1, 1)
    for i in range(len(letters)):
        counts[min(i, len(counts) - 1)] += 1
    code, out = Huffman.canonical(bytes(counts), letters), BitSink()
    for r in rows:
        for b in r.body.encode():
            code.put(out, b)
    taken = BitTap(out.bytes())
    for i, r in enumerate(rows):
        yield i, bytes(code.take(taken) for _ in r.body).decode()


_bytes_query("huffman_words", f"\n    SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, body FROM p", "place long, body string", _huffman)


def _segments(rows):
    """Segments of a transport stream are whole packets that begin with the sync byte."""
    raw = muxers.ts_segment({0: "h264", 1: "aac"}, [(r.track, r.ms * 90, r.ms * 90, r.body.encode() * 20) for r in rows])
    yield len(rows), len(raw) % 188, sum(raw[i] != 0x47 for i in range(0, len(raw), 188)), sum(raw[i + 1] >> 6 & 1 for i in range(0, len(raw), 188))


_bytes_query("transport_segments", "\n    SELECT source_id, count(*) AS n, CAST(0 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS unsynced, count(*) + 2 AS units FROM p GROUP BY source_id", "n long, rest long, unsynced long, units long", _segments)


def _flv_metadata(rows):
    """The metadata tag in front of a file, and the tags behind it."""
    data = {"width": 640.0, "height": 360.0, "duration": float(rows[-1].ms) / 1000, "name": rows[0].body}
    raw = containers.flv_file([(18, 0, containers.amf0_write("onMetaData") + containers.amf0_write(data))] + [(8, r.ms, b"\xaf\1" + r.body.encode()) for r in rows])
    tags = list(containers.flv_tags(raw))
    name, at = containers.amf0_read(tags[0][2])
    got, _ = containers.amf0_read(tags[0][2], at)
    yield name, got["width"], got["duration"], got["name"], len(tags) - 1


_bytes_query("flv_metadata", "\n    SELECT source_id, 'onMetaData' AS title, CAST(640 AS DOUBLE) AS width, max(ms) / 1000.0::DOUBLE AS duration, arg_min(body, (ms, event_id)) AS name, count(*) AS n_tags FROM p GROUP BY source_id", "title string, width double, duration double, name string, n_tags long", _flv_metadata)


def _lacing(rows):
    """Frames of a block under the three ways of lacing."""
    frames = [r.body.encode() * (1 + i % 40) for i, r in enumerate(rows[:100])]
    xiph = bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
    sizes = b""
    for i, f in enumerate(frames[:-1]):
        sizes += (0x4000 | len(f)).to_bytes(2, "big") if i == 0 else (0x4000 | len(f) - len(frames[i - 1]) + 8191).to_bytes(2, "big")
    ebml = bytes([len(frames) - 1]) + sizes + b"".join(frames)
    fixed = bytes([len(frames) - 1]) + b"".join(f[:5] for f in frames)
    for i, (a, b, c) in enumerate(zip(containers.lacing(xiph, 0, 1), containers.lacing(ebml, 0, 3), containers.lacing(fixed, 0, 2), strict=True)):
        yield i, len(a), a == b, c.decode()


_bytes_query("block_lacing", f"\n    SELECT source_id, place, length(body) * (1 + place % 40) AS size, true AS alike, substr(body, 1, 5) AS head FROM (SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, body FROM p) WHERE place < 100", "place long, size long, alike boolean, head string", _lacing)


@query("probe_all", _k_sql("").replace("SELECT clip_id, coalesce(lufs", """, lv AS (SELECT clip_id, count(*) AS total_frames, max(abs(CAST(sample AS BIGINT))) / 32768.0::DOUBLE AS peak, round(sqrt(sum(CAST(sample AS DOUBLE) * sample) / count(*)) / 32768, 6) AS rms FROM s GROUP BY clip_id)
    SELECT clip_id, total_frames, peak, rms, coalesce(lufs""").replace("FROM (SELECT DISTINCT clip_id FROM s)", "FROM lv"))
def probe_all(spark, sf_dir):
    """Length, peak, RMS and loudness of each clip in one plan."""
    s = samples(spark, sf_dir, "event_type")
    both = analysis.levels(s, 16).join(analysis.integrated_loudness(s, 4000, 16), "clip_id")
    return both.select("clip_id", "total_frames", "peak", F.round("rms", 6).alias("rms"), F.round("lufs", 4).alias("lufs"))


@query("tta_info", "SELECT CAST(n_nationkey AS VARCHAR) AS clip_id, CAST(1 AS INTEGER) AS channels, CAST(8000 + n_nationkey AS INTEGER) AS rate, CAST(16 AS INTEGER) AS bits, CAST(n_nationkey * 5 AS BIGINT) AS frames FROM nation")
def tta_info(spark, sf_dir):
    """What a file's header says without decoding it."""
    return _per_row(spark, sf_dir, "nation", [F.col("n_nationkey").cast("int")], "clip_id string, channels int, rate int, bits int, frames long", lambda n: (str(n), *tta.info(tta.encode(np.zeros((n * 5, 1), int), 8000 + n))))
