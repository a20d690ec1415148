"""Queries that write clips and packets as files and read them back; what comes back is said in SQL without the files."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavelattice.operators import groups
from wavelattice.plans.registry import query
from wavelattice.plans.tables import micros, read, samples, samples_sql, stereo, stereo_sql
from wavelattice.sources import adpcm, bits, clips, containers, flac, muxers, sniff

LOW, HIGH = -32768, 32767
_CLIP = f"CAST(greatest({LOW}, least({HIGH}, sample)) AS INTEGER)"
_MONO = f"WITH RECURSIVE {samples_sql()}, x AS (SELECT clip_id, frame, {_CLIP} AS v FROM s)"


def _clipped(rows):
    return rows.withColumn("sample", F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("sample"))).cast("int"))


def _there_and_back(rows, form, rate=44100, bits_=16):
    return clips.decode_files(clips.encode_files(rows, form, rate, bits_))


# Formats that keep every sample, mono.
def _lossless(form: str) -> None:
    @query(f"roundtrip_{form.replace('-', '_')}", f"{_MONO} SELECT clip_id, frame, CAST(0 AS INTEGER) AS channel, v AS sample, CAST(44100 AS INTEGER) AS sample_rate, CAST(16 AS INTEGER) AS bits FROM x")
    def run(spark, sf_dir):
        return _there_and_back(_clipped(samples(spark, sf_dir)), form)


for _form in ("wav", "au", "aiff", "aifc-sowt", "flac", "tta", "alac", "wavpack"):
    _lossless(_form)


# The same in stereo, with 24 bits where a format has them.
def _stereo(form: str, bits_: int) -> None:
    scale = 1 if bits_ == 16 else 200
    oracle = f"WITH {stereo_sql()} SELECT clip_id, frame, channel, CAST(greatest({LOW}, least({HIGH}, sample)) * {scale} AS INTEGER) AS sample, CAST(48000 AS INTEGER) AS sample_rate, CAST({bits_} AS INTEGER) AS bits FROM t"

    @query(f"roundtrip_{form}_stereo", oracle)
    def run(spark, sf_dir):
        rows = _clipped(stereo(spark, sf_dir)).withColumn("sample", F.col("sample") * scale)
        return _there_and_back(rows, form, 48000, bits_)


for _form, _bits in (("wav", 24), ("au", 24), ("aiff", 24), ("flac", 24), ("tta", 16), ("alac", 24), ("wavpack", 24)):
    _stereo(_form, _bits)


@query("roundtrip_wav_float", f"""{_MONO} SELECT clip_id, frame, CAST(0 AS INTEGER) AS channel, CAST(trunc(v / 32768.0 * 2147483647.0) AS INTEGER) AS sample, CAST(44100 AS INTEGER) AS sample_rate, CAST(32 AS INTEGER) AS bits FROM x""")
def roundtrip_wav_float(spark, sf_dir):
    return _there_and_back(_clipped(samples(spark, sf_dir)), "wav-float")


@query("clip_floats", f"""{_MONO} SELECT clip_id, frame, CAST(0 AS INTEGER) AS channel, round(CAST(CAST(v / 32767.0::DOUBLE AS FLOAT) AS DOUBLE), 6) AS value, CAST(44100 AS INTEGER) AS sample_rate FROM x""")
def clip_floats(spark, sf_dir):
    out = clips.decode_floats(clips.encode_files(_clipped(samples(spark, sf_dir)), "wav", 44100))
    return out.withColumn("value", F.round(F.col("value").cast("double"), 6))


# G.711: the nearest of 256 values, the smaller of two.
_ALAW = """CASE WHEN (a & 128) <> 0 THEN 1 ELSE -1 END * CASE WHEN (a & 112) >> 4 = 0 THEN (2 * (a & 15) + 1) * 8 ELSE (2 * (a & 15) + 33) * (1 << (((a & 112) >> 4) + 2)) END"""
_MULAW = """CASE WHEN (a & 128) <> 0 THEN 132 - ((((a & 15) << 3) + 132) << ((a & 112) >> 4)) ELSE ((((a & 15) << 3) + 132) << ((a & 112) >> 4)) - 132 END"""


def _g711(form: str, values: str) -> None:
    oracle = f"""{_MONO}, c AS (SELECT DISTINCT CAST({values} AS INTEGER) AS y FROM (SELECT unnest(range(256)) AS a)), d AS (SELECT DISTINCT v FROM x),
      n AS (SELECT v, arg_min(y, (abs(v - y), y)) AS y FROM d, c GROUP BY v)
      SELECT clip_id, frame, CAST(0 AS INTEGER) AS channel, y AS sample, CAST(44100 AS INTEGER) AS sample_rate, CAST(16 AS INTEGER) AS bits FROM x JOIN n USING (v)"""

    @query(f"roundtrip_{form.replace('-', '_')}", oracle)
    def run(spark, sf_dir):
        return _there_and_back(_clipped(samples(spark, sf_dir)), form)


_g711("wav-alaw", _ALAW)
_g711("wav-mulaw", _MULAW)


# ADPCM: a recurrence of predictor and step, with the encoder's choice of the next code in it.
_STEPS = str(list(adpcm.IMA_STEPS))
_IMA_MOVE = f"""SELECT clip_id, frame, CAST(greatest({LOW}, least({HIGH}, CASE WHEN d < 0 THEN p - sz[n] ELSE p + sz[n] END)) AS INTEGER) AS p, CAST(greatest(0, least(88, i + [-1, -1, -1, -1, 2, 4, 6, 8][n])) AS INTEGER) AS i
  FROM (SELECT *, list_position(er, list_min(er)) AS n FROM (SELECT *, [abs(abs(d) - z) for z in sz] AS er FROM (SELECT *, [(st >> 3) + m * 0 + (CASE WHEN m & 4 <> 0 THEN st ELSE 0 END) + (CASE WHEN m & 2 <> 0 THEN st >> 1 ELSE 0 END) + (CASE WHEN m & 1 <> 0 THEN st >> 2 ELSE 0 END) for m in range(8)] AS sz
  FROM (SELECT x.clip_id, x.frame, x.v - g.p AS d, g.p, g.i, {_STEPS}[g.i + 1] AS st FROM g JOIN x ON x.clip_id = g.clip_id AND x.frame = g.frame + 1))))"""


def _adpcm_result(rows: str) -> str:
    return f"SELECT clip_id, frame, CAST(0 AS INTEGER) AS channel, CAST({rows} AS INTEGER) AS sample, CAST(44100 AS INTEGER) AS sample_rate, CAST(16 AS INTEGER) AS bits FROM g"


@query("roundtrip_wav_ima", f"{_MONO}, g AS (SELECT clip_id, frame, v AS p, CAST(0 AS INTEGER) AS i FROM x WHERE frame = 0 UNION ALL {_IMA_MOVE}) {_adpcm_result('p')}")
def roundtrip_wav_ima(spark, sf_dir):
    return _there_and_back(_clipped(samples(spark, sf_dir)), "wav-ima")


@query("roundtrip_aifc_ima4", f"{_MONO}, g AS (SELECT clip_id, CAST(-1 AS BIGINT) AS frame, CAST(0 AS INTEGER) AS p, CAST(0 AS INTEGER) AS i FROM x WHERE frame = 0 UNION ALL {_IMA_MOVE}) {_adpcm_result('p')} WHERE frame >= 0")
def roundtrip_aifc_ima4(spark, sf_dir):
    rows = _clipped(samples(spark, sf_dir))
    # The file ends with a whole sub-block; its frames behind the clip's end are left out.
    return _there_and_back(rows, "aifc-ima4").join(rows.select("clip_id", "frame"), ["clip_id", "frame"], "left_semi")


@query("roundtrip_wav_ms", f"""{_MONO}, g AS (SELECT a.clip_id, a.frame, a.v AS p, CAST(16 AS INTEGER) AS t FROM x a WHERE a.frame < 2 UNION ALL
  SELECT clip_id, frame, CAST(greatest({LOW}, least({HIGH}, p + n * t)) AS INTEGER) AS p, CAST(greatest(16, ([230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230][(n + 16) % 16 + 1] * t) >> 8) AS INTEGER) AS t
  FROM (SELECT *, greatest(-8, least(7, CAST(sign(d) * ((abs(d) + (t >> 1)) // t) AS INTEGER))) AS n FROM (SELECT x.clip_id, x.frame, x.v - g.p AS d, g.p, g.t FROM g JOIN x ON x.clip_id = g.clip_id AND x.frame = g.frame + 1 AND g.frame >= 1)))
  {_adpcm_result('p')}""")
def roundtrip_wav_ms(spark, sf_dir):
    return _there_and_back(_clipped(samples(spark, sf_dir)), "wav-ms")


@query("roundtrip_wav_yamaha", f"""{_MONO}, g AS (SELECT clip_id, CAST(-1 AS BIGINT) AS frame, CAST(0 AS INTEGER) AS p, CAST(127 AS INTEGER) AS t FROM x WHERE frame = 0 UNION ALL
  SELECT clip_id, frame, CAST(greatest({LOW}, least({HIGH}, p + CASE WHEN d < 0 THEN -1 ELSE 1 END * ((t * (2 * n + 1)) // 8))) AS INTEGER) AS p, CAST(greatest(127, least(24576, ([230, 230, 230, 230, 307, 409, 512, 614][n + 1] * t) >> 8)) AS INTEGER) AS t
  FROM (SELECT *, CAST(least(7, (abs(d) * 4) // t) AS INTEGER) AS n FROM (SELECT x.clip_id, x.frame, x.v - g.p AS d, g.p, g.t FROM g JOIN x ON x.clip_id = g.clip_id AND x.frame = g.frame + 1)))
  {_adpcm_result('p')} WHERE frame >= 0""")
def roundtrip_wav_yamaha(spark, sf_dir):
    rows = _clipped(samples(spark, sf_dir))
    # An odd number of codes is filled up with one more.
    return _there_and_back(rows, "wav-yamaha").join(rows.select("clip_id", "frame"), ["clip_id", "frame"], "left_semi")


@query("pcm_md5", f"""{_MONO} SELECT clip_id, md5(unhex(string_agg(printf('%02x%02x', v & 255, (v >> 8) & 255), '' ORDER BY frame))) AS digest FROM x GROUP BY clip_id""")
def pcm_md5(spark, sf_dir):
    """The digest that a stream header keeps of its samples."""

    def run(clip: pd.DataFrame) -> pd.DataFrame:
        x = clip.sort_values("frame")["sample"].to_numpy(np.int64).reshape(-1, 1)
        return pd.DataFrame({"clip_id": [clip["clip_id"].iloc[0]], "digest": [flac.pcm_md5(x, 16).hex()]})

    return _clipped(samples(spark, sf_dir)).groupBy("clip_id").applyInPandas(run, "clip_id string, digest string")


# Containers: a user's events as packets of two tracks, in milliseconds from the first.
_PACKETS = """p AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id, event_id % 2 AS track, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS ms, event_type = 'signup' AS is_key,
    event_type || CAST(event_id AS VARCHAR) AS body FROM events)"""


def _packets(spark, sf_dir):
    """source_id, event_id, track, ms, is_key and body of every event, and its place in its source from 1."""
    ms = F.floor(micros("ts") / 1000).cast("long")
    rows = read(spark, sf_dir, "events").where("user_id IS NOT NULL").select(
        F.col("user_id").cast("string").alias("source_id"), "event_id", (F.col("event_id") % 2).cast("int").alias("track"), ms.alias("ms"), (F.col("event_type") == "signup").alias("is_key"),
        F.concat("event_type", F.col("event_id").cast("string")).alias("body"),
    )
    rows = groups.placed(rows, "source_id", "ms", "event_id")
    return rows.withColumn("ms", F.col("ms") - F.min("ms").over(groups.in_order("source_id", "ms", "event_id")))


def _files(spark, sf_dir, write):
    """One file a source, made by ``write`` from its rows in order of time, as format binaryFile gives them."""
    return groups.apply(_packets(spark, sf_dir), lambda rows: [(rows[0].source_id, write(rows))], "path string, content binary")


def _read_back(files):
    return containers.packets(files).select("source_id", "track_id", "codec", "pts", "dts", "is_keyframe", F.col("payload").cast("string").alias("body"))


def _container(name: str, write, oracle: str) -> None:
    @query(name, f"WITH {_PACKETS}{oracle}")
    def run(spark, sf_dir):
        return _read_back(_files(spark, sf_dir, write))


def _write_mp4(rows) -> bytes:
    tracks = []
    for t in sorted({r.track for r in rows}):
        own = [r for r in rows if r.track == t]
        start = own[0].ms
        tracks.append({"codec": "avc1" if t == 0 else "mp4a", "timescale": 1000, "packets": [(r.ms - start + (40 if t == 0 else 0), r.ms - start, r.is_key, r.body.encode()) for r in own]})
    return muxers.mp4(tracks)


_container("roundtrip_mp4", _write_mp4, """, q AS (SELECT *, ms - min(ms) OVER (PARTITION BY source_id, track) AS t FROM p), k AS (SELECT source_id, count(DISTINCT track) AS n, min(track) AS lowest FROM p GROUP BY 1),
    h AS (SELECT source_id, track, bool_or(is_key) AS keyed, bool_and(is_key) AS all_keys FROM p GROUP BY 1, 2)
    SELECT source_id, CAST(track - lowest AS INTEGER) AS track_id, CASE WHEN track = 0 THEN 'h264' ELSE 'aac' END AS codec, t + CASE WHEN track = 0 THEN 40 ELSE 0 END AS pts, t AS dts, is_key AS is_keyframe, body
    FROM q JOIN k USING (source_id) JOIN h USING (source_id, track)""")


def _write_fragments(rows) -> bytes:
    out = muxers.fmp4_init([{"codec": "avc1", "timescale": 1000}, {"codec": "mp4a", "timescale": 1000}])
    for n in range(0, len(rows), 50):
        part = rows[n : n + 50]
        runs = []
        for t in (0, 1):
            after = next((r.ms for r in rows[n + 50 :] if r.track == t), None)
            runs.append((t + 1, [(r.ms + (40 if t == 0 else 0), r.ms, r.is_key, r.body.encode()) for r in part if r.track == t], after))
        out += muxers.fmp4_segment(n // 50 + 1, runs)
    return out


_container("roundtrip_fragments", _write_fragments, """
    SELECT source_id, CAST(track AS INTEGER) AS track_id, CASE WHEN track = 0 THEN 'h264' ELSE 'aac' END AS codec, ms + CASE WHEN track = 0 THEN 40 ELSE 0 END AS pts, ms AS dts, is_key AS is_keyframe, body FROM p""")


def _write_flv(rows) -> bytes:
    tags = []
    for r in rows:
        if r.track == 0:
            tags.append((9, r.ms, bytes([(0x10 if r.is_key else 0x20) | 7, 1]) + (40).to_bytes(3, "big") + r.body.encode()))
        else:
            tags.append((8, r.ms, b"\xaf\x01" + r.body.encode()))
    return containers.flv_file(tags)


_container("roundtrip_flv", _write_flv, "\n    SELECT source_id, CAST(track AS INTEGER) AS track_id, CASE WHEN track = 0 THEN 'h264' ELSE 'aac' END AS codec, ms + CASE WHEN track = 0 THEN 40 ELSE 0 END AS pts, ms AS dts, track = 1 OR is_key AS is_keyframe, body FROM p")


def _matroska_writer(seekable: bool):
    return lambda rows: muxers.matroska({1: "aac", 2: "opus"}, [(r.track + 1, r.ms, r.is_key, r.body.encode()) for r in rows], seekable)


_MATROSKA = "\n    SELECT source_id, CAST(track + 1 AS INTEGER) AS track_id, CASE WHEN track = 0 THEN 'aac' ELSE 'opus' END AS codec, ms * 1000 AS pts, ms * 1000 AS dts, is_key AS is_keyframe, body FROM p"
_container("roundtrip_matroska", _matroska_writer(True), _MATROSKA)
_container("roundtrip_matroska_live", _matroska_writer(False), _MATROSKA)
_container("roundtrip_avi", lambda rows: muxers.avi([("h264", 25, 1), ("mp3", 48000, 1152)], [(r.track, r.is_key, r.body.encode()) for r in rows]), """, q AS (SELECT *, row_number() OVER (PARTITION BY source_id, track ORDER BY ms, event_id) - 1 AS k FROM p)
    SELECT source_id, CAST(track AS INTEGER) AS track_id, CASE WHEN track = 0 THEN 'h264' ELSE 'mp3' END AS codec, CASE WHEN track = 0 THEN k * 40000 ELSE k * 24000 END AS pts, CASE WHEN track = 0 THEN k * 40000 ELSE k * 24000 END AS dts, is_key AS is_keyframe, body FROM q""")


def _write_ogg(rows) -> bytes:
    return b"".join(containers.ogg_page(7, i, i * 960, [r.body.encode()], i == 0) for i, r in enumerate(rows))


_container("roundtrip_ogg", _write_ogg, """, q AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ms, event_id) - 1 AS k FROM p)
    SELECT source_id, CAST(7 AS INTEGER) AS track_id, '' AS codec, k * 960 AS pts, k * 960 AS dts, true AS is_keyframe, body FROM q""")


def _bytes_query(name: str, oracle: str, schema: str, run) -> None:
    """A query over the bodies of one source's packets at a time; ``run`` gives rows (event_id or place, ...)."""

    @query(name, f"WITH {_PACKETS}{oracle}")
    def make(spark, sf_dir):
        return groups.apply(_packets(spark, sf_dir), lambda rows: [(rows[0].source_id, *x) for x in run(rows)], f"source_id string, {schema}")


_ORDERED = "row_number() OVER (PARTITION BY source_id ORDER BY ms, event_id) - 1"
_BODIES = f"\n    SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, body FROM p"


def _rtmp(rows):
    messages = [(8 + r.track, 1, r.ms, r.body.encode() * 30) for r in rows]
    for i, (kind, stream, time, payload) in enumerate(muxers.rtmp_messages(muxers.rtmp_chunks(messages))):
        yield i, kind, stream, time, payload.decode()


_bytes_query("rtmp_chunks", f"\n    SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, CAST(8 + track AS INTEGER) AS kind, CAST(1 AS INTEGER) AS stream, ms AS time, repeat(body, 30) AS body FROM p", "place long, kind int, stream int, time long, body string", _rtmp)


def _amf0(rows):
    value = {r.body: {"time": float(r.ms), "key": bool(r.is_key), "list": [r.track, None, r.body]} for r in rows}
    back, _ = containers.amf0_read(containers.amf0_write(value))
    for i, (name, v) in enumerate(back.items()):
        yield i, name, v["time"], v["key"], v["list"][2]


_bytes_query("amf0_values", f"\n    SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, body AS name, CAST(ms AS DOUBLE) AS time, is_key AS flag, body AS item FROM p", "place long, name string, time double, flag boolean, item string", _amf0)


def _annex_b(rows):
    units = [b"\x65" + r.body.encode() for r in rows]
    prefixed = b"".join(len(u).to_bytes(4, "big") + u for u in units)
    again = bits.to_length_prefixed(bits.to_annex_b(prefixed))
    for i, u in enumerate(bits.nal_units(bits.to_annex_b(again))):
        yield i, u[1:].decode()


_bytes_query("annex_b", _BODIES, "place long, body string", _annex_b)


def _avcc(rows):
    sps = tuple(r.body.encode() for r in rows[:31])
    c = bits.parse_avcc(bits.build_avcc(bits.AvcConfig(100, 0, 31, 4, sps, (b"pps",))))
    for i, s in enumerate(c.sps):
        yield i, c.profile, c.level, c.length_size, s.decode()


_bytes_query("avc_config", f"""\n    SELECT source_id, place, CAST(100 AS INTEGER) AS profile, CAST(31 AS INTEGER) AS level, CAST(4 AS INTEGER) AS length_size, body FROM (SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, body FROM p) WHERE place < 31""", "place long, profile int, level int, length_size int, body string", _avcc)


def _adts(rows):
    raw = b"".join(bits.adts_header(2, 44100, 1 + r.track, len(r.body)) + r.body.encode() for r in rows)
    for i, (kind, rate, channels, payload) in enumerate(bits.adts_frames(raw)):
        yield i, kind, rate, channels, payload.decode()


_bytes_query("adts_frames", f"\n    SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, CAST(2 AS INTEGER) AS object_type, CAST(44100 AS INTEGER) AS rate, CAST(1 + track AS INTEGER) AS channels, body FROM p", "place long, object_type int, rate int, channels int, body string", _adts)


def _tags(rows):
    tags = {f"K{r.event_id}": r.body for r in rows}
    comments = sniff.vorbis_comments(sniff.vorbis_bytes(tags))
    frames = sniff.id3v2(sniff.id3v2_bytes({f"T{i:03d}": r.body for i, r in enumerate(rows[:999])}))
    for i, (k, v) in enumerate(comments.items()):
        yield i, k, v, frames.get(f"T{i:03d}")


_bytes_query("tag_values", f"""\n    SELECT source_id, place, key, body AS comment, CASE WHEN place < 999 THEN body END AS frame FROM (SELECT source_id, CAST({_ORDERED} AS BIGINT) AS place, 'K' || event_id AS key, body FROM p)""", "place long, key string, comment string, frame string", _tags)


def _golomb(rows):
    """Unsigned and signed Exp-Golomb codes written by their definition and read back."""
    for r in rows:
        n = int(r.event_id)
        code = f"{n + 1:b}"
        text = "0" * (len(code) - 1) + code
        reader = bits.BitReader(int((text + text).ljust(-(-2 * len(text) // 8) * 8, "0"), 2).to_bytes(-(-2 * len(text) // 8), "big"))
        yield n, reader.unsigned_golomb(), reader.signed_golomb()


_bytes_query("exp_golomb", "\n    SELECT source_id, event_id, event_id AS u, CASE WHEN event_id % 2 = 1 THEN (event_id + 1) // 2 ELSE -(event_id // 2) END AS s FROM p", "event_id long, u long, s long", _golomb)


def _emulation(rows):
    """Payloads with zeros, protected as a bit stream must be, and stripped again."""
    for r in rows:
        raw = bytes(int(c) % 4 if c.isdigit() else 0 for c in r.body)
        out, zeros = bytearray(), 0
        for b in raw:
            if zeros >= 2 and b < 4:
                out.append(3)
                zeros = 0
            out.append(b)
            zeros = zeros + 1 if b == 0 else 0
        yield int(r.event_id), bits.without_emulation(bytes(out)).hex()


_bytes_query("emulation_prevention", "\n    SELECT source_id, event_id, regexp_replace(regexp_replace(translate(body, '0123456789', '0123012301'), '[^0-9]', '0', 'g'), '(.)', '0\\1', 'g') AS payload FROM p", "event_id long, payload string", _emulation)
