"""Queries over containers and streams."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..config import FINAL
from ..folders import new_folder
from ..operators import waveform
from ..sources import audio, beatfiles, container, layout, synthetic
from ..sources import surrogates as S
from ..streaming import progressive
from . import waveform_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _containers(spark, sf_dir):
    x = S.user_samples(spark, sf_dir)
    total = waveform.totals(x)
    cols = waveform.columns(x, 64, total)
    return cols, container.encoded(cols, total, 3000, 64)


@query(waveform_queries.ORACLE_SQL["overview_multi_track"].replace("frame // 16 ", "frame // 64 ").replace("least(16, total - column_index * 16)", "least(64, total - column_index * 64)").replace(", n AS sample_count", ""))
def container_roundtrip(spark, sf_dir):
    """Columns that were written to containers and read again."""
    return container.decoded_columns(_containers(spark, sf_dir)[1], "track_id")


_SPANS = waveform_queries.ORACLE_SQL["overview_multi_track"].split("SELECT track_id, column_index, CASE")[0].replace("frame // 16 ", "frame // 64 ").replace("least(16, total - column_index * 16)", "least(64, total - column_index * 64)")


@query(
    f"""{_SPANS}, r AS (SELECT track_id, column_index - row_number() OVER (PARTITION BY track_id ORDER BY column_index) AS run FROM cols), k AS (SELECT track_id, count(*) AS columns, count(DISTINCT run) AS spans FROM r GROUP BY 1),
    z AS (SELECT *, 48 + 32 * spans + 10 * columns AS size FROM k) SELECT track_id, 'WOVR' AS section, 176 AS "offset", size, NULL AS error FROM z UNION ALL SELECT track_id, 'META', 176 + (size + 7) // 8 * 8, 10, NULL FROM z"""
)
def container_sections(spark, sf_dir):
    """Sections of containers: their places follow from the layout, from the numbers of columns and spans."""
    return container.inspected(_containers(spark, sf_dir)[1], "track_id").drop("crc")


@query(
    """SELECT p_partkey, (list_reduce(list_transform(range(strlen(p_name)), lambda i: ('0x' || substr(hex(p_name), 2 * i + 1, 2))::BIGINT), lambda c, b: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 2197175160) ELSE r >> 1 END, xor(c, b)), 4294967295) # 4294967295) AS crc FROM part""".replace(
        "(list_reduce(list_transform", "xor(list_reduce(list_transform"
    ).replace(", 4294967295) # 4294967295)", ", 4294967295), 4294967295)")
)
def crc32c(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select("p_partkey", container.crc32c_of(F.encode("p_name", "UTF-8")).alias("crc"))


@query(
    """SELECT event_id, lower(CASE WHEN n < 24 THEN printf('%02x', n) WHEN n < 256 THEN printf('18%02x', n) WHEN n < 65536 THEN printf('19%04x', n) WHEN n < 4294967296 THEN printf('1a%08x', n) ELSE printf('1b%016x', n) END) AS head
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 30 WHEN 1 THEN 250 + event_id % 12 WHEN 2 THEN 65530 + event_id % 12 WHEN 3 THEN 4294967290 + event_id % 12 ELSE event_id * 1000003 END AS n FROM events)"""
)
def cbor_heads(spark, sf_dir):
    """The shortest encoding of whole numbers, around every border, and read back."""
    k = F.col("event_id")
    n = F.when(k % 5 == 0, k % 30).when(k % 5 == 1, k % 12 + 250).when(k % 5 == 2, k % 12 + 65_530).when(k % 5 == 3, k % 12 + 4_294_967_290).otherwise(k * 1_000_003)

    @F.pandas_udf("string")
    def head(s: pd.Series) -> pd.Series:
        raw = [layout.cbor(int(v)) for v in s]
        if any(layout.cbor_value(r) != (int(v), len(r)) for r, v in zip(raw, s, strict=True)):
            raise ValueError("a number was read back as another one")
        return pd.Series([r.hex() for r in raw])

    return S.table(spark, sf_dir, "events").select("event_id", head(n).alias("head"))


@query(
    f"""{S.with_sql("sig_u")}, q AS (SELECT track_id, frame, greatest(-32768, least(32767, CASE WHEN x < 0 THEN round_even(x * 32768, 0) ELSE round_even(x * 32767, 0) END)) AS v FROM sig_u)
    SELECT track_id, frame, floor(CASE WHEN v < 0 THEN v / 32768.0::DOUBLE ELSE v / 32767.0::DOUBLE END * 1000000000 + 0.5)::BIGINT AS x_e9 FROM q"""
)
def wav_scan(spark, sf_dir):
    """Tracks written as 16-bit files and read as frames again."""
    x = S.user_samples(spark, sf_dir)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return pd.DataFrame([(pdf["track_id"].iloc[0], audio.wav_bytes(pdf["x"].to_numpy(), 8000))], columns=["path", "content"])

    files = x.groupBy("track_id").applyInPandas(run, "path string, content binary")
    return audio.wav_samples(files, 7).select("track_id", "frame", F.floor(F.col("x") * 1e9 + 0.5).cast("bigint").alias("x_e9"))


@query(
    f"""{S.with_sql("sig_u")}, w AS (SELECT DISTINCT track_id, greatest(track_id::BIGINT % 40, 0) AS f, track_id::BIGINT % 40 + 9 AS e FROM sig_u WHERE track_id::BIGINT % 3 <> 0)
    SELECT u.track_id, frame, floor(CASE WHEN v < 0 THEN v / 32768.0::DOUBLE ELSE v / 32767.0::DOUBLE END * 1000000000 + 0.5)::BIGINT AS x_e9 FROM (SELECT *, CASE WHEN x < 0 THEN round_even(x * 32768, 0) ELSE round_even(x * 32767, 0) END AS v FROM sig_u) u
    JOIN w ON w.track_id = u.track_id AND f < (frame // 16 + 1) * 16 AND frame // 16 * 16 < e"""
)
def wav_pull(spark, sf_dir):
    """Only the blocks of sound files that ranges ask for."""
    x = S.user_samples(spark, sf_dir)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return pd.DataFrame([(pdf["track_id"].iloc[0], audio.wav_bytes(pdf["x"].to_numpy(), 8000))], columns=["path", "content"])

    files = x.groupBy("track_id").applyInPandas(run, "path string, content binary")
    k = F.col("track_id").cast("bigint")
    wanted = x.select("track_id").distinct().filter(k % 3 != 0).select("track_id", (k % 40).alias("first_frame"), (k % 40 + 9).alias("end_frame"))
    return audio.pulled(audio.wav_blocks(files, 16), wanted).select("track_id", "frame", F.floor(F.col("x") * 1e9 + 0.5).cast("bigint").alias("x_e9"))


#: What is done to a sound file, and whether it can still be read.
_WAV_FAULTS = ("none", "magic", "short", "channels", "rate", "align", "bits", "tag", "odd_data", "extra_chunk", "two_data")


@query("SELECT p_partkey, p_partkey % 11 AS fault, p_partkey % 11 IN (0, 9) AS readable, CASE WHEN p_partkey % 11 IN (0, 9) THEN p_size::BIGINT END AS frames FROM part")
def wav_faults(spark, sf_dir):
    """Sound files with one thing wrong; a chunk that isn't known is skipped."""

    @F.pandas_udf("binary")
    def made(size: pd.Series, fault: pd.Series) -> pd.Series:
        out = []
        for n, k in zip(size, fault, strict=True):
            d = bytearray(audio.wav_bytes(np.linspace(-1, 1, int(n)), 8000))
            what = _WAV_FAULTS[int(k)]
            at, fmt, value = {"magic": (8, "<I", 0), "channels": (22, "<H", 3), "rate": (24, "<I", 800_000), "align": (32, "<H", 4), "bits": (34, "<H", 12), "tag": (20, "<H", 7)}.get(what, (0, None, 0))
            if fmt:
                struct.pack_into(fmt, d, at, value)
            if what == "short":
                d = d[:-1]
            if what == "odd_data":
                struct.pack_into("<I", d, 40, len(d) - 45)
            if what == "extra_chunk":
                d[12:12] = b"LIST" + struct.pack("<I", 3) + b"abc\0"
            if what == "two_data":
                d += b"data" + struct.pack("<I", 0)
            out.append(bytes(d))
        return pd.Series(out)

    files = S.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), made(F.col("p_size"), F.col("p_partkey") % 11).alias("content"))
    key = F.col("path").cast("bigint")
    return audio.wav_info(files).select(key.alias("p_partkey"), (key % 11).alias("fault"), F.col("error").isNull().alias("readable"), "frames")


@query(
    r"""WITH l AS (SELECT CASE p_partkey % 6 WHEN 0 THEN '# ' || p_name || ' 120' WHEN 1 THEN '  ' || p_name || ' ' || (60 + p_size) || '.25 ' WHEN 2 THEN p_name || chr(9) || (60 + p_size) WHEN 3 THEN 'lone' || p_partkey WHEN 4 THEN p_name || '   0' ELSE p_partkey || '.wav x' END AS line FROM part),
    t AS (SELECT trim(replace(line, chr(9), ' ')) AS line FROM l), k AS (SELECT trim(regexp_extract(line, '^(.*) ', 1)) AS path, try_cast(regexp_extract(line, '([^ ]+)$', 1) AS DOUBLE) AS bpm FROM t WHERE line NOT LIKE '#%' AND line LIKE '% %')
    SELECT path, round_even(bpm * 1000, 0)::INT AS millibpm FROM k WHERE bpm > 0"""
)
def track_list_scan(spark, sf_dir):
    """Lines of path and tempo: comments, blanks around, tabs, paths with blanks, lines without a tempo."""
    k, name = F.col("p_partkey"), F.col("p_name")
    bpm = (F.col("p_size") + 60).cast("string")
    line = F.when(k % 6 == 0, F.concat(F.lit("# "), name, F.lit(" 120"))).when(k % 6 == 1, F.concat(F.lit("  "), name, F.lit(" "), bpm, F.lit(".25 "))).when(k % 6 == 2, F.concat(name, F.lit("\t"), bpm))
    line = line.when(k % 6 == 3, F.concat(F.lit("lone"), k.cast("string"))).when(k % 6 == 4, F.concat(name, F.lit("   0"))).otherwise(F.concat(k.cast("string"), F.lit(".wav x")))
    return beatfiles.track_list(S.table(spark, sf_dir, "part").select(line.alias("value")))


@query(
    """WITH b AS (SELECT l_partkey AS k, l_orderkey * 8 + l_linenumber AS o, 6000 + l_quantity::BIGINT * 100 AS tempo FROM lineitem), p AS (SELECT p_partkey, '/' || p_name AS track FROM part WHERE p_partkey % 5 <> 0),
    f AS (SELECT p_partkey, track, tempo, row_number() OVER (PARTITION BY p_partkey ORDER BY o, tempo) - 1 AS beat FROM p JOIN b ON b.k = p_partkey)
    SELECT p_partkey, track, beat, tempo, false AS failed FROM f UNION ALL SELECT DISTINCT p_partkey, NULL, NULL, NULL, true FROM part JOIN b ON b.k = p_partkey WHERE p_partkey % 5 = 0"""
)
def beat_file_scan(spark, sf_dir):
    """Tagged beat files made by column expressions and scanned; every fifth claims more bytes than it has."""
    u32 = lambda c: F.lpad(F.hex(c), 8, "0")
    l, part = S.table(spark, sf_dir, "lineitem"), S.table(spark, sf_dir, "part")  # noqa: E741
    beat = F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"), F.concat(F.lit("0001"), F.lpad(F.hex(F.col("l_quantity").cast("bigint") * 100 + 6000), 4, "0"), F.lit("00000000")).alias("x"))
    beats = l.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.transform(F.array_sort(F.collect_list(beat)), lambda b: b["x"]).alias("b"))
    path = F.hex(F.encode(F.concat(F.lit("/"), F.col("p_name")), "UTF-16BE"))
    n, m = (F.length(path) / 2).cast("bigint"), F.size("b").cast("bigint")
    tags = F.concat(F.lit("50505448"), u32(F.lit(16)), u32(n + 16), u32(n), path, F.lit("5051545A"), u32(F.lit(24)), u32(m * 8 + 24), F.lit("00" * 8), u32(m), F.array_join("b", ""))
    total = (F.length(tags) / 2).cast("bigint") + 12 + F.when(F.col("p_partkey") % 5 == 0, 4).otherwise(0)
    content = F.unhex(F.concat(F.lit("504D4149"), u32(F.lit(12)), u32(total), tags))
    files = part.join(beats, "p_partkey").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    return beatfiles.beat_rows(files).select(F.col("path").cast("bigint").alias("p_partkey"), "track", "beat", "tempo", F.col("error").isNotNull().alias("failed"))


_VOICES = " UNION ALL ".join(f"SELECT '{p}' AS pattern, unnest({list(v[voice])}) AS step, {w} AS w" for p, v in synthetic.PATTERNS.items() for voice, w in (("kick", 1.0), ("snare", 0.8)) if voice in v)


@query(
    f"""WITH v AS ({_VOICES}), x AS (SELECT p.pattern, k.step, coalesce(sum(v.w), 0)::DOUBLE AS x FROM (SELECT DISTINCT pattern FROM v) p CROSS JOIN (SELECT unnest(range(16)) AS step) k LEFT JOIN v ON v.pattern = p.pattern AND v.step = k.step GROUP BY 1, 2),
    r AS (SELECT a.pattern, shift, sum(a.x * b.x) / sum(a.x * a.x) AS r FROM x a CROSS JOIN (SELECT unnest(range(1, 9)) AS shift) s JOIN x b ON b.pattern = a.pattern AND b.step = (a.step + 16 - shift) % 16 GROUP BY 1, 2)
    SELECT pattern, floor((max(r) FILTER (shift = 4) - max(r) FILTER (shift <> 4)) * 1000000 + 0.5)::BIGINT AS margin_e6 FROM r GROUP BY 1"""
)
def pattern_margins(spark, sf_dir):
    """How clearly patterns repeat after a beat, by the cyclic correlation of their sixteen steps."""
    return spark.createDataFrame([(p, int(np.floor(synthetic.margin(p) * 1e6 + 0.5))) for p in synthetic.PATTERNS], "pattern string, margin_e6 bigint")


#: Changes to a whole container, (place, code, value) or a part of its values, and what reading it says by the format's rules.
_FAULTS: tuple[tuple[str, object, str], ...] = (
    ("sound", None, "ok"),
    ("magic", (0, "<I", 1), "corrupt"),
    ("container version", (6, "<H", 9), "unsupported"),
    ("specification version", (8, "<H", 2), "unsupported"),
    ("unknown container flag", (16, "<I", 8), "unsupported"),
    ("duration flag without its frames", (16, "<I", 2), "corrupt"),
    ("too many sections", (20, "<I", 65), "limit"),
    ("directory off its alignment", (24, "<Q", 100), "corrupt"),
    ("file size", (32, "<Q", 1), "corrupt"),
    ("no sample rate", (48, "<I", 0), "corrupt"),
    ("nine channels", (52, "<H", 9), "corrupt"),
    ("fingerprint without a kind", (56, "<I", 7), "corrupt"),
    ("fingerprint kind", (88, "<I", 3), "unsupported"),
    ("version of a section", (96 + 4, "<H", 2), "unsupported"),
    ("compressed section", (96 + 6, "<H", 3), "unsupported"),
    ("overview not required", (96 + 6, "<H", 0), "corrupt"),
    ("section off its alignment", (96 + 8, "<Q", 1001), "corrupt"),
    ("stored and logical size differ", (96 + 24, "<Q", 1), "corrupt"),
    ("checksum of a section", (96 + 32, "<I", 1), "corrupt"),
    ("reserved directory field", (96 + 36, "<I", 1), "corrupt"),
    ("unknown optional section", (96 + 40, "<I", 0x5A5A5A5A), "ok"),
    ("unknown required section", (96 + 40, "<IHH", (0x5A5A5A5A, 1, 1)), "unsupported"),
    ("grid and revision apart", (96 + 6 * 40, "<I", 0x5A5A5A5A), "corrupt"),
    ("minimum above maximum", {"overview": {"columns": {"minimum": 9}}}, "corrupt"),
    ("column that isn't valid", {"overview": {"columns": {"flags": 0}}}, "corrupt"),
    ("bands without their flag", {"overview": {"columns": {"low": 1}}}, "corrupt"),
    ("unknown column flag", {"overview": {"columns": {"flags": 33}}}, "unsupported"),
    ("column size", {"overview": {"frames_per_column": 1000}}, "corrupt"),
    ("span off its column", {"overview": {"first_frame": 1}}, "corrupt"),
    ("span beyond the end", {"overview": {"end_frame": 1400}}, "corrupt"),
    ("a tile twice", {"tiles": 2}, "corrupt"),
    ("scores that rise", {"scores": (100, 65_535)}, "corrupt"),
    ("tempo out of range", {"tempo": 39_999}, "corrupt"),
    ("selected tempo that is no candidate", {"selected": 90_500}, "corrupt"),
    ("confidence above a hundred", {"confidence": 101}, "corrupt"),
    ("local grid of another tempo", {"local": {"tempo": 121_000}}, "corrupt"),
    ("segment outside its grid", {"segment": {"end_frame": 1501}}, "corrupt"),
    ("segment of another revision", {"segment": {"revision": 4}}, "corrupt"),
    ("beats out of order", {"beats": ((700, 1), (600, 2))}, "corrupt"),
    ("ordinals out of order", {"beats": ((600, 2), (700, 2))}, "corrupt"),
    ("pending revision under a final grid", {"revision": {"state": 1}}, "invalid"),
    ("text that isn't UTF-8", {"meta": b"\xa1\x01\x62\xff\xfe"}, "corrupt"),
    ("metadata keys out of order", {"meta": b"\xa2\x02\x61a\x01\x61b"}, "corrupt"),
    ("a head that isn't the shortest", {"meta": b"\xa1\x18\x01\x61a"}, "corrupt"),
)


def _faulty(change: object, tempo: int) -> bytes:
    """A container with all sections, changed."""
    change = change if change is not None else {}
    part = change if isinstance(change, dict) else {}
    col = {"minimum": -5, "maximum": 7, "rms": 9, "flags": 1} | part.get("overview", {}).get("columns", {})
    ranges = {f"{r}_{e}": v for r in ("requested", "evidence", "coverage") for e, v in (("first", 0), ("end", 1500))} | {"first_frame": 0, "end_frame": 1500}
    same = {"state": FINAL, "confidence": part.get("confidence", 80)}
    span = {"first_frame": 0, "end_frame": 1500, "first_column": 0, "columns": [col, col]} | {k: v for k, v in part.get("overview", {}).items() if k in ("first_frame", "end_frame")}
    scores = part.get("scores", (65_535, 100))
    chosen = part.get("tempo", tempo)
    beats = [{"whole": w, "ordinal": o, "revision": 3, "confidence": 80} for w, o in part.get("beats", ((0, 0), (800, 1)))]
    segment = {"first_frame": 0, "end_frame": 1500, "period_whole": 800, "tempo": tempo, "segment_id": 1, "revision": 3, "beat_count": 2} | same | part.get("segment", {})
    tile = {"level_id": 1, "tile_index": 0, "first_frame": 0, "end_frame": 512, "first_column": 0, "columns": [col, col]} | same
    r = {
        "source": {"sample_rate": 48_000, "channels": 2, "layout": 2, "total_frames": 1500},
        "overview": {"frames_per_column": part.get("overview", {}).get("frames_per_column", 1024), "column_count": 2, "spans": [span]} | same, "tiles": [tile] * part.get("tiles", 1), "metadata": {"producer_name": "us", "comments": "ü"},
        "tempo": {"tempo": part.get("selected", chosen), "candidate_set_id": 1, "evidence_first": 0, "evidence_end": 1500, "first_frame": 0, "end_frame": 1500, "candidates": [{"tempo": chosen, "score": scores[0], "confidence": 95}, {"tempo": 60_000, "score": scores[1], "confidence": 25, "relation": 1}]} | same,
        "local": ranges | {"period_whole": 800, "tempo": chosen, "segment_id": 1, "segment_state": FINAL, "segment_confidence": 80, "beat_count": 2} | same | part.get("local", {}),
        "grid": ranges | {"representation": 3, "segments": [segment], "beats": beats} | same, "revision": {"revision": 3, "first_frame": 0, "end_frame": 1500} | same | {"state": 2} | part.get("revision", {}),
    }
    data = bytearray(container.write(r, listed=True, metadata=part.get("meta"), check=False))
    if isinstance(change, tuple):
        at, code, value = change
        struct.pack_into(code, data, at, *(value if isinstance(value, tuple) else (value,)))
        if at != 92:
            struct.pack_into("<I", data, 92, layout.crc32c(bytes(data[:92])))
    return bytes(data)


_CODES = "[" + ", ".join(f"'{code}'" for _, _, code in _FAULTS) + "]"


@query(
    f"""SELECT p_partkey, p_partkey % {len(_FAULTS)} AS fault, {_CODES}[p_partkey % {len(_FAULTS)} + 1] AS outcome, CASE WHEN {_CODES}[p_partkey % {len(_FAULTS)} + 1] = 'ok' THEN 60000 + p_size * 1000 END AS tempo,
    CASE WHEN {_CODES}[p_partkey % {len(_FAULTS)} + 1] = 'ok' THEN 2 END AS beats, CASE WHEN {_CODES}[p_partkey % {len(_FAULTS)} + 1] = 'ok' THEN p_partkey % {len(_FAULTS)} = 0 END AS has_detail FROM part"""
)
def container_faults(spark, sf_dir):
    """Containers with all sections and one fault each; what reading says, and what sound ones hold."""
    part = S.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(_FAULTS)).alias("fault"), (F.col("p_size") * 1000 + 60_000).cast("int").alias("tempo"))

    def run(batches):
        for pdf in batches:
            out = []
            for key, fault, tempo in zip(pdf["p_partkey"], pdf["fault"], pdf["tempo"], strict=True):
                try:
                    got = container.read(_faulty(_FAULTS[int(fault)][1], int(tempo)))
                    out.append((key, fault, "ok", got["tempo"]["tempo"], len(got["grid"]["beats"]), "tiles" in got))
                except container.ContainerError as e:
                    out.append((key, fault, e.code, None, None, None))
            yield pd.DataFrame(out, columns=["p_partkey", "fault", "outcome", "tempo", "beats", "has_detail"]).astype({"has_detail": "boolean"})

    # a row is few bytes and much work: by a number, so that Spark doesn't put small partitions together again
    return part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").mapInPandas(run, "p_partkey long, fault long, outcome string, tempo int, beats int, has_detail boolean")


@query(waveform_queries.ORACLE_SQL["overview_columns"])
def stream_overview(spark, sf_dir):
    """The overview by a stream over the event files: equal to the batch one."""
    schema = S.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    x = stream.select(F.lit("e").alias("track_id"), F.col("event_id").alias("frame"), S.clamp(F.col("value") / 100.0 - 1.0).alias("x"))
    root = new_folder(spark, "stream")
    progressive.accumulate(x, f"{root}/parts", 64, f"{root}/checkpoint").awaitTermination()
    return progressive.snapshot(spark, f"{root}/parts", 64, waveform.totals(S.event_samples(spark, sf_dir)))


#: The end of what is accepted from frame 0 on: the first frame of 0 and the ends that no accepted part holds.
@query(
    f"""WITH RECURSIVE b AS (SELECT o_custkey % 97 AS track_id, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey) AS n, o_orderkey AS serial, o_custkey % 40 * 256 AS f, 100 + o_orderkey % 500 AS size FROM orders), {waveform_queries.FOLD}
    SELECT track_id::VARCHAR AS track_id, serial, took AS accepted, status, list_min(list_filter([0::BIGINT] || list_transform(held, lambda r: r.e), lambda x: len(list_filter(held, lambda r: r.f <= x AND x < r.e)) = 0)) AS contiguous_end FROM s WHERE n > 0"""
)
def late_rejects(spark, sf_dir):
    """Blocks of a track in order of arrival against what it has accepted, in keyed state."""
    schema = S.table(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parquet*")
    blocks = stream.select((F.col("o_custkey") % 97).cast("string").alias("track_id"), (F.col("o_custkey") % 40 * 256).alias("first_frame"), (F.lit(100) + F.col("o_orderkey") % 500).alias("frame_count"), F.col("o_orderkey").alias("serial"))
    root = new_folder(spark, "late")
    out = progressive.accepted_blocks(blocks).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
