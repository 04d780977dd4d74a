"""Signal analysis and encoders over the sample arrays."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import signal as G
from ..functions import tags as A
from ..sources import tables as S
from .base import query

RATE = 1000  # the sample arrays stand for clips at this rate


@query()
def track_tempo(spark, d):
    def run(batches):
        import numpy as np

        for pdf in batches:
            clips = [np.asarray(x, np.float32) for x in pdf["embedding"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "bpm": [G.tempo(x, RATE) for x in clips], "first_beat_ms": [G.first_beat_ms(x, RATE) for x in clips]})

    return S.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, bpm double, first_beat_ms double")


_BPM = "(90 + vec_id % 91 * 0.5)"
_BEATS = f"(select vec_id, cast(b % 4 as int) + 1 as beat, vec_id % 7 * 50 + b * (60000.0 / {_BPM}::double) as ms, cast(round({_BPM} * 100) as int) as tempo from embeddings, (select unnest(range(0, 60)) as b) where vec_id % 7 * 50 + b * (60000.0 / {_BPM}::double) < 10000)"


def beats(spark, d):
    """The grid of each clip, from its own tempo and first beat up to ten seconds."""
    bpm, first = F.lit(90) + F.col("vec_id") % 91 * F.lit(0.5), (F.col("vec_id") % 7 * 50).cast("double")
    step = F.lit(60000.0) / bpm
    last = F.greatest(F.ceil((F.lit(10000) - first) / step).cast("int"), F.lit(1))
    grid = S.table(spark, d, "embeddings").select("vec_id", bpm.alias("bpm"), first.alias("first"), step.alias("step"), F.explode(F.sequence(F.lit(0), last)).alias("b"))
    ms = F.col("first") + F.col("b") * F.col("step")
    return grid.select("vec_id", (F.col("b") % 4 + 1).cast("int").alias("beat"), ms.alias("ms"), F.round(F.col("bpm") * 100).cast("int").alias("tempo")).where("ms < 10000")


@query(f"select vec_id, beat, round(ms, 3) as time_ms, tempo from {_BEATS}")
def beat_grids(spark, d):
    return beats(spark, d).select("vec_id", "beat", F.round("ms", 3).alias("time_ms"), "tempo")


@query(f"select vec_id, concat('5051545A00000018', printf('%08X', 24 + 8 * count(*)), '0000000000080000', printf('%08X', count(*)), string_agg(printf('%04X%04X%08X', beat, tempo, cast(floor(ms) as bigint)), '' order by ms)) as section from {_BEATS} group by vec_id")
def beat_sections(spark, d):
    """The packed beat section of each clip, as hex: number, tempo and whole milliseconds of each beat."""
    hexed = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    row = F.concat(hexed(F.col("beat"), 4), hexed(F.col("tempo"), 4), hexed(F.floor("ms"), 8))
    rows = beats(spark, d).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("ms", row.alias("hex")))).alias("e"))
    n = F.size("e")
    return rows.select("vec_id", F.concat(F.lit("5051545A00000018"), hexed(24 + 8 * n, 8), F.lit("0000000000080000"), hexed(n, 8), F.array_join(F.transform("e", lambda x: x["hex"]), "")).alias("section"))


#: Samples of a clip, each held so many times, that make the 400 segments of a preview.
HELD = 25
_SEGMENTS = "(select vec_id, i, sqrt((a * a + b * b + c * c + e * e) / 4) as rms, greatest(abs(a), abs(b), abs(c), abs(e)) as peak from (select vec_id, i, x[4 * i // 25 + 1] as a, x[(4 * i + 1) // 25 + 1] as b, x[(4 * i + 2) // 25 + 1] as c, x[(4 * i + 3) // 25 + 1] as e from (select vec_id, [cast(v as double) for v in embedding] as x from embeddings), (select unnest(range(0, 400)) as i)))"


def segments(spark, d):
    """Loudness and peak of each of the 400 segments of a clip whose samples are held HELD times."""
    x = lambda k: F.element_at("embedding", F.expr(f"(4 * i + {k}) div {HELD} + 1").cast("int")).cast("double")
    rows = S.table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("i"))
    four = rows.select("vec_id", "i", *[x(k).alias(c) for k, c in enumerate("abce")])
    return four.select("vec_id", F.col("i").cast("long").alias("i"), F.sqrt((F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c") + F.col("e") * F.col("e")) / 4).alias("rms"), F.greatest(*[F.abs(c) for c in "abce"]).alias("peak"))


@query(f"select vec_id, i, round(rms, 9) as rms, round(peak, 9) as peak, round(case when max(rms) over (partition by vec_id) > 0 then rms / max(rms) over (partition by vec_id) else rms end, 9) as envelope from {_SEGMENTS}")
def segment_levels(spark, d):
    """Loudness and peak by segment, and loudness against the clip's loudest segment."""
    top = F.max("rms").over(Window.partitionBy("vec_id"))
    scaled = F.when(top > 0, F.col("rms") / top).otherwise(F.col("rms"))
    return segments(spark, d).select("vec_id", "i", F.round("rms", 9).alias("rms"), F.round("peak", 9).alias("peak"), F.round(scaled, 9).alias("envelope"))


@query(f"""select vec_id, concat('5057415600000014000001A40000019000010000', string_agg(printf('%02X', (white << 5) | height), '' order by i)) as section from (select vec_id, i, cast(least(greatest(floor(rms / ref * 22), 0), 31) as int) as height,
  cast(least(greatest(floor(((case when rms > 0.001 then peak / rms else 1 end) - 1) / 2), 0), 5) as int) as white from (select *, greatest(list_sort(list(rms) over (partition by vec_id))[381], 0.000001) as ref from {_SEGMENTS})) group by vec_id""")
def preview_sections(spark, d):
    """The preview section of each clip, as hex: 400 columns of whiteness and height, against the 95th percentile by rank."""
    rows = segments(spark, d)
    ref = rows.groupBy("vec_id").agg(F.greatest(F.element_at(F.sort_array(F.collect_list("rms")), 381), F.lit(1e-6)).alias("ref"))
    level = lambda c, most: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(most)).cast("int")
    crest = F.when(F.col("rms") > 0.001, F.col("peak") / F.col("rms")).otherwise(1.0)
    byte = F.shiftleft(level((crest - 1) / 2, 5), 5).bitwiseOR(level(F.col("rms") / F.col("ref") * 22, 31))
    packed = rows.join(ref, "vec_id").select("vec_id", F.struct("i", F.lpad(F.hex(byte.cast("long")), 2, "0").alias("hex")).alias("e")).groupBy("vec_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return packed.select("vec_id", F.concat(F.lit("5057415600000014000001A40000019000010000"), F.array_join(F.transform("e", lambda x: x["hex"]), "")).alias("section"))


@query("""select vec_id, arg_min(lag, -round(power, 9) * 1000 + lag / 1000000.0) as lag, round(max(power), 9) as power from (select a.vec_id, b.i - a.i as lag, avg(a.x * b.x) as power from
  (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings) a join (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings) b on a.vec_id = b.vec_id and b.i - a.i between 4 and 32 group by 1, 2) group by vec_id""")
def strongest_lags(spark, d):
    """The lag of the highest mean autocorrelation: a later lag stands back by a billionth of power each, and the
    first of equal ones counts."""
    clips = S.table(spark, d, "embeddings").select("vec_id", "embedding").where("vec_id is not null")
    return clips.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(G.strongest_lags, "vec_id long, lag long, power double")


@query("select vec_id, cast(k as bigint) as frame, round((trunc(x[2 * k + 1] * 32767) / 32768 + trunc(x[2 * k + 2] * 32767) / 32768) / 2, 6) as mono, len(x) / 2 / 1000.0 as seconds from (select vec_id, [cast(greatest(least(v, 1), -1) as double) for v in embedding] as x from embeddings), (select unnest(range(0, 32)) as k)")
def downmix(spark, d):
    """Clips as the two channels of a 16-bit file, mixed down to one."""
    level = lambda c: F.greatest(F.least(c.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 32767
    at = lambda k: level(F.element_at("embedding", (F.col("frame") * 2 + k).cast("int"))).cast("int") / F.lit(32768.0)
    rows = S.table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("frame"))
    return rows.select("vec_id", "frame", F.round((at(1) + at(2)) / 2, 6).alias("mono"), (F.size("embedding") / 2 / 1000.0).alias("seconds"))


@query()
def file_analyses(spark, d):
    """Each clip written as a WAV file with tags, decoded again and analysed as a whole."""
    from ..functions import audio as A

    @F.pandas_udf("binary")
    def as_file(ids: pd.Series, clips: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([A.wav(np.repeat(np.asarray(x, np.float32), 400), 8000, 2, {b"INAM": f"clip {i}", b"ICRD": "2021-05-06"}) for i, x in zip(ids, clips, strict=True)])

    files = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.lit("fallback").alias("title"), as_file("vec_id", "embedding").alias("content"))
    return A.analyses(files)


@query()
def content_identity(spark, d):
    """Identity of each text's bytes. Spark cuts the window and counts the bytes, so that only the window reaches Python."""

    @F.arrow_udf("string")
    def identity(head: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array([B.window_hash(h.as_buffer(), n) for h, n in zip(head, size.to_pylist(), strict=True)], pa.string())

    raw = F.col("text").cast("binary")
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", identity(F.substring(raw, 1, B.SAMPLE_WINDOW), F.octet_length("text").cast("long")).alias("hash"))


@query()
def tag_files(spark, d):
    def run(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for vec, clip in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                x = np.repeat(np.asarray(clip, np.float32), 40)  # long enough for every waveform
                seconds = len(x) / RATE
                files = A.tag_files(f"/Contents/{vec}.wav", G.beat_grid(G.tempo(x, RATE), G.first_beat_ms(x, RATE), seconds * 1000), G.preview(x), G.color_preview(x, RATE), G.detail(x, RATE, seconds), 2 * len(x), len(x))
                rows += [(vec, name, raw) for name, raw in files.items()]
            yield pd.DataFrame(rows, columns=["vec_id", "extension", "content"])

    return S.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, extension string, content binary")
