"""Queries of windows, gaps and islands, edits and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.jobs.interval_queries import _STRETCH
from melodyspark.jobs.registry import query
from melodyspark.jobs.sql import duck, r
from melodyspark.operators import edits as E
from melodyspark.operators import gates as Z
from melodyspark.operators import islands as L
from melodyspark.operators import scoring as G
from melodyspark.operators import voice as V
from melodyspark.sources import tables as T

KEY, BY = ["recording_id"], ["onset", "frame_id"]
_W = "(PARTITION BY recording_id ORDER BY onset, frame_id)"
_WT = "(PARTITION BY recording_id ORDER BY t, frame_id)"


@query(duck("notes", more={"a": f"SELECT *, CASE WHEN midi // 6 = lag(midi // 6) OVER {_W} THEN 0 ELSE 1 END AS new FROM notes", "b": f"SELECT *, sum(new) OVER {_W} AS grp FROM a"}, body="SELECT recording_id, grp::BIGINT AS grp, (first(midi // 6))::INT AS band, count(*) AS n FROM b GROUP BY recording_id, grp"))
def w1_run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    n = T.notes(spark, sf).withColumn("band", F.floor(F.col("midi") / 6).cast("int"))
    runs = L.islands(n, KEY, BY, L.changed(KEY, BY, "band"))
    return runs.groupBy("recording_id", "grp").agg(F.first("band").alias("band"), F.count(F.lit(1)).alias("n"))


@query(duck("notes", more=_STRETCH, body=f"SELECT recording_id, grp::BIGINT AS grp, {r('start', 3)} AS start, {r('\"end\"', 3)} AS \"end\", notes FROM stretch"))
def w2_stretches(spark: SparkSession, sf: str) -> DataFrame:
    s = L.stretches(T.notes(spark, sf), 1.2, KEY, BY)
    return s.select("recording_id", "grp", S.round_to(F.col("start"), 3).alias("start"), S.round_to(F.col("end"), 3).alias("end"), "notes")


@query(duck("frames", more={"a": f"SELECT *, coalesce(t - lag(t) OVER {_WT} > 1.5::DOUBLE, true)::INT AS new FROM frames WHERE voiced", "b": f"SELECT *, sum(new) OVER {_WT} AS g FROM a", "s": "SELECT recording_id, g, min(t) - 0.01::DOUBLE AS a, max(t) + 0.01::DOUBLE AS z FROM b GROUP BY ALL HAVING max(t) - min(t) + 0.02::DOUBLE >= 0.18::DOUBLE",
    "c": "SELECT *, coalesce(a - lag(z) OVER (PARTITION BY recording_id ORDER BY a) >= 4, true)::INT AS new FROM s", "d": "SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY a) AS sec FROM c"}, body=f"SELECT recording_id, sec::BIGINT AS section, {r('min(a)', 3)} AS start, {r('max(z)', 3)} AS \"end\", count(*) AS spans FROM d GROUP BY recording_id, sec"))
def w3_voiced_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Voiced spans and acoustic sections; gaps as the data's frame rate asks."""
    secs = V.voiced_sections(T.frames(spark, sf), KEY, ["t", "frame_id"], gap=1.5, merge=4.0)
    return secs.select("recording_id", "section", S.round_to(F.col("start"), 3).alias("start"), S.round_to(F.col("end"), 3).alias("end"), "spans")



@query(duck("frames", more={"i": f"SELECT *, row_number() OVER {_WT} AS i FROM frames", "a": "SELECT *, coalesce(i - lag(i) OVER (PARTITION BY recording_id ORDER BY i) > 2, true)::INT AS new FROM i WHERE voiced", "b": "SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY i) AS g FROM a"}, body="SELECT recording_id, min(i) AS first, max(i) AS last, count(*) AS voiced FROM b GROUP BY recording_id, g HAVING max(i) - min(i) + 1 >= 6"))
def w4_voiced_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of voiced frames over holes of one frame, six frames long or more."""
    return V.voiced_runs(T.frames(spark, sf), KEY, ["t", "frame_id"], hole=1)



@query("SELECT vec_id, (i - 1)::INT AS hop, round_even(sqrt(list_sum(list_transform(list_slice(embedding, (i - 1) * 5 + 1, (i - 1) * 5 + 25), lambda x: x::DOUBLE * x::DOUBLE)) / 25) * 1e4, 0) / 1e4 AS rms FROM embeddings, unnest(range(1, 9)) AS u(i)")
def w5_sliding_loudness(spark: SparkSession, sf: str) -> DataFrame:
    """Loudness over 25 samples every 5, inside one row's samples."""
    v = T.table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("hop"))
    part = F.slice("embedding", F.col("hop") * 5 + 1, 25)
    total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return v.select("vec_id", "hop", S.round_to(F.sqrt(total / 25), 4).alias("rms"))


@query(duck("frames", more={"s": f"SELECT *, (coalesce(lag(rms) OVER {_WT}, 0) + rms + coalesce(lead(rms) OVER {_WT}, 0)) / 3 AS sm FROM frames", "d": f"SELECT *, min(sm) OVER (PARTITION BY recording_id ORDER BY t, frame_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near, max(sm) OVER (PARTITION BY recording_id ORDER BY t, frame_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS lo, max(sm) OVER (PARTITION BY recording_id ORDER BY t, frame_id ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS hi FROM s"},
    body=f"SELECT frame_id, {r('sm', 4)} AS smoothed, {r('sm / nullif(least(lo, hi), 0)', 4)} AS depth FROM d WHERE sm = near AND lo IS NOT NULL AND hi IS NOT NULL AND sm / nullif(least(lo, hi), 0) < 0.9::DOUBLE"))
def w6_w7_loudness_dips(spark: SparkSession, sf: str) -> DataFrame:
    """Three-point smoothing with zeros beyond the ends; local minima that lie well under both sides' peaks."""
    w = T.by_time()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = T.frames(spark, sf).withColumn("sm", (zero(F.lag("rms").over(w)) + F.col("rms") + zero(F.lead("rms").over(w))) / 3)
    side = F.least(F.max("sm").over(w.rowsBetween(-30, -1)), F.max("sm").over(w.rowsBetween(1, 30)))
    both = F.max("sm").over(w.rowsBetween(-30, -1)).isNotNull() & F.max("sm").over(w.rowsBetween(1, 30)).isNotNull()
    s = s.withColumn("near", F.min("sm").over(w.rowsBetween(-4, 4))).withColumn("depth", F.when(both, F.try_divide(F.col("sm"), side)))
    return s.where((F.col("sm") == F.col("near")) & (F.col("depth") < 0.9)).select("frame_id", S.round_to(F.col("sm"), 4).alias("smoothed"), S.round_to(F.col("depth"), 4).alias("depth"))


@query(duck("frames", more={"i": f"SELECT *, row_number() OVER {_WT} AS i FROM frames", "m": "SELECT *, quantile_cont(midi, 0.5) OVER (PARTITION BY recording_id ORDER BY i RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS mid FROM i WHERE voiced"}, body=f"SELECT frame_id, {r('CASE WHEN midi - mid > 7.5::DOUBLE THEN midi - 12 * ceil((midi - mid - 7.5::DOUBLE) / 12) WHEN mid - midi > 7.5::DOUBLE THEN midi + 12 * ceil((mid - midi - 7.5::DOUBLE) / 12) ELSE midi END', 4)} AS midi FROM m"))
def w8_octave_slips(spark: SparkSession, sf: str) -> DataFrame:
    """Frames moved by octaves towards the median of ten frames on either side."""
    return V.octave_slips(T.frames(spark, sf), KEY, ["t", "frame_id"], near=10).select("frame_id", S.round_to(F.col("fixed"), 4).alias("midi"))



@query(duck("secnotes", more={"a": "SELECT *, row_number() OVER (PARTITION BY recording_id, section ORDER BY onset, frame_id) AS i, count(*) OVER (PARTITION BY recording_id, section) AS n FROM secnotes"}, body=f"SELECT recording_id, section, {r('median(median) FILTER (WHERE i > n - greatest(1, n // 3)) - median(median) FILTER (WHERE i <= greatest(1, n // 3))', 4)} AS glide FROM a GROUP BY ALL"))
def w9_glide(spark: SparkSession, sf: str) -> DataFrame:
    """Median of the last third less the median of the first."""
    p = Window.partitionBy("recording_id", "section")
    n = T.with_section(T.notes(spark, sf)).withColumn("i", F.row_number().over(p.orderBy("onset", "frame_id"))).withColumn("n", F.count(F.lit(1)).over(p))
    third = F.greatest(F.lit(1), F.expr("n div 3"))
    g = F.median(F.when(F.col("i") > F.col("n") - third, F.col("median"))) - F.median(F.when(F.col("i") <= third, F.col("median")))
    return n.groupBy("recording_id", "section").agg(S.round_to(g, 4).alias("glide"))


@query("""WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) <= count(*) OVER (PARTITION BY label) // 2 AS before, embedding FROM embeddings),
x AS (SELECT label, before, i, avg(embedding[i]::DOUBLE) AS m FROM v, unnest(range(1, 65)) AS u(i) GROUP BY ALL)
SELECT label, round_even((1 - corr(a.m, b.m)) * 1e3, 0) / 1e3 AS colour_change FROM x a JOIN x b USING (label, i) WHERE a.before AND NOT b.before GROUP BY label""")
def w10_colour_change(spark: SparkSession, sf: str) -> DataFrame:
    """One less the correlation of mean band vectors before and after a cut."""
    p = Window.partitionBy("label")
    v = T.table(spark, sf, "embeddings").withColumn("before", F.row_number().over(p.orderBy("vec_id")) <= F.floor(F.count(F.lit(1)).over(p) / 2))
    m = v.select("label", "before", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.when(F.col("before"), F.col("x").cast("double"))).alias("a"), F.avg(F.when(~F.col("before"), F.col("x").cast("double"))).alias("b"))
    return m.groupBy("label").agg(S.round_to(1 - F.corr("a", "b"), 3).alias("colour_change"))


@query(duck("notes", more={"e": "SELECT n.frame_id, min(f.rms) FILTER (WHERE abs(f.t - n.onset) <= 0.5::DOUBLE) AS low, max(f.rms) FILTER (WHERE f.t < n.onset - 0.5::DOUBLE) AS l, max(f.rms) FILTER (WHERE f.t > n.onset + 0.5::DOUBLE) AS h FROM notes n JOIN frames f ON f.recording_id = n.recording_id AND abs(f.t - n.onset) <= 2.0 GROUP BY 1"}, body=f"SELECT frame_id, {r('low / nullif(least(l, h), 0)', 4)} AS edge FROM e WHERE l IS NOT NULL AND h IS NOT NULL"))
def w11_attack_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Loudness at every note's onset against both sides' peaks; widths as the data's frame rate asks."""
    f = T.frames(spark, sf)
    cuts = T.notes_of(f).select("recording_id", "frame_id", F.col("onset").alias("at"))
    return V.attack_edge(f, cuts, KEY, near=0.5, reach=2.0, bucket=5.0).select("frame_id", S.round_to(F.col("edge"), 4).alias("edge"))



@query(duck("notes", more={"a": f'SELECT *, CASE WHEN midi // 4 = lag(midi // 4) OVER {_W} AND onset - lag("end") OVER {_W} <= 1.0 THEN 0 ELSE 1 END AS new FROM notes', "b": f"SELECT *, sum(new) OVER {_W} AS g FROM a"}, body=f"SELECT recording_id, {r('min(onset)', 3)} AS onset, {r('max(\"end\")', 3)} AS \"end\", count(*) AS pieces, {r('sum(median * (\"end\" - onset)) / nullif(sum(\"end\" - onset), 0)', 3)} AS median FROM b GROUP BY recording_id, g"))
def w12_merge_held(spark: SparkSession, sf: str) -> DataFrame:
    """Touching notes of a pitch become one. Four semitones count as a pitch here."""
    n = T.notes(spark, sf).withColumn("band", F.floor(F.col("midi") / 4).cast("int"))
    m = V.merge_held(n, KEY, BY, pitch="band", gap=1.0)
    return m.select("recording_id", S.round_to(F.col("onset"), 3).alias("onset"), S.round_to(F.col("end"), 3).alias("end"), "pieces", S.round_to(F.col("median"), 3).alias("median"))



@query(duck("notes", "lengths", more={"x": f'SELECT *, lag("end") OVER {_W} AS prev FROM notes'}, body=f"SELECT recording_id, 'note' AS kind, {r('onset', 3)} AS start, {r('\"end\"', 3)} AS \"end\" FROM x UNION ALL SELECT recording_id, 'rest', {r('coalesce(prev, 0)', 3)}, {r('onset', 3)} FROM x WHERE onset > coalesce(prev, 0) UNION ALL SELECT recording_id, 'outro', {r('max(\"end\")', 3)}, {r('max(length)', 3)} FROM x JOIN lengths USING (recording_id) GROUP BY recording_id"))
def w14_rests(spark: SparkSession, sf: str) -> DataFrame:
    """A timeline without gaps: notes, a rest for each silence, and the outro."""
    f = T.frames(spark, sf)
    x = T.notes_of(f).withColumn("prev", F.coalesce(F.lag("end").over(Window.partitionBy("recording_id").orderBy(*BY)), F.lit(0.0)))
    row = lambda kind, a, b: (F.lit(kind).alias("kind"), S.round_to(a, 3).alias("start"), S.round_to(b, 3).alias("end"))
    rests = x.where("onset > prev").select("recording_id", *row("rest", F.col("prev"), F.col("onset")))
    outro = x.groupBy("recording_id").agg(F.max("end").alias("e")).join(T.lengths(f), "recording_id").select("recording_id", *row("outro", F.col("e"), F.col("length")))
    return x.select("recording_id", *row("note", F.col("onset"), F.col("end"))).unionByName(rests).unionByName(outro)


@query(duck("frames", more={"i": f"SELECT *, row_number() OVER {_WT} AS i FROM frames", "k": "SELECT recording_id, i, CASE WHEN voiced THEN midi END AS v FROM i", "s": "SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY i) AS i0, last_value(v IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY i) AS v0, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1, first_value(v IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM k"},
    body=f"SELECT recording_id, i, {r('coalesce(v, v0 + (v1 - v0) * (i - i0) / (i1 - i0)::DOUBLE)', 4)} AS midi, v IS NULL AND v0 IS NOT NULL AND v1 IS NOT NULL AS interpolated FROM s"))
def w20_fill_linear(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf).withColumn("i", F.row_number().over(T.by_time()).cast("long")).withColumn("v", F.when(F.col("voiced"), F.col("midi")))
    f = f.withColumn("m", L.fill_linear(f, KEY, "i", "v"))
    return f.select("recording_id", "i", S.round_to(F.col("m"), 4).alias("midi"), (F.col("v").isNull() & F.col("m").isNotNull()).alias("interpolated"))


@query(duck("secnotes", more={"x": 'SELECT *, row_number() OVER w AS i, count(*) OVER p AS n, min(onset) OVER p AS a, max("end") OVER p AS z FROM secnotes WINDOW w AS (PARTITION BY recording_id, section ORDER BY onset, frame_id), p AS (PARTITION BY recording_id, section)'}, body=f"SELECT frame_id, {r('a + (z - a) * (i - 1) / n', 4)} AS start FROM x"))
def w21_even_spread(spark: SparkSession, sf: str) -> DataFrame:
    p = Window.partitionBy("recording_id", "section")
    n = T.with_section(T.notes(spark, sf)).withColumn("i", F.row_number().over(p.orderBy("onset", "frame_id"))).withColumn("n", F.count(F.lit(1)).over(p)).withColumn("a", F.min("onset").over(p)).withColumn("z", F.max("end").over(p))
    return n.select("frame_id", S.round_to(F.col("a") + (F.col("z") - F.col("a")) * (F.col("i") - 1) / F.col("n"), 4).alias("start"))


@query(duck("frames", more={"m": f"SELECT *, sum(voiced::INT) OVER (PARTITION BY recording_id ORDER BY t, frame_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10.0::DOUBLE AS run FROM frames"}, body=f"SELECT recording_id, {r('min(t) - 0.15::DOUBLE', 3)} AS first_voice FROM m WHERE run > 0.8::DOUBLE GROUP BY 1"))
def w22_first_voice(spark: SparkSession, sf: str) -> DataFrame:
    """First moment of sustained voice: a centred moving mean over ten frames, zeros beyond the ends."""
    return V.first_voice(T.frames(spark, sf), KEY, ["t", "frame_id"], span=10).select("recording_id", S.round_to(F.col("first_voice"), 3).alias("first_voice"))



@query(duck("secnotes", "lengths", more={"s": 'SELECT recording_id, section, min(onset) AS a, max("end") AS z FROM secnotes GROUP BY ALL', "f": "SELECT *, first_value(a) OVER w AS a0, lag(z) OVER w AS prev_z, lead(a) OVER w AS next_a FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY section)", "c": "SELECT * FROM f WHERE prev_z IS NULL OR prev_z - a0 < 30",
    "q": "SELECT recording_id, a0, length, max(z) AS z, count(*) AS sections, arg_max(next_a, section) AS nxt FROM c JOIN lengths USING (recording_id) GROUP BY ALL"}, body=f"SELECT recording_id, sections, {r('CASE WHEN a0 > 6 THEN a0 - 4 ELSE 0 END', 2)} AS start, {r('CASE WHEN coalesce(nxt, length) - z >= 0.6::DOUBLE THEN least(z + 1.4::DOUBLE, coalesce(nxt, length) - 0.05::DOUBLE) ELSE greatest(z, coalesce(nxt, length) - 0.02::DOUBLE) END', 2)} AS \"end\" FROM q"))
def w23_quick_part(spark: SparkSession, sf: str) -> DataFrame:
    """The first sections until their singing spans 30 s, with lead-in and ending."""
    f = T.frames(spark, sf)
    s = T.with_section(T.notes_of(f)).groupBy("recording_id", "section").agg(F.min("onset").alias("a"), F.max("end").alias("z")).join(T.lengths(f), "recording_id")
    q = V.quick_part(s, [*KEY, "length"], "section", F.col("length"), span=30.0)
    return q.select("recording_id", "sections", S.round_to(F.col("start"), 2).alias("start"), S.round_to(F.col("end"), 2).alias("end"))



@query(duck("secnotes", more={"i": f"SELECT *, row_number() OVER {_W} - 1 AS i FROM secnotes"}, body="SELECT recording_id, section, min(i)::INT AS first_note, max(i)::INT AS last_note FROM i GROUP BY ALL"))
def w26_reindex(spark: SparkSession, sf: str) -> DataFrame:
    n = T.with_section(T.notes(spark, sf)).withColumn("i", F.row_number().over(Window.partitionBy("recording_id").orderBy(*BY)) - 1)
    return n.groupBy("recording_id", "section").agg(F.min("i").alias("first_note"), F.max("i").alias("last_note"))


@query(duck("score", more={"e": "SELECT song, seq, midi % 3 AS pitch, o_orderkey, (o_orderkey % 2 = 1) AS is_on, sum(dur) OVER (PARTITION BY song ORDER BY seq) AS clock FROM score", "p": "SELECT *, lead(clock) OVER w AS off, lead(is_on) OVER w AS next_on FROM e WINDOW w AS (PARTITION BY song, pitch ORDER BY seq)"}, body="SELECT o_orderkey, clock::BIGINT AS start, (off - clock)::BIGINT AS dur FROM p WHERE is_on AND next_on = false"))
def w27_note_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """On events with the off event that follows on the same track and pitch, on a running clock; three pitches a song."""
    e = T.score_events(spark, sf).withColumn("pitch", F.col("midi") % 3).withColumn("is_on", F.col("o_orderkey") % 2 == 1).withColumn("velocity", F.lit(64)).withColumnRenamed("dur", "delta")
    return V.note_pairs(e, ["song", "pitch"], ["song"], "seq").select("o_orderkey", "start", "dur")



@query(duck("score", more={"a": "SELECT *, CASE WHEN lag(tie) OVER (PARTITION BY song ORDER BY seq) THEN 0 ELSE 1 END AS new FROM score", "b": "SELECT *, sum(new) OVER (PARTITION BY song ORDER BY seq) AS g FROM a"}, body="SELECT song, min(seq)::INT AS seq, arg_min(midi, seq) AS midi, sum(dur)::BIGINT AS dur, count(*) AS tied FROM b GROUP BY song, g"))
def w28_tied_notes(spark: SparkSession, sf: str) -> DataFrame:
    e = T.score_events(spark, sf)
    g = L.islands(e, ["song"], ["seq"], ~F.lag("tie").over(Window.partitionBy("song").orderBy("seq")))
    return g.groupBy("song", "grp").agg(F.min("seq").alias("seq"), F.min_by("midi", "seq").alias("midi"), F.sum("dur").alias("dur"), F.count(F.lit(1)).alias("tied")).drop("grp")


@query(duck("words", more={"c": "SELECT *, regexp_matches(word, '^[A-Z]') AS cap FROM words", "d": "SELECT *, avg(cap::INT) OVER (PARTITION BY recording_id) AS share, lag(segment) OVER w AS ps, lag(word) OVER w AS pw FROM c WINDOW w AS (PARTITION BY recording_id ORDER BY pos)"}, body="SELECT recording_id, pos FROM d WHERE pw IS NULL OR ps <> segment OR regexp_matches(pw, '[.!?]$') OR (cap AND share < 0.45::DOUBLE)"))
def w29_line_starts(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("pos")
    d = T.words(spark, sf).withColumn("cap", F.col("word").rlike("^[A-Z]")).withColumn("share", F.avg(F.col("cap").cast("int")).over(Window.partitionBy("recording_id"))).withColumn("ps", F.lag("segment").over(w)).withColumn("pw", F.lag("word").over(w))
    return d.where(F.col("pw").isNull() | (F.col("ps") != F.col("segment")) | F.col("pw").rlike("[.!?]$") | (F.col("cap") & (F.col("share") < 0.45))).select("recording_id", "pos")


_EDITS = {"ed": "SELECT frame_id AS edit_id, recording_id, onset + CASE WHEN frame_id % 51 = 0 THEN 0.5::DOUBLE ELSE 0.002::DOUBLE END AS onset, midi AS old, CASE (frame_id // 17) % 4 WHEN 0 THEN 'midi' WHEN 1 THEN 'split' WHEN 2 THEN 'join' ELSE 'delete' END AS op, (midi + 2)::INT AS new, onset + 0.15::DOUBLE AS cut_at FROM notes WHERE frame_id % 17 = 0",
    "hit": "SELECT e.edit_id, count(n.frame_id) AS matches, min(n.frame_id) AS frame_id, min(n.midi) AS actual FROM ed e LEFT JOIN notes n ON n.recording_id = e.recording_id AND abs(n.onset - e.onset) < 0.006::DOUBLE GROUP BY 1", "loc": "SELECT ed.*, matches, frame_id, (matches <> 1 OR actual IS DISTINCT FROM old) AS stale FROM ed JOIN hit USING (edit_id)"}


def _edits(n: DataFrame) -> DataFrame:
    op = F.element_at(F.array(*[F.lit(x) for x in ("midi", "split", "join", "delete")]), (F.expr("frame_id div 17") % 4).cast("int") + 1)
    e = n.where("frame_id % 17 = 0")
    return e.select(F.col("frame_id").alias("edit_id"), "recording_id", (F.col("onset") + F.when(F.col("frame_id") % 51 == 0, 0.5).otherwise(0.002)).alias("onset"), F.col("midi").alias("old"), op.alias("op"), (F.col("midi") + 2).alias("new"), (F.col("onset") + 0.15).alias("at"))


@query(duck("notes", more=_EDITS, body="SELECT edit_id, op, matches, stale FROM loc"))
def j9_locate_edits(spark: SparkSession, sf: str) -> DataFrame:
    n = T.notes(spark, sf)
    return E.locate(_edits(n), n, "recording_id").select("edit_id", "op", "matches", "stale")


@query(duck("notes", more={**_EDITS, "x": f'SELECT n.*, op, new, cut_at, lead("end") OVER w AS ne, lag(op) OVER w AS po FROM notes n LEFT JOIN (SELECT frame_id, op, new, cut_at FROM loc WHERE NOT stale) l USING (frame_id) WINDOW w AS (PARTITION BY recording_id ORDER BY onset, frame_id)', "y": "SELECT * FROM x WHERE po IS DISTINCT FROM 'join' AND op IS DISTINCT FROM 'delete'"},
    body=f"""SELECT frame_id, 0 AS part, {r('onset', 3)} AS onset, {r("CASE WHEN op = 'split' THEN cut_at WHEN op = 'join' AND ne IS NOT NULL THEN ne ELSE \"end\" END", 3)} AS "end", CASE WHEN op = 'midi' THEN new ELSE midi END AS midi FROM y
    UNION ALL SELECT frame_id, 1, {r('cut_at', 3)}, {r('"end"', 3)}, new FROM y WHERE op = 'split'"""))  # fmt: skip
def j10_apply_edits(spark: SparkSession, sf: str) -> DataFrame:
    n = T.notes(spark, sf)
    out = E.apply_edits(n, E.locate(_edits(n), n, "recording_id").select("frame_id", "op", "new", "at", "stale"), "recording_id")
    return out.select("frame_id", "part", S.round_to(F.col("onset"), 3).alias("onset"), S.round_to(F.col("end"), 3).alias("end"), "midi")


@query(duck("notes", more={**_EDITS, "fit": "SELECT frame_id, op, cut_at FROM loc WHERE NOT stale AND op IN ('midi', 'split')", "cut": "SELECT recording_id, onset - 0.05 AS start, onset + 2 AS \"end\" FROM notes WHERE frame_id % 23 = 0", "gone": 'SELECT DISTINCT n.frame_id FROM notes n JOIN cut c ON n.recording_id = c.recording_id AND ((onset >= c.start AND onset < c."end") OR ((onset + n."end") / 2 >= c.start AND (onset + n."end") / 2 < c."end"))'},
    body="SELECT n.recording_id, count(*) AS pieces, count(*) FILTER (WHERE k = 1) AS splits FROM notes n LEFT JOIN fit USING (frame_id), range(2) u(k) WHERE n.frame_id NOT IN (SELECT frame_id FROM gone) AND (k = 0 OR op = 'split') GROUP BY 1"))
def j4_j9_gated_chart(spark: SparkSession, sf: str) -> DataFrame:
    """Left-out stretches and pitch and split edits under gates that fail the job at a stale one; those that are stale here are taken away before."""
    n = T.notes(spark, sf)
    fit = E.locate(_edits(n), n, "recording_id").where("not stale and op in ('midi', 'split')").select("edit_id", "recording_id", "onset", "old", "op", "new", "at")
    done = Z.apply_strictly(n, E.locate(fit, n, "recording_id"), "recording_id")
    cut = n.where("frame_id % 23 = 0").select("recording_id", F.col("frame_id").alias("ex"), (F.col("onset") - 0.05).alias("start"), (F.col("onset") + 2).alias("end"))
    left = Z.leave_out(n, cut, ["recording_id"], "frame_id", "ex").select("recording_id", "frame_id")
    out = done.join(left, ["recording_id", "frame_id"])
    return out.groupBy("recording_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("part") == 1).alias("splits"))


_SAMPLES = {"smp": """SELECT n.recording_id, n.frame_id AS note, n.onset AS t, n."end", n.onset + k * 0.04::DOUBLE AS a, n.onset + (k + 1) * 0.04::DOUBLE AS b, CASE WHEN (n.frame_id + k) % 6 = 0 OR k < n.frame_id % 4 THEN NULL ELSE ((n.frame_id * 7 + k * 13) % 120 - 40)::DOUBLE END AS error FROM notes n, range(25) u(k)"""}
_CATS = ", ".join(f"({i}, '{n}', {c}, {late}::DOUBLE, {cover}::DOUBLE, {w}::DOUBLE)" for i, (n, c, late, cover, w) in enumerate(G.GRADES))
_TIER = " ".join(f"WHEN combo >= {least} THEN {worth}" for least, worth in G.TIERS)
#: grades and streaks of the samples ``smp``, for DuckDB
GRADE_SQL = {
    "cats": f"SELECT * FROM (VALUES {_CATS}) v(c, name, cents, latest, least_cover, worth)",
    "clip": """SELECT *, greatest(a, t) AS ca, greatest(0, least(b, "end") - greatest(a, t)) AS d FROM smp""",
    "sil": "SELECT *, sum(CASE WHEN error IS NULL THEN d ELSE 0 END) OVER (PARTITION BY recording_id, note ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS s FROM clip",
    "voi": "SELECT *, abs(error) <= cents AS ok, coalesce(lag(abs(error) <= cents) OVER w, false) AS pok, ca - lag(ca + d) OVER w AS gap, s - lag(s) OVER w AS silent FROM sil, cats WHERE error IS NOT NULL WINDOW w AS (PARTITION BY recording_id, note, c ORDER BY a, b)",
    "runs": f"SELECT *, sum((ok AND NOT (pok AND gap <= 1e-9))::INT) OVER (PARTITION BY recording_id, note, c ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run, CASE WHEN pok AND gap > 1e-9 AND gap <= {G.BRIDGE}::DOUBLE + 1e-9 THEN least(gap, silent) ELSE 0 END AS credit FROM voi",
    "steady": 'SELECT recording_id, note, t, "end", c, run, sum(d) AS d, sum(credit) AS credit, min(ca) AS first FROM runs WHERE ok GROUP BY ALL',
    "cov": f'SELECT recording_id, note, c, (sum(d) + least(sum(credit), {G.BRIDGE_SHARE}::DOUBLE * any_value("end" - t))) / any_value("end" - t) AS cover, min(CASE WHEN d >= least({G.STABLE}::DOUBLE, {G.STABLE_SHARE}::DOUBLE * ("end" - t)) - 1e-9 THEN first END) - any_value(t) AS late FROM steady GROUP BY recording_id, note, c',
    "wm": "SELECT recording_id, note, min(e) FILTER (WHERE upto >= total / 2 - 1e-9) AS median FROM (SELECT *, sum(w) OVER (PARTITION BY recording_id, note ORDER BY e) AS upto, sum(w) OVER (PARTITION BY recording_id, note) AS total FROM (SELECT recording_id, note, abs(error) AS e, sum(d) AS w FROM clip WHERE error IS NOT NULL AND d > 0 GROUP BY ALL)) GROUP BY ALL",
    "won": "SELECT recording_id, note, min(c) AS c FROM cov JOIN wm USING (recording_id, note) JOIN cats USING (c) WHERE median <= cents AND late <= latest + 1e-9 AND cover >= least_cover - 1e-9 GROUP BY ALL",
    "graded": f"""SELECT n.recording_id, n.note, n.t, n."end", median, late, coalesce(cover, 0) AS cover, CASE WHEN won.c IS NULL THEN 'miss' ELSE name END AS grade, CASE WHEN won.c IS NULL THEN 0 ELSE worth END AS worth
        FROM (SELECT DISTINCT recording_id, note, t, "end" FROM smp) n LEFT JOIN wm ON wm.recording_id = n.recording_id AND wm.note = n.note LEFT JOIN won ON won.recording_id = n.recording_id AND won.note = n.note
        JOIN cats ON cats.c = coalesce(won.c, {len(G.GRADES) - 1}) LEFT JOIN cov ON cov.recording_id = n.recording_id AND cov.note = n.note AND cov.c = cats.c""",
    "broken": "SELECT *, sum((grade NOT IN ('perfect', 'great'))::INT) OVER (PARTITION BY recording_id ORDER BY t, note) AS run FROM graded",
    "streak": "SELECT *, sum((grade IN ('perfect', 'great'))::INT) OVER (PARTITION BY recording_id, run ORDER BY t, note) AS combo FROM broken",
    "scored": f"SELECT *, worth * CASE {_TIER} END AS points FROM streak",
}


def samples(n: DataFrame) -> DataFrame:
    """One second of samples of .04 s for every note."""
    k = F.col("k")
    x = n.select("recording_id", F.col("frame_id").alias("note"), F.col("onset").alias("t"), "end", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k"))
    none = ((F.col("note") + k) % 6 == 0) | (k < F.col("note") % 4)
    return x.withColumn("a", F.col("t") + k * 0.04).withColumn("b", F.col("t") + (k + 1) * 0.04).withColumn("error", F.when(~none, ((F.col("note") * 7 + k * 13) % 120 - 40).cast("double"))).drop("k")


@query(duck("notes", more={**_SAMPLES, **GRADE_SQL}, body=f"SELECT note, median, {r('late', 4)} AS late, {r('cover', 4)} AS cover, grade FROM graded"))
def a23_grade_notes(spark: SparkSession, sf: str) -> DataFrame:
    g = G.grade_notes(samples(T.notes(spark, sf)), ["recording_id", "note"])
    return g.select("note", "median", S.round_to(F.col("late"), 4).alias("late"), S.round_to(F.col("cover"), 4).alias("cover"), "grade")


_RANK = " ".join(f"WHEN performance >= {least} - 1e-9 THEN '{name}'" for name, least in G.RANKS)


@query(duck("notes", more={**_SAMPLES, **GRADE_SQL, "sums": "SELECT recording_id, count(*) FILTER (WHERE grade = 'perfect') AS perfect, count(*) FILTER (WHERE grade = 'great') AS great, count(*) FILTER (WHERE grade = 'good') AS good, count(*) FILTER (WHERE grade = 'miss') AS miss, max(combo)::BIGINT AS best_combo, sum(points)::DOUBLE AS points, 100 * avg(worth) AS performance FROM scored GROUP BY 1"},
    body=f"SELECT recording_id, perfect, great, good, miss, best_combo, {r('points', 3)} AS points, {r('performance', 3)} AS performance, CASE {_RANK} ELSE 'F' END AS rank FROM sums"))
def a24_w15_performance(spark: SparkSession, sf: str) -> DataFrame:
    g = G.streaks(G.grade_notes(samples(T.notes(spark, sf)), ["recording_id", "note"]), ["recording_id"], ["t", "note"])
    return G.performance(g, ["recording_id"]).withColumn("points", S.round_to(F.col("points"), 3)).withColumn("performance", S.round_to(F.col("performance"), 3))


@query(duck("notes", more={"d": 'SELECT recording_id, frame_id, onset AS deadline, onset - (frame_id % 9 - 3) * 0.1::DOUBLE AS done, length(lyric) AS chars, "end" - onset AS dur FROM notes WHERE lyric <> \'\''}, body=f"SELECT recording_id, count(*) FILTER (WHERE done <= deadline) AS prepared, sum(CASE WHEN done <= deadline THEN 100 + CASE WHEN deadline - done <= 0.3::DOUBLE + 1e-9 THEN 25 ELSE 0 END ELSE 0 END)::BIGINT AS points, {r('sum(chars) / 5.0::DOUBLE / (sum(dur) / 60)', 2)} AS wpm FROM d GROUP BY 1"))
def a25_typed_run(spark: SparkSession, sf: str) -> DataFrame:
    """Words typed before their notes: prepared in time, close in time, and speed without pauses."""
    n = T.notes(spark, sf).where("lyric != ''").withColumn("done", F.col("onset") - (F.col("frame_id") % 9 - 3) * 0.1)
    early = F.col("done") <= F.col("onset")
    points = F.when(early, 100 + F.when(F.col("onset") - F.col("done") <= 0.3 + 1e-9, 25).otherwise(0)).otherwise(0)
    return n.groupBy("recording_id").agg(F.count_if(early).alias("prepared"), F.sum(points).alias("points"), S.round_to(F.sum(F.length("lyric")) / 5.0 / (F.sum(F.col("end") - F.col("onset")) / 60), 2).alias("wpm"))


@query("""WITH b AS (SELECT label, vec_id * 0.005::DOUBLE AS t, embedding FROM embeddings), c AS (SELECT label, vec_id * 0.005::DOUBLE AS cut FROM embeddings WHERE vec_id % 40 = 20),
x AS (SELECT c.label, cut, t < cut AS before, i, embedding[i]::DOUBLE AS v FROM c JOIN b ON b.label = c.label AND ((t >= cut - 1.5::DOUBLE - 6.0::DOUBLE AND t < cut - 1.5::DOUBLE) OR (t > cut + 1.5::DOUBLE AND t <= cut + 1.5::DOUBLE + 6.0::DOUBLE)), unnest(range(1, 65)) AS u(i)),
m AS (SELECT label, cut, i, avg(v) FILTER (WHERE before) AS a, avg(v) FILTER (WHERE NOT before) AS z, count(*) FILTER (WHERE before) AS n, count(*) FILTER (WHERE NOT before) AS k FROM x GROUP BY ALL),
g AS (SELECT label, cut, CASE WHEN min(n) >= 3 AND min(k) >= 3 THEN 1 - corr(a, z) ELSE 0 END AS colour FROM m GROUP BY ALL)
SELECT c.label, round_even(c.cut * 1e3, 0) / 1e3 AS "at", round_even(coalesce(colour, 0) * 1e3, 0) / 1e3 AS colour FROM c LEFT JOIN g USING (label, cut)""")
def w10_colour_change_at_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Change of the band vectors' shape across cuts of each label's series, one vector in 5 ms; sides as the data's density asks."""
    v = T.table(spark, sf, "embeddings").withColumn("t", F.col("vec_id") * 0.005)
    cuts = v.where("vec_id % 40 = 20").select("label", F.col("t").alias("at"))
    c = V.colour_change(v.withColumnRenamed("embedding", "bands"), cuts, ["label"], guard=1.5, side=6.0, bucket=30.0)
    return c.select("label", S.round_to(F.col("at"), 3).alias("at"), S.round_to(F.col("colour"), 3).alias("colour"))


@query(duck("words", more={"g": "SELECT recording_id, pos, CASE WHEN pos % 5 < 3 THEN start END AS s, CASE WHEN pos % 5 < 3 THEN \"end\" END AS e FROM words", "k": "SELECT *, last_value(CASE WHEN s IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS bi, last_value(e IGNORE NULLS) OVER w AS be, first_value(CASE WHEN s IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS ai, first_value(s IGNORE NULLS) OVER v AS \"as\" FROM g WINDOW w AS (PARTITION BY recording_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY recording_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"},
    body=f"SELECT recording_id, pos, {r('coalesce(s, be + (\"as\" - be) * (pos - bi - 0.5::DOUBLE) / (ai - bi)::DOUBLE)', 3)} AS start, CASE WHEN s IS NOT NULL THEN 'known' WHEN bi IS NOT NULL AND ai IS NOT NULL THEN 'interpolated' ELSE 'none' END AS anchor FROM k"))
def w20_fill_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times of words that two in five lack, between the end of the word before and the start of the next."""
    known = F.col("pos") % 5 < 3
    w = T.words(spark, sf).select("recording_id", "pos", F.when(known, F.col("start")).alias("start"), F.when(known, F.col("end")).alias("end"))
    return V.fill_times(w, KEY, "pos").select("recording_id", "pos", S.round_to(F.col("start"), 3).alias("start"), "anchor")


@query("""WITH c AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk, embedding FROM embeddings), x AS (SELECT label, chunk * 64 + i - 1 AS p, embedding[i]::DOUBLE AS v FROM c, unnest(range(1, 65)) AS u(i)),
s AS (SELECT label, p, sum(v * v) OVER (PARTITION BY label ORDER BY p ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS e, count(*) OVER (PARTITION BY label) AS n FROM x)
SELECT label, (p // 5)::BIGINT AS hop, round_even(sqrt(greatest(e, 0) / 25) * 1e4, 0) / 1e4 AS rms FROM s WHERE p % 5 = 0 AND p // 5 < (n - 25) // 5""")
def w5_sliding_loudness_of_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Loudness over 25 samples every 5 of each label's vectors as the chunks of one signal at 1 kHz."""
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    c = T.table(spark, sf, "embeddings").select("label", number.alias("chunk"), F.col("embedding").alias("samples"))
    return V.sliding_loudness(c, ["label"], 1000).select("label", "hop", S.round_to(F.col("rms"), 4).alias("rms"))
