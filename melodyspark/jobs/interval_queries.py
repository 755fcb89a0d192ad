"""Queries of interval, as-of and lag joins and of version differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.jobs.registry import query
from melodyspark.jobs.sql import duck, r
from melodyspark.operators import audit as U
from melodyspark.operators import intervals as I
from melodyspark.operators import quality as Q
from melodyspark.operators import stats as A
from melodyspark.sources import tables as T

#: test spans of ten seconds with an expected pitch, long enough to hold several frames
SPANS = {"spans": "SELECT recording_id, k::INT AS span, k * 10.0::DOUBLE AS start, k * 10.0::DOUBLE + 10 AS \"end\", (50 + (recording_id + k) % 20)::INT AS expected FROM (SELECT recording_id, floor(max(t) / 10)::INT AS last FROM frames GROUP BY 1), unnest(generate_series(0, last)) AS u(k)"}
_INSET = 'f.t >= s.start + least(0.05::DOUBLE, ("end" - start) * 0.2::DOUBLE) AND f.t < s."end" - least(0.04::DOUBLE, ("end" - start) * 0.2::DOUBLE)'
READ_SQL = {
    **SPANS,
    "hits": f"SELECT s.recording_id, span, expected, f.midi, voiced, median(CASE WHEN voiced THEN f.midi END) OVER (PARTITION BY s.recording_id, span) AS med FROM frames f JOIN spans s ON f.recording_id = s.recording_id AND {_INSET}",
    "reads": """SELECT recording_id, span, first(expected) AS expected, first(med) AS median, count(*) FILTER (WHERE voiced) AS frames, count(*) FILTER (WHERE voiced) / count(*)::DOUBLE AS coverage,
        avg(CASE WHEN voiced THEN (abs(midi - med) <= 0.30::DOUBLE)::INT END) AS stable, avg(CASE WHEN voiced THEN (abs(midi - round_even(med, 0)) <= 0.40::DOUBLE)::INT END) AS support,
        avg(CASE WHEN voiced THEN (abs(midi - expected) <= 0.65::DOUBLE)::INT END) AS agreement FROM hits GROUP BY recording_id, span""",
}


def spans(frames: DataFrame) -> DataFrame:
    return T.steps(frames, 10.0, "span").select("recording_id", "span", (F.col("span") * 10.0).alias("start"), (F.col("span") * 10.0 + 10).alias("end"), (50 + (F.col("recording_id") + F.col("span")) % 20).cast("int").alias("expected"))


def span_points(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf).select("recording_id", "frame_id", "t", "midi", "voiced")
    a, b = I.inset(F.col("start"), F.col("end"))
    return I.interval_join(f, spans(f).withColumn("a", a).withColumn("b", b), ["recording_id"], "t", "a", "b", 10.0)


@query(duck("frames", more=READ_SQL, body=f"SELECT recording_id, span, {r('median', 4)} AS median, frames, {r('coverage', 4)} AS coverage, {r('stable', 4)} AS stable, {r('support', 4)} AS support FROM reads"))
def j2_a4_interval_readings(spark: SparkSession, sf: str) -> DataFrame:
    out = A.reading(span_points(spark, sf), ["recording_id", "span"])
    return out.select("recording_id", "span", "frames", *[S.round_to(F.col(c), 4).alias(c) for c in ("median", "coverage", "stable", "support")])


@query(duck("sections", body='SELECT frame_id, s.section FROM notes n JOIN sections s ON n.recording_id = s.recording_id AND n.onset >= s.start AND n.onset < s."end"'))
def j3_note_sections(spark: SparkSession, sf: str) -> DataFrame:
    n = T.notes(spark, sf)
    return I.interval_join(n.select("recording_id", "frame_id", "onset"), T.sections(n), ["recording_id"], "onset", "start", "end", 20.0).select("frame_id", "section")


@query(duck("notes", more={"cut": 'SELECT recording_id, onset + 0.1 AS start, onset + 3.1 AS "end", frame_id AS cut_id FROM notes WHERE frame_id % 19 = 0', "gone": 'SELECT DISTINCT n.frame_id FROM notes n JOIN cut c ON n.recording_id = c.recording_id AND ((onset >= c.start AND onset < c."end") OR ((onset + n."end") / 2 >= c.start AND (onset + n."end") / 2 < c."end"))'}, body="SELECT n.frame_id, n.recording_id FROM notes n ANTI JOIN gone g ON n.frame_id = g.frame_id"))
def j4_excluded_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that begin, or have their middle, inside a left-out stretch are dropped."""
    n = T.notes(spark, sf).withColumn("middle", (F.col("onset") + F.col("end")) / 2)
    cut = n.where("frame_id % 19 = 0").select("recording_id", (F.col("onset") + 0.1).alias("start"), (F.col("onset") + 3.1).alias("end"))
    kept = n.select("recording_id", "frame_id", "onset", "middle")
    for t in ("onset", "middle"):
        kept = I.outside(kept, cut, ["recording_id"], t, "start", "end", 5.0, ["frame_id"])
    return kept.select("frame_id", "recording_id")


@query(duck("sections", body='SELECT frame_id FROM notes n WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.recording_id = n.recording_id AND s.section % 2 = 0 AND n.onset >= s.start AND n.onset < s."end")'))
def j5_uncovered_notes(spark: SparkSession, sf: str) -> DataFrame:
    n = T.notes(spark, sf)
    charted = T.sections(n).where("section % 2 = 0")
    return I.outside(n.select("recording_id", "frame_id", "onset"), charted, ["recording_id"], "onset", "start", "end", 20.0, ["frame_id"]).select("frame_id")


_ANCHORS = {"anchors": "SELECT recording_id, frame_id, t + 0.37::DOUBLE AS start FROM frames", "near": "SELECT a.recording_id, a.frame_id, a.start, (SELECT n.onset FROM notes n WHERE n.recording_id = a.recording_id ORDER BY abs(n.onset - a.start), n.onset LIMIT 1) AS onset FROM anchors a"}


@query(duck("notes", more={**_ANCHORS, "d": "SELECT recording_id, onset - start AS d FROM near WHERE abs(onset - start) <= 1.0"}, body=f"SELECT recording_id, count(*) AS used, {r('CASE WHEN count(*) >= 3 THEN median(d) ELSE 0 END', 4)} AS shift FROM d GROUP BY recording_id"))
def j6_anchor_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Constant lateness of word times: every frame is a word, .37 s late."""
    words = T.frames(spark, sf).select("recording_id", "frame_id", (F.col("t") + 0.37).alias("start"))
    found = U.anchor_shift(words, T.notes(spark, sf), ["recording_id"], "frame_id")
    return found.withColumn("shift", S.round_to(F.col("shift"), 4))


@query(duck("notes", more={"att": "SELECT recording_id, t AS at FROM frames WHERE NOT voiced", "p": "SELECT n.frame_id, a.at, a.at - n.onset AS delta, row_number() OVER (PARTITION BY n.frame_id ORDER BY abs(a.at - n.onset), a.at) AS k FROM notes n JOIN att a ON n.recording_id = a.recording_id AND abs(a.at - n.onset) <= 0.30::DOUBLE"}, body=f"SELECT frame_id, {r('delta', 4)} AS delta, abs(delta) > 0.1::DOUBLE AS late FROM p WHERE k = 1"))
def j7_nearest_attack(spark: SparkSession, sf: str) -> DataFrame:
    attacks = T.frames(spark, sf).where(~F.col("voiced")).select("recording_id", F.col("t").alias("at"))
    best = U.nearest_attack(T.notes(spark, sf), attacks, ["recording_id"], "frame_id")
    return best.select("frame_id", S.round_to(F.col("delta"), 4).alias("delta"), "late")


_STRETCH = {"g": 'SELECT *, CASE WHEN onset - lag("end") OVER w >= 1.2 THEN 1 WHEN lag("end") OVER w IS NULL THEN 1 ELSE 0 END AS new FROM notes WINDOW w AS (PARTITION BY recording_id ORDER BY onset, frame_id)', "h": "SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY onset, frame_id) AS grp FROM g", "stretch": 'SELECT recording_id, grp, min(onset) AS start, max("end") AS "end", count(*) AS notes FROM h GROUP BY ALL'}


@query(duck("notes", more={**_STRETCH, "w": "SELECT recording_id, frame_id, t AS lo, t + 0.3::DOUBLE AS hi FROM frames"}, body='SELECT w.frame_id, s.grp::BIGINT AS grp FROM w JOIN stretch s ON w.recording_id = s.recording_id AND hi > s.start - 0.2::DOUBLE AND lo < s."end" + 0.2::DOUBLE'))
def j8_words_in_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame, as a word of .3 s, with the sung stretches that it meets within .2 s."""
    from melodyspark.operators.islands import stretches

    st = stretches(T.notes(spark, sf), 1.2, ["recording_id"], ["onset", "frame_id"])
    w = T.frames(spark, sf).select("recording_id", "frame_id", F.col("t").alias("lo"), (F.col("t") + 0.3).alias("hi"))
    return I.overlap_join(w, st, ["recording_id"], 0.2, 10.0).select("frame_id", F.col("grp").cast("long").alias("grp"))


@query(duck("notes", more={"base": "SELECT recording_id, frame_id, onset, lyric FROM notes WHERE lyric <> ''", "other": "SELECT recording_id, onset + late AS at, lyric, pass FROM base, (VALUES (0, 0.4::DOUBLE), (1, 0.7::DOUBLE)) v(pass, late)"}, body="SELECT b.frame_id, count(DISTINCT o.pass) AS support FROM base b JOIN other o ON b.recording_id = o.recording_id AND b.lyric = o.lyric AND abs(o.at - b.onset) < 0.6::DOUBLE GROUP BY b.frame_id"))
def j11_supported_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words that another pass heard alike within .6 s, with the number of passes: two that heard every word, .4 and .7 s late."""
    n = T.notes(spark, sf).where("lyric <> ''")
    base = n.select("recording_id", "lyric", "frame_id", "onset", (F.col("onset") - 0.7).alias("a"), (F.col("onset") + 0.7).alias("b"))
    late = F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), F.lit(x).alias("late")) for k, x in enumerate((0.4, 0.7))]))
    other = n.select("recording_id", "lyric", "onset", late.alias("p")).select("recording_id", "lyric", (F.col("onset") + F.col("p.late")).alias("at"), "p.pass")
    hit = I.interval_join(other, base, ["recording_id", "lyric"], "at", "a", "b", 2.0).where(F.abs(F.col("at") - F.col("onset")) < 0.6)
    return hit.groupBy("frame_id").agg(F.count_distinct("pass").alias("support"))


@query(duck("secnotes", more={"v": "SELECT recording_id, (line % 4)::INT AS pos, section, midi % 12 AS pc, frame_id FROM secnotes", "c": "SELECT recording_id, pos, pc, count(*) AS n FROM v GROUP BY ALL", "own": "SELECT recording_id, pos, section, pc, count(*) AS n FROM v GROUP BY ALL", "sec": "SELECT DISTINCT recording_id, pos, section FROM v",
    "x": "SELECT s.recording_id, s.pos, s.section, c.pc, c.n - coalesce(o.n, 0) AS n FROM sec s JOIN c USING (recording_id, pos) LEFT JOIN own o ON o.recording_id = s.recording_id AND o.pos = s.pos AND o.section = s.section AND o.pc = c.pc", "b": "SELECT *, sum(n) OVER (PARTITION BY recording_id, pos, section) AS total, row_number() OVER (PARTITION BY recording_id, pos, section ORDER BY n DESC, pc) AS k FROM x"},
    body="SELECT recording_id, pos, section, pc::INT AS pc FROM b WHERE k = 1 AND n >= 2 AND n >= 0.2::DOUBLE * total"))
def j13_a15_sister_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The pitch class other sections sing at a line position: all votes counted once, a section's own subtracted."""
    n = T.with_section(T.notes(spark, sf)).select("recording_id", (F.col("line") % 4).alias("pos"), "section", F.pmod("midi", F.lit(12)).alias("pc"))
    return Q.expected_by_sisters(n, ["recording_id", "pos"], "section", "pc", least=2, share=0.2)


@query(duck("chart_old", "chart_new", body="""SELECT coalesce(o.frame_id, n.frame_id) AS frame_id, CASE WHEN o.frame_id IS NULL THEN 'added' WHEN n.frame_id IS NULL THEN 'removed' ELSE 'changed' END AS change, o.midi AS old_midi, n.midi AS new_midi
FROM chart_old o FULL JOIN chart_new n ON o.frame_id = n.frame_id WHERE o.frame_id IS NULL OR n.frame_id IS NULL OR o.midi <> n.midi"""))
def j14_version_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = T.charts(T.notes(spark, sf))
    return Q.diff_versions(old, new, ["frame_id"], ["midi"]).select("frame_id", "change", "old_midi", "new_midi")


@query(duck("chart_old", "chart_new", body="""SELECT coalesce(a.recording_id, b.recording_id) AS recording_id, CASE WHEN a.recording_id IS NULL THEN 'missing' ELSE 'extra' END AS state FROM (SELECT DISTINCT recording_id FROM chart_new WHERE recording_id % 5 <> 0) a
FULL JOIN (SELECT DISTINCT recording_id FROM chart_old WHERE recording_id % 7 <> 0) b ON a.recording_id = b.recording_id WHERE a.recording_id IS NULL OR b.recording_id IS NULL"""))
def j15_set_completeness(spark: SparkSession, sf: str) -> DataFrame:
    old, new = T.charts(T.notes(spark, sf))
    return Q.set_gaps(new.where("recording_id % 5 <> 0"), old.where("recording_id % 7 <> 0"), "recording_id")


@query(duck("frames", more={**SPANS, "g": "SELECT k, (k - 4) * 0.5::DOUBLE AS shift FROM range(9) u(k)", "m": 'SELECT s.recording_id, span, expected, k, median(f.midi) AS med FROM spans s, g JOIN frames f ON f.recording_id = s.recording_id AND f.voiced AND f.t >= s.start + shift AND f.t < s."end" + shift GROUP BY ALL',
    "sc": "SELECT recording_id, k, tr::INT AS tr, count(*) FILTER (WHERE abs(((med - expected - tr + 6) % 12 + 12) % 12 - 6) <= 0.6::DOUBLE) AS hits FROM m, range(-6, 6) u(tr) GROUP BY ALL", "b": "SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY hits DESC, (k = 4 AND tr = 0) DESC, k, tr) AS n FROM sc"},
    body="SELECT recording_id, (k - 4) * 0.5::DOUBLE AS shift, tr AS transpose, hits FROM b WHERE n = 1"))
def j16_t3_best_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Best of nine shifts and all transpositions, as its SQL has it; the documented grid is j16_t3_best_shift_grid.

    Only shifts join; a transposition moves the median by itself.
    """
    every = T.frames(spark, sf)
    f = every.where("voiced").select("recording_id", "t", "midi")
    # spans end with the last frame, voiced or not: a shift brings voiced frames into them
    moved = spans(every).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("a", F.col("start") + (F.col("k") - 4) * 0.5).withColumn("b", F.col("end") + (F.col("k") - 4) * 0.5)
    med = I.interval_join(f, moved, ["recording_id"], "t", "a", "b", 10.0).groupBy("recording_id", "span", "expected", "k").agg(F.median("midi").alias("med"))
    tried = med.withColumn("tr", F.explode(F.sequence(F.lit(-6), F.lit(5))))
    hit = F.abs(S.octave_blind(F.col("med") - F.col("expected") - F.col("tr"))) <= 0.6
    score = tried.groupBy("recording_id", "k", "tr").agg(F.count_if(hit).alias("hits"))
    still = ((F.col("k") == 4) & (F.col("tr") == 0)).cast("int")
    best = score.groupBy("recording_id").agg(F.max(F.struct("hits", still.alias("still"), (-F.col("k")).alias("nk"), (-F.col("tr")).alias("ntr"))).alias("b"))
    return best.select("recording_id", ((-F.col("b.nk") - 4) * 0.5).alias("shift"), (-F.col("b.ntr")).alias("transpose"), F.col("b.hits").alias("hits"))


@query()
def j16_t3_best_shift_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The documented 121 shifts (-3 to 3 s by .05) and 12 transpositions; one voiced frame is enough, as the data's frame rate asks."""
    from melodyspark.operators.grid import best_shift

    f = T.frames(spark, sf).select("recording_id", "t", "midi", "voiced")
    return best_shift(f, spans(f), ["recording_id"], "span", least=1, share=0.0)


_SIG = {"sig": "SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY t, frame_id) AS i, rms, midi FROM frames", "lagged": "SELECT a.recording_id, lag::INT AS lag, a.rms AS x, b.midi AS y FROM sig a, range(-5, 6) u(lag) JOIN sig b ON a.recording_id = b.recording_id AND b.i = a.i - lag", "sc": "SELECT recording_id, lag, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 9) AS c FROM lagged GROUP BY ALL"}


@query(duck("frames", more=_SIG, body=f"SELECT recording_id, lag, {r('c', 4)} AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY c DESC, lag) AS k FROM sc) WHERE k = 1"))
def j17_a16_signal_alignment(spark: SparkSession, sf: str) -> DataFrame:
    sig = T.frames(spark, sf).withColumn("i", F.row_number().over(T.by_time()))
    p = I.lagged_pairs(sig, ["recording_id"], "i", "rms", "midi", 5)
    c = F.round(F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))), 9)
    best = p.groupBy("recording_id", "lag").agg(c.alias("c")).groupBy("recording_id").agg(F.max(F.struct("c", (-F.col("lag")).alias("n"))).alias("b"))
    return best.select("recording_id", (-F.col("b.n")).alias("lag"), S.round_to(F.col("b.c"), 4).alias("correlation"))


@query("SELECT o_orderkey, n_name, p.bpm::INT AS bpm FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT n_nationkey AS k, 80 + n_nationkey * 2 AS bpm FROM nation) p ON p.k = c_nationkey")
def j19_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Tempo and label by lookup; the 25-row table is broadcast by Spark's own size rule."""
    look = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", (80 + F.col("n_nationkey") * 2).cast("int").alias("bpm"))
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(look, "c_nationkey")
    return T.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").select("o_orderkey", "n_name", "bpm")
