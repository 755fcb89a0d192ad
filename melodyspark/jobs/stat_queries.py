"""Queries of aggregates over frames, notes, sections and songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.jobs.interval_queries import READ_SQL, SPANS, span_points, spans
from melodyspark.jobs.registry import query
from melodyspark.jobs.scalar_queries import _LANE
from melodyspark.jobs.sql import case_list, duck, r
from melodyspark.operators import audit as U
from melodyspark.operators import quality as Q
from melodyspark.operators import stats as A
from melodyspark.operators import voice as V
from melodyspark.sources import tables as T


@query(duck("notes", more={"h": 'SELECT recording_id, midi % 12 AS pc, sum("end" - onset) AS d FROM notes GROUP BY ALL', "l": "SELECT recording_id, arg_max(midi % 12, {'o': onset, 'f': frame_id}) AS last FROM notes GROUP BY 1", "ids": "SELECT DISTINCT recording_id FROM notes",
    "s": f"SELECT i.recording_id, tonic, round(coalesce(corr(coalesce(d, 0), {case_list(A.MAJOR_PROFILE, '(p.pc - tonic + 12) % 12')}), 0) + CASE WHEN any_value(last) = tonic THEN 0.25::DOUBLE ELSE 0 END, 9) AS score FROM ids i, range(12) t(tonic), range(12) p(pc) LEFT JOIN h ON h.recording_id = i.recording_id AND h.pc = p.pc JOIN l ON l.recording_id = i.recording_id GROUP BY i.recording_id, tonic"},
    body="SELECT recording_id, tonic::INT AS tonic FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, tonic) AS k FROM s) WHERE k = 1"))
def a2_key_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    return A.key_by_profile(T.notes(spark, sf), "recording_id")


@query(duck("frames", body=f"SELECT recording_id, {r('atan2(avg(sin(2 * pi() * midi)), avg(cos(2 * pi() * midi))) / (2 * pi())', 4)} AS tuning FROM frames WHERE voiced GROUP BY 1"))
def a5_tuning_offset(spark: SparkSession, sf: str) -> DataFrame:
    return A.tuning_offset(T.frames(spark, sf)).select("recording_id", S.round_to(F.col("offset"), 4).alias("tuning"))


@query(duck("frames", body="SELECT frame_id, rms > greatest(0.01::DOUBLE, 0.12::DOUBLE * p) AND midi > 45 AND midi < 88 AS loud FROM (SELECT *, quantile_cont(rms, 0.95) OVER (PARTITION BY recording_id) AS p FROM frames)"))
def a6_loudness_gate(spark: SparkSession, sf: str) -> DataFrame:
    return A.gate_by_percentile(T.frames(spark, sf), "recording_id", 0.12, 0.01, 45, 88).select("frame_id", "loud")


@query(duck("frames", more={**SPANS, "m": 'SELECT s.recording_id, span, expected, count(f.t) AS n, count(*) FILTER (WHERE f.voiced) AS v, median(CASE WHEN f.voiced THEN f.midi END) AS med FROM spans s LEFT JOIN frames f ON f.recording_id = s.recording_id AND f.t >= s.start AND f.t < s."end" GROUP BY ALL',
    "d": "SELECT recording_id, CASE WHEN n = 0 OR v < 0.3::DOUBLE * n OR v < 3 THEN NULL ELSE med - expected END AS d FROM m"},
    body=f"SELECT recording_id, count(*) AS notes, count(*) FILTER (WHERE abs(d) <= 0.6::DOUBLE) AS exact, count(*) FILTER (WHERE abs(((d + 6) % 12 + 12) % 12 - 6) <= 0.6::DOUBLE) AS octave, count(*) FILTER (WHERE d IS NULL) AS silent, {r('median(abs(((d + 6) % 12 + 12) % 12 - 6))', 4)} AS med_err FROM d GROUP BY 1"))
def a7_chart_score(spark: SparkSession, sf: str) -> DataFrame:
    """Right, right but for the octave, and unsung spans of each chart. Three voiced frames are enough here."""
    f = T.frames(spark, sf)
    found = V.chart_match(f, spans(f), ["recording_id"], "span", least=3)
    return found.withColumn("med_err", S.round_to(F.col("med_err"), 4))


_FIELDS = "(5 + frame_id % 9)::INT AS frames, 0.6::DOUBLE + (frame_id % 10) / 20.0::DOUBLE AS coverage, 0.7::DOUBLE + (frame_id % 7) / 20.0::DOUBLE AS stable, 0.75::DOUBLE + (frame_id % 5) / 20.0::DOUBLE AS support"


def _read_fields(df: DataFrame) -> DataFrame:
    k = F.col("frame_id")
    return df.withColumn("frames", (5 + k % 9).cast("int")).withColumn("coverage", 0.6 + (k % 10) / F.lit(20.0)).withColumn("stable", 0.7 + (k % 7) / F.lit(20.0)).withColumn("support", 0.75 + (k % 5) / F.lit(20.0))


@query(duck("readings", more={"e": "SELECT frame_id, midi + (CASE WHEN frame_id % 4 = 0 THEN 1 WHEN frame_id % 4 = 1 THEN 12 WHEN frame_id % 4 = 2 THEN 5 ELSE 0 END) AS midi FROM notes", "s": f"SELECT * FROM (SELECT *, {_FIELDS} FROM readings) WHERE coverage >= 0.70::DOUBLE AND stable >= 0.80::DOUBLE AND support >= 0.80::DOUBLE",
    "one": "SELECT frame_id FROM s GROUP BY 1 HAVING count(DISTINCT round_even(median, 0)) = 1", "p": "SELECT a.frame_id, (a.median + b.median) / 2 AS m, row_number() OVER (PARTITION BY a.frame_id ORDER BY a.frames + b.frames DESC, a.reader, b.reader) AS k FROM s a JOIN s b ON a.frame_id = b.frame_id AND a.reader < b.reader AND abs(a.median - b.median) <= 0.25::DOUBLE JOIN one ON one.frame_id = a.frame_id",
    "n": "SELECT p.frame_id, e.midi AS old, round_even(m, 0)::INT AS new FROM p JOIN e ON e.frame_id = p.frame_id WHERE k = 1"},
    body="SELECT frame_id, old, new FROM n WHERE new <> old AND new BETWEEN 45 AND 84 AND (abs(new - old) <= 2 OR abs(new - old) = 12)"))
def a8_reader_consensus(spark: SparkSession, sf: str) -> DataFrame:
    n = T.notes(spark, sf)
    k = F.col("frame_id") % 4
    events = n.select("frame_id", (F.col("midi") + F.when(k == 0, 1).when(k == 1, 12).when(k == 2, 5).otherwise(0)).alias("midi"))
    return Q.consensus(events, _read_fields(T.readings(n)), "frame_id")


_FLAG = """CASE WHEN y IS NULL OR frame_id % 9 < 2 THEN 'weak-independent-voicing' WHEN abs(y - midi) > 0.65::DOUBLE THEN CASE WHEN round_even((y - midi) / 12, 0) <> 0 AND abs(y - midi - round_even((y - midi) / 12, 0) * 12) <= 0.65::DOUBLE AND abs(w - midi - round_even((y - midi) / 12, 0) * 12) <= 0.65::DOUBLE THEN 'octave-fold-suspect'
    WHEN (frame_id % 10) / 10.0::DOUBLE >= 0.6::DOUBLE THEN 'estimators-disagree' ELSE 'unstable-pitch' END END"""


@query(duck("readings", more={"p": "SELECT n.frame_id, n.midi, n.lyric, max(CASE WHEN reader = 'c' THEN r.median + (n.frame_id % 3) * 0.4::DOUBLE END) AS y, max(CASE WHEN reader = CASE WHEN n.frame_id % 2 = 0 THEN 'c' ELSE 'b' END THEN r.median END) AS w FROM notes n JOIN readings r ON r.frame_id = n.frame_id GROUP BY ALL"}, body=f"SELECT frame_id, array_to_string(list_filter([{_FLAG}, CASE WHEN lyric = '' THEN 'no-lyric' END], lambda x: x IS NOT NULL), ',') AS flags FROM p"))
def a9_second_opinion(spark: SparkSession, sf: str) -> DataFrame:
    n = T.notes(spark, sf)
    k = F.col("frame_id")
    rd = T.readings(n).groupBy("frame_id").agg(*[F.max(F.when(F.col("reader") == x, F.col("median"))).alias(f"m{x}") for x in "bc"])
    p = n.select("frame_id", "midi", "lyric").join(rd, "frame_id")
    flag = Q.pitch_flag(F.col("midi"), F.col("mc") + (k % 3) * 0.4, F.when(k % 9 < 2, 3).otherwise(9), (k % 10) / F.lit(10.0), F.when(k % 2 == 0, F.col("mc")).otherwise(F.col("mb")))
    return p.select("frame_id", F.array_join(F.array_compact(F.array(flag, F.when(F.col("lyric") == "", "no-lyric"))), ",").alias("flags"))


@query(duck("frames", more=READ_SQL, body=f"""SELECT recording_id, span, frames, {r('coverage', 3)} AS voiced_fraction, {r('agreement', 3)} AS agreement, CASE WHEN frames < 4 OR coverage < 0.45::DOUBLE THEN 'insufficient-independent-voice' WHEN agreement < 0.65::DOUBLE THEN 'independent-pitch-disagreement' END AS flag,
CASE WHEN NOT (frames < 4 OR coverage < 0.45::DOUBLE) AND agreement < 0.65::DOUBLE AND support >= 0.3::DOUBLE THEN round_even(median, 0)::INT END AS candidate FROM reads WHERE frames < 4 OR coverage < 0.45::DOUBLE OR agreement < 0.65::DOUBLE"""))
def a10_review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Notes to review, with a candidate where the voice is steady: three frames in ten are enough here."""
    pts = span_points(spark, sf)
    agree = pts.groupBy("recording_id", "span").agg(F.avg(F.when(F.col("voiced"), (F.abs(F.col("midi") - F.col("expected")) <= 0.65).cast("int"))).alias("agreement"))
    x = A.reading(pts, ["recording_id", "span"]).join(agree, ["recording_id", "span"])
    flag = U.review_flag(F.col("frames"), F.col("coverage"), F.col("agreement"))
    cand = U.candidate_pitch(flag, F.col("median"), F.col("support"), sure=0.3)
    return x.select("recording_id", "span", "frames", S.round_to(F.col("coverage"), 3).alias("voiced_fraction"), S.round_to(F.col("agreement"), 3).alias("agreement"), flag.alias("flag"), cand.alias("candidate")).where("flag is not null")


@query(duck("secnotes", more={"j": 'SELECT *, CASE WHEN lead(onset) OVER w - "end" < 0.3::DOUBLE THEN abs(lead(midi) OVER w - midi) END AS step FROM secnotes WINDOW w AS (PARTITION BY recording_id, section ORDER BY onset, frame_id)',
    "q": "SELECT recording_id, section, avg((frame_id % 5 = 0)::INT) AS fl, coalesce(median(step), 0) AS med, count(*) FILTER (WHERE step >= 9) / greatest(1, count(step))::DOUBLE AS leap, avg((lyric <> '')::INT) AS lab FROM j GROUP BY ALL"},
    body=f"SELECT recording_id, section, {r('fl', 2)} AS flagged, med::DOUBLE AS median_step, {r('leap', 2)} AS leaps, {r('lab', 2)} AS labelled, CASE WHEN {r('fl', 2)} >= 0.35::DOUBLE OR {r('leap', 2)} >= 0.15::DOUBLE THEN 'pitch-unreliable' WHEN {r('lab', 2)} < 0.6::DOUBLE THEN 'lyrics-sparse' END AS quality FROM q"))
def a11_section_quality(spark: SparkSession, sf: str) -> DataFrame:
    return U.section_quality(T.with_section(T.notes(spark, sf)), ["recording_id", "section"], ["onset", "frame_id"], F.col("frame_id") % 5 == 0)


_STATUS = "CASE frame_id % 4 WHEN 0 THEN 'heard' WHEN 1 THEN 'heard+extra-sung' WHEN 2 THEN 'interpolated' ELSE 'not-heard' END"


def _status() -> F.Column:
    k = F.col("frame_id") % 4
    return F.when(k == 0, "heard").when(k == 1, "heard+extra-sung").when(k == 2, "interpolated").otherwise("not-heard")


@query(duck("secnotes", more={"s": f"SELECT recording_id, section, unnest(string_split({_STATUS}, '+')) AS s FROM secnotes"}, body="SELECT recording_id, section, count(*) FILTER (WHERE s = 'heard') AS heard, count(*) FILTER (WHERE s = 'extra-sung') AS extra_sung, count(*) FILTER (WHERE s = 'interpolated') AS interpolated, count(*) FILTER (WHERE s = 'heard') < greatest(3, 0.3::DOUBLE * count(*)) AS absent FROM s GROUP BY ALL"))
def a12_a14_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of a section's words, where one word can have two; a verse with few heard words is absent."""
    n = T.with_section(T.notes(spark, sf)).withColumn("status", _status())
    return U.status_counts(n, ["recording_id", "section"], "status", ["heard", "extra-sung", "interpolated"])


@query(duck("secnotes", body="SELECT recording_id, section, count(*) AS notes, count(*) FILTER (WHERE lyric = '') AS unlabelled FROM secnotes GROUP BY ROLLUP (recording_id, section)"))
def a13_catalogue_totals(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_section(T.notes(spark, sf)).rollup("recording_id", "section").agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("lyric") == "").alias("unlabelled"))


@query(duck("frames", more={"m": "SELECT recording_id, sum(rms * rms) aa, sum(rms * t) ab, sum(t * t) bb, sum(rms * midi) ay, sum(t * midi) byy, sum(midi * midi) yy FROM frames GROUP BY 1", "g": "SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS ga, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS gb FROM m WHERE abs(aa * bb - ab * ab) > 1e-9"},
    body=f"SELECT recording_id, {r('ga', 3)} AS gain_a, {r('gb', 3)} AS gain_b, {r('sqrt(greatest(yy - ga * ay - gb * byy, 0) / yy)', 3)} AS residual FROM g"))
def a17_two_source_gains(spark: SparkSession, sf: str) -> DataFrame:
    g = A.two_gains(T.frames(spark, sf), ["recording_id"], "midi", "rms", "t")
    return g.select("recording_id", *[S.round_to(F.col(a), 3).alias(b) for a, b in (("ga", "gain_a"), ("gb", "gain_b"), ("residual", "residual"))])


@query(duck("notes", more={"x": """SELECT *, onset < lag("end") OVER w AS over_prev, count(*) OVER (PARTITION BY recording_id, midi, floor(onset)) > 1 AS dup FROM notes WINDOW w AS (PARTITION BY recording_id ORDER BY onset, frame_id)"""},
    body="""SELECT frame_id, unnest(list_filter([CASE WHEN "end" - onset < 0.3::DOUBLE THEN 'short' END, CASE WHEN midi < 48 OR midi > 84 THEN 'range' END, CASE WHEN over_prev THEN 'overlap' END, CASE WHEN dup THEN 'duplicate' END, CASE WHEN isnan(median) OR isinf(median) THEN 'finite' END], lambda x: x IS NOT NULL)) AS rule FROM x"""))
def a18_rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    n = T.notes(spark, sf)
    w = Window.partitionBy("recording_id").orderBy("onset", "frame_id")
    x = n.withColumn("_over", F.col("onset") < F.lag("end").over(w)).withColumn("_dup", F.count(F.lit(1)).over(Window.partitionBy("recording_id", "midi", F.floor("onset"))) > 1)
    return Q.violations(x, "frame_id", {"short": F.col("end") - F.col("onset") < 0.3, "range": ~F.col("midi").between(48, 84), "overlap": F.col("_over"), "duplicate": F.col("_dup"), "finite": F.isnan("median")})


_LANES = _LANE.replace("WHEN l ", "WHEN {0} ").replace("(l -", "({0} -")


def _lane_sql(x: str) -> str:
    local = f"(({x}) - floor(({x}) / 12.0) * 12)"
    return f"(floor(({x}) / 12.0) + {_LANES.format(local)})"


@query(duck("notes", more={"m": "SELECT recording_id, min(midi) AS lo, max(midi) AS hi FROM notes GROUP BY 1", "w": f"SELECT *, {_lane_sql('lo - 60')} AS w0, {_lane_sql('hi - 60')} AS w1 FROM m"}, body=f"SELECT recording_id, (hi - lo)::INT AS semitones, {r('w0 - greatest(0, 1 - (w1 - w0)) / 2', 3)} AS low, {r('w1 + greatest(0, 1 - (w1 - w0)) / 2', 3)} AS high FROM w"))
def a19_lane_window(spark: SparkSession, sf: str) -> DataFrame:
    return U.lane_window(T.notes(spark, sf), ["recording_id"]).select("recording_id", "semitones", S.round_to(F.col("low"), 3).alias("low"), S.round_to(F.col("high"), 3).alias("high"))


@query(duck("frames", body="SELECT recording_id, string_agg(event_type, ',' ORDER BY t0, f0) AS kinds FROM (SELECT recording_id, event_type, min(t) AS t0, arg_min(frame_id, t) AS f0 FROM frames GROUP BY ALL) GROUP BY 1"))
def a20_first_seen_order(spark: SparkSession, sf: str) -> DataFrame:
    return U.first_seen(T.frames(spark, sf), ["recording_id"], "event_type", ["t", "frame_id"]).select("recording_id", F.array_join("values", ",").alias("kinds"))


@query(duck("score", more={"p": "SELECT *, seq // 2 AS attack FROM score"}, body="SELECT song, attack, arg_max(o_orderkey, {'m': midi, 'k': o_orderkey}) AS o_orderkey, max(midi) AS midi FROM p GROUP BY ALL"))
def a21_top_line(spark: SparkSession, sf: str) -> DataFrame:
    return U.top_line(T.score_events(spark, sf).withColumn("attack", F.expr("seq div 2")), ["song", "attack"], "o_orderkey")


@query(duck("frames", more={"s": "SELECT event_type, rms, row_number() OVER (PARTITION BY event_type ORDER BY rms) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM frames"}, body="SELECT event_type, max(rms) FILTER (WHERE i = floor(0.5 * n)) AS median, max(rms) FILTER (WHERE i = floor(0.95::DOUBLE * n)) AS p95, max(rms) AS max FROM s GROUP BY 1"))
def a22_index_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles by index: values are counted first, so a group is as many rows as it has different values."""
    c = T.frames(spark, sf).groupBy("event_type", "rms").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("rms")
    c = c.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("event_type")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("all")), F.col("rms")))
    return c.groupBy("event_type").agg(at(0.5).alias("median"), at(0.95).alias("p95"), F.max("rms").alias("max"))


@query(duck("notes", more={"w": "SELECT recording_id, min(t) + 20 AS first_word FROM frames WHERE event_type = 'purchase' GROUP BY 1", "c": "SELECT n.recording_id, first_word, count(*) AS early, min(onset) AS start FROM notes n JOIN w USING (recording_id) WHERE onset < first_word - 0.6::DOUBLE GROUP BY ALL"}, body=f"SELECT recording_id, early, {r('start', 2)} AS start, {r('first_word', 2)} AS \"end\" FROM c WHERE early >= 8"))
def a26_missing_opening(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings sung for eight notes or more before the first transcribed word: the interval to transcribe again."""
    w = T.frames(spark, sf).where("event_type = 'purchase'").select("recording_id", (F.col("t") + 20).alias("start"))
    g = U.missing_openings(T.notes(spark, sf), w, ["recording_id"])
    return g.select("recording_id", "early", S.round_to(F.col("start"), 2).alias("start"), S.round_to(F.col("end"), 2).alias("end"))


@query(duck("frames", more={"p": "SELECT *, max(rms) OVER (PARTITION BY recording_id) AS peak FROM frames", "d": "SELECT recording_id, max(t) - min(t) AS gap FROM (SELECT recording_id, event_type, max(t) AS t FROM frames GROUP BY ALL) GROUP BY 1"}, body=f"SELECT recording_id, {r('max(t) + 0.5', 3)} AS last_audible, first(gap) > 0.2::DOUBLE AS discrepant FROM p JOIN d USING (recording_id) WHERE rms > 0.3::DOUBLE * peak GROUP BY 1"))
def a27_durations(spark: SparkSession, sf: str) -> DataFrame:
    """Last audible moment of a recording (at three tenths of the peak here), and whether its assets end more than .2 s apart."""
    f = T.frames(spark, sf)
    ends = f.groupBy("recording_id", "event_type").agg(F.max("t").alias("length"))
    loud = U.last_audible(f, ["recording_id"], share=0.3).join(U.discrepant_lengths(ends, ["recording_id"]), "recording_id")
    return loud.select("recording_id", S.round_to(F.col("last_audible"), 3).alias("last_audible"), "discrepant")


@query(duck("notes", more={"c": "SELECT recording_id, max(onset) - 10 AS cut, count(*) AS notes, count(*) FILTER (WHERE lyric = '') AS unlabelled, count(*) FILTER (WHERE frame_id % 6 = 0) AS splits, count(*) FILTER (WHERE midi > 80) AS high FROM notes GROUP BY 1"}, body="SELECT c.recording_id, notes, unlabelled, splits, high, count(f.t) AS words_after_cut FROM c LEFT JOIN frames f ON f.recording_id = c.recording_id AND f.t >= cut GROUP BY ALL"))
def a28_song_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = T.frames(spark, sf)
    n = T.notes_of(f)
    cut = n.groupBy("recording_id").agg((F.max("onset") - 10).alias("cut"))
    return U.song_summary(n, f, ["recording_id"], {"unlabelled": F.col("lyric") == "", "splits": F.col("frame_id") % 6 == 0, "high": F.col("midi") > 80}, cut)


@query(duck("notes", more={"g": 'SELECT recording_id, onset - prev AS gap, (prev + onset) / 2 AS mid, floor((prev + onset) / 2 / 30)::INT AS range_no FROM (SELECT *, lag("end") OVER (PARTITION BY recording_id ORDER BY onset, frame_id) AS prev FROM notes) WHERE prev IS NOT NULL'}, body=f"SELECT recording_id, range_no, {r('mid', 4)} AS boundary FROM g QUALIFY row_number() OVER (PARTITION BY recording_id, range_no ORDER BY gap DESC, mid DESC) = 1"))
def t1_widest_silence(spark: SparkSession, sf: str) -> DataFrame:
    """The section boundary in each stretch of 30 s."""
    g = U.widest_silences(T.notes(spark, sf), ["recording_id"], ["onset", "frame_id"], number=F.floor(F.col("mid") / 30).cast("int"))
    return g.withColumn("boundary", S.round_to(F.col("boundary"), 4))


@query(duck("notes", more={"a": "SELECT frame_id, onset, 'sung' AS src FROM notes", "b": "SELECT event_id AS frame_id, NULL::DOUBLE AS onset, 'extra' AS src FROM events WHERE event_type = 'error'"}, body=f"SELECT frame_id, {r('onset', 3)} AS onset, src FROM a UNION ALL SELECT * FROM b"))
def t5_union_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    a = T.notes(spark, sf).select("frame_id", S.round_to(F.col("onset"), 3).alias("onset"), F.lit("sung").alias("src"))
    b = T.table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("frame_id"), F.lit("extra").alias("src"))
    return a.unionByName(b, allowMissingColumns=True)


@query(duck("chart_old", "chart_new", body="(SELECT recording_id, midi FROM chart_new EXCEPT ALL SELECT recording_id, midi FROM chart_old)"))
def t6_except_all(spark: SparkSession, sf: str) -> DataFrame:
    old, new = T.charts(T.notes(spark, sf))
    return new.select("recording_id", "midi").exceptAll(old.select("recording_id", "midi"))
