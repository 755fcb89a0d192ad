"""Queries of projections and scalar functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.functions import text as X
from melodyspark.jobs.registry import query
from melodyspark.jobs.sql import case_list, duck, r
from melodyspark.sources import tables as T

_PC = "((midi % 12 + 12) % 12)"
_NAME = f"{case_list(S.NOTE_NAMES, _PC)} || (floor(midi / 12.0)::INT - 1)"


@query(duck("frames", body=f"SELECT frame_id, {r('440 * pow(2.0, (midi - 69) / 12)', 4)} AS hz, CASE WHEN voiced THEN {r('12 * log2(440 * pow(2.0, (midi - 69) / 12) / 440.0) + 69', 4)} END AS midi FROM frames"))
def p1_hz_to_midi(spark: SparkSession, sf: str) -> DataFrame:
    hz = S.midi_to_hz(F.col("midi"))
    return T.frames(spark, sf).select("frame_id", S.round_to(hz, 4).alias("hz"), S.round_to(S.hz_to_midi(F.when(F.col("voiced"), hz).otherwise(F.lit(0.0))), 4).alias("midi"))


@query(duck("frames", body=f"SELECT frame_id, {r('1200 * log2((440 * pow(2.0, (midi - 69) / 12)) / (440 * pow(2.0, (round_even(midi, 0) - 69) / 12)))', 3)} AS cents FROM frames"))
def p2_cents(spark: SparkSession, sf: str) -> DataFrame:
    return T.frames(spark, sf).select("frame_id", S.round_to(S.cents(S.midi_to_hz(F.col("midi")), S.midi_to_hz(F.rint("midi"))), 3).alias("cents"))


@query(duck("notes", body=f"SELECT frame_id, {_NAME} AS name, {_PC}::INT AS pc FROM notes"))
def p3_note_names(spark: SparkSession, sf: str) -> DataFrame:
    return T.notes(spark, sf).select("frame_id", S.note_name(F.col("midi")).alias("name"), S.pitch_class(F.col("midi")).alias("pc"))


_SNAP = """(SELECT c.pc FROM (SELECT (tonic + s) % 12 AS pc, i FROM (VALUES (0,0),(2,1),(4,2),(5,3),(7,4),(9,5),(11,6)) v(s, i)) c
  ORDER BY least(abs(c.pc - m % 12), 12 - abs(c.pc - m % 12)), c.i LIMIT 1)"""


@query(duck("frames", more={"x": "SELECT frame_id, (recording_id % 12)::INT AS tonic, round_even(midi, 0)::INT AS m FROM frames", "y": f"SELECT *, m - m % 12 + {_SNAP} AS c FROM x", "z": "SELECT frame_id, tonic, CASE WHEN abs(c - m) > 6 THEN CASE WHEN c < m THEN c + 12 ELSE c - 12 END ELSE c END AS s FROM y"},
    body=f"SELECT frame_id, s::INT AS snapped, d::INT AS degree, {case_list(S.DEGREE_NAMES, 'd')} AS name, {case_list(S.DEGREE_RATIOS, 'd')} AS ratio FROM (SELECT *, list_position([0,2,4,5,7,9,11], (s - tonic) % 12) - 1 AS d FROM z)"))
def p4_p5_snap_and_degree(spark: SparkSession, sf: str) -> DataFrame:
    tonic = (F.col("recording_id") % 12).cast("int")
    out = T.frames(spark, sf).select("frame_id", tonic.alias("tonic"), S.snap_to_scale(F.col("midi"), tonic).alias("snapped"))
    d = S.scale_degree(F.col("snapped"), F.col("tonic"))
    return out.select("frame_id", "snapped", d.alias("degree"), S.degree_name(d).alias("name"), S.degree_ratio(d).alias("ratio"))


_LANE = "CASE " + " ".join(f"WHEN l <= {b} THEN {x}::DOUBLE + (l - {a}) / {float(b - a)}::DOUBLE * ({y}::DOUBLE - {x}::DOUBLE)" for a, b, x, y in zip(S.MAJOR_STEPS, [*S.MAJOR_STEPS[1:], 12], S.DEGREE_RATIOS, [*S.DEGREE_RATIOS[1:], 1.0], strict=True)) + " END"


@query(duck("notes", body=f"SELECT frame_id, {r(f'o + {_LANE}', 4)} AS lane FROM (SELECT frame_id, floor((midi - 60) / 12.0) AS o, (midi - 60) - floor((midi - 60) / 12.0) * 12 AS l FROM notes)"))
def p6_lane(spark: SparkSession, sf: str) -> DataFrame:
    return T.notes(spark, sf).select("frame_id", S.round_to(S.lane(F.col("midi") - F.lit(60)), 4).alias("lane"))


@query(duck("notes", body="SELECT frame_id, (CASE WHEN u > 69 THEN u - 12 * ceil((u - 69) / 12.0) ELSE u END)::INT AS folded FROM (SELECT frame_id, CASE WHEN midi < 58 THEN midi + 12 * ceil((58 - midi) / 12.0) ELSE midi END AS u FROM notes)"))
def p7_fold_register(spark: SparkSession, sf: str) -> DataFrame:
    return T.notes(spark, sf).select("frame_id", S.fold_register(F.col("midi"), F.lit(58), F.lit(69)).alias("folded"))


@query(duck("notes", body=f"SELECT frame_id, {r('(((median - 60 + 6) % 12) + 12) % 12 - 6', 4)} AS error, (midi - 60) % 12 = 0 AS same_class FROM notes"))
def p8_octave_blind_error(spark: SparkSession, sf: str) -> DataFrame:
    return T.notes(spark, sf).select("frame_id", S.round_to(S.octave_blind(F.col("median") - 60), 4).alias("error"), S.same_pitch_class(F.col("midi"), F.lit(60)).alias("same_class"))


@query(duck("score", more={"b": "SELECT *, (sum(dur) OVER (PARTITION BY song ORDER BY seq) - dur)::BIGINT AS beat FROM score"},
    body=f"SELECT o_orderkey, beat, {r('4 + beat * 60.0::DOUBLE / (90 + song % 4 * 10)', 3)} AS start, (midi + song % 5)::INT AS midi, (beat // 12)::INT AS phrase FROM b WHERE beat < 32"))
def p9_w16_tempo_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Running beat clock, seconds with lead-in, transposition, phrase bucket, first 32 beats."""
    before = Window.partitionBy("song").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = T.score_events(spark, sf).withColumn("beat", F.coalesce(F.sum("dur").over(before), F.lit(0)).cast("long")).where("beat < 32")
    bpm = (90 + F.col("song") % 4 * 10).cast("double")
    return e.select("o_orderkey", "beat", S.round_to(S.beats_to_seconds(F.col("beat"), bpm, F.lit(4)), 3).alias("start"), (F.col("midi") + F.col("song") % 5).cast("int").alias("midi"), F.floor(F.col("beat") / 12).cast("int").alias("phrase"))


@query(duck("words", body=r"SELECT recording_id, pos, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS key, regexp_matches(word, '[\x{3400}-\x{9fff}]') AS han, lower(regexp_replace(word, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS plain FROM words"))
def p10_text_keys(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("word")
    return T.words(spark, sf).select("recording_id", "pos", X.latin_key(w).alias("key"), X.is_han(w).alias("han"), X.plain(w).alias("plain"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no FROM documents),
t AS (SELECT doc_id, line_no, regexp_extract_all(line, '[\x{3400}-\x{9fff}]|[A-Za-z][A-Za-z''\x{2019}\-]*') AS w FROM l)
SELECT doc_id, line_no, (i - 1)::INT AS token_no, w[i] AS token, i = 1 AS line_start FROM t, unnest(range(1, len(w) + 1)) AS u(i)""")
def p11_lyric_tokens(spark: SparkSession, sf: str) -> DataFrame:
    lines = T.table(spark, sf, "documents").select("doc_id", F.posexplode(T.rows_of("text")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.posexplode(X.tokens(F.col("line"))).alias("token_no", "token")).withColumn("line_start", F.col("token_no") == 0)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no FROM documents),
t AS (SELECT doc_id, line_no, regexp_extract_all(line, '[\x{3400}-\x{9fff}]|[A-Za-z][A-Za-z''\x{2019}\-]*') AS w FROM l)
SELECT doc_id, line_no, (i - 1)::INT AS token_no, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) - 1)::INT AS unit_no, w[i] AS token FROM t, unnest(range(1, len(w) + 1)) AS u(i)""")
def p11_lyric_units_from_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Units of all lines, numbered through each song, by the table function ``lyric_units`` called from SQL."""
    from melodyspark.functions import tablefunctions as U

    U.register(spark)
    T.table(spark, sf, "documents").select(F.col("doc_id").alias("song"), F.posexplode(T.rows_of("text")).alias("line_no", "line")).createOrReplaceTempView("lyric_lines_of_documents")
    return spark.sql("SELECT song AS doc_id, line_no, token_no, unit_no, token FROM lyric_units(TABLE(lyric_lines_of_documents) PARTITION BY song ORDER BY line_no)")


_SKEL = "regexp_replace(translate(lower(word), 'bdgvzcq', 'ptkfskk'), '[aeiouh]', '', 'g')"


@query()
def p12_p13_syllables(spark: SparkSession, sf: str) -> DataFrame:
    """English and Malay syllables of every Latin word."""
    w = T.words(spark, sf).where("word rlike '[A-Za-z]'")
    return w.select("recording_id", "pos", X.both_syllables(F.col("word")).alias("s")).select("recording_id", "pos", "s.english", "s.malay")


@query(duck("words", body=f"SELECT recording_id, pos, list_reduce(list_prepend('', string_split({_SKEL}, '')), lambda a, c: CASE WHEN right(a, 1) = c THEN a ELSE a || c END) AS skeleton FROM words"))
def p14_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return T.words(spark, sf).select("recording_id", "pos", X.skeleton(F.col("word")).alias("skeleton"))


@query(duck("words", more={"n": f"""SELECT recording_id, pos, word, lead(word) OVER (PARTITION BY recording_id ORDER BY pos) AS nxt FROM words""", "k": "SELECT recording_id, pos, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(nxt), '[^a-z0-9]', '', 'g') AS b FROM n WHERE nxt IS NOT NULL",
    "v": "SELECT *, translate(a, 'bdgvzcq', 'ptkfskk') AS va, translate(b, 'bdgvzcq', 'ptkfskk') AS vb FROM k",
    "s": "SELECT *, list_reduce(list_prepend('', string_split(regexp_replace(va, '[aeiouh]', '', 'g'), '')), lambda x, c: CASE WHEN right(x, 1) = c THEN x ELSE x || c END) AS ka, list_reduce(list_prepend('', string_split(regexp_replace(vb, '[aeiouh]', '', 'g'), '')), lambda x, c: CASE WHEN right(x, 1) = c THEN x ELSE x || c END) AS kb FROM v"},
    body="""SELECT recording_id, pos, CASE WHEN a = b THEN 'exact' WHEN a <> '' AND b <> '' AND (va = vb OR (ka = kb AND (ka <> '' OR substr(regexp_replace(a, '^h+', ''), 1, 1) = substr(regexp_replace(b, '^h+', ''), 1, 1)))) THEN 'homophone' ELSE 'different' END AS relation FROM s"""))
def p15_word_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Exact, same sound or different, for each word and the next; the whole rule is p15_spelling_relation."""
    a, b = F.col("a"), F.col("b")
    return _word_pairs(spark, sf).select("recording_id", "pos", F.when(a == b, "exact").when(X.same_sound(a, b), "homophone").otherwise("different").alias("relation"))


def _word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of each word and the next as a and b; nothing else rides through the window's sort."""
    w = T.words(spark, sf).select("recording_id", "pos", X.latin_key(F.col("word")).alias("a"))
    return w.withColumn("b", F.lead("a").over(Window.partitionBy("recording_id").orderBy("pos"))).where("b is not null")


@query()
def p15_spelling_relation(spark: SparkSession, sf: str) -> DataFrame:
    """As p15_word_relation, and spellings alike to .8 count as one sound; the ratio is worked out once for each pair of words."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    n = _word_pairs(spark, sf).withColumn("same", X.same_sound(F.col("a"), F.col("b")))
    unsure = (F.col("a") != F.col("b")) & ~F.col("same") & (F.greatest(F.length("a"), F.length("b")) >= 4) & (F.col("a") != "") & (F.col("b") != "")
    # twice what both hold of each letter bounds the ratio by length alone
    unsure = unsure & (2 * F.least(F.length("a"), F.length("b")) >= 0.8 * (F.length("a") + F.length("b")))
    alike = n.where(unsure).select("a", "b").distinct().withColumn("r", ratio("a", "b")).where("r >= 0.8").select("a", "b", F.lit(True).alias("alike"))
    found = n.join(alike, ["a", "b"], "left")
    return found.select("recording_id", "pos", F.when(F.col("a") == F.col("b"), "exact").when(F.col("same") | F.col("alike"), "homophone").otherwise("different").alias("relation"))


@query()
def p16_spread_syllables(spark: SparkSession, sf: str) -> DataFrame:
    """A word's time spread evenly over its English syllables."""
    # a word with a letter has a syllable, so the outer form adds no row; from the inner one Spark infers a filter that cuts every word again
    w = T.words(spark, sf).where("word rlike '[A-Za-z]'").withColumn("parts", X.english_syllables(F.col("word")))
    w = w.select("recording_id", "pos", "start", "end", F.size("parts").alias("k"), F.posexplode_outer("parts").alias("q", "syllable"))
    at = lambda q: S.round_to(F.col("start") + (F.col("end") - F.col("start")) / F.col("k") * q, 4)
    return w.select("recording_id", "pos", "q", "syllable", at(F.col("q")).alias("start"), at(F.col("q") + 1).alias("end"))


@query(duck("words", more={"f": "SELECT *, coalesce(NOT regexp_matches(lower(lag(word) OVER w), '[aeiouy]') AND regexp_matches(lag(word) OVER w, '^[A-Za-z]') AND regexp_matches(word, '^[A-Za-z]') AND lag(\"end\") OVER w >= start - 0.12::DOUBLE, false) AS glue FROM words WINDOW w AS (PARTITION BY recording_id ORDER BY pos)", "g": "SELECT *, sum(CASE WHEN glue THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY pos) AS grp FROM f"},
    body="""SELECT recording_id, min(pos) AS pos, string_agg(word, '' ORDER BY pos) AS word, count(*) AS pieces FROM g GROUP BY recording_id, grp"""))
def p17_rejoin_touching(spark: SparkSession, sf: str) -> DataFrame:
    """Latin pieces joined to the piece before that has no vowel and touches; a tenth of a second counts as touching here."""
    glued = X.rejoin(T.words(spark, sf), ["recording_id"], "pos", touch=0.12)
    return glued.select("recording_id", "pos", "word", "pieces")


@query(duck("words", more={"c": "SELECT *, greatest(1, length(word) // 3)::INT AS k FROM words"}, body=f"""SELECT recording_id, pos, (q)::INT AS q, {r('start + ("end" - start) / k * q', 4)} AS start, {r('start + ("end" - start) / k * (q + 1)', 4)} AS "end" FROM c, unnest(range(0, k)) AS u(q)"""))
def p16_spread_word_time(spark: SparkSession, sf: str) -> DataFrame:
    k = F.greatest(F.lit(1), F.floor(F.length("word") / 3)).cast("int")
    w = T.words(spark, sf).withColumn("k", k).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    at = lambda q: S.round_to(F.col("start") + (F.col("end") - F.col("start")) / F.col("k") * q, 4)
    return w.select("recording_id", "pos", "q", at(F.col("q")).alias("start"), at(F.col("q") + 1).alias("end"))


@query(duck("words", more={"f": "SELECT *, coalesce(NOT regexp_matches(lower(lag(word) OVER w), '[aeiouyéèêóíñüäö]'), false) AS glue FROM words WINDOW w AS (PARTITION BY recording_id ORDER BY pos)", "g": "SELECT *, sum(CASE WHEN glue THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY pos) AS grp FROM f"},
    body="""SELECT recording_id, min(pos) AS pos, string_agg(word, '' ORDER BY pos) AS word, count(*) AS pieces FROM g GROUP BY recording_id, grp"""))
def p17_rejoin_fragments(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("pos")
    vowels = "[aeiouyéèêóíñüäö]"
    glue = F.coalesce(~F.lower(F.lag("word").over(w)).rlike(vowels), F.lit(False))
    g = T.words(spark, sf).withColumn("glue", glue).withColumn("grp", F.sum(F.when(F.col("glue"), 0).otherwise(1)).over(w))
    parts = g.groupBy("recording_id", "grp").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("p"))
    return parts.select("recording_id", "pos", F.array_join(F.transform("p", lambda x: x["word"]), "").alias("word"), F.size("p").cast("long").alias("pieces"))


@query(duck("words", body="""SELECT recording_id, segment, string_agg(word || CASE WHEN pos % 12 = 11 OR (pos % 3 <> 0) THEN '' ELSE ' ' END, '' ORDER BY pos) || CASE WHEN max(pos) % 3 <> 0 THEN '-' ELSE '' END AS text FROM words GROUP BY recording_id, segment"""))
def p18_display_text(spark: SparkSession, sf: str) -> DataFrame:
    """Units joined to what a note shows: a space after a finished word, a hyphen after an unfinished last one."""
    u = F.struct("pos", "word", (F.col("pos") % 3 == 0).alias("word_end"), (F.col("pos") % 12 == 11).alias("last"))
    g = T.words(spark, sf).groupBy("recording_id", "segment").agg(F.array_sort(F.collect_list(u)).alias("u"))
    joined = F.array_join(F.transform("u", lambda x: F.concat(x["word"], F.when(x["last"] | ~x["word_end"], "").otherwise(" "))), "")
    return g.select("recording_id", "segment", F.concat(joined, F.when(~F.element_at("u", -1)["word_end"], "-").otherwise("")).alias("text"))


@query(duck("secnotes", body="""SELECT frame_id, id || CASE WHEN row_number() OVER (PARTITION BY id ORDER BY frame_id) > 1 THEN 'b' ELSE '' END AS id FROM (SELECT frame_id, format('{}-{}-{:05d}', recording_id, section, round_even(onset * 10, 0)::BIGINT * 10) AS id FROM secnotes)"""))
def p19_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = T.with_section(T.notes(spark, sf)).select("frame_id", S.centisecond_id(F.col("recording_id"), F.col("section"), F.rint(F.col("onset") * 10) / 10).alias("id"))
    again = F.row_number().over(Window.partitionBy("id").orderBy("frame_id")) > 1
    return n.select("frame_id", F.concat("id", F.when(again, "b").otherwise("")).alias("id"))


@query(duck("words", body="SELECT recording_id, count(*) FILTER (WHERE v) AS vocables, count(*) FILTER (WHERE NOT v) AS lyric_words FROM (SELECT recording_id, regexp_matches(word, '(?i)^(o+h*|u+h*|a+h*|la+|da+|do+|du+|na+|m+|hm+|mm+|哦|啊|啦|呀|嗯|哼|喔|噢|呜)$') AS v FROM words) GROUP BY recording_id"))
def p20_vocables(spark: SparkSession, sf: str) -> DataFrame:
    v = X.is_vocable(F.col("word"))
    return T.words(spark, sf).groupBy("recording_id").agg(F.count_if(v).alias("vocables"), F.count_if(~v).alias("lyric_words"))


@query(duck("notes", body="SELECT frame_id, (floor(onset)::INT // 60) || ':' || lpad((floor(onset)::INT % 60)::VARCHAR, 2, '0') AS clock FROM notes"))
def p21_clock(spark: SparkSession, sf: str) -> DataFrame:
    return T.notes(spark, sf).select("frame_id", S.clock(F.col("onset")).alias("clock"))


@query(duck("notes", more={"m": "SELECT recording_id, min(midi) AS lo, max(midi) AS hi FROM notes GROUP BY 1", "v": "SELECT * FROM (VALUES ('low', 43, 64), ('middle', 50, 72), ('high', 55, 84)) x(voice, vlo, vhi)"},
    body="SELECT recording_id, voice, hi - lo <= vhi - vlo AS fits, CASE WHEN hi - lo <= vhi - vlo THEN CASE WHEN lo < vlo THEN vlo - lo WHEN hi > vhi THEN vhi - hi ELSE 0 END END::INT AS shift FROM m, v"))
def p22_voice_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest transposition that puts a melody inside a voice's range; null where it cannot fit."""
    m = T.notes(spark, sf).groupBy("recording_id").agg(F.min("midi").alias("lo"), F.max("midi").alias("hi"))
    voices = F.explode(F.array(*[F.struct(F.lit(n).alias("voice"), F.lit(a).alias("vlo"), F.lit(b).alias("vhi")) for n, a, b in (("low", 43, 64), ("middle", 50, 72), ("high", 55, 84))]))
    x = m.select("recording_id", "lo", "hi", voices.alias("v")).select("recording_id", "lo", "hi", "v.*")
    fits = F.col("hi") - F.col("lo") <= F.col("vhi") - F.col("vlo")
    shift = F.when(F.col("lo") < F.col("vlo"), F.col("vlo") - F.col("lo")).when(F.col("hi") > F.col("vhi"), F.col("vhi") - F.col("hi")).otherwise(0)
    return x.select("recording_id", "voice", fits.alias("fits"), F.when(fits, shift).alias("shift"))


@query("SELECT p_type AS category, count(*) AS songs, count(*) FILTER (WHERE p_size <= 25) AS playable FROM part GROUP BY p_type")
def p23_categories(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("songs"), F.count_if(F.col("p_size") <= 25).alias("playable"))
