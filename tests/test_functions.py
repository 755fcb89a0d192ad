"""Small cases of column functions, with the answers worked out by hand."""

import random
import re

from pyspark.sql import functions as F

from melodyspark.functions import scalars as S
from melodyspark.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pitch(spark):
    assert one(spark, S.hz_to_midi(F.lit(440.0))) == 69
    assert one(spark, S.hz_to_midi(F.lit(0.0))) is None
    assert one(spark, S.note_name(F.lit(61))) == "C#4"
    assert one(spark, S.note_name(F.lit(11))) == "B-1"
    assert abs(one(spark, S.cents(F.lit(880.0), F.lit(440.0))) - 1200) < 1e-9


def test_snap_takes_the_first_of_equals(spark):
    # C# lies as near to C as to D: C comes first in C major
    assert one(spark, S.snap_to_scale(F.lit(61.2), F.lit(0))) == 60
    # in D major the scale is counted from D: C natural lies between C# and B
    assert one(spark, S.snap_to_scale(F.lit(60.0), F.lit(2))) == 59
    assert one(spark, S.scale_degree(F.lit(59), F.lit(2))) == 5


def test_fold_register(spark):
    assert [one(spark, S.fold_register(F.lit(m), F.lit(58), F.lit(69))) for m in (46, 57, 58, 69, 70, 82, 95)] == [58, 69, 58, 69, 58, 58, 59]


def test_lane(spark):
    assert [round(one(spark, S.lane(F.lit(x))), 3) for x in (0, 2, 1, 12, -12, 11.5)] == [0, 0.14, 0.07, 1, -1, 0.93]


def test_clock_and_error(spark):
    assert one(spark, S.clock(F.lit(65.9))) == "1:05"
    assert one(spark, S.octave_blind(F.lit(11.7))) - -0.3 < 1e-9


def test_syllables(spark):
    english = {"jumped": "jumped", "happy": "hap|py", "little": "lit|tle", "over": "o|ver", "rainbow": "rain|bow", "make": "make", "together": "to|geth|er", "People": "Peo|ple", "lives": "lives", "where\u2019s": "where's", "'": ""}
    for word, parts in english.items():
        assert "|".join(one(spark, X.english_syllables(F.lit(word)))) == parts
    malay = {"sayang": "sa|yang", "dia": "di|a", "buah": "bu|ah", "ketipung": "ke|ti|pung", "kambing": "kam|bing", "bagai": "ba|gai"}
    for word, parts in malay.items():
        assert "|".join(one(spark, X.malay_syllables(F.lit(word)))) == parts


def test_sounds(spark):
    same = lambda a, b: one(spark, X.same_sound(F.lit(a), F.lit(b)))
    assert same("beep", "peep") and same("dikubas", "dikupas") and same("oi", "hoi")
    assert not same("star", "moon") and not same("", "a")
    assert one(spark, X.tokens(F.lit("小星 twin-kle, it's"))) == ["小", "星", "twin-kle", "it's"]


def plain_english(word):
    """The documented rule: cut after a vowel group, or after the first of several consonants; silent e and -ed end no syllable."""
    core = re.sub("[^A-Za-z'-]", "", word.replace("\u2019", "'"))
    if not re.search("[A-Za-z]", core):
        return []
    out = []
    for part in filter(None, core.split("-")):
        low = part.lower()
        vowels = [m.span() for m in re.finditer("[aeiouy]+", low)]
        if len(vowels) > 1 and vowels[-1] == (len(low) - 1, len(low)) and low[-1] == "e" and low[-2] != "l":
            vowels.pop()
        elif len(vowels) > 1 and low[-2:] == "ed" and low[-3] not in "td" and vowels[-1][1] == len(low) - 1:
            vowels.pop()
        cuts = [0, *[z if b - z <= 1 else z + 1 for (_, z), (b, _) in zip(vowels, vowels[1:])], len(part)]  # noqa: B905, RUF007
        out += [part[a:z] for a, z in zip(cuts, cuts[1:]) if a < z]  # noqa: B905, RUF007
    return out


def plain_malay(word):
    w = re.sub("[^A-Za-z]", "", word)
    units = re.findall("ng|ny|sy|kh|gh|[a-z]", w.lower())
    parts, last = [[]], None
    for k, u in enumerate(units):
        rest = units[k + 1 :]
        vowel, final = u in "aeiou", not rest and last is not None and last + u in ("ai", "au", "oi")
        if vowel and last is not None and not final:
            # a vowel after a vowel parts; one consonant goes with the next vowel, of more the first stays
            head = [x for x in parts[-1]]
            at = max(i for i, x in enumerate(head) if x in "aeiou")
            between = head[at + 1 :]
            keep = at + 1 + (0 if len(between) <= 1 else 1)
            parts[-1:] = [head[:keep], head[keep:]]
        parts[-1].append(u)
        last = u if vowel else (last if last is None else "-")
    sizes = [sum(map(len, p)) for p in parts if p]
    out, at = [], 0
    for n in sizes:
        out.append(w[at : at + n])
        at += n
    return out


def test_syllables_against_plain_rules(spark):
    rnd = random.Random(2)
    bits = ["a", "e", "i", "o", "u", "y", "ed", "le", "b", "c", "d", "l", "ng", "ny", "r", "s", "st", "t", "th", "kh", "ai", "au", "'", "-"]
    words = sorted({"".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7))) for _ in range(4000)} | {"Played", "little", "agreed", "baked", "added"})
    known = {e.replace("-", "") for e in X.ENGLISH_EXCEPTIONS}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.english_syllables(F.col("w")).alias("e"), X.malay_syllables(F.col("w")).alias("m"))
    for r in df.collect():
        if r["w"].lower() not in known:
            assert r["e"] == plain_english(r["w"]), r["w"]
        assert r["m"] == plain_malay(r["w"]), r["w"]


def test_syllables_of_both_languages_in_one_pass(spark):
    """Each word is cut once for both languages, in one Arrow step without regular expressions a row; odd words and nulls included."""
    words = ["Singing", "don’t", "where's", "well-known", "-", "", None, "Nyéanyi", "bunga", "KHaNGa", "a", "fam-ily", "你a"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    out = df.select("word", X.both_syllables(F.col("word")).alias("b"), X.english_syllables(F.col("word")).alias("e"), X.malay_syllables(F.col("word")).alias("m"))
    for r in out.collect():
        assert (r["b"]["english"], r["b"]["malay"]) == ((None, None) if r["e"] is None else ("|".join(r["e"]), "|".join(r["m"])))
        assert r["word"] is not None or r["e"] is None
        assert r["word"] not in ("", "-") or (r["e"], r["m"]) == ([], [])
    from melodyspark.jobs import catalogue

    plan = catalogue.QUERIES["p12_p13_syllables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


def test_syllables_are_cut_once_to_be_spread(spark):
    """The filter of words without a syllable does not cut the words a second time."""
    from melodyspark.jobs import catalogue

    plan = catalogue.QUERIES["p16_spread_syllables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan
