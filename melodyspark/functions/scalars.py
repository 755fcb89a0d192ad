"""Column functions over pitches, intervals and times. Nothing here shuffles or leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note names, major scale and its lane positions.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR_STEPS = [0, 2, 4, 5, 7, 9, 11]
DEGREE_NAMES = ["Do", "Re", "Mi", "Fa", "Sol", "La", "Ti"]
DEGREE_RATIOS = [0.00, 0.14, 0.29, 0.43, 0.57, 0.71, 0.86]


def literal_array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def round_to(x: Column, places: int) -> Column:
    """Round half to even at a decimal place by way of the nearest whole number."""
    scale = float(10**places)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def hz_to_midi(hz: Column) -> Column:
    """MIDI number of a frequency; null unless it is positive."""
    return F.when(hz > 0, 12 * F.log2(hz / F.lit(440.0)) + 69)


def midi_to_hz(midi: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (midi - 69) / 12)


def cents(a: Column, b: Column) -> Column:
    """Distance from frequency b to frequency a in cents."""
    return F.when((a > 0) & (b > 0), 1200 * F.log2(a / b))


def pitch_class(midi: Column) -> Column:
    return F.pmod(midi.cast("int"), F.lit(12))


def note_name(midi: Column) -> Column:
    """Name with octave, such as C#4, of a whole MIDI number."""
    name = F.element_at(literal_array(NOTE_NAMES), pitch_class(midi) + 1)
    return F.concat(name, (F.floor(midi / 12) - 1).cast("int").cast("string"))


def scale_degree(midi: Column, tonic: Column) -> Column:
    """Index 0..6 in the major scale of ``tonic``; null outside the scale."""
    at = F.array_position(literal_array(MAJOR_STEPS), F.pmod(midi.cast("int") - tonic.cast("int"), F.lit(12)))
    return F.when(at > 0, (at - 1).cast("int"))


def degree_name(degree: Column) -> Column:
    return F.coalesce(F.element_at(literal_array(DEGREE_NAMES), degree + 1), F.lit("?"))


def degree_ratio(degree: Column) -> Column:
    return F.coalesce(F.element_at(literal_array(DEGREE_RATIOS), degree + 1), F.lit(0.0))


def snap_to_scale(midi: Column, tonic: Column) -> Column:
    """Nearest note of the major scale; of two as near, the one that comes first in the scale.

    The candidates are folded to within six semitones of the pitch, as numbers from the tonic up.
    """
    whole = F.rint(midi).cast("int")
    pc = F.pmod(whole, F.lit(12))

    def ranked(step: int) -> Column:
        target = F.pmod(tonic.cast("int") + step, F.lit(12))
        apart = F.abs(target - pc)
        return F.struct(F.least(apart, 12 - apart).alias("d"), F.lit(MAJOR_STEPS.index(step)).alias("i"), target.alias("pc"))

    best = F.array_min(F.array(*[ranked(s) for s in MAJOR_STEPS]))["pc"]
    moved = whole - pc + best
    return F.when(F.abs(moved - whole) > 6, F.when(moved < whole, moved + 12).otherwise(moved - 12)).otherwise(moved)


def lane(semitones: Column) -> Column:
    """Piecewise-linear height of an interval above the base note: one octave is one lane unit."""
    octave = F.floor(semitones / 12)
    local = semitones - octave * 12
    steps, heights = [*MAJOR_STEPS, 12], [*DEGREE_RATIOS, 1.0]
    out = None
    for i in range(7):
        piece = heights[i] + (local - steps[i]) / float(steps[i + 1] - steps[i]) * (heights[i + 1] - heights[i])
        out = F.when(local <= steps[i + 1], piece) if out is None else out.when(local <= steps[i + 1], piece)
    return octave + out


def fold_register(midi: Column, low: Column, high: Column) -> Column:
    """The pitch moved by octaves into [low, high]: up first where it is below, then down where it is above."""
    up = F.when(midi < low, midi + 12 * F.ceil((low - midi) / 12)).otherwise(midi)
    return F.when(up > high, up - 12 * F.ceil((up - high) / 12)).otherwise(up).cast("int")


def octave_blind(error: Column) -> Column:
    """An error folded to [-6, 6)."""
    return F.pmod(error + 6, F.lit(12.0)) - 6


def same_pitch_class(a: Column, b: Column) -> Column:
    return F.pmod(a.cast("int") - b.cast("int"), F.lit(12)) == 0


def beats_to_seconds(beat: Column, bpm: Column, lead_in: Column) -> Column:
    return lead_in + beat * 60.0 / bpm


def clock(seconds: Column) -> Column:
    """m:ss, rounded down."""
    whole = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), F.pmod(whole, F.lit(60)))


def centisecond_id(key: Column, section: Column, t: Column) -> Column:
    """Deterministic id from song, section and onset in centiseconds."""
    return F.format_string("%s-%s-%05d", key.cast("string"), section.cast("string"), F.rint(t * 100).cast("int"))
