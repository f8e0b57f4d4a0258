"""Rows as music: melodies, moods and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sievefold.operators.profile import display_value, non_null_count

# Instruments by table position and their waveforms, words of the two moods, notes of each mood in Hz.
INSTRUMENTS = ("piano", "synth", "bass", "lead", "pad", "pluck", "bell", "drum")
OSCILLATORS = {"piano": "triangle", "synth": "sawtooth", "bass": "square", "lead": "sine", "pad": "triangle", "pluck": "square", "bell": "sine", "drum": "noise"}
RISK = ("debt", "overdue", "default", "late", "reject", "negative")
POSITIVE = ("approve", "good", "high", "income", "positive", "active")
SCALES = {
    "happy": (261.63, 293.66, 329.63, 349.23, 392.00, 440.00, 493.88),
    "mysterious": (220.00, 246.94, 277.18, 329.63, 369.99, 415.30, 493.88),
    "chaotic": (261.63, 277.18, 311.13, 369.99, 415.30, 466.16, 523.25),
    "peaceful": (261.63, 293.66, 349.23, 392.00, 440.00, 523.25),
}


def degree_hz(degree: Column) -> Column:
    """F10."""
    return 261.63 * F.pow(F.lit(2.0), degree / 7.0)


def text_degree(x: Column) -> Column:
    """a stable hash of the text."""
    return F.pmod(F.ascii(F.substring(x, 1, 1)) + F.length(x), F.lit(7))


def note(x: Column, name: str, position: int, numeric: bool) -> Column:
    """One field's note; types come from the schema."""
    text = x.cast("string")
    if numeric:
        v = F.abs(x.cast("double"))
        hz, length, kind = degree_hz(F.floor(v) % 7), F.least(0.2 + F.least((v % 10) / 20, F.lit(0.8)), F.lit(1.0)), "numeric"
    else:
        hz, length, kind = degree_hz(text_degree(text)), F.least(0.15 + F.least(F.length(text) / 100, F.lit(0.6)), F.lit(1.0)), "text"
    empty = x.isNull()
    return F.struct(
        F.when(empty, 130.81).otherwise(hz).alias("frequency"),
        F.when(empty, 0.1).otherwise(length).alias("duration"),
        F.lit(name).alias("column_name"),
        display_value(x).alias("value"),
        F.lit(0.3 * position).alias("start_time"),
        F.when(empty, "null").otherwise(kind).alias("note_type"),
    )


def melody(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row for each field, in position order."""
    notes = F.array(*[note(F.col(c), c, k, isinstance(df.schema[c].dataType, NumericType)) for k, c in enumerate(columns)])
    return df.select(*keys, F.posexplode(notes).alias("position", "note")).select(*keys, "position", "note.*")


def mood(columns: Sequence[str]) -> Column:
    """M3, F15."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    score = lambda words: sum((text.contains(w).cast("int") for w in words), F.lit(0))
    risk, good = score(RISK), score(POSITIVE)
    return F.when(risk > good + 1, "chaotic").when(good > risk + 1, "happy").when(text.contains("amount") | text.contains("balance"), "mysterious").otherwise("peaceful")


def tempo(n: Column) -> Column:
    """F16."""
    return F.greatest(F.lit(60), F.least(F.lit(180), 2 * n))


def volume(n: Column) -> Column:
    return F.least(F.lit(0.8), n / 20)


def part(df: DataFrame, table: str, position: int, keys: Sequence[str]) -> DataFrame:
    """M1: one instrument's part for each row: mood, scale, tempo, volume and notes."""
    n = non_null_count(df.columns)
    scale = F.create_map(*[x for name, hz in SCALES.items() for x in (F.lit(name), F.array(*map(F.lit, hz)))])
    notes = F.array(*[note(F.col(c), c, k, isinstance(df.schema[c].dataType, NumericType)) for k, c in enumerate(df.columns)])
    m = mood(df.columns)
    return df.select(*keys, F.lit(table).alias("table_name"), F.lit(INSTRUMENTS[position % len(INSTRUMENTS)]).alias("instrument"), m.alias("mood"), F.element_at(scale, m).alias("scale"), tempo(n).alias("tempo"), volume(n).alias("volume"), notes.alias("melody"))


def oscillator(instrument: Column) -> Column:
    """the waveform of an instrument; unknown ones sound like the synth."""
    known = F.create_map(*[F.lit(x) for pair in OSCILLATORS.items() for x in pair])
    return F.coalesce(F.element_at(known, instrument), F.lit(OSCILLATORS["synth"]))


def schedule(notes: DataFrame, instrument: Column, bpm: Column) -> DataFrame:
    """delay in ms of each note and loudness in dB."""
    return notes.withColumns({"delay": (2000 * instrument + 1000 * F.col("start_time")) / bpm, "db": -20 + 15 * F.col("volume")})


def composition(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON document for each entity from its parts, tables in name order."""
    held = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("table_name", "instrument", "mood", "scale", "tempo", "volume", "melody"))).alias("instruments"))
    n = F.size("instruments")
    return held.select(*keys, n.alias("total_tables"), F.greatest(F.lit(45), 15 * n).alias("composition_length"), F.to_json(F.struct("instruments")).alias("document"))
