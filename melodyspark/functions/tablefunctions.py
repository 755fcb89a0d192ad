"""Table functions for SQL: rows of a partition in order, to more rows that depend on those before."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from melodyspark.functions.text import TOKEN

UNITS = "song long, line_no int, token_no int, unit_no int, token string"


@F.udtf(returnType=UNITS)
class LyricUnits:
    """Lines of a song (song, line_no, line) to their units, numbered in the line and through the song. Null lines have none."""

    def __init__(self) -> None:
        self.pattern = re.compile(TOKEN)
        self.units = 0

    def eval(self, row: Row) -> Iterator[tuple[int, int, int, int, str]]:
        for k, token in enumerate(self.pattern.findall(row["line"] or "")):
            yield row["song"], row["line_no"], k, self.units, token
            self.units += 1


def register(spark: SparkSession) -> None:
    """Make ``lyric_units(TABLE(lines) PARTITION BY song ORDER BY line_no)`` known to SQL."""
    spark.udtf.register("lyric_units", LyricUnits)
