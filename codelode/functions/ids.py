"""Ids that hold a file's number and a place in the file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.schemas import ORDINAL_SPAN


def packed(file_id: Column, place: Column) -> Column:
    """The id of a place in a file; places beyond the span are an error, not the next file's ids."""
    beyond = F.raise_error(F.concat(F.lit("more places in a file than its id can hold: "), place.cast("string"))).cast("long")
    return F.when(place < ORDINAL_SPAN, file_id * ORDINAL_SPAN + place).otherwise(beyond)
