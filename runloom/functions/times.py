"""Time texts of run records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.constants import DISPLAY_FORMAT, LOG_TIME_FORMAT, STAMP_FORMAT


def parse_stamp(text: Column) -> Column:
    """The time in a record text, NULL if it is not one."""
    return F.try_to_timestamp(text, F.lit(STAMP_FORMAT))


def parse_log_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(LOG_TIME_FORMAT))


def display_stamp(text: Column) -> Column:
    """A record time in the form tables show."""
    return F.date_format(parse_stamp(text), DISPLAY_FORMAT)


def folder_stamp(folder: Column) -> Column:
    """The start time in front of a run folder's name."""
    return parse_stamp(F.substring_index(folder, "-", 1))


def epoch_micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def epoch_seconds(time: Column) -> Column:
    return F.unix_seconds(time.cast("timestamp"))
