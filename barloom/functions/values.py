"""Numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column, places: int = 2) -> Column:
    """Scales, rounds half away from zero, scales back, all in doubles."""
    scale = float(10**places)
    return F.signum(x) * F.floor(F.abs(x * scale) + 0.5) / scale


def fixed(x: Column, places: int = 2) -> Column:
    """A number as text with so many decimals. Rounds the number itself, as printf does, and not its shortest
    decimal form, as format_string would; what is beyond its sixth decimal, where sums may differ by their
    order, goes first. What is below 0, or a negative 0, keeps its sign when its digits are zeros."""
    text = F.call_function("format_number", F.abs(F.round(x, 6)), F.lit("0." + "0" * places))
    return F.when((x < 0) | (x == 0) & (x.cast("string") == "-0.0"), F.concat(F.lit("-"), text)).otherwise(text)


def is_weekday(ts: Column) -> Column:
    return ~F.dayofweek(ts).isin(1, 7)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_trading_hours(ts: Column) -> Column:
    """On weekdays, from 9:30 to 11:30 and from 13:00 to 15:00, both ends included."""
    m = minute_of_day(ts)
    return is_weekday(ts) & (m.between(570, 690) | m.between(780, 900))


def after_close(ts: Column) -> Column:
    return is_weekday(ts) & (minute_of_day(ts) >= 900)


def previous_weekday(day: Column) -> Column:
    return F.date_sub(day, F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1))


def last_complete_day(now: Column) -> Column:
    """The last day whose trading is over at that time."""
    day = F.to_date(now)
    return F.when(after_close(now), day).otherwise(previous_weekday(day))


def packed_minute(day_part: Column, minute_part: Column) -> Column:
    """A time from two 16-bit numbers: year since 2004, month and day in one, minutes of the day in the other."""
    month, day = F.floor(day_part % 2048 / 100).cast("int"), (day_part % 2048 % 100).cast("int")
    return F.make_timestamp((F.shiftright(day_part, 11) + 2004).cast("int"), month, day, F.floor(minute_part / 60).cast("int"), (minute_part % 60).cast("int"), F.lit(0))


def packed_day(number: Column) -> Column:
    """15:00 on the day that yyyymmdd names, when a day's bar is complete."""
    return F.make_timestamp(F.floor(number / 10000).cast("int"), F.floor(number % 10000 / 100).cast("int"), (number % 100).cast("int"), F.lit(15), F.lit(0), F.lit(0))


def compact_day(ts: Column) -> Column:
    """A day as yyyyMMdd."""
    return F.date_format(ts, "yyyyMMdd")


def parse_day(text: Column) -> Column:
    """The date of a yyyyMMdd or yyyy-MM-dd; null for any other text, or a day that there is not."""
    plain = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", text.substr(1, 4), text.substr(5, 2), text.substr(7, 2))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return plain.try_cast("date")


def uint_le(data: Column, at: int, size: int) -> Column:
    """The number in `size` bytes (up to seven) from the 0-based place `at`, least byte first; null if they end before."""
    parts = [F.conv(F.hex(F.substring(data, at + k + 1, 1)), 16, 10).cast("long") * (1 << 8 * k) for k in range(size)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(F.octet_length(data) >= at + size, total)


def clock(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def slot_clock(slot: Column) -> Column:
    """HH:MM of the 0-based minute of trading: 120 of the morning, then the afternoon's."""
    return clock(F.lit(571) + slot + F.when(slot >= 120, 90).otherwise(0))


def gbk_text(data: Column) -> Column:
    """Text from GBK bytes, without NULs. Spark decodes GBK only under spark.sql.legacy.javaCharsets."""
    return F.replace(F.decode(data, "GBK"), F.lit("\x00"), F.lit(""))


def change(close: Column, previous: Column) -> tuple[Column, Column]:
    """Difference to the previous close and its percentage; 0 without a previous one, or one that isn't positive."""
    diff = F.when(previous.isNull(), 0.0).otherwise(close - previous)
    return diff, F.when(previous > 0, diff / previous * 100).otherwise(0.0)
