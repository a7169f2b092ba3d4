"""What listings and reports print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types of st_mode and their letters, and the units of sizes.
S_IFMT = 0o170000
TYPE_LETTERS = {0o100000: "-", 0o040000: "d", 0o120000: "l", 0o060000: "b", 0o020000: "c", 0o010000: "p", 0o140000: "s"}
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def bit(mode: Column, mask: int) -> Column:
    return mode.bitwiseAND(F.lit(mask)) != 0


def mode_string(mode: Column) -> Column:
    """ls -l's ten characters."""
    kind = F.lit("?")
    for value, letter in TYPE_LETTERS.items():
        kind = F.when(mode.bitwiseAND(F.lit(S_IFMT)) == value, letter).otherwise(kind)

    def triple(shift: int, special: int, lower: str) -> list[Column]:
        run = bit(mode, 1 << shift)
        last = F.when(bit(mode, special), F.when(run, lower).otherwise(lower.upper())).otherwise(F.when(run, "x").otherwise("-"))
        return [F.when(bit(mode, 4 << shift), "r").otherwise("-"), F.when(bit(mode, 2 << shift), "w").otherwise("-"), last]

    return F.concat(kind, *triple(6, 0o4000, "s"), *triple(3, 0o2000, "s"), *triple(0, 0o1000, "t"))


def whole(n: Column) -> Column:
    """A whole number's digits, also of a decimal beyond a long."""
    return F.coalesce(n.try_cast("long").cast("string"), n.cast("string"))


def scaled(n: Column, digits: int, promote: float) -> Column:
    """n in the largest unit in which it is at least one; promote: from where the next unit is taken."""
    value = n.cast("double")
    out = None
    for power in range(len(UNITS) - 1, 0, -1):
        below = promote * 1024.0 ** (power - 1)
        shown = F.format_string(f"%.{digits}f {UNITS[power]}", F.bround(value / 1024.0**power, digits))
        out = F.when(value >= below, shown) if out is None else out.when(value >= below, shown)
    return out.otherwise(F.concat(whole(n), F.lit(" B")))


def human_bytes(n: Column) -> Column:
    """One decimal; a size that would round to 1024 of a unit is one of the next. Bytes need no rounding."""
    value = n.cast("double")
    out = F.when(value < 1024, F.concat(whole(n), F.lit(" B")))
    for power in range(1, len(UNITS)):
        unit = value / 1024.0**power
        last = power == len(UNITS) - 1
        shown = F.format_string(f"%.1f {UNITS[power]}", F.bround(unit, 1))
        out = out.otherwise(shown) if last else out.when(unit < 1023.95, shown)
    return out


def human_bytes2(n: Column) -> Column:
    """Two decimals, without that rule."""
    return scaled(n, 2, 1024.0)


def duration(seconds: Column) -> Column:
    """M:SS, from an hour on H:MM:SS; rounded half away from zero, never negative."""
    s = F.greatest(F.round(seconds.cast("double")).cast("long"), F.lit(0).cast("long"))
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def bar(percent: Column, width: int) -> Column:
    """A progress bar's cells in brackets; what is beyond 0 to 100 is cut."""
    part = F.least(F.greatest(percent.cast("double"), F.lit(0.0)), F.lit(100.0))
    full = (part / 100 * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("\u2588"), full), F.repeat(F.lit("\u2591"), F.lit(width) - full), F.lit("]"))


def mtime(t: Column, now: Column) -> Column:
    """Month and day with the year if t is in the future or over six months old, else with the time."""
    day = F.concat(F.date_format(t, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(t).cast("string"), 2, " "))
    old = (t > now) | (t < now - F.expr("interval 6 months"))
    return F.when(old, F.concat(day, F.lit("  "), F.date_format(t, "yyyy"))).otherwise(F.concat(day, F.lit(" "), F.date_format(t, "HH:mm")))


def entry_size(major: Column, minor: Column, content_length: Column, target: Column) -> Column:
    """A device's numbers, else the content's length, else the length of a link's target."""
    device = F.concat(major.cast("string"), F.lit(","), minor.cast("string"))
    return F.coalesce(F.when(major.isNotNull() & minor.isNotNull(), device), content_length.cast("string"), F.octet_length(target).cast("string"), F.lit("0"))


def rate_owed(done: Column, rate: Column) -> Column:
    """Nanoseconds that a copy of `done` bytes should have taken at a rate; whole seconds first, so nothing overflows."""
    quotient = lambda x: ((x - x % rate) / rate).cast("long")
    return F.when(rate <= 0, F.lit(0).cast("long")).otherwise(quotient(done) * 1_000_000_000 + quotient(done % rate * 1_000_000_000))


def one_decimal(x: Column) -> Column:
    """x >= 0 as a double rounded to one decimal by its exact binary value, ties to even.

    Twenty times x is sixteen and four times x, both exact; their sum and its error decide on which side of half
    a tenth x lies, which the digits of a double as shown don't tell."""
    a, b = x * 16, x * 4
    total = a + b
    part = total - a
    error = (a - (total - part)) + (b - part)
    tenths = F.floor(total / 2)
    rest = total - tenths * 2
    up = (rest > 1) | (rest == 1) & ((error > 0) | (error == 0) & (tenths % 2 == 1))
    return (tenths + up.cast("long")) / F.lit(10.0)


def progress(done: Column, total: Column, files: Column, all_files: Column, seconds: Column, width: int = 16) -> Column:
    """An ingest's progress line. An empty total counts as done; the time left comes from the rate so far."""
    rate = F.when(seconds > 0, done / seconds).otherwise(F.lit(0.0))
    percent = F.when(total > 0, F.least(done / total * 100, F.lit(100.0))).otherwise(F.lit(100.0))
    # whole seconds, as the rate isn't finer
    left = F.when((total > 0) & (done > 0) & (done < total) & (rate > 0), duration(F.floor((total - done) / rate))).otherwise("--:--")
    return F.concat(
        F.lit("ingest "), F.format_string("%5.1f", one_decimal(percent)), F.lit("% "), bar(percent, width),
        F.lit("  "), human_bytes(done), F.lit("/"), human_bytes(total),
        F.lit("  "), human_bytes(F.floor(rate).cast("long")), F.lit("/s  elapsed "), duration(seconds), F.lit("  eta "), left,
        F.lit("  files "), files.cast("string"), F.lit("/"), all_files.cast("string"),
        F.when((total > 0) & (done >= total), "  finalizing…").otherwise(""),
    )
