"""Text predicates and keys shared by the operators, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What chat exports write in place of an attachment.
MEDIA_MARKERS = (
    "<media omitted>",
    "<multimedia omitido>",
    "imagen omitida",
    "video omitido",
    "audio omitido",
    "sticker omitido",
)

#: White space, controls, format characters, blank-looking letters and variation selectors.
INVISIBLE = r"[\s\p{Z}\p{C}ᅟᅠㅤﾠ⠀︀-️͏]"


def visible(col: Column) -> Column:
    """The text without white space and invisible characters at its ends."""
    return F.regexp_replace(col, rf"(?U)^{INVISIBLE}+|{INVISIBLE}+$", "")


def says_something(col: Column) -> Column:
    """False for null, blank or invisible text and for a bare media marker; never null.

    Both patterns settle at the first letters of an ordinary text.
    """
    markers = "|".join(m.replace(" ", f"{INVISIBLE}+") for m in MEDIA_MARKERS)
    seen = col.rlike(f"(?U)[^{INVISIBLE[1:]}")
    marker = col.rlike(f"(?iuU)^{INVISIBLE}*(?:{markers}){INVISIBLE}*$")
    return F.coalesce(seen & ~marker, F.lit(False))


def clean_role(col: Column) -> Column:
    """Role without case and outer white space; null stays null."""
    return F.lower(F.regexp_replace(col, r"(?U)^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))


def duration(seconds: Column) -> Column:
    """SNK-03: whole seconds, rounded up, as MM:SS or HH:MM:SS; `--:--` for no number."""
    whole = F.greatest(F.lit(0), F.ceil(seconds)).cast("long")
    two = lambda n: F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    known = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (F.abs(seconds) < float("inf"))
    return F.when(~known, "--:--").when(h > 0, F.concat_ws(":", two(h), two(m), two(s))).otherwise(F.concat_ws(":", two(m), two(s)))


def progress(done: Column, total: Column, elapsed: Column) -> Column:
    """SNK-03: how far a write is, and how long it will take at its pace so far."""
    share = F.when(total != 0, done / total * 100).otherwise(100.0)
    left = F.when(done >= total, F.lit(0.0)).when((done > 0) & (elapsed > 0), (total - done) / (done / elapsed))
    return F.concat(done.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), F.format_string("%.1f", F.bround(share, 1)), F.lit("%) | elapsed "), duration(elapsed), F.lit(" | ETA "), duration(left))
