"""One instant for a stamp in any known notation, as JVM-side column expressions.

Every notation is rewritten to one canonical form `year|month|day|hour|minute|second|fraction|meridiem|zone`, from
which the instant is computed in whole microseconds.  A stamp that names no real instant (no date, 30 February,
25 o'clock, free text) gives null.  Nothing here depends on the session's time zone.
"""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their numbers (English, Spanish, French, German; names and common short forms).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "sept": 9, "october": 10, "november": 11, "december": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "januar": 1, "februar": 2, "märz": 3, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
}

# Zone abbreviations and their offsets in minutes.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "ist": 330, "aest": 600, "aedt": 660, "pet": -300, "cot": -300,
}

# Seconds from 1970 to 2001, where iMessage counts from.
APPLE_EPOCH_S = 978307200

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_MERIDIEM = r"(?: ?([ap])\.? ?m\b\.?)?"
_ZONE = r"(?: ?(z|[+-]\d{2}:?(?:\d{2})?|[a-z]{2,5}(?:[+-]\d{1,2}:?(?:\d{2})?)?))?"
_WEEKDAY = r"(?:\p{L}{2,10}\.?,? )?"
_NAME = r"(\p{L}{3,10})\.?"

#: (pattern, canonical form); patterns see lower-case text with single plain spaces, without brackets.
NOTATIONS = {
    "year_first": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:t|,? ){_TIME}{_MERIDIEM}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[t ](\d{2})(\d{2})(\d{2})?(?:[.,](\d+))? ?(z|[+-]\d{2}:?(?:\d{2})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "numeric": (rf"^(\d{{1,2}})([/.-])(\d{{1,2}})[/.-](\d{{4}}|\d{{2}})(?:,? {_TIME}{_MERIDIEM}{_ZONE})?$", "$4|$1$2|$3|$5|$6|$7|$8|$9|$10"),
    "mail": (rf"^{_WEEKDAY}(\d{{1,2}})\.? (?:de )?{_NAME} (?:de )?(\d{{4}})(?:,? {_TIME}{_MERIDIEM}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "month_first": (rf"^{_WEEKDAY}{_NAME} (\d{{1,2}}),? (\d{{4}})(?:,? {_TIME}{_MERIDIEM}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "year_last": (rf"^{_WEEKDAY}{_NAME} (\d{{1,2}}) {_TIME}{_MERIDIEM}{_ZONE} (\d{{4}})$", "$9|$1|$2|$3|$4|$5|$6|$7|$8"),
}


def _tidy(stamp: Column) -> Column:
    flat = F.regexp_replace(stamp, r"(?U)[\s\p{Z}\p{Cc}\p{Cf}]+", " ")
    return F.lower(F.regexp_replace(flat, r"^ ?[\[(]? ?| ?[\])]? ?$", ""))


def _int(col: Column) -> Column:
    return F.when(col != "", col).try_cast("int")


def canonical(stamp: Column) -> Column:
    """`year|month|day|hour|minute|second|fraction|meridiem|zone`, or `#digits` for a bare number, or null."""
    s = _tidy(stamp)
    out = F.when(s.rlike(r"^\d{1,20}$"), F.concat(F.lit("#"), s))
    for pattern, form in NOTATIONS.values():
        out = out.when(s.rlike(pattern), F.regexp_replace(s, pattern, form))
    return out


def _lookup(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def usable_zone(zone: Column) -> Column:
    """The zone where its name is known, else UTC."""
    known = sorted(z for z in available_timezones() if z[0].isupper() and "/" in z and not z.startswith(("Etc/", "SystemV/")))
    return F.when(zone.isin(*known), zone).otherwise(F.lit("UTC"))


def instant_us(canon: Column, zone: Column, month_first: Column, apple: Column) -> Column:
    """Microseconds since 1970 UTC of a canonical stamp, finer digits cut.

    zone: a usable zone for stamps that carry none; month_first: order of numeric dates with slashes or dashes (dotted
    ones are day first everywhere); apple: 18 digits count nanoseconds from 2001.
    """
    return let(canon, lambda c: let(F.split(c, r"\|", 9), lambda p: _instant(c, p, zone, month_first, apple)))


#: The commonest notation, which the cast of strings reads without any pattern's groups: ISO date and time, zone or none.
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"


def instant(stamp: Column, zone: Column, month_first: Column, apple: Column) -> Column:
    """`instant_us` of a raw stamp; ISO ones take the short way, all others (and ISO ones it cannot read) the long one."""
    zoned = stamp.rlike(r"[Z+]|-\d{2}:\d{2}$")
    utc = F.when(zoned, stamp).otherwise(F.concat(stamp, F.lit("Z"))).try_cast("timestamp")
    short = F.unix_micros(F.when(zoned, utc).otherwise(F.to_utc_timestamp(utc, zone)))
    return F.coalesce(F.when(stamp.rlike(ISO), short), instant_us(canonical(stamp), zone, month_first, apple))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _instant(canon: Column, p: Column, zone: Column, month_first: Column, apple: Column) -> Column:
    digits = F.substring(canon, 2, 20)
    number = digits.try_cast("decimal(20,0)")
    size = F.length(digits)
    bare = (
        F.when(apple & (size == 18), number / 1000 + APPLE_EPOCH_S * 1_000_000)
        .when(size <= 11, number * 1_000_000)
        .when(size <= 14, number * 1_000)
        .when(size <= 17, number)
        .otherwise(number / 1000)
    )
    year = F.get(p, F.lit(0)).try_cast("int")
    year = F.when(F.length(F.get(p, F.lit(0))) == 2, F.when(year < 69, year + 2000).otherwise(year + 1900)).otherwise(year)
    a, b = F.get(p, F.lit(1)), F.get(p, F.lit(2))
    first = F.regexp_extract(a, r"^(\d+)", 1)
    numeric = a.rlike(r"[/.-]$")
    swap = numeric & (~month_first | a.endswith("."))
    month = F.when(swap, _int(b)).when(first != "", _int(first)).otherwise(F.element_at(_lookup(MONTHS), a))
    day = F.when(swap, _int(first)).otherwise(_int(b))
    hour, meridiem = F.coalesce(_int(F.get(p, F.lit(3))), F.lit(0)), F.get(p, F.lit(7))
    hour = (
        F.when(meridiem == "", hour)
        .when((hour < 1) | (hour > 12), F.lit(None).cast("int"))
        .when(meridiem == "p", F.when(hour == 12, hour).otherwise(hour + 12))
        .otherwise(F.when(hour == 12, F.lit(0)).otherwise(hour))
    )
    minute, second = (F.coalesce(_int(F.get(p, F.lit(k))), F.lit(0)) for k in (4, 5))
    micros = F.coalesce(_int(F.substring(F.rpad(F.get(p, F.lit(6)), 6, "0"), 1, 6)), F.lit(0))
    local = F.try_make_timestamp(year, month, day, hour, minute, F.lit(0), F.lit("UTC"))
    zoned = F.get(p, F.lit(8))
    sign = F.when(zoned.contains("-"), F.lit(-1)).otherwise(F.lit(1))
    shift = F.regexp_replace(F.regexp_extract(zoned, r"([+-][\d:]+)$", 1), r"[+:-]", "")
    shift = sign * (F.coalesce(_int(F.substring(shift, 1, 2)), F.lit(0)) * 60 + F.coalesce(_int(F.substring(shift, 3, 2)), F.lit(0)))
    name = F.regexp_extract(zoned, r"^([a-z]+)", 1)
    base = F.when(name == "", F.lit(0)).otherwise(F.element_at(_lookup(ZONE_MINUTES), name))
    utc = F.when(zoned == "", F.unix_micros(F.to_utc_timestamp(local, zone))).otherwise(F.unix_micros(local) - (base + shift).cast("long") * 60_000_000)
    dated = F.when(second < 60, utc + second.cast("long") * 1_000_000 + micros)
    return F.when(canon.startswith("#"), F.floor(bare).cast("long")).otherwise(dated)
