"""Dates: the method API on instants, and the older functions on epoch seconds.

Dates are Spark timestamps with their zone known at compile time. Sessions run
in UTC, so that a timestamp's parts are UTC's; another zone's wall clock is the
timestamp moved by ``from_utc_timestamp``. A null date is an invalid one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Scope, typed_like
from ..plans.syntax import RuleError
from ..plans.typed import Val, both, failed, given

TS, LONG, BOOL, STRING = T.TimestampType(), T.LongType(), T.BooleanType(), T.StringType()

_UNITS = {
    "second": "seconds second secs sec s",
    "minute": "minutes minute min mins m",
    "hour": "hours hour hr hrs h",
    "day": "days day d",
    "week": "weeks week w",
    "month": "months month mo M",
    "quarter": "quarters quarter qtr q",
    "year": "years year y",
}
UNITS = {name: unit for unit, names in _UNITS.items() for name in names.split()}
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def local(v: Val) -> Column:
    """The wall clock of the date's zone, as a timestamp of the session's zone, UTC."""
    return v.col.cast("timestamp") if v.zone == "UTC" else F.from_utc_timestamp(v.col.cast("timestamp"), v.zone)


def instant(c: Column, zone: str) -> Column:
    return c if zone == "UTC" else F.to_utc_timestamp(c, zone)


def now_of(s: Scope) -> Column:
    return F.lit(s.now).cast("timestamp") if s.now else F.current_timestamp()


def wall(c: Column) -> Column:
    """The date and time in a text; an offset is read over, not applied."""
    bare = F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2}(?:\.\d+)?)(?:[Zz]|[+-]\d{2}:\d{2})$", "$1 $2")
    fit = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), bare)
    return fit.try_cast("timestamp")


def parse_date(v: Val, zone: str, s: Scope) -> Column | None:
    if v.date:
        return v.col.cast("timestamp")
    if v.number:
        return F.timestamp_millis(v.col.cast("long"))
    if v.string or v.variant:
        text = v.col if v.string else F.try_variant_get(v.col, "$", "string")
        if isinstance(v.const, str) and v.const in available_timezones():
            return now_of(s)
        return instant(wall(text), zone)
    return F.lit(None).cast("timestamp")


def _d(args: list[Val], s: Scope) -> Val:
    if not args:
        return Val(now_of(s), TS, sure=True)
    zone = "UTC"
    if len(args) > 1:
        if not isinstance(args[1].const, str):
            raise RuleError("a zone must be a literal")
        zone = args[1].const
        if zone not in available_timezones():
            return failed()
    elif args[0].date:
        zone = args[0].zone
    elif isinstance(args[0].const, str) and args[0].const in available_timezones():
        zone = args[0].const
    return Val(parse_date(args[0], zone, s), TS, ok=both(*(a.ok for a in args)), zone=zone)


def duration(text: str) -> tuple[int, int]:
    """(seconds, months) of a text such as ``1d 2h`` or ``3 months``."""
    seconds, months = 0, 0
    parts = re.findall(r"([+-]?\d+)\s*([A-Za-z]+)", text)
    if not parts or re.sub(r"([+-]?\d+)\s*([A-Za-z]+)", "", text).strip(" ,and"):
        raise RuleError(f"no duration: {text!r}")
    for n, name in parts:
        unit = UNITS.get(name)
        if unit is None:
            raise RuleError(f"no unit of time: {name!r}")
        if unit in SECONDS:
            seconds += int(n) * SECONDS[unit]
        else:
            months = int(n) * MONTHS[unit]
    return seconds, months


def unit_of(v: Val) -> str | None:
    if not isinstance(v.const, str):
        raise RuleError("a unit of time must be a literal")
    return UNITS.get(v.const)


def by_unit(u: Val, make: Callable[[str], Val]) -> Val:
    """What ``make`` builds for a unit of time; a unit that is known at run time only picks among all of them."""
    if isinstance(u.const, str):
        unit = UNITS.get(u.const)
        return failed() if unit is None else make(unit)
    if not u.string:
        return failed()
    made = {unit: make(unit) for unit in dict.fromkeys(UNITS.values())}
    first = next(v for v in made.values() if not v.nothing)
    col, ok = F.lit(None).cast(first.type), F.lit(False)
    for unit, v in made.items():
        hit = u.col.isin(*[name for name, x in UNITS.items() if x == unit])
        if not v.nothing:
            col = F.when(hit, v.col).otherwise(col)
        ok = F.when(hit, v.ok if v.ok is not None else F.lit(True)).otherwise(ok)
    return Val(col, first.type, ok=both(u.ok, F.coalesce(ok, F.lit(False))), zone=first.zone)


def duration_of(text: Column) -> tuple[Column, Column, Column]:
    """(seconds, months, whether it is a duration) of a text at run time, as ``duration`` reads it."""
    pair = r"([+-]?\d+)\s*([A-Za-z]+)"
    seconds = F.create_map(*[F.lit(x) for name, unit in UNITS.items() for x in (name, SECONDS.get(unit, 0))])
    months = F.create_map(*[F.lit(x) for name, unit in UNITS.items() for x in (name, MONTHS.get(unit, 0))])
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(pair), F.lit(1)), F.regexp_extract_all(text, F.lit(pair), F.lit(2)), lambda n, u: F.struct(n.try_cast("long").alias("n"), u.alias("u")))
    known = (F.size(parts) > 0) & F.forall(parts, lambda x: F.map_contains_key(seconds, x["u"]) & x["n"].isNotNull()) & (F.regexp_replace(F.regexp_replace(text, pair, ""), "^[ ,and]+|[ ,and]+$", "") == "")
    s = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x["n"] * F.coalesce(F.try_element_at(seconds, x["u"]), F.lit(0)))
    m = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: F.when(F.coalesce(F.try_element_at(months, x["u"]), F.lit(0)) > 0, x["n"] * F.try_element_at(months, x["u"])).otherwise(a))
    return s, m, F.coalesce(known, F.lit(False))


def moved(c: Column, seconds: Column | int, months: Column | int) -> Column:
    """Seconds first, then months, the day cut to the month's last."""
    c = c + F.make_interval(secs=F.lit(seconds).cast("decimal(18,6)") if isinstance(seconds, int) else seconds.cast("decimal(18,6)"))
    n = F.lit(months) if isinstance(months, int) else months.cast("int")
    return c + F.make_interval(months=n)


def start_of(c: Column, unit: str) -> Column:
    return F.date_trunc(unit, c)


def end_of(c: Column, unit: str) -> Column:
    start = F.date_trunc(unit, c)
    step = F.make_interval(months=F.lit(MONTHS[unit])) if unit in MONTHS else F.make_interval(secs=F.lit(SECONDS[unit]).cast("decimal(18,6)"))
    return start + step - F.expr("interval 1 microsecond")


def add_months(c: Column, n: Column) -> Column:
    return c + F.make_interval(months=n)


def month_difference(a: Column, b: Column) -> Column:
    """Calendar months from b to a, with a fraction: the later day of the month is the anchor."""

    def one(a: Column, b: Column) -> Column:
        n = ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("int")
        anchor = add_months(a, n)
        rest = F.unix_micros(b) - F.unix_micros(anchor)
        other = add_months(a, F.when(rest < 0, n - 1).otherwise(n + 1))
        span = F.abs(F.unix_micros(other) - F.unix_micros(anchor))
        return -(n + F.coalesce(F.try_divide(rest.cast("double"), span.cast("double")), F.lit(0.0)))

    return F.when(F.dayofmonth(a) < F.dayofmonth(b), -one(b, a)).otherwise(one(a, b))


_FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm"}


def formatted(v: Val, pattern: str) -> Column:
    """strftime in Spark's functions."""
    c = local(v)
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"%([-_0]?)([A-Za-z%]|\d?f|\.\d?f)", pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        flag, x = m.groups()
        at = m.end()
        if x == "%":
            parts.append(F.lit("%"))
        elif x == "e":
            parts.append(F.lpad(F.dayofmonth(c).cast("string"), 2, " ") if flag != "-" else F.dayofmonth(c).cast("string"))
        elif x == "u":
            parts.append((F.weekday(c) + 1).cast("string"))
        elif x == "w":
            parts.append(((F.weekday(c) + 1) % 7).cast("string"))
        elif x == "V":
            parts.append(F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
        elif x == "s":
            parts.append(F.unix_seconds(v.col.cast("timestamp")).cast("string"))
        elif x.endswith("f"):
            digits = int(re.sub(r"\D", "", x) or 9)
            part = F.rpad(F.date_format(c, "SSSSSS"), 9, "0")
            parts.append(F.concat(F.lit("." if x.startswith(".") else ""), F.substring(part, 1, digits)))
        elif x == "Z":
            parts.append(F.lit(v.zone))
        elif x == "z":
            minutes = ((F.unix_seconds(c) - F.unix_seconds(v.col.cast("timestamp"))) / 60).cast("int")
            parts.append(F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0")))
        elif x in _FORMATS:
            text = F.date_format(c, _FORMATS[x])
            parts.append(F.regexp_replace(text, "^0+(?=.)", "") if flag == "-" else text)
        else:
            raise RuleError(f"no date format %{x}")
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts) if parts else F.lit("")


def rendered(v: Val) -> Column:
    """RFC 3339 to the second, as results show dates."""
    c = formatted(v, "%Y-%m-%dT%H:%M:%S")
    if v.zone == "UTC":
        return F.concat(c, F.lit("Z"))
    z = formatted(v, "%z")
    return F.concat(c, F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2))


def _shift(v: Val, args: list[Val], sign: int) -> Val:
    c = local(v)

    def shifted(out: Column, yearly: Column | bool, ok: Column | None) -> Val:
        """The 29th of February has no day in another year."""
        if yearly is not False:
            same = F.dayofmonth(out) == F.dayofmonth(c)
            out = F.when(same if yearly is True else ~yearly | same, out)
        return Val(instant(out, v.zone), TS, ok=ok, zone=v.zone)

    if len(args) == 1:
        text = args[0]
        if isinstance(text.const, str):
            seconds, months = duration(text.const)
            return shifted(moved(c, sign * seconds, sign * months), bool(months and months % 12 == 0 and re.search(r"\d\s*y", text.const)), v.ok)
        if not text.string:
            raise RuleError("a duration is a text, or a number and a unit")
        seconds, months, known = duration_of(text.col)
        yearly = (months != 0) & (months % 12 == 0) & text.col.rlike(r"\d\s*y")
        return shifted(moved(c, seconds * sign, months * sign), yearly, both(v.ok, text.ok, known))
    if not args[0].number:
        return failed()
    n = args[0].col * sign
    ok = both(v.ok, args[0].ok, given(args[0]))
    return by_unit(args[1], lambda unit: shifted(moved(c, n * SECONDS[unit], 0) if unit in SECONDS else moved(c, 0, n * MONTHS[unit]), unit == "year", ok))


def _set(v: Val, args: list[Val]) -> Val:
    if not args[1].number:
        return failed()
    c, x = local(v), args[1].col.cast("int")

    def one(unit: str) -> Val:
        if unit in ("week", "quarter"):
            return v
        parts = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c).cast("decimal(16,6)")}
        parts[unit] = x.cast("decimal(16,6)") if unit == "second" else x
        fits = {"hour": x.between(0, 23), "minute": x.between(0, 59), "second": x.between(0, 59)}.get(unit, F.lit(True))
        out = F.when(fits, F.try_make_timestamp(parts["year"], parts["month"], parts["day"], parts["hour"], parts["minute"], parts["second"]))
        return Val(instant(out, v.zone), TS, ok=both(v.ok, args[1].ok, given(args[1])), zone=v.zone)

    return by_unit(args[0], one)


def _diff(v: Val, args: list[Val], s: Scope) -> Val:
    other = as_date(args[0], s)
    if other is None:
        return failed()
    ms = F.unix_millis(v.col.cast("timestamp")) - F.unix_millis(other.col.cast("timestamp"))
    ok = both(v.ok, other.ok)
    if len(args) == 1:
        return Val(ms, LONG, ok=ok)

    def one(unit: str) -> Val:
        if unit in MONTHS:
            x = month_difference(local(v), local(other)) / MONTHS[unit]
        else:
            own = F.unix_millis(local(v)) - F.unix_millis(local(other)) if unit in ("day", "week") else ms
            x = own.cast("double") / (SECONDS[unit] * 1000)
        return Val(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"), LONG, ok=ok)

    return by_unit(args[1], one)


def as_date(v: Val, s: Scope) -> Val | None:
    if v.date:
        return v
    if v.string or v.number:
        return Val(parse_date(v, "UTC", s), TS, ok=v.ok)
    return None


def _compare(name: str, v: Val, args: list[Val], s: Scope) -> Val:
    other = as_date(args[0], s)
    if other is None:
        return failed()
    a, b = local(v), other.col.cast("timestamp") if v.zone == "UTC" else F.from_utc_timestamp(other.col.cast("timestamp"), v.zone)

    def one(unit: str | None) -> Val:
        low, high = (start_of(a, unit), end_of(a, unit)) if unit else (a, a)
        same = (F.unix_millis(a) == F.unix_millis(b)) if unit is None else (low <= b) & (b <= high)
        test = {"isSame": same, "isBefore": high < b, "isAfter": b < low, "isSameOrBefore": same | (high < b), "isSameOrAfter": same | (b < low)}[name]
        return Val(F.coalesce(test, F.lit(False)), BOOL, ok=both(v.ok, other.ok), sure=True)

    return by_unit(args[1], one) if len(args) > 1 else one(None)


_GETTERS: dict[str, Callable[[Column], Column]] = {
    "second": F.second,
    "minute": F.minute,
    "hour": F.hour,
    "day": F.dayofmonth,
    "weekday": lambda c: F.weekday(c) + 1,
    "dayOfYear": F.dayofyear,
    "week": F.weekofyear,
    "month": F.month,
    "quarter": F.quarter,
    "year": F.year,
}


def method(name: str, v: Val, args: list[Val], s: Scope) -> Val:
    if v.variant:
        v = typed_like(v, TS)
    if not v.date:
        return failed()
    if name in ("add", "sub"):
        return _shift(v, args, 1 if name == "add" else -1)
    if name == "set":
        return _set(v, args)
    if name == "tz":
        zone = args[0].const
        if not isinstance(zone, str):
            raise RuleError("a zone must be a literal")
        return replace(v, zone=zone) if zone in available_timezones() else failed()
    if name == "format":
        if args and not isinstance(args[0].const, str):
            raise RuleError("a date format must be a literal")
        pattern = args[0].const if args else "%Y-%m-%d %H:%M:%S %Z"
        return Val(F.coalesce(formatted(v, pattern), F.lit("Invalid date")), STRING, ok=v.ok, sure=True)
    if name in ("startOf", "endOf"):
        edge = start_of if name == "startOf" else end_of
        return by_unit(args[0], lambda unit: Val(instant(edge(local(v), unit), v.zone), TS, ok=v.ok, zone=v.zone))
    if name == "diff":
        return _diff(v, args, s)
    if name in ("isSame", "isBefore", "isAfter", "isSameOrBefore", "isSameOrAfter"):
        return _compare(name, v, args, s)
    if name in _GETTERS:
        return Val(_GETTERS[name](local(v)).cast("long"), LONG, ok=v.ok)
    if name == "timestamp":
        return Val(F.unix_millis(v.col.cast("timestamp")), LONG, ok=v.ok)
    if name == "offsetName":
        return Val(F.when(v.col.isNotNull(), v.zone), STRING, ok=v.ok)
    if name == "isValid":
        return Val(v.col.isNotNull(), BOOL, ok=v.ok, sure=True)
    if name in ("isYesterday", "isToday", "isTomorrow"):
        day = F.date_trunc("day", F.from_utc_timestamp(now_of(s), v.zone)) + F.make_interval(days=F.lit({"isYesterday": -1, "isToday": 0, "isTomorrow": 1}[name]))
        return Val(F.coalesce(F.date_trunc("day", local(v)) == day, F.lit(False)), BOOL, ok=v.ok, sure=True)
    if name == "isLeapYear":
        y = F.year(local(v))
        return Val((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), BOOL, ok=v.ok)
    raise RuleError(f"no date method {name!r}")


# -- the older functions: epoch seconds


def moment(v: Val, s: Scope) -> Column | None:
    """The instant of a text or of epoch seconds; an offset is applied."""
    if v.number:
        return F.timestamp_seconds(v.col)
    if v.date:
        return v.col.cast("timestamp")
    if isinstance(v.const, str) and v.const == "now":
        return now_of(s)
    if v.string:
        t = v.col
        return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$|^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), t).try_cast("timestamp")
    return None


def legacy(make: Callable[[Column], Column], kind: T.DataType = LONG) -> Callable:
    def f(args: list[Val], s: Scope) -> Val:
        c = moment(args[0], s)
        if c is None:
            return failed()
        return Val(make(c).cast(kind), kind, ok=both(args[0].ok, c.isNotNull()))

    return f


def _time(args: list[Val], s: Scope) -> Val:
    v = args[0]
    if v.string and v.const != "now":
        short = F.when(v.col.rlike(r"^\d{2}$"), F.concat(v.col, F.lit(":00:00"))).when(v.col.rlike(r"^\d{2}:\d{2}$"), F.concat(v.col, F.lit(":00"))).when(v.col.rlike(r"^\d{2}:\d{2}:\d{2}$"), v.col)
        c = F.coalesce(F.concat(F.lit("1970-01-01 "), short).try_cast("timestamp"), moment(v, s))
    else:
        c = moment(v, s)
    if c is None:
        return failed()
    return Val((F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("long"), LONG, ok=both(v.ok, c.isNotNull()))


#: Units of the older duration texts, in seconds; months and years are averages.
_HUMAN = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2630016, "year": 31557600}


def _duration(args: list[Val], s: Scope) -> Val:
    from ..plans.typed import literal

    v = args[0]
    if v.number:
        return v
    if not isinstance(v.const, str):
        if v.string:
            raise RuleError("a duration must be a literal")
        return failed()
    total = 0
    parts = re.findall(r"(\d+)\s*([A-Za-z]+)", v.const)
    for n, name in parts:
        unit = UNITS.get(name)
        if unit not in _HUMAN:
            return failed()
        total += int(n) * _HUMAN[unit]
    return literal(total) if parts else failed()


def _edge(end: bool) -> Callable:
    def f(args: list[Val], s: Scope) -> Val:
        c, unit = moment(args[0], s), unit_of(args[1])
        if c is None or unit is None or unit == "quarter":
            return failed()
        out = F.unix_seconds(end_of(c, unit) if end else start_of(c, unit))
        return Val(out, LONG, ok=both(args[0].ok, c.isNotNull()))

    return f


FUNCTIONS: dict[str, Callable[[list[Val], Scope], Val]] = {
    "d": _d,
    "date": legacy(F.unix_seconds),
    "time": _time,
    "duration": _duration,
    "year": legacy(F.year),
    "dayOfWeek": legacy(lambda c: F.weekday(c) + 1),
    "dayOfMonth": legacy(F.dayofmonth),
    "dayOfYear": legacy(F.dayofyear),
    "weekOfYear": legacy(F.weekofyear),
    "monthOfYear": legacy(F.month),
    "monthString": legacy(lambda c: F.date_format(c, "MMM"), STRING),
    "dateString": legacy(lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), STRING),
    "weekdayString": legacy(lambda c: F.date_format(c, "EEE"), STRING),
    "startOf": _edge(False),
    "endOf": _edge(True),
}
