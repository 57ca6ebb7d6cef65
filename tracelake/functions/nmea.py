"""NMEA sentences (GGA and RMC) as expressions: fields or the reason of rejection, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINE = 256
#: Codes of fix quality (fixed values); 3 and 7 have no counterpart.
QUALITY = {"0": "invalid", "1": "gps_fix", "2": "dgps", "4": "rtk_fixed", "5": "rtk_float", "6": "estimated", "8": "simulated"}
KNOT = 1852.0 / 3600.0


def checksum(body: Column) -> Column:
    """XOR of all characters, as two upper-case hexadecimal digits."""
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.lpad(F.hex(F.aggregate(codes, F.lit(0), lambda a, b: a.bitwiseXOR(b))), 2, "0")


def coordinate(raw: Column, hemisphere: Column, digits: int, most: float, allowed: tuple[str, str]) -> tuple[Column, Column]:
    """Degrees of ``ddmm.mmmm`` and the reason against it; both null where both fields are empty."""
    minutes = F.substring(raw, digits - 1, 20).try_cast("double")
    value = F.substring(raw, 1, digits - 2).try_cast("double") + minutes / 60
    shaped = raw.rlike(rf"^[0-9]{{{digits}}}(\.[0-9]+)?$")
    reason = (
        F.when((raw == "") & (hemisphere == ""), F.lit(None).cast("string"))
        .when((raw == "") | (hemisphere == "") | ~hemisphere.isin(*allowed) | ~shaped, "malformed_field")
        .when((minutes >= 60) | (value > most), "out_of_range")
    )
    signed = F.when(hemisphere == allowed[1], -value).otherwise(value)
    return F.when((raw != "") & reason.isNull(), signed), reason


def number(raw: Column, low: float | None, high: float | None, *, inclusive: bool = False, signed: bool = False, whole: bool = False) -> tuple[Column, Column]:
    """An optional number and the reason against it."""
    shape = "^[0-9]+$" if whole else r"^-?[0-9]+(\.[0-9]+)?$" if signed else r"^[0-9]+(\.[0-9]+)?$"
    v = raw.try_cast("double")
    out = F.lit(False)
    if low is not None:
        out = out | (v < low)
    if high is not None:
        out = out | (v > high if inclusive or whole else v >= high)
    reason = F.when(raw == "", F.lit(None).cast("string")).when(~raw.rlike(shape), "malformed_field").when(out, "out_of_range")
    return F.when((raw != "") & reason.isNull(), v), reason


def parse(lines: DataFrame) -> DataFrame:
    """``lines(line, ...)`` with sentence, latitude, longitude, quality, satellites, hdop, altitude, speed_mps, course, date, seconds and ``reason``.

    A rejected line has its first reason and no values. A null line is ``not_a_sentence``.
    """
    line = F.rtrim(F.coalesce(F.col("line"), F.lit("")), F.lit("\r\n"))
    df = lines.withColumn("_l", line)
    star = F.instr("_l", "*")
    df = df.withColumns({"_body": F.when(star > 1, F.expr("substring(_l, 2, instr(_l, '*') - 2)")).otherwise(""), "_sum": F.expr("substring(_l, instr(_l, '*') + 1)"), "_star": star})
    df = df.withColumn("_f", F.split("_body", ","))
    f = lambda k: F.coalesce(F.get("_f", F.lit(k)), F.lit(""))
    head = f(0)
    kind = F.substring(head, 3, 3)
    lat, lat_bad = coordinate(F.when(kind == "GGA", f(2)).otherwise(f(3)), F.when(kind == "GGA", f(3)).otherwise(f(4)), 4, 90.0, ("N", "S"))
    lon, lon_bad = coordinate(F.when(kind == "GGA", f(4)).otherwise(f(5)), F.when(kind == "GGA", f(5)).otherwise(f(6)), 5, 180.0, ("E", "W"))
    sat, sat_bad = number(f(7), 0, 99, whole=True)
    hdop, hdop_bad = number(f(8), 0, 99.9, inclusive=True)
    alt, alt_bad = number(f(9), None, None, signed=True)
    speed, speed_bad = number(f(7), 0, None)
    course, course_bad = number(f(8), 0, 360)
    date = F.try_to_date(F.concat(F.when(F.substring(f(9), 5, 2) >= "80", "19").otherwise("20"), F.substring(f(9), 5, 2), F.substring(f(9), 3, 2), F.substring(f(9), 1, 2)), "yyyyMMdd")
    date_bad = F.when(f(9) == "", F.lit(None).cast("string")).when(~f(9).rlike("^[0-9]{6}$"), "malformed_field").when(date.isNull(), "out_of_range")
    clock = f(1)
    hms = F.substring(clock, 1, 2).try_cast("double") * 3600 + F.substring(clock, 3, 2).try_cast("double") * 60 + F.substring(clock, 5, 20).try_cast("double")
    clock_bad = (
        F.when(clock == "", F.lit(None).cast("string")).when(~clock.rlike(r"^[0-9]{6}(\.[0-9]+)?$"), "malformed_field")
        .when((F.substring(clock, 1, 2) > "23") | (F.substring(clock, 3, 2) > "59") | (F.substring(clock, 5, 20).try_cast("double") >= 60), "out_of_range")
    )
    quality = F.element_at(F.create_map(*(F.lit(x) for kv in QUALITY.items() for x in kv)), f(6))
    quality_bad = F.when(f(6).isin(*QUALITY), F.lit(None).cast("string")).when(f(6).isin("3", "7"), "unsupported_fix_quality").otherwise("out_of_range")
    placed = F.when((quality != "invalid") & (lat.isNull() | lon.isNull()), "malformed_field")
    frame = (
        F.when(F.length("_l") > MAX_LINE, "line_too_long").when(F.length("_l") != F.octet_length("_l"), "non_ascii").when(~F.col("_l").startswith("$"), "not_a_sentence")
        .when(F.col("_star") == 0, "missing_checksum").when(~F.col("_sum").rlike("^[0-9A-Fa-f]{2}$"), "malformed_field").when(F.upper("_sum") != checksum(F.col("_body")), "bad_checksum")
        .when((F.length(head) != 5) | ~head.rlike("^[A-Z]{2}"), "bad_talker").when(~kind.isin("GGA", "RMC"), "unsupported_sentence")
    )
    n = F.size("_f") - 1
    gga = F.coalesce(F.when(n < 14, "too_few_fields"), clock_bad, lat_bad, lon_bad, quality_bad, sat_bad, hdop_bad, alt_bad, placed)
    status_bad = F.when(~f(2).isin("A", "V"), "malformed_field")
    rmc = F.coalesce(F.when(n < 9, "too_few_fields"), clock_bad, status_bad, lat_bad, lon_bad, speed_bad, course_bad, date_bad)
    reason = F.coalesce(frame, F.when(kind == "GGA", gga).otherwise(rmc))
    df = df.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    is_gga, live = kind == "GGA", (kind == "RMC") & (f(2) == "A")
    valid = F.when(is_gga, quality != "invalid").otherwise(live)
    return df.withColumns({
        "sentence": F.when(ok, kind), "latitude": F.when(ok & valid, lat), "longitude": F.when(ok & valid, lon), "quality": F.when(ok & is_gga, quality),
        "satellites": F.when(ok & is_gga, sat).cast("int"), "hdop": F.when(ok & is_gga, hdop), "altitude": F.when(ok & is_gga, alt),
        "speed_mps": F.when(ok & live, speed * KNOT), "course": F.when(ok & live, course), "date": F.when(ok & live, date), "seconds": F.when(ok, hms),
    }).drop("_l", "_body", "_sum", "_star", "_f")


def combine_utc(date: Column, rmc_seconds: Column, gga_seconds: Column) -> Column:
    """The instant of a GGA's time on an RMC's date: more than 12 hours apart rolls over midnight."""
    delta = gga_seconds - rmc_seconds
    days = F.when(delta < -43200, 1).when(delta > 43200, -1).otherwise(0)
    return F.timestamp_micros((F.unix_date(F.date_add(date, days)).cast("long") * 86_400_000_000 + F.round(gga_seconds * 1e6).cast("long")))
