"""Instants from mixed timestamp spellings.

Every supported spelling is one branch of a single regular expression with named groups. One
``regexp_replace`` rewrites a value into its components (JVM-side, one match per value); the components are
range-checked and turned into microseconds since 1970-01-01 UTC by integer day arithmetic. Only the
offset of a named zone is looked up, with the engine's own zone rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY = 86_400

#: Names of the months and their short forms in English, German, French and Spanish, without full stop.
MONTH_NAMES = [
    "january jan januar jänner janvier janv enero ene",
    "february feb februar februar février févr fév febrero",
    "march mar märz mär mars marzo",
    "april apr avril avr abril abr",
    "may mai mayo",
    "june jun juni juin junio",
    "july jul juli juillet juil julio",
    "august aug août agosto ago",
    "september sep sept septembre septiembre set",
    "october oct oktober okt octobre octubre",
    "november nov novembre noviembre",
    "december dec dezember dez décembre déc diciembre dic",
]
MONTHS = {name: k + 1 for k, names in enumerate(MONTH_NAMES) for name in names.split()}

#: Zone abbreviations that name one offset, in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
    "NZST": 720, "NZDT": 780,
}

_BLANK = r"[\s\u00a0\u3000\u200b\ufeff]"
_MONTH = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
_CLOCK = r"(?<h{0}>\d{{1,2}}):(?<i{0}>\d{{2}}):(?<s{0}>\d{{2}})"

#: The date branches. Groups: y year, m month number, n month name, d day, p and q the two leading numbers
#: of a date whose order depends on the locale, w and k week and weekday; the branch number keeps the names apart.
_DATES = [
    r"(?<y1>\d{4})(?<x1>[-/.])(?<m1>\d{1,2})\k<x1>(?<d1>\d{1,2})",
    r"(?<y2>\d{4})年(?<m2>\d{1,2})月(?<d2>\d{1,2})日",
    r"(?:[\p{L}]{2,10}\.?,? )?(?<d3>\d{1,2})(?:\.|er)? (?:de )?(?<n3>" + _MONTH + r")\.?,? (?:del? )?(?<y3>\d{4})",
    r"(?:[\p{L}]{2,10}\.?,? )?(?<n4>" + _MONTH + r")\.? (?<d4>\d{1,2})(?:st|nd|rd|th)?,? (?<y4>\d{4})",
    r"(?<p5>\d{1,2})(?<x5>[-/.])(?<q5>\d{1,2})\k<x5>(?<y5>\d{4})",
    r"(?<y6>\d{4})-?w(?<w6>\d{2})-?(?<k6>[1-7])",
]

_TIME = (
    r"(?:(?:t|,|" + _BLANK + r")" + _BLANK + r"*|(?<=日))(?:(?:at|um|à|a las|klockan) )?(?<pre>上午|下午|午前|午後|오전|오후)?" + _BLANK + r"*"
    r"(?:(?<h>\d{1,2})[:時时点點](?<i>\d{2})(?:[:分](?<s>\d{2})(?:[.,](?<f>\d{1,12}))?)?[分秒]?(?:" + _BLANK + r"*(?<ap>[ap])\.?m\.?)?(?:" + _BLANK + r"*uhr)?"
    r"|(?<ha>\d{1,2})" + _BLANK + r"*(?<aq>[ap])\.?m\.?)"
)
_ZONE = (
    r"(?:" + _BLANK + r"+(?<zr>[a-z_]+/[a-z0-9_+\-/]+)|"
    + _BLANK + r"*(?:(?:utc|gmt|z)?(?<os>[+\-\u2212])(?<oh>\d{1,2})(?::?(?<om>\d{2}))?|(?<ab>[a-z]{1,5}))?"
    r"(?:\[(?<zn>[a-z0-9_+\-/]+)\])?)"
)
PATTERN = (
    r"(?iu)\A" + _BLANK + r"*(?:"
    r"(?<ep>\d{9,16})(?:\.(?<ef>\d{1,12}))?"
    r"|(?<cy>\d{4})(?<cm>\d{2})(?<cd>\d{2})(?:t(?<ch>\d{2})(?<ci>\d{2})(?:(?<cs>\d{2})(?:[.,](?<cf>\d{1,12}))?)?(?:(?<cz>z)|(?<cos>[+\-])(?<coh>\d{2}):?(?<com>\d{2})?)?)?"
    r"|(?<yy>\d{4})(?:-(?<ym>\d{2}))?"
    r"|(?:" + "|".join(_DATES) + r")(?:" + _TIME + _ZONE + r")?"
    r"|[a-z]{3} (?<n7>" + _MONTH + r") +(?<d7>\d{1,2}) " + _CLOCK.format(7) + r"(?: (?<ab7>[a-z]{1,5}))? (?<y7>\d{4})"
    r")" + _BLANK + r"*\z"
)


#: Order of the components after the rewrite.
_FIELDS = {
    "year": ["y1", "y2", "y3", "y4", "y5", "y6", "y7", "cy", "yy"],
    "month": ["m1", "m2", "cm", "ym"],
    "name": ["n3", "n4", "n7"],
    "day": ["d1", "d2", "d3", "d4", "d7", "cd"],
    "first": ["p5"],
    "second": ["q5"],
    "hour": ["h", "ha", "h7", "ch"],
    "minute": ["i", "i7", "ci"],
    "sec": ["s", "s7", "cs"],
    "frac": ["f", "cf", "ef"],
    "half": ["pre", "ap", "aq"],
    "sign": ["os", "cos"],
    "oh": ["oh", "coh"],
    "om": ["om", "com"],
    "abbr": ["ab", "ab7", "cz"],
    "zone": ["zn", "zr"],
    "epoch": ["ep"],
    "week": ["w6"],
    "weekday": ["k6"],
}
_MARK = "\u0001"
REPLACEMENT = _MARK + "|".join("".join(f"${{{g}}}" for g in groups) for groups in _FIELDS.values())


def zone_names(spark: SparkSession) -> list[str]:
    """All region names that the engine can resolve."""
    jvm = spark._jvm
    return sorted(str(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds())).split(","))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, by integer arithmetic.

    The year counts from March, so that the leap day is its last; ``(153 * k + 2) div 5`` are the days before
    its month ``k``.
    """
    march = F.when(m <= 2, y - 1).otherwise(y).cast("bigint")
    k = F.pmod(m + 9, F.lit(12)).cast("bigint")
    return march * 365 + F.floor(march / 4) - F.floor(march / 100) + F.floor(march / 400) + F.floor((k * 153 + 2) / 5) + d - 719_469


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _map(values: dict[str, int]) -> Column:
    """A constant map, as one expression."""
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")")


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions the optimizer can neither repeat nor push filters into.

    A row's values pass through a one-element generator; without it, every later use of a long expression
    would be replaced by the expression itself.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def _offset_at(instant: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone)) - instant


def with_instant(df: DataFrame, value: str, out: str, zone: Column | str | None = None, month_first: Column | bool = False) -> DataFrame:
    """Add ``out``: microseconds since 1970-01-01 UTC of the text in ``value``, null where it is not one instant.

    ``zone`` is the region whose wall clock a value without zone shows (a column or a name; null: such values
    have no instant); ``month_first`` tells for which rows a date of numbers that does not begin with the year
    starts with the month. Plain numbers count seconds, milliseconds or microseconds, whichever puts them into
    the years 1990 to 2100. A date, month or year alone is its first moment. Fractions finer than a
    microsecond are cut off. Null, empty and unreadable values, dates that do not exist, and wall clock times
    that a zone shows twice or never give null. A column named ``out`` is
    replaced, also if it is ``value`` itself; names that start with ``_i_`` are reserved; all other columns stay as they are.
    """
    zones = zone_names(df.sparkSession)
    text = F.translate(F.col(value), "０１２３４５６７８９：／－．＋", "0123456789:/-.+")
    step = df.withColumn("_i_raw", F.regexp_replace(text, F.lit(PATTERN), F.lit(REPLACEMENT)))
    step = bound(step, {"_i_part": F.when(F.col("_i_raw").startswith(_MARK), F.split(F.substring(F.col("_i_raw"), 2, 400), r"\|", -1))})
    at = {k: F.col("_i_part")[n] for n, k in enumerate(_FIELDS)}
    num = lambda k: F.when(at[k] != "", at[k].cast("bigint"))  # noqa: E731  # digits or nothing; failed casts are slow
    first, second = num("first"), num("second")
    if isinstance(month_first, bool):
        month_first = F.lit(month_first)
    lead = F.coalesce(month_first, F.lit(False))
    by_name = F.try_element_at(_map(MONTHS), F.lower(at["name"])).cast("bigint")
    dated = F.coalesce(num("month"), F.when(at["name"] != "", by_name), F.when(lead, first).otherwise(second), F.lit(1))
    day = F.coalesce(num("day"), F.when(lead, second).otherwise(first), F.lit(1))
    half = F.when(F.lower(at["half"]).isin("p", "下午", "午後", "오후"), "p").when(at["half"] != "", "a").otherwise("")
    micros = lambda k: F.rpad(F.substring(at[k], 1, 6), 6, "0").cast("bigint")
    abbr = _map(ABBREVIATIONS)
    region = F.lit(zone) if isinstance(zone, str) else zone if zone is not None else F.lit(None).cast("string")
    step = bound(step, {
        "_i_y": num("year"), "_i_m": dated, "_i_d": day, "_i_h": F.coalesce(num("hour"), F.lit(0)), "_i_n": F.coalesce(num("minute"), F.lit(0)),
        "_i_s": F.coalesce(num("sec"), F.lit(0)), "_i_f": F.when(at["frac"] != "", micros("frac")).otherwise(0), "_i_half": half, "_i_ep": num("epoch"),
        "_i_w": num("week"), "_i_k": num("weekday"), "_i_oh": num("oh"), "_i_om": F.coalesce(num("om"), F.lit(0)),
    })
    c = F.col
    hour = F.when(c("_i_half") == "", c("_i_h")).when(c("_i_half") == "p", c("_i_h") % 12 + 12).otherwise(c("_i_h") % 12)
    noon_ok = (c("_i_half") == "") | (c("_i_h") <= 12)
    valid = (
        c("_i_y").between(1, 9999) & c("_i_m").between(1, 12) & (c("_i_d") >= 1) & (c("_i_d") <= days_in_month(c("_i_y"), c("_i_m")))
        & c("_i_h").between(0, 23) & c("_i_n").between(0, 59) & c("_i_s").between(0, 59) & noon_ok
    )
    # Week 1 holds January 4; a year whose week 53 begins in the next year has none.
    fourth, next_fourth = (days_from_civil(c("_i_y") + k, F.lit(1), F.lit(4)) for k in (0, 1))
    monday = lambda day: day - F.pmod(day + 3, F.lit(7))
    by_week = monday(fourth) + (c("_i_w") - 1) * 7
    by_week = F.when((c("_i_w") >= 1) & (by_week < monday(next_fourth)), by_week + c("_i_k") - 1)
    step = bound(step, {"_i_days": F.when(valid, F.when(c("_i_w").isNotNull(), by_week).otherwise(days_from_civil(c("_i_y"), c("_i_m"), c("_i_d"))))})
    seconds = c("_i_days") * DAY + hour * 3600 + c("_i_n") * 60 + c("_i_s")
    offset = F.when(
        at["sign"] != "",
        F.when(c("_i_oh").between(0, 18) & c("_i_om").between(0, 59), (c("_i_oh") * 60 + c("_i_om")) * F.when(at["sign"] == "+", 1).otherwise(-1)),
    ).when(at["abbr"] != "", F.try_element_at(abbr, F.upper(at["abbr"])))
    stated = (at["sign"] != "") | (at["abbr"] != "")
    own = F.when(at["zone"] != "", at["zone"]).otherwise(region)
    step = bound(step, {"_i_wall": (seconds * MICROS + c("_i_f")).cast("bigint"), "_i_off": offset, "_i_stated": stated, "_i_zone": own})
    # A wall clock time is one instant if just one of the offsets in force a day before and a day after fits.
    listed = F.expr("_i_zone in (" + ",".join(f"'{z}'" for z in zones) + ")")
    own = F.when(~c("_i_stated") & c("_i_wall").isNotNull() & listed, c("_i_zone"))
    step = step.withColumn("_i_zone", own)
    day = DAY * MICROS
    step = bound(step, {"_i_a": c("_i_wall") - _offset_at(c("_i_wall") - day, c("_i_zone")), "_i_b": c("_i_wall") - _offset_at(c("_i_wall") + day, c("_i_zone"))})
    fits = lambda k: c(k) + _offset_at(c(k), c("_i_zone")) == c("_i_wall")
    step = bound(step, {"_i_aok": fits("_i_a"), "_i_bok": fits("_i_b")})
    one = F.when((c("_i_a") == c("_i_b")) & c("_i_aok"), c("_i_a")).when(c("_i_a") == c("_i_b"), None).when(c("_i_aok") & ~c("_i_bok"), c("_i_a")).when(c("_i_bok") & ~c("_i_aok"), c("_i_b"))
    e, scale = c("_i_ep"), F.lit(None).cast("bigint")
    for unit in (MICROS, 1000, 1):
        low, high = 631_152_000 * MICROS // unit, 4_102_444_800 * MICROS // unit
        scale = F.when(e.between(low, high), F.lit(unit)).otherwise(scale)
    step = step.withColumn("_i_scale", scale)
    fine = F.when(c("_i_scale") == MICROS, c("_i_f")).when(c("_i_scale") == 1000, F.floor(c("_i_f") / 1000)).otherwise(0)
    numeric = (e * c("_i_scale") + fine).cast("bigint")
    result = F.when(e.isNotNull(), numeric).when(c("_i_stated"), c("_i_wall") - c("_i_off") * (60 * MICROS)).otherwise(one).cast("bigint")
    helpers = [x for x in step.columns if x.startswith("_i_")]
    return bound(step, {"_i_out": result}).drop(*helpers).withColumn(out, c("_i_out")).drop("_i_out")
