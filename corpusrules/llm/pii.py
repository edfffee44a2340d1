"""Personal data replaced by format-preserving pseudonyms, in native columns.

Validated numbers and dates are permuted within their own format by a keyed Feistel network
over two halves: a card stays a card with a right check digit, a date a date, and equal values
get equal pseudonyms in every document. Numbers that fail validation stay as they are. Mail
addresses, which are no numbers, get a keyed name at ``example.invalid``. The key is a literal of
the plan: treat plan texts and event logs as private.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import col

ROUNDS = 8
KINDS = ("email", "date", "ssn", "card", "phone", "ip")
#: One pattern per kind; each starts only where no longer run of its characters is cut.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_YMD = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}"
_DAY_FIRST = r"\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4}"
_DATE = rf"(?<![\d-])\d{{4}}-\d{{2}}-\d{{2}}(?![\d-])|(?<![\d./-])(?:{_YMD}|{_DAY_FIRST})(?![\d/-]|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
_IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
#: Numbers of ten digits: with a bracket, a + or a last separator that is no blank any area code
#: and exchange are taken, else (blanks only, or no separators) those that can be dialled.
_TEN = (
    r"(?<![\d(+-])(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}"
    r"|(?:1[ .-]?)?(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[.-]\d{4}|[2-9]\d{2}[ .-][2-9]\d{2} \d{4}))(?!\d)"
    r"|(?<![\w.+(/-])1?[2-9]\d{2}[2-9]\d{6}(?![\w/-]|\.\d)"
)
#: Numbers with a country code; a date, card or address behind a + is none.
_WORLD = (
    r"(?<![\w+])\+(?!1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\d{14}|\d{4}[-/.]\d{2}[-/.]\d{2}(?!\d)"
    r"|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?!\d)|\d{3}-\d{2}-\d{4}(?!\d)|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}"
    r"|\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))[1-9](?:[ .-]?\(?\d\)?){7,14}(?!\d)"
)
PATTERN = "|".join((_EMAIL, _DATE, _SSN, _CARD, _TEN, _WORLD, _IP))
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_DATE_WHOLE = rf"^(?:{_YMD}|{_DAY_FIRST})$"

#: Days of the Gregorian cycle of 400 years, as the product of the two halves.
_CYCLE, _DATE_LEFT, _DATE_RIGHT = 146097, 27, 5411
_EPOCH = "0001-01-01"
#: Days of the cycle after the 12th of their month, as the product of the two halves.
_LATE_LEFT, _LATE_RIGHT = 9, 9833
#: Numbers of ten digits that can be dialled, and the others of them.
_DIALLED, _OTHER = 800, 60000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number(text: Column) -> Column:
    return text.cast("long")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn algorithm; the last digit counts once."""

    def one(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda a, b: a + b
    )


def _power(exponent: Column) -> Column:
    return F.rpad(F.lit("1"), exponent + 1, "0").cast("long")


def _order(value: Column) -> tuple[Column, Column, Column]:
    """The parts of a date: is the year first, is the month first, is that against the custom.

    12/31 is month and day, 31.12. and 31-12 day and month; where that gives no month, the other order
    holds, which then has a day after the 12th.
    """
    parts = F.split(value, "[-/.]")
    number = lambda i: F.get(parts, F.lit(i)).cast("int")
    year_first = F.length(F.get(parts, F.lit(0))) == 4
    slash = value.contains("/")
    against = ~year_first & (F.when(slash, number(0)).otherwise(number(1)) > 12)
    return year_first, F.when(against, ~slash).otherwise(slash), against


def _iso(value: Column) -> Column:
    """A date as yyyy-mm-dd (whether or not there is such a day), null for other values."""
    parts = F.split(value, "[-/.]")
    year_first, month_first, _ = _order(value)
    part = lambda i: F.lpad(F.get(parts, F.lit(i)), 2, "0")
    other = F.when(month_first, F.concat_ws("-", F.get(parts, F.lit(2)), part(0), part(1))).otherwise(
        F.concat_ws("-", F.get(parts, F.lit(2)), part(1), part(0))
    )
    return F.when(
        value.rlike(_DATE_WHOLE), F.when(year_first, F.regexp_replace(value, "[/.]", "-")).otherwise(other)
    )


def _late_index(iso: Column) -> Column:
    day = F.to_date(iso)
    months = (F.year(day) - 1) % 400 * 12 + F.month(day)
    return F.datediff(day, F.lit(_EPOCH)) % _CYCLE - 12 * months


def _late_day(index: Column) -> Column:
    """Day of the cycle with that ``_late_index``."""
    first = lambda m: F.datediff(
        F.make_date(F.floor(m / 12).cast("int") + 1, (m % 12).cast("int") + 1, F.lit(1)), F.lit(_EPOCH)
    )
    near = F.floor(index * 4800 / (_LATE_LEFT * _LATE_RIGHT)).cast("int")
    days = F.transform(
        F.sequence(F.greatest(near - 2, F.lit(0)), near + 2),
        lambda m: F.struct((first(m + 1) - 12 * (m + 1)).alias("end"), (index + 12 * (m + 1)).alias("day")),
    )
    return F.get(F.filter(days, lambda x: x["end"] > index), F.lit(0))["day"]


def _kind(value: Column, iso: Column) -> Column:
    """Kind of a match, null where it fails validation."""
    digits = _digits(value)
    octets = F.split(value, r"\.")
    day = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))
    right_octet = lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o)
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(iso.isNotNull(), F.when(day >= F.lit(_EPOCH), F.lit("date")))
        .when(value.startswith("+"), F.lit("phone"))
        .when(
            value.rlike(r"^\d{3}-\d{2}-\d{4}$"),
            F.when(~value.rlike(r"^(?:000|666|9)|-00-|-0000$"), F.lit("ssn")),
        )
        .when(value.rlike(r"^\d+(?:\.\d+){3}$"), F.when(F.forall(octets, right_octet), F.lit("ip")))
        .when(
            F.length(digits) >= 13,
            F.when((_luhn(digits) % 10 == 0) & ~digits.rlike("^0+$"), F.lit("card")),
        )
        .otherwise(F.lit("phone"))
    )


def _dialled(national: Column) -> Column:
    return national.rlike("^[2-9]..[2-9]")


def _world(value: Column) -> Column:
    """Has a country code other than that of the numbers of ten digits."""
    return value.startswith("+") & ~(value.startswith("+1") & (F.length(_digits(value)) == 11))


def _code(value: Column) -> Column:
    """Digits before the number of the subscriber: the country code, if there is one."""
    digits = _digits(value)
    ten = F.substring(digits, F.lit(1), F.length(digits) - 10)
    return F.when(_world(value), F.regexp_extract(digits, _COUNTRY, 0)).otherwise(ten)


def _part(digits: Column, start, length) -> Column:
    return _number(F.substring(digits, F.lit(start), F.lit(length)))


def _halves(value: Column, kind: Column, iso: Column) -> Column:
    """Left and right half of a value as numbers, and the sizes of their domains."""
    digits = _digits(value)
    n = F.length(digits) - 1
    u = F.floor(n / 2).cast("int")
    days = F.datediff(F.to_date(iso), F.lit(_EPOCH)) % _CYCLE
    late = _late_index(iso)
    octet = lambda i: F.get(F.split(value, r"\."), F.lit(i)).cast("long")
    national = F.right(digits, F.lit(10))
    # the number of a number that cannot be dialled: area codes below 200, then the others
    whole = _number(national)
    hole = F.when(whole < 2 * 10**9, whole).otherwise(
        2 * 10**9 + (F.floor(whole / 10**7) - 200) * (2 * 10**6) + whole % 10**7
    )
    subscriber = F.substring(digits, F.length(_code(value)) + 1, F.length(digits))
    m = F.length(subscriber)
    w = F.floor(m / 2).cast("int")

    def halves(left, right, size_left, size_right):
        return F.struct(
            left.cast("long").alias("l"),
            right.cast("long").alias("r"),
            F.lit(size_left).cast("long").alias("a") if isinstance(size_left, int) else size_left.alias("a"),
            F.lit(size_right).cast("long").alias("b") if isinstance(size_right, int) else size_right.alias("b"),
        )

    area = _part(digits, 1, 3)
    return (
        F.when(
            kind == "card",
            halves(
                _number(F.substring(digits, F.lit(1), u)),
                _number(F.substring(digits, u + 1, n - u)),
                _power(u),
                _power(n - u),
            ),
        )
        .when(
            (kind == "date") & _order(value)[2],
            halves(F.floor(late / _LATE_RIGHT), late % _LATE_RIGHT, _LATE_LEFT, _LATE_RIGHT),
        )
        .when(
            kind == "date",
            halves(F.floor(days / _DATE_RIGHT), days % _DATE_RIGHT, _DATE_LEFT, _DATE_RIGHT),
        )
        .when(
            kind == "ssn",
            halves(
                F.when(area > 666, area - 2).otherwise(area - 1),
                (_part(digits, 4, 2) - 1) * 9999 + _part(digits, 6, 4) - 1,
                898,
                99 * 9999,
            ),
        )
        .when(
            (kind == "phone") & _world(value),
            halves(
                _number(F.substring(subscriber, F.lit(1), w)),
                _number(F.substring(subscriber, w + 1, m - w)),
                _power(w),
                _power(m - w),
            ),
        )
        .when(
            (kind == "phone") & ~_dialled(national),
            halves(F.floor(hole / _OTHER), hole % _OTHER, _OTHER, _OTHER),
        )
        .when(
            kind == "phone",
            halves(
                _part(national, 1, 3) - 200,
                (_part(national, 4, 3) - 200) * 10000 + _part(national, 7, 4),
                _DIALLED,
                _DIALLED * 10000,
            ),
        )
        .when(
            kind == "ip",
            halves(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536),
        )
    )


def _feistel(halves: Column, kind: Column, key: str, back: bool = False) -> Column:
    """Alternating rounds: one half is moved round its domain by a keyed hash of the other."""

    def moved(number, other, round_, size):
        text = F.concat_ws(":", F.lit(key), kind, halves["a"], halves["b"], round_, other)
        by = F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")
        return F.pmod(number - by if back else number + by, size)

    def step(s, round_):
        even = round_ % 2 == 0
        return F.struct(
            F.when(even, moved(s["l"], s["r"], round_, halves["a"])).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], round_, halves["b"])).alias("r"),
        )

    rounds = list(range(ROUNDS))
    start = F.struct(halves["l"].alias("l"), halves["r"].alias("r"))
    order = F.array(*[F.lit(i) for i in (rounds[::-1] if back else rounds)])
    return F.aggregate(order, start, step)


def _filled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits`` one after another."""

    def one(i):
        c = F.substring(value, i, F.lit(1))
        before = F.length(_digits(F.substring(value, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _rendered(value: Column, kind: Column, iso: Column, halves: Column, new: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits) - 1
    u = F.floor(n / 2).cast("int")
    pad = lambda number, width: F.lpad(number.cast("string"), width, "0")
    payload = F.concat(pad(new["l"], u), pad(new["r"], n - u))
    check = F.pmod(F.lit(10) - _luhn(F.concat(payload, F.lit("0"))) % 10, F.lit(10))
    cycle = F.floor(F.datediff(F.to_date(iso), F.lit(_EPOCH)) / _CYCLE)
    year_first, month_first, late = _order(value)
    in_cycle = F.when(late, _late_day(new["l"] * _LATE_RIGHT + new["r"])).otherwise(
        new["l"] * _DATE_RIGHT + new["r"]
    )
    day = F.date_add(F.lit(_EPOCH).cast("date"), (cycle * _CYCLE + in_cycle).cast("int"))
    y, mo, d = (F.date_format(day, x) for x in ("yyyy", "MM", "dd"))
    sep = F.regexp_extract(value, "[-/.]", 0)
    date = (
        F.when(year_first, F.concat(y, sep, mo, sep, d))
        .when(month_first, F.concat(mo, sep, d, sep, y))
        .otherwise(F.concat(d, sep, mo, sep, y))
    )
    area = F.when(new["l"] >= 665, new["l"] + 2).otherwise(new["l"] + 1)
    over = lambda number, by: F.floor(number / by).cast("long")
    code = _code(value)
    m = F.length(digits) - F.length(code)
    w = F.floor(m / 2).cast("int")
    hole = new["l"] * _OTHER + new["r"]
    ten = F.when(hole < 2 * 10**9, hole).otherwise(
        (over(hole - 2 * 10**9, 2 * 10**6) + 200) * 10**7 + (hole - 2 * 10**9) % (2 * 10**6)
    )
    return (
        F.when(kind == "card", _filled(value, F.concat(payload, check.cast("string"))))
        .when(kind == "date", date)
        .when(
            kind == "ssn",
            F.concat_ws(
                "-", pad(area, 3), pad(over(new["r"], 9999) + 1, 2), pad(new["r"] % 9999 + 1, 4)
            ),
        )
        .when(
            (kind == "phone") & _world(value),
            _filled(value, F.concat(code, pad(new["l"], w), pad(new["r"], m - w))),
        )
        .when(
            (kind == "phone") & ~_dialled(F.right(digits, F.lit(10))),
            _filled(value, F.concat(code, pad(ten, 10))),
        )
        .when(
            kind == "phone",
            _filled(
                value,
                F.concat(
                    code,
                    pad(new["l"] + 200, 3),
                    pad(over(new["r"], 10000) + 200, 3),
                    pad(new["r"] % 10000, 4),
                ),
            ),
        )
        .when(
            kind == "ip",
            F.concat_ws(
                ".", over(new["l"], 256), new["l"] % 256, over(new["r"], 256), new["r"] % 256
            ),
        )
    )


def _mail(value: Column, key: str) -> Column:
    name = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(value)), 256)
    return F.concat(F.lit("user-"), F.substring(name, 1, 16), F.lit("@example.invalid"))


def pseudonyms(matches: Column, key: str, back: bool = False) -> Column:
    """Array of struct(kind, value, new) for an array of matches; kind is null if invalid."""
    read = F.transform(matches, lambda m: F.struct(m.alias("value"), _iso(m).alias("iso")))
    kinds = F.transform(
        read, lambda x: F.struct(x["value"].alias("value"), x["iso"].alias("iso"), _kind(x["value"], x["iso"]).alias("kind"))
    )
    halves = F.transform(
        kinds,
        lambda x: F.struct(
            x["value"].alias("value"), x["iso"].alias("iso"), x["kind"].alias("kind"),
            _halves(x["value"], x["kind"], x["iso"]).alias("half"),
        ),
    )
    moved = F.transform(
        halves,
        lambda x: F.struct(
            x["value"].alias("value"), x["iso"].alias("iso"), x["kind"].alias("kind"), x["half"].alias("half"),
            F.when(x["half"].isNotNull(), _feistel(x["half"], x["kind"], key, back)).alias("new"),
        ),
    )
    return F.transform(
        moved,
        lambda x: F.struct(
            x["kind"].alias("kind"),
            x["value"].alias("value"),
            F.when(x["kind"] == "email", _mail(x["value"], key))
            .when(x["new"].isNotNull(), _rendered(x["value"], x["kind"], x["iso"], x["half"], x["new"]))
            .otherwise(x["value"])
            .alias("new"),
        ),
    )


def _count(found: Column, kind: str) -> Column:
    some = F.size(F.filter(found, lambda x: x["kind"] == kind))
    return F.when(found.isNull(), F.lit(0)).otherwise(some).cast("long")


def pseudonymise(
    df: DataFrame, key: str, text_col: str = "text", back: bool = False, counts: bool = True
) -> DataFrame:
    """``df`` with ``text_col`` rewritten and, if ``counts``, n_<kind> for each kind.

    A null text stays null and counts 0. Each row stands for itself: no shuffle, and the key
    alone links equal values. ``back`` inverts the permutation of numbers and dates (mail
    addresses stay; a date written without leading zeros comes back with them). Columns named n_<kind>, or beginning with ``__p_``, are replaced.
    """
    made = [f"n_{k}" for k in KINDS] if counts else []
    names = [c for c in df.columns if c not in made or c == text_col]
    text = col(text_col).cast("string")
    some = text.rlike(r"[0-9]{3}|[0-9]\.[0-9]|@[A-Za-z0-9]")
    out = df.select(*[col(c) for c in names]).withColumn(
        "__p_found",
        pseudonyms(F.regexp_extract_all(F.when(some, text), F.lit(PATTERN), F.lit(0)), key, back),
    )
    found = F.col("__p_found")
    gaps = F.split(text, PATTERN, -1)
    glued = F.zip_with(
        gaps, found, lambda gap, x: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(x["new"], F.lit("")))
    )
    rewritten = F.when(F.size(found) > 0, F.array_join(glued, "")).otherwise(text)
    extra = [_count(found, k).alias(f"n_{k}") for k in KINDS] if counts else []
    return out.select(
        *[rewritten.alias(c) if c == text_col else col(c) for c in names], *extra
    )
