"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers are validated (check digits, ranges, calendars) and permuted by a keyed Feistel network within the valid values of
their format, and so are dates: a card number becomes another that passes the same check, a date another date written the
same way. Addresses and secrets are permuted character by character within their classes. A permutation gives equal values
equal pseudonyms in all documents, different values different ones, and can be undone with the key alone.

Which value may stand where is found by one pattern, at every place of a text, also within what another place may hold. The
first that is valid is replaced, then the first valid after its end; all else is kept as it is. Of the groups that may make a
card or account number, the longest valid beginning counts, so what follows a number does not hide it.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is looked for, in this order. Fixed formats.
PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*+[=:]\s*+[\"']?(?=[A-Za-z+/_-]*+\d)[A-Za-z0-9+/_-]{8,})",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w]|[./-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?![\w]|[.-]\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|\.\d)",
}
ANY = "|".join(PATTERNS.values())
#: Lengths of account numbers by country, from the register of ISO 13616. Fixed values.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(" ".join(IBAN_COUNTRIES.values()).split())
#: What account numbers begin with: the length of the country, or for others any number of groups, longest first.
IBANS = [
    "^(?:" + "|".join(rf"(?:{c.replace(' ', '|')})\d\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()) + ")(?![A-Z0-9])",
    *(rf"^(?!{_KNOWN})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n}}}{end}(?![A-Z0-9])" for n in range(7, 1, -1) for end in ("(?: ?[A-Z0-9]{1,3})", "")),
]
CARDS = [rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)" for n in range(19, 12, -1)]


def divided(x: Column, y: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", x, y)


@dataclass(frozen=True)
class Feistel:
    """Keyed permutations as column expressions."""

    key: str

    def _number(self, kind: str, turn: Column, x: Column, modulus: Column) -> Column:
        said = F.concat_ws("|", F.lit(self.key), F.lit(kind), turn.cast("string"), x.cast("string"), modulus.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("bigint"), modulus)

    def number(self, kind: str, x: Column, a: Column, b: Column) -> Column:
        """A permutation of 0 .. a * b - 1: a mixed-radix Feistel network on the two digits of x."""
        a, b = a.cast("bigint"), b.cast("bigint")
        start = F.struct(divided(x, b).alias("l"), F.pmod(x, b).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + self._number(kind, i, s["r"], a), a)
            right = F.pmod(s["r"] + self._number(kind, -i, left, b), b)
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn, lambda s: s["l"] * b + s["r"])

    def digits(self, kind: str, d: Column) -> Column:
        """A permutation of the digit strings of each length, up to 18."""
        n = F.length(d)
        small = F.floor(n / 2).cast("int")
        ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
        return F.lpad(self.number(kind, d.cast("bigint"), ten(small), ten(n - small)).cast("string"), n, "0")

    def characters(self, kind: str, s: Column) -> Column:
        """A permutation of the strings of each shape: digits stay digits, letters letters of their case, others as they are."""
        n = F.length(s)
        half = F.floor(n / 2).cast("int")
        halves = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, n).alias("r"))

        def shifted(x: Column, turn: Column, other: Column) -> Column:
            blocks = F.transform(
                F.sequence(F.lit(0), F.floor(F.length(x) / 64).cast("int")),
                lambda b: F.sha2(F.concat_ws("|", F.lit(self.key), F.lit(kind), turn.cast("string"), b.cast("string"), other), 512),
            )

            def one(c: Column, stream: Column) -> Column:
                code, k = F.ascii(c), F.conv(stream, 16, 10).cast("int")
                turned = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + k, F.lit(size)))
                return (
                    F.when((c >= "0") & (c <= "9"), turned(48, 10))
                    .when((c >= "a") & (c <= "z"), turned(97, 26))
                    .when((c >= "A") & (c <= "Z"), turned(65, 26))
                    .otherwise(c)
                )

            # Two hexadecimal digits of the stream for each character; there are more than needed.
            stream = F.regexp_extract_all(F.array_join(blocks, ""), F.lit("(..)"), F.lit(1))
            return F.array_join(F.zip_with(letters(x), stream, one), "")

        def turn(s: Column, i: Column) -> Column:
            left = shifted(s["l"], i, s["r"])
            return F.struct(left.alias("l"), shifted(s["r"], -i, left).alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), halves, turn, lambda s: F.concat(s["l"], s["r"]))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def letters(s: Column) -> Column:
    """The characters of a string."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def filled(shape: Column, pattern: str, values: Column) -> Column:
    """The shape with its characters of a class replaced, in order, by those of another string."""

    def add(s: Column, c: Column) -> Column:
        of_class = c.rlike(f"[{pattern}]")
        new = F.when(of_class, F.substring(s["rest"], 1, 1)).otherwise(c)
        rest = F.when(of_class, F.substring(s["rest"], F.lit(2), F.length(s["rest"]))).otherwise(s["rest"])
        return F.struct(F.concat(s["out"], new).alias("out"), rest.alias("rest"))

    return F.aggregate(letters(shape), F.struct(F.lit("").alias("out"), values.alias("rest")), add, lambda s: s["out"])


def luhn_sum(d: Column, doubled: int) -> Column:
    """Sum of the digits, where every second one from the right is doubled, beginning with the first (0) or second (1)."""

    def value(c: Column, i: Column) -> Column:
        x = c.cast("int")
        twice = 2 * x - F.when(x > 4, 9).otherwise(0)
        return F.when(F.pmod(i, F.lit(2)) == doubled, twice).otherwise(x)

    return F.aggregate(F.transform(letters(F.reverse(d)), value), F.lit(0), lambda a, x: a + x)


def mod97(s: Column) -> Column:
    """Remainder of an IBAN, moved and with letters as numbers."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        value = F.when(letter, F.ascii(c) - 55).otherwise(c.cast("int"))
        return F.pmod(rest * F.when(letter, 100).otherwise(10) + value, F.lit(97))

    return F.aggregate(letters(moved), F.lit(0), add)


#: The Gregorian calendar repeats after 400 years of 146,097 days: 4,800 months of twelve first days, and 9 * 9,833 others. Fixed values.
FIRST_DAY, LAST_DAY, MONTHS, FIRST_DAYS, LATER_RADIX = "1800-01-01", "2199-12-31", 4800, 12, (9, 9833)


def _moved_day(day: Column, f: Feistel) -> Column:
    """A permutation of the days of those 400 years, of the first twelve of the months and of all others apart.

    What is written month first can be read day first only if its day is one of the first twelve, and is then read month
    first. So a date and its image are read the same way in every spelling, and one date has one image in all of them.
    """
    first = F.lit(FIRST_DAY).cast("date")
    month = (F.year(day) - 1800) * 12 + F.month(day) - 1
    early = f.number("early date", (month * FIRST_DAYS + F.dayofmonth(day) - 1).cast("bigint"), F.lit(MONTHS), F.lit(FIRST_DAYS))
    from_early = F.date_add(F.add_months(first, divided(early, F.lit(FIRST_DAYS)).cast("int")), F.pmod(early, F.lit(FIRST_DAYS)).cast("int"))
    # The later days are counted from the first on; of a month's start, those before it.
    before = lambda m: F.datediff(F.add_months(first, m), first) - FIRST_DAYS * m
    later = f.number("later date", (F.datediff(day, first) - FIRST_DAYS * (month + 1)).cast("bigint"), *map(F.lit, LATER_RADIX))

    def from_later(y: Column) -> Column:
        # Months are about equally long: the month is the one reckoned, or one beside it.
        near = divided(y * MONTHS, F.lit(LATER_RADIX[0] * LATER_RADIX[1])).cast("int")
        m = F.array_max(F.filter(F.sequence(F.greatest(near - 2, F.lit(0)), F.least(near + 2, F.lit(MONTHS - 1))), lambda k: before(k) <= y))
        return F.date_add(first, (y + FIRST_DAYS * (m + 1)).cast("int"))

    # An array of one, so that the number is computed once.
    return F.when(F.dayofmonth(day) <= FIRST_DAYS, from_early).otherwise(F.get(F.transform(F.array(later), from_later), F.lit(0)))


def _dates(m: Column, f: Feistel) -> Column:
    def read(pattern: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(pattern)).cast("date")
        valid = day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")) & (F.date_format(day, pattern) == m)
        return F.when(valid, F.struct(day.alias("day"), F.lit(pattern).alias("pattern")))

    found = (
        F.when(m.rlike(r"^\d{4}-"), read("yyyy-MM-dd"))
        .when(m.rlike(r"^\d{4}/"), read("yyyy/MM/dd"))
        .when(m.rlike(r"\."), read("dd.MM.yyyy"))
        .otherwise(F.coalesce(read("MM/dd/yyyy"), read("dd/MM/yyyy")))
    )
    written = lambda x: F.when(x.isNotNull(), F.call_function("date_format", _moved_day(x["day"], f), x["pattern"]))
    return F.get(F.transform(F.array(found), written), F.lit(0))


def _cards(m: Column, f: Feistel) -> Column:
    d = only_digits(m)
    payload = f.digits("card", F.substring(d, F.lit(1), F.length(d) - 1))
    check = F.pmod(10 - F.pmod(luhn_sum(payload, 0), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(d, 1), F.lit(10)) == 0, filled(m, "0-9", F.concat(payload, check.cast("string"))))


def _phones(m: Column, f: Feistel) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}[ .-]", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, filled(rest, "0-9", f.digits("phone", only_digits(rest))))


def _ssns(m: Column, f: Feistel) -> Column:
    # Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
    area, group, serial = (F.regexp_extract(m, r"(\d+)-(\d+)-(\d+)", k).cast("bigint") for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = ((area - 1 - (area > 666).cast("bigint")) * 99 + group - 1) * 9999 + serial - 1
    y = f.number("ssn", x, F.lit(898 * 99), F.lit(9999))
    part = lambda value, size: F.lpad(value.cast("string"), size, "0")
    order = divided(y, F.lit(99 * 9999))
    area = order + 1 + (order >= 665).cast("bigint")
    group = F.pmod(divided(y, F.lit(9999)), F.lit(99)) + 1
    return F.when(valid, F.concat(part(area, 3), F.lit("-"), part(group, 2), F.lit("-"), part(F.pmod(y, F.lit(9999)) + 1, 4)))


def _ips(m: Column, f: Feistel) -> Column:
    x = F.aggregate(F.split(m, r"\."), F.lit(0).cast("bigint"), lambda total, p: total * 256 + p.cast("bigint"))
    y = f.number("ip", x, F.lit(65536), F.lit(65536))
    return F.concat_ws(".", *(F.pmod(F.shiftright(y, 8 * k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)))


def _ibans(m: Column, f: Feistel) -> Column:
    s = F.regexp_replace(m, " ", "")
    rest = f.characters("iban", F.substring(s, F.lit(5), F.length(s)))
    land = F.substring(s, F.lit(1), F.lit(2))
    check = F.lpad((98 - mod97(F.concat(land, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.when(mod97(s) == 1, filled(m, "A-Z0-9", F.concat(land, check, rest)))


def _emails(m: Column, f: Feistel) -> Column:
    # Addresses are equal whatever the case of their letters; the new ones have the same letters in capitals.
    end = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    old = F.substring(m, F.lit(1), F.length(m) - F.length(end))
    cased = F.zip_with(letters(old), letters(f.characters("email", F.lower(old))), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b))
    return F.concat(F.array_join(cased, ""), end)


def _secrets(m: Column, f: Feistel) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_-]+$", 0)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), f.characters("secret", value))


REPLACE = {"secret": _secrets, "email": _emails, "iban": _ibans, "ip": _ips, "date": _dates, "ssn": _ssns, "phone": _phones, "card": _cards}


def _valid_cards(m: Column) -> Column:
    return F.pmod(luhn_sum(only_digits(m), 1), F.lit(10)) == 0


def _valid_ibans(m: Column) -> Column:
    return mod97(F.regexp_replace(m, " ", "")) == 1


#: Kinds of which a match may hold more than the value: its beginnings, longest first, and their check.
BEGINNINGS = {"iban": (IBANS, _valid_ibans), "card": (CARDS, _valid_cards)}


def replaced(m: Column, key: str) -> Column:
    """(kind, value, size) of a match: what replaces its first `size` characters; the value is null if it is not valid."""
    f = Feistel(key)

    def found(kind: str, m: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), REPLACE[kind](m, f).alias("value"), F.length(m).alias("size"))

    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("size"))
    out = none
    for kind in reversed(PATTERNS):
        if kind in BEGINNINGS:
            shapes, valid = BEGINNINGS[kind]
            begins = F.filter(F.array(*(F.regexp_extract(m, shape, 0) for shape in shapes)), lambda x: F.when(x != "", valid(x)).otherwise(False))
            # An array of one, so that the beginning is computed once.
            value = F.coalesce(F.get(F.transform(F.slice(begins, 1, 1), lambda x: found(kind, x)), F.lit(0)), none)
        else:
            value = found(kind, m)
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), value).otherwise(out)
    return out


def _picked(pieces: Column) -> Column:
    """(hit, drop) of each piece (text, found): whether its match is replaced, and how much of its text gives way.

    A piece begins where a match does. Matches are taken in order, if they are valid and the one before has ended.
    """
    none = F.array().cast("array<struct<hit:boolean,drop:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), none.alias("picks"))

    def add(s: Column, x: Column) -> Column:
        hit = x["found"]["value"].isNotNull() & (s["at"] >= s["end"])
        pick = F.struct(hit.alias("hit"), F.when(hit, x["found"]["size"]).otherwise(F.greatest(s["end"] - s["at"], F.lit(0))).alias("drop"))
        return F.struct(
            (s["at"] + F.length(x["text"])).alias("at"),
            F.when(hit, s["at"] + x["found"]["size"]).otherwise(s["end"]).alias("end"),
            F.concat(s["picks"], F.array(pick)).alias("picks"),
        )

    return F.aggregate(pieces, start, add, lambda s: s["picks"])


def pseudonymize(df: DataFrame, text: str, key: str, kinds: str = "pii") -> DataFrame:
    """df with the text column rewritten, and a map from kind to the number of values replaced in the text as column `kinds`.

    Texts are whole and of any length. Null texts stay null and, like texts without personal data, have an empty map. A
    column named `kinds` is replaced; all others are kept, whatever their names. No shuffle.
    """
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = [c for c in df.columns if c != kinds]
    # One column of all that was there, so that no name can clash; one step for each thing that is used more than once.
    rows = df.select(F.struct(*map(name, kept)).alias("row"), name(text).alias("t"))
    # Everything looked for has a digit or an @.
    rows = rows.withColumn("m", F.when(F.col("t").rlike("[0-9@]"), F.regexp_extract_all("t", F.lit(rf"(?=({ANY}))[\s\S]"), F.lit(1))))
    rows = rows.withColumn("found", F.transform("m", lambda m: replaced(m, key)))
    # The text is cut where matches begin; what stands before the first is no piece.
    rows = rows.withColumn("cut", F.when(F.size("m") > 0, F.split("t", f"(?={ANY})", -1)))
    head = F.size("cut") - F.size("m")
    pieces = F.zip_with(F.slice("cut", head + 1, F.size("m")), "found", lambda p, f: F.struct(p.alias("text"), f.alias("found")))
    rows = rows.select("row", "t", F.when(head > 0, F.get("cut", F.lit(0))).otherwise("").alias("head"), pieces.alias("pieces"))
    rows = rows.withColumn("picks", _picked(F.col("pieces")))

    def rewritten(x: Column, pick: Column) -> Column:
        value = F.when(pick["hit"], x["found"]["value"]).otherwise("")
        return F.concat(value, F.substring(x["text"], pick["drop"] + 1, F.length(x["text"])))

    hits = F.filter(F.zip_with("pieces", "picks", lambda x, pick: F.when(pick["hit"], x["found"]["kind"])), lambda k: k.isNotNull())
    new = F.concat(F.col("head"), F.array_join(F.zip_with("pieces", "picks", rewritten), ""))
    rows = rows.select("row", F.coalesce(new, F.col("t")).alias("t"), hits.alias("names"))
    counts = F.transform(F.array_distinct("names"), lambda k: F.struct(k.alias("key"), F.size(F.filter("names", lambda x: x == k)).alias("value")))
    none = F.array().cast("array<struct<key:string,value:int>>")
    columns = [F.col("row")[c].alias(c) if c != text else F.col("t").alias(c) for c in kept]
    return rows.select(*columns, F.map_from_entries(F.coalesce(counts, none)).alias(kinds))
