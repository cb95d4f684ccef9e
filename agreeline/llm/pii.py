"""Pseudonyms for personal data that keep the format, with DataFrame functions only.

Numbers and dates that pass their validity test are permuted by a keyed Feistel network over the
set of valid values of their format, so the result is valid again, equal values get equal
pseudonyms in every document, and different values stay different:

* card numbers (13 to 19 digits, Luhn): all digits but the last, which is computed anew;
* social security numbers: over all numbers that can be issued;
* phone numbers: all national digits, leading ones within 2 to 9 where the plan asks for it;
* IPv4 addresses: over all addresses;
* dates from 1800 to 2199, in ISO order, with slashes or with dots: over all days of these years,
  the same day in each format;
* e-mail addresses: the letters and digits before the @, each within its kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: Days of 400 years from 1800 on are 189 * 773.
DAYS = (189, 773)
FIRST_DAY = "1800-01-01"
#: Social security areas 001 to 899 without 666; groups 01 to 99 times serials 0001 to 9999.
SSN = (898, 99 * 9999)

EDGE, END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: The end of a mail address: a label of letters only. A candidate has such a label; its labels are
#: taken by a possessive group, which Java's engine runs through in a loop, however many there are.
LABEL_END = r"\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9.-]*?" + LABEL_END + r")[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: A candidate up to its last label of letters only.
ADDRESS = r"^[^@]++@[A-Za-z0-9.-]+(?<=\.[A-Za-z]{2,24})(?![A-Za-z0-9-])"
#: In ISO order only days that exist, since their dashes could be those of a card.
LEAP = r"(?:(?:1[89]|2[01])(?:0[48]|[2468][048]|[13579][26])|2000)"
ISO = r"(?:(?:1[89]|2[01])[0-9]{2}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))|" + LEAP + "-02-29)"
DATE = EDGE + "(?:" + ISO + r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})" + END
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
SOCIAL = EDGE + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + END
#: Card numbers as they are printed, in one piece or in like groups.
PRINTED = r"[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}"
NEAT = r"^(?:[0-9]{13,19}|" + PRINTED + ")(?![0-9])"
NATIONAL = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
PHONE = r"(?<![0-9A-Za-z+])(?:" + NATIONAL + r"|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4})" + END
#: A phone number that doesn't go on into groups printed like a card.
ALONE = r"(?<![0-9A-Za-z+])(?:" + NATIONAL + r"|\+[0-9]{1,3}(?:(?![ .-]?(?:" + PRINTED + r")(?![0-9]))[ .-]?\(?[0-9]{2,4}\)?){2,4})" + END
CARD = EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + END
#: Digit groups, one blank or dash between them, of 13 digits or more; and what begins at each group.
RUN = EDGE + r"\+?(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+"
HEADS = r"(?<![0-9])(?=([0-9][0-9 -]{0,37}))"
#: Cards of a run that are gathered at a time.
FINDS = 64
ANY = "|".join((EMAIL, DATE, IPV4, SOCIAL, ALONE))


def session_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms from the session's setting ``agreeline.pii.key``; where that is
    unset, as in tests, a key that everyone knows."""
    return spark.conf.get("agreeline.pii.key", "for tests only")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def hashed(key: str, tag: str, turn: Column | int, value: Column) -> Column:
    """64 hexadecimal digits that follow from the key, the format, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), F.lit(turn).cast("string"), value).cast("binary"), 256)


def feistel_pair(key: str, tag: str, left: Column, right: Column, sizes: tuple[int, int]) -> Column:
    """A permutation of pairs (left, right) below the two sizes: one side is shifted by a hash of
    the other, in turns."""
    number = lambda h: F.conv(F.substring(h, 1, 12), 16, 10).cast("long")
    step = lambda a, turn: F.when(
        turn % 2 == 0,
        F.struct(F.pmod(a["l"] + number(hashed(key, tag, turn, a["r"].cast("string"))), F.lit(sizes[0])).alias("l"), a["r"].alias("r")),
    ).otherwise(F.struct(a["l"].alias("l"), F.pmod(a["r"] + number(hashed(key, tag, turn, a["l"].cast("string"))), F.lit(sizes[1])).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def feistel_chars(key: str, tag: str, chars: Column, radix: Column, low: Column) -> Column:
    """A permutation of strings: ``chars`` are code points, of which each may become any from its
    ``low`` on, ``radix`` of them; radix 1 keeps a character. The halves shift each other in turns."""
    half = F.floor(F.size(chars) / 2).cast("int")
    values = F.zip_with(chars, low, lambda c, b: c - b)

    def step(a: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        other = F.when(even, F.slice(a, half + 1, F.size(a) - half)).otherwise(F.slice(a, F.lit(1), half))
        shifted = lambda h: F.transform(
            a,
            lambda x, i: F.when((i < half) == even, F.pmod(x + F.conv(F.substr(h, 1 + 4 * (i % 16), F.lit(4)), 16, 10).cast("int"), F.get(radix, i))).otherwise(x),
        )
        return let(hashed(key, tag, turn, F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), shifted)

    return F.zip_with(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, step), low, lambda x, b: x + b)


def codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def text_of(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.char(p)), "")


def is_digit(c: Column) -> Column:
    return c.between(48, 57)


def luhn(digits: Column) -> Column:
    """The Luhn sum of digits, of which the last is a check digit."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - 1 - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def number_digits(text: Column) -> Column:
    return F.transform(codes(F.regexp_replace(text, "[^0-9]", "")), lambda c: c - 48)


def is_card(m: Column) -> Column:
    return m.rlike(f"^(?:{CARD})$") & (luhn(number_digits(m)) % 10 == 0)


def card(key: str, m: Column) -> Column:
    """All digits but the last are permuted among the numbers of that length; blanks and dashes stay."""
    digits = number_digits(m)
    tag = F.size(digits)

    def place(new: Column) -> Column:  # the digits back into the places of the old ones
        return F.aggregate(
            codes(m), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
            lambda a, c: F.struct((a["i"] + is_digit(c).cast("int")).alias("i"), F.concat(a["out"], F.when(is_digit(c), F.get(new, a["i"]).cast("string")).otherwise(F.char(c))).alias("out")),
        )["out"]

    payload = F.slice(digits, F.lit(1), tag - 1)
    ten, zero = F.transform(payload, lambda _: F.lit(10)), F.transform(payload, lambda _: F.lit(0))
    permuted = feistel_chars(key, "card", payload, ten, zero)
    return let(permuted, lambda p: place(F.concat(p, F.array(F.pmod(10 - luhn(F.concat(p, F.array(F.lit(0)))) % 10, F.lit(10)).cast("int")))))


def phone(key: str, m: Column) -> Column:
    national = ~m.startswith("+") | m.rlike(r"^\+1(?![0-9]) ?") | m.rlike(r"^\+1[0-9(]")
    after = lambda i: F.length(F.regexp_replace(F.substr(m, i + 2), "[^0-9]", ""))  # noqa: E731  digits that follow
    before = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i), "[^0-9]", ""))
    points = codes(m)
    lead = lambda c, i: national & after(i).isin(9, 6) & (c >= 50)
    fixed = lambda c, i: ~is_digit(c) | F.when(national, after(i) > 9).otherwise(before(i) < 2)
    ones = lambda c, i: national & after(i).isin(9, 6) & (c < 50)
    low = F.transform(points, lambda c, i: F.when(fixed(c, i), c).when(lead(c, i), 50).otherwise(48))
    radix = F.transform(points, lambda c, i: F.when(fixed(c, i), 1).when(lead(c, i), 8).when(ones(c, i), 2).otherwise(10))
    return text_of(feistel_chars(key, "phone", points, radix, low))


def email(key: str, m: Column) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    points = codes(local)
    kind = lambda c: F.when(is_digit(c), 48).when(c.between(97, 122), 97).when(c.between(65, 90), 65)
    low = F.transform(points, lambda c: F.coalesce(kind(c), c))
    radix = F.transform(points, lambda c: F.when(is_digit(c), 10).when(kind(c).isNotNull(), 26).otherwise(1))
    return F.concat(text_of(feistel_chars(key, "email", points, radix, low)), F.lit("@"), domain)


def ipv4(key: str, m: Column) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    new = feistel_pair(key, "ipv4", p[0] * 256 + p[1], p[2] * 256 + p[3], (65536, 65536))
    return let(new, lambda x: F.concat_ws(".", *[(F.floor(x[s] / 256) if high else x[s] % 256).cast("string") for s in "lr" for high in (True, False)]))


def is_ipv4(m: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return m.rlike(rf"^(?:{octet}\.){{3}}{octet}$")


def is_social(m: Column) -> Column:
    return m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def social(key: str, m: Column) -> Column:
    p = F.transform(F.split(m, "-"), lambda x: x.cast("int"))
    area = F.when(p[0] > 666, p[0] - 2).otherwise(p[0] - 1)
    new = feistel_pair(key, "social", area, (p[1] - 1) * 9999 + p[2] - 1, SSN)
    back = lambda a: F.when(a >= 665, a + 2).otherwise(a + 1)
    return let(new, lambda x: F.concat_ws("-", F.lpad(back(x["l"]).cast("string"), 3, "0"), F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0")))


def day_of(m: Column) -> Column:
    """The day that a date names, null if there is none; with slashes the month comes first unless
    only the other order is a date."""
    p = F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int"))
    make = lambda y, mo, d: F.when(p[y].between(1800, 2199), F.try_to_date(F.concat_ws("-", F.lpad(p[y].cast("string"), 4, "0"), F.lpad(p[mo].cast("string"), 2, "0"), F.lpad(p[d].cast("string"), 2, "0"))))
    return F.when(m.contains("-"), make(0, 1, 2)).when(m.contains("/"), F.coalesce(make(2, 0, 1), make(2, 1, 0))).otherwise(make(2, 1, 0))


def date(key: str, m: Column) -> Column:
    day = F.datediff(day_of(m), F.lit(FIRST_DAY).cast("date"))
    new = feistel_pair(key, "date", F.floor(day / DAYS[1]), day % DAYS[1], DAYS)
    first = F.split(m, "[/.]")
    month_first = m.contains("/") & (F.get(first, F.lit(0)).cast("int") <= 12)
    wide = F.length(m) >= 10
    say = lambda d: F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(
        m.contains("/"),
        F.when(month_first, F.when(wide, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "M/d/yyyy"))).otherwise(F.date_format(d, "dd/MM/yyyy")),
    ).otherwise(F.when(wide, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "d.M.yyyy")))
    return let(new, lambda x: say(F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * DAYS[1] + x["r"]).cast("int"))))


def kind_of(m: Column) -> Column:
    """What a candidate is, null if it isn't valid."""
    return (
        F.when(m.contains("@"), F.when(m.rlike(ADDRESS + "$"), "email"))
        .when(m.rlike(f"^(?:{DATE})$"), F.when(day_of(m).isNotNull(), "date"))
        .when(m.rlike(f"^(?:{IPV4})$"), F.when(is_ipv4(m), "ipv4"))
        .when(m.rlike(f"^(?:{SOCIAL})$"), F.when(is_social(m), "social"))
        .when(is_card(m), "card")
        .when(m.rlike(f"^(?:{PHONE})$"), "phone")
    )


KINDS = {"email": email, "date": date, "ipv4": ipv4, "social": social, "card": card, "phone": phone}


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    out = F.when(F.lit(False), m)
    for name, f in KINDS.items():
        out = out.when(kind == name, f(key, m))
    return out.otherwise(m)


def part(kind: Column | None, value: Column) -> Column:
    return F.struct((F.lit(None).cast("string") if kind is None else kind).alias("kind"), value.alias("value"))


def none_of(value: Column) -> Column:
    """An empty array of parts."""
    return F.filter(F.array(part(None, value)), lambda _: F.lit(False))


def search(parts: Column, pattern: str, inside: Callable[[Column], Column]) -> Column:
    """The parts of a text, where each one without a kind is searched: what matches becomes the parts
    that ``inside`` makes of it, and a part without any find stays whole. Matches begin and end at
    the borders of words, so those of a part are the same as those of the whole text."""

    def one(s: Column) -> Column:
        found = lambda hits: F.when(
            F.exists(hits, lambda h: F.exists(h, lambda x: x["kind"].isNotNull())),
            F.flatten(F.zip_with(F.split(s["value"], pattern, -1), hits, lambda p, h: F.concat(F.array(part(None, p)), F.coalesce(h, none_of(p))))),
        ).otherwise(F.array(s))
        hits = F.transform(F.regexp_extract_all(s["value"], F.lit(pattern), F.lit(0)), inside)
        return F.when(s["kind"].isNull(), let(hits, found)).otherwise(F.array(s))

    return F.flatten(F.transform(parts, one))


def printed_card(head: Column) -> Column:
    """The card number, printed as usual, with which a text begins; null if there is none."""
    return let(F.regexp_extract(head, NEAT, 0), lambda m: F.when((m != "") & is_card(m), m))


def any_card(head: Column) -> Column:
    """The same with blanks and dashes anywhere; among several lengths the commoner ones first."""
    one = lambda n: let(F.regexp_extract(head, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0), lambda m: F.when((m != "") & is_card(m), m))
    return F.coalesce(*[one(n) for n in (16, 15, 14, 13, 19, 18, 17)])


def cards(run: Column, begins: Callable[[Column], Column]) -> Column:
    """The parts of a run of digit groups: every group is tried as a card's first one, from the left."""

    def chosen(tried: Column, groups: Column) -> Column:  # groups have the signs before them
        # groups are picked by index and finds gathered a few at a time: slices and a growing array would be copied at each find
        text = lambda start, end: F.when(end > start, F.array_join(F.transform(F.sequence(start, end - 1), lambda i: groups[i]), "")).otherwise("")

        def take(a: Column, x: Column) -> Column:
            before = F.concat(text(a["free"], x["i"]), F.regexp_extract(groups[x["i"]], "^[ +-]*", 0))
            return F.when(x["i"] < a["free"], a).otherwise(
                F.struct((x["i"] + F.size(F.split(x["m"], "[ -]"))).alias("free"), F.concat(a["out"], F.array(part(None, before), part(F.lit("card"), x["m"]))).alias("out"))
            )

        def some(a: Column, c: Column) -> Column:
            places = F.sequence(c * FINDS, F.least((c + 1) * FINDS, F.size(tried)) - 1)
            begin = F.struct(a["free"].alias("free"), none_of(run).alias("out"))
            done = F.aggregate(places, begin, lambda b, i: take(b, tried[i]))
            return let(done, lambda b: F.struct(b["free"].alias("free"), F.concat(a["out"], F.array(b["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("free"), F.filter(F.array(none_of(run)), lambda _: F.lit(False)).alias("out"))
        last = lambda a: F.concat(F.flatten(a["out"]), F.array(part(None, text(a["free"], F.size(groups)))))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(tried) - 1) / FINDS).cast("int")), start, some, last)

    heads = F.regexp_extract_all(run, F.lit(HEADS), F.lit(1))
    tried = F.filter(F.transform(heads, lambda h, i: F.struct(i.alias("i"), begins(h).alias("m"))), lambda x: x["m"].isNotNull())
    groups = F.regexp_extract_all(run, F.lit("[ -]?[+]?[0-9]+"), F.lit(0))
    return let(tried, lambda t: F.when(F.size(t) > 0, let(groups, lambda g: chosen(t, g))).otherwise(F.array(part(None, run))))


def own_forms(m: Column) -> Column:
    """The parts of a candidate with a form of its own: a mail address ends with its last label of
    letters only, and what follows it is searched on."""
    split = lambda e: F.when(e == "", F.array(part(None, m))).otherwise(F.array(part(F.lit("email"), e), part(None, F.substr(m, F.length(e) + 1))))
    return F.when(m.contains("@"), let(F.regexp_extract(m, ADDRESS, 0), split)).otherwise(F.array(part(kind_of(m), m)))


#: What has a form of its own comes first, then cards printed as usual, phone numbers that go on into
#: such groups, and at last cards in any digit groups that are left, a whole run before what is inside it.
SEARCHES = (
    (ANY, own_forms),
    (RUN, lambda m: cards(m, printed_card)),
    (PHONE, lambda m: F.array(part(F.lit("phone"), m))),
    (RUN, lambda m: F.when(is_card(m), F.array(part(F.lit("card"), m))).otherwise(cards(m, any_card))),
)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with each valid number, date and address of the text replaced by its pseudonym.

    ``key`` is the caller's secret: who has it can tell what a pseudonym stands for. All other
    characters, and candidates that aren't valid, stay as they are; a null text stays null and an empty
    one empty; other columns, whatever their names, and the rows' number and repeats are kept. With
    ``found``, a column of that name lists kind, value and pseudonym in the order of the text. Each row
    is worked on alone, whole whatever its length: nothing is shuffled, and no pattern recurs with it.
    """
    col, (_, spans) = F.col(f"`{text}`"), fresh(docs, found or "found", "spans")
    # only texts with a digit or an @ are searched, once
    one = lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), pseudonym(key, s["kind"], s["value"]).alias("pseudonym"))
    out = docs.withColumn(spans, F.when(col.rlike("[0-9@]"), F.array(part(None, col))))
    for pattern, inside in SEARCHES:
        out = out.withColumn(spans, search(F.col(spans), pattern, inside))
    out = out.withColumn(spans, F.transform(spans, one))
    joined = F.array_join(F.transform(F.col(spans), lambda s: s["pseudonym"]), "")
    out = out.withColumn(text, F.when(F.col(spans).isNull(), col).otherwise(joined))
    if found:
        valid = F.filter(F.col(spans), lambda s: s["kind"].isNotNull())
        out = out.withColumn(found, F.coalesce(valid, F.filter(F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value"), F.lit("").alias("pseudonym"))), lambda s: F.lit(False))))
    return out.drop(spans)
