"""Format-preserving pseudonyms for personal values in texts.

Values are found by one pattern, validated, and replaced by a keyed permutation of all
values of their format, so a pseudonym is of the same kind and equal values get equal
pseudonyms in every document. The permutation is an alternating Feistel network over a
pair (a, b) with a in Z_m and b in Z_n: even rounds add a keyed hash of b to a, odd ones
a hash of a to b. It is a bijection for every m and n and can be undone with the key.

| kind | valid if | what is permuted |
|---|---|---|
| email | local part and a dotted domain | letters and digits of the local part, base 36, case folded |
| ip | four octets of 0 to 255 | the 32 bits |
| date | a calendar day from 1901 to 2096, ISO, day first, or MM/DD/YYYY if DD is over 12 | the day number (71,589 = 147 x 487 days; month first, among days over 12: 43,365 = 49 x 885) |
| phone | ten digits after +1, 8 to 15 after another +, or a 10-digit form with separators | the last 10 digits, or all if fewer |
| ssn | 3-2-4 digits | the 9 digits |
| card | 13 to 19 digits with a right Luhn digit, from edge to edge of digit groups | all but the first digit and the Luhn digit, which is set anew |

What does not validate stays as it is, and never covers a value beside it: in a run of digit
groups every stretch is tried as a card, stretches with a card's own groups first. Separators, and the lengths of all parts, stay.
NULL texts stay NULL, empty ones empty. The key is part of the plan: hand it out like the
plan's event log.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlkit.llm.common import let, matches, packed, pieces, unpacked

ROUNDS = 10
KINDS = ("email", "ip", "date", "phone", "ssn", "card")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_YEAR = "(?:19(?:0[1-9]|[1-9][0-9])|20(?:[0-8][0-9]|9[0-6]))"
_LEAP = "(?:19(?:0[48]|[2468][048]|[13579][26])|20(?:0[048]|[2468][048]|[13579][26]))"
#: Months and their days; 29 February is apart.
_MONTHS = (
    ("(?:0[13578]|1[02])", "(?:0[1-9]|[12][0-9]|3[01])"),
    ("(?:0[469]|11)", "(?:0[1-9]|[12][0-9]|30)"),
    ("02", "(?:0[1-9]|1[0-9]|2[0-8])"),
)


def _days(form: str) -> str:
    """Pattern of the calendar days of 1901 to 2096 in a form of y, m and d."""
    parts = [(_YEAR, m, d) for m, d in _MONTHS] + [(_LEAP, "02", "29")]
    return "|".join("".join({"y": y, "m": m, "d": d}.get(c, c) for c in form) for y, m, d in parts)


_CODE_1 = r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
_TEN = r"(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})"
#: Looks back over a phone number with + of 8 to 15 digits, which ends here.
#: Written out, since Java allows no counted groups there.
_ENOUGH = rf"(?<=\+[0-9]{'[ .()-]{0,3}[0-9]' * 7}{'(?:[ .()-]{0,3}[0-9])?' * 7}\)?)"
_CARD_GROUPS = r"[0-9]{4}(?:(?:-[0-9]{4}){3}(?:-[0-9]{3})?|(?: [0-9]{4}){3}(?: [0-9]{3})?|-[0-9]{6}-[0-9]{4,5}| [0-9]{6} [0-9]{4,5})(?![A-Za-z0-9])"
#: Each starts at the edge of a run, so a long run is scanned once. All but "card" validate by
#: themselves, so a match that is no value never covers one.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "date": rf"(?<![A-Za-z0-9./-])(?:{_days('y-m-d')}|{_days('d[.]m[.]y')}|{_days('d/m/y')}|{_days('m/d/y')})(?![A-Za-z0-9]|[./-][0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
}
_NEXT = "|".join([*PATTERNS.values(), f"(?<![A-Za-z0-9+]){_TEN}(?![A-Za-z0-9])", _CARD_GROUPS])
#: After +1 ten digits; else groups up to 15 digits, and from 8 on none that begins another value.
PATTERNS["phone"] = (
    rf"(?<![A-Za-z0-9+])(?:{_CODE_1}|{_TEN}|\+[0-9]{{1,15}}+(?:(?!{_ENOUGH}[ .-]?(?:{_NEXT}))"
    rf"(?:[ .-]?\([0-9]{{1,4}}\)(?:[ .-]?[0-9]{{1,15}}+)?|[ .-][0-9]{{1,15}}+)){{0,14}}{_ENOUGH})(?![A-Za-z0-9])"
)
_GROUP = "[0-9]{1,19}+(?![0-9A-Za-z])"
#: A whole run of digit groups; ``_cards`` finds the cards in it.
PATTERNS["card"] = (
    r"(?<![A-Za-z0-9])(?=[0-9](?:[ -]?[0-9]){12})"
    rf"{_GROUP}(?:[ -](?!{'|'.join(PATTERNS.values())}){_GROUP})*+"
)
#: What a card in a run looks like, surest first: its own groups or none, then any stretch from edge to edge.
CARD_SHAPES = ([_CARD_GROUPS, "[0-9]{13,19}(?![0-9])"], [rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])" for n in range(19, 12, -1)])
ANY = "|".join(PATTERNS.values())
DAYS = (147, 487)
FIRST_DAY = "1901-01-01"
#: Days of four years; in each such cycle these are after the 12th of their month.
CYCLE = 1461
LATE_DAYS = [i for i in range(CYCLE) if (date.fromisoformat(FIRST_DAY) + timedelta(i)).day > 12]
CYCLES = 49


def feistel(a: Column, b: Column, m: Column, n: Column, tweak: Column, key: str, undo: bool = False) -> Column:
    """Permute (a, b) of Z_m x Z_n; bigints, struct out."""

    def hashed(x: Column, r: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), x.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), size)

    sign = -1 if undo else 1

    def step(pair: Column, r: Column) -> Column:
        return F.when(
            r % 2 == 0,
            F.struct(F.pmod(pair.a + sign * hashed(pair.b, r, m), m).alias("a"), pair.b.alias("b")),
        ).otherwise(F.struct(pair.a.alias("a"), F.pmod(pair.b + sign * hashed(pair.a, r, n), n).alias("b")))

    rounds = F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS))])
    return F.aggregate(rounds, F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _power(base: int, exponent: Column) -> Column:
    table = F.array(*[F.lit(base**e) for e in range(11)])
    return F.element_at(table, exponent + 1).cast("bigint")


def permute_numeral(value: Column, base: int, tweak: Column, key: str, undo: bool = False) -> Column:
    """Permute a numeral of up to 20 digits of ``base`` (10 or 36, lower case) among those of its length."""
    size = F.length(value)
    left = F.floor(size / 2).cast("int")
    right = (size - left).cast("int")

    def part(text: Column) -> Column:
        return F.coalesce(F.conv(text, base, 10).cast("bigint"), F.lit(0))

    def numeral(number: Column, width: Column) -> Column:
        text = F.lower(F.conv(number.cast("string"), 10, base))
        return F.when(width > 0, F.lpad(text, width, "0")).otherwise("")

    tagged = F.concat_ws(":", tweak, size.cast("string"))
    pair = feistel(
        part(F.substr(value, F.lit(1), left)), part(F.substr(value, left + 1)),
        _power(base, left), _power(base, right), tagged, key, undo,
    )
    return let(pair, lambda p: F.concat(numeral(p.a, left), numeral(p.b, right)))


def _refill(layout: Column, slots: str, chars: Column) -> Column:
    """Put ``chars`` one by one where ``slots`` matched in ``layout``."""
    return F.array_join(
        F.zip_with(pieces(layout, slots), F.split(chars, ""), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), ""
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` plus it valid."""
    chars = F.reverse(F.split(body, ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(-total, F.lit(10)).cast("string")


def _email(value: Column, key: str, undo: bool) -> Column:
    local, rest = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    chars = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", ""))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.length(chars) - 1, F.lit(0)) / 20).cast("int")),
        lambda i: permute_numeral(
            F.substr(chars, i * 20 + 1, F.lit(20)), 36, F.concat(F.lit("email"), i.cast("string")), key, undo
        ),
    )
    return F.concat(_refill(local, "[A-Za-z0-9]", F.array_join(blocks, "")), F.lit("@"), rest)


def _ip(value: Column, key: str, undo: bool) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    size = F.lit(65536).cast("bigint")
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], size, size, F.lit("ip"), key, undo)
    return let(pair, lambda p: F.concat_ws(".", *[
        x.cast("string") for x in (F.floor(p.a / 256), p.a % 256, F.floor(p.b / 256), p.b % 256)]))


def _month_first(value: Column) -> Column:
    return value.contains("/") & (F.substring(value, 4, 2) > "12")


def _day(value: Column) -> Column:
    first, second = F.substring(value, 1, 2), F.substring(value, 4, 2)
    iso = (
        F.when(value.rlike("^[0-9]{4}-"), value)
        .when(_month_first(value), F.concat_ws("-", F.substring(value, 7, 4), first, second))
        .otherwise(F.concat_ws("-", F.substring(value, 7, 4), second, first))
    )
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))


def _date(value: Column, key: str, undo: bool) -> Column:
    day = _day(value).cast("bigint")
    late = F.lit(LATE_DAYS)

    def permuted(a: Column, b: Column, sizes: tuple[int, int], tweak: str) -> Column:
        return feistel(a, b, *[F.lit(n).cast("bigint") for n in sizes], F.lit(tweak), key, undo)

    def shown(number: Column, form: str) -> Column:
        return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), number.cast("int")), form)

    of_all = permuted(F.floor(day / DAYS[1]), day % DAYS[1], DAYS, "date")
    of_late = permuted(
        F.floor(day / CYCLE), F.array_position(late, (day % CYCLE).cast("int")) - 1, (CYCLES, len(LATE_DAYS)), "late date"
    )
    new = let(of_all, lambda p: p.a * DAYS[1] + p.b)
    new_late = let(of_late, lambda p: p.a * CYCLE + F.element_at(late, (p.b + 1).cast("int")))
    return (
        F.when(value.rlike("^[0-9]{4}-"), shown(new, "yyyy-MM-dd"))
        .when(_month_first(value), shown(new_late, "MM/dd/yyyy"))
        .when(value.contains("/"), shown(new, "dd/MM/yyyy"))
        .otherwise(shown(new, "dd.MM.yyyy"))
    )


def _number(value: Column, tweak: str, key: str, undo: bool) -> Column:
    """The last ten digits permuted, what stands before them kept."""
    digits = _digits(value)
    kept = F.greatest(F.length(digits) - 10, F.lit(0))
    new = permute_numeral(F.substr(digits, kept + 1), 10, F.lit(tweak), key, undo)
    return _refill(value, "[0-9]", F.concat(F.substr(digits, F.lit(1), kept), new))


def _card(value: Column, key: str, undo: bool) -> Column:
    digits = _digits(value)
    body = F.concat(
        F.substring(digits, 1, 1),
        permute_numeral(F.substr(digits, F.lit(2), F.length(digits) - 2), 10, F.lit("card"), key, undo),
    )
    return _refill(value, "[0-9]", let(body, lambda b: F.concat(b, luhn_digit(b))))


def _cut(run: Column, shapes: list[str]) -> Column:
    """What stands before, between and after the valid cards of ``shapes``, and the cards: struct of two arrays.

    Every group start is marked with the number of groups of its first valid candidate (a
    letter, z for none), so that one pattern takes the cards from left to right.
    """
    found = F.array(*[F.regexp_extract_all(run, F.lit(f"(?<![0-9])(?=[0-9])(?=({s})?)"), F.lit(1)) for s in shapes])
    groups = F.regexp_extract_all(run, F.lit("[0-9]+[ -]*"), F.lit(0))

    def mark(tried: Column, i: Column) -> Column:
        valid = F.filter(F.transform(tried, lambda f: F.get(f, i)), lambda c: (c != "") & F.call_function("luhn_check", _digits(c)))
        counted = F.transform(valid, lambda c: F.chr(F.size(F.split(c, "[ -]")) + 96))
        return F.coalesce(F.get(counted, F.lit(0)), F.lit("z"))

    lead = F.regexp_extract(run, "^[ -]*", 0)
    marked = F.concat(
        lead, let(found, lambda tried: F.array_join(F.transform(groups, lambda g, i: F.concat(mark(tried, i), g)), ""))
    )
    cards = "|".join(f"{chr(96 + n)}[0-9]+(?:[ -][a-z][0-9]+){{{n - 1}}}" for n in range(1, 20))

    def plain(parts: Column) -> Column:
        return F.transform(parts, lambda x: F.regexp_replace(x, "[a-z]", ""))

    return let(marked, lambda m: F.struct(plain(pieces(m, cards)).alias("gaps"), plain(matches(m, cards)).alias("cards")))


def _parts(run: Column) -> Column:
    """A run in parts, array of (kind, text): cards, and what stands around them with kind NULL."""

    def woven(cut: Column, gap_parts) -> Column:
        card = F.transform(cut.cards, lambda c: F.array(F.struct(F.lit("card").alias("kind"), c.alias("text"))))
        none = F.array().cast("array<struct<kind:string,text:string>>")
        return F.flatten(F.zip_with(cut.gaps, card, lambda g, c: F.concat(gap_parts(g), F.coalesce(c, none))))

    def bare(gap: Column) -> Column:
        return F.array(F.struct(F.lit(None).cast("string").alias("kind"), gap.alias("text")))

    sure, other = CARD_SHAPES
    return let(_cut(run, sure), lambda cut: woven(cut, lambda gap: F.when(
        F.length(_digits(gap)) >= 13, let(_cut(gap, other), lambda c: woven(c, bare))
    ).otherwise(bare(gap))))


def parts_of(value: Column) -> Column:
    """A found value as an array of (kind, text) that add up to it; kind is NULL for what is no value."""

    def as_kind(kind: str) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), value.alias("text")))

    return (
        F.when(value.contains("@"), as_kind("email"))
        .when(value.rlike(rf"\A(?:[+(]|{_TEN}\z)"), as_kind("phone"))
        .when(value.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"), as_kind("ip"))
        .when(value.rlike(r"\A(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})\z"), as_kind("date"))
        .when(value.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), as_kind("ssn"))
        .otherwise(_parts(value))
    )


def pseudonym(value: Column, kind: Column, key: str, undo: bool = False) -> Column:
    return (
        F.when(kind == "email", _email(value, key, undo))
        .when(kind == "ip", _ip(value, key, undo))
        .when(kind == "date", _date(value, key, undo))
        .when(kind == "phone", _number(value, "phone", key, undo))
        .when(kind == "ssn", _number(value, "ssn", key, undo))
        .when(kind == "card", _card(value, key, undo))
        .otherwise(value)
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text", undo: bool = False) -> DataFrame:
    """Every row with its values replaced in ``text``, and ``pii``: array of (kind, new).

    ``undo`` restores the values of texts made with the same key (email local parts come
    back in lower case). An existing column ``pii`` is replaced.
    """
    whole = packed(docs).withColumn("t", F.col(f"row.`{text}`"))

    def values(m: Column) -> Column:
        return F.transform(
            parts_of(m), lambda p: F.struct(p.kind.alias("kind"), pseudonym(p.text, p.kind, key, undo).alias("new"))
        )

    none = F.array().cast("array<array<struct<kind:string,new:string>>>")
    found = whole.withColumn(
        "all", F.when(F.col("t").rlike(ANY), F.transform(matches(F.col("t"), ANY), values)).otherwise(none)
    )

    def joined(parts: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(parts, lambda p: p.new), ""), F.lit(""))

    new = F.zip_with(pieces(F.col("t"), ANY), "all", lambda gap, v: F.concat(gap, joined(v)))
    text_out = F.when(F.size("all") > 0, F.array_join(new, "")).otherwise(F.col("t"))
    return unpacked(found, **{text: text_out, "pii": F.filter(F.flatten("all"), lambda v: v.kind.isNotNull())})


def of_kind(values: str, kind: str) -> Column:
    return F.filter(values, lambda v: v.kind == kind)
