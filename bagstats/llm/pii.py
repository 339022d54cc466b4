"""Format-preserving pseudonyms for personal data, by DataFrame functions only.

Values that pass the check of their kind are replaced by another valid value of the same kind and
form: a keyed permutation, so that equal values stay equal in every document and no two
different ones become the same.  The permutation is an alternating Feistel network over a list of digits in
mixed bases: in each round every other digit is shifted by a keyed hash of the rest, modulo its own base.

Kinds: payment card numbers (13 to 19 digits, Luhn check), IBANs (modulus 97), dates of 1900 to
2099 (yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy, real days only), US social security numbers, telephone
numbers, IPv4 addresses and the local part of e-mail addresses.  What fails its check is no
personal data and stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IPV4 = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
)
CARD = (
    r"(?<![0-9])(?<![0-9]\.)(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
)
ANY = "|".join([CARD, EMAIL, IBAN, IPV4, DATE, SSN, PHONE])  # the card's group is number 1: it comes first
HINT = r"@|[0-9]{2}|[0-9]\.[0-9]"  # whatever matches ANY holds this
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, YEAR_DAYS = "1900-01-01", (319, 229)  # 1900 to 2099 has 319 * 229 days


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def permuted(values: Column, bases: Column, kind: str, key: str) -> Column:
    """Alternating Feistel network over ``values[i]`` in ``0 .. bases[i] - 1``; one-to-one for every key."""

    def step(state: Column, number: Column) -> Column:
        rest = F.concat_ws(",", F.filter(state, lambda v, j: F.pmod(j + number, F.lit(2)) == 1).cast("array<string>"))

        def shift(v: Column, i: Column) -> Column:
            drawn = F.md5(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), i.cast("string"), rest).cast("binary"))
            number_drawn = F.conv(F.substring(drawn, 1, 12), 16, 10).cast("bigint")
            moved = F.pmod(v.cast("bigint") + number_drawn, F.get(bases, i).cast("bigint")).cast("int")
            return F.when(F.pmod(i + number, F.lit(2)) == 0, moved).otherwise(v)

        return F.transform(state, shift)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), values, step)


def _laid(form: Column, digits: Column) -> Column:
    """The digits set in order into the digit places of a form."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def put(state: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        added = F.when(is_digit, F.get(digits, state["used"]).cast("string")).otherwise(c)
        return F.struct(F.concat(state["text"], added).alias("text"), (state["used"] + is_digit.cast("int")).alias("used"))

    return F.aggregate(_chars(form), start, put, lambda s: s["text"])


def _tens(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(10))


def _luhn_sum(digits: Column, size: Column) -> Column:
    """Luhn sum of the first digits of a number of ``size`` digits."""

    def weigh(d: Column, i: Column) -> Column:
        doubled = F.pmod(size - 1 - i, F.lit(2)) == 1
        return F.when(doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, d: a + d)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    size = F.size(digits)
    front = F.slice(digits, F.lit(1), F.greatest(size - 1, F.lit(0)))
    changed = permuted(front, _tens(front), "card", key)
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(changed, size), F.lit(10)), F.lit(10))
    whole = F.concat(changed, F.array(check))
    return F.when(F.pmod(_luhn_sum(digits, size), F.lit(10)) == 0, _laid(m, whole))


def _iban_rest(text: Column) -> Column:
    """Modulus 97 of a string of digits and capitals, letters standing for 10 to 35."""

    def put(rest: Column, c: Column) -> Column:
        letter = F.instr(F.lit(_LETTERS), c)
        return F.when(letter > 0, F.pmod(rest * 100 + letter + 9, F.lit(97))).otherwise(
            F.pmod(rest * 10 + F.ascii(c) - 48, F.lit(97))
        )

    return F.aggregate(_chars(text), F.lit(0), put)


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    body = F.substring(plain, 5, 40)
    codes, bases = _codes(body)
    changed = _spelled(body, permuted(codes, bases, "iban", key))
    land = F.substring(plain, 1, 2)
    check = F.lpad((F.lit(98) - _iban_rest(F.concat(changed, land, F.lit("00")))).cast("string"), 2, "0")
    whole = _chars(F.concat(land, check, changed))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def put(state: Column, c: Column) -> Column:
        gap = c == " "
        return F.struct(
            F.concat(state["text"], F.when(gap, c).otherwise(F.get(whole, state["used"]))).alias("text"),
            (state["used"] + (~gap).cast("int")).alias("used"),
        )

    valid = _iban_rest(F.concat(body, F.substring(plain, 1, 4))) == 1
    return F.when(valid, F.aggregate(_chars(m), start, put, lambda s: s["text"]))


def _codes(text: Column) -> tuple[Column, Column]:
    """Place of every character in its own alphabet (digits, small or capital letters) and the alphabets' sizes; others have size 1."""
    code = F.ascii
    chars = _chars(text)

    def base(c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1)

    def place(c: Column) -> Column:
        return (
            F.when(c.rlike("^[0-9]$"), code(c) - 48).when(c.rlike("^[A-Z]$"), code(c) - 65).when(c.rlike("^[a-z]$"), code(c) - 97)
        ).otherwise(0)

    return F.transform(chars, place), F.transform(chars, base)


def _spelled(text: Column, codes: Column) -> Column:
    """The characters at the given places of the alphabets of a text's own characters."""

    def put(c: Column, v: Column) -> Column:
        first = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[A-Z]$"), 65).when(c.rlike("^[a-z]$"), 97)
        return F.when(first.isNull(), c).otherwise(F.char(first + v))

    return F.array_join(F.zip_with(_chars(text), codes, put), "")


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    codes, bases = _codes(local)
    return F.concat(_spelled(local, permuted(codes, bases, "email", key)), F.lit("@"), F.substring_index(m, "@", -1))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    changed = permuted(octets, F.transform(octets, lambda _: F.lit(256)), "ipv4", key)
    return F.array_join(changed.cast("array<string>"), ".")


def _date(m: Column, key: str) -> Column:
    parts = F.split(m, "[-/.]")
    ahead = F.length(F.get(parts, F.lit(0))) == 4
    iso = F.when(ahead, F.array_join(parts, "-")).otherwise(F.array_join(F.reverse(parts), "-"))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    rows, columns = YEAR_DAYS
    pair = F.array((number / columns).cast("int"), F.pmod(number, F.lit(columns)))
    changed = permuted(pair, F.array(F.lit(rows), F.lit(columns)), "date", key)
    other = F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(changed, F.lit(0)) * columns + F.get(changed, F.lit(1)))
    sign = F.when(ahead, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    fields = F.split(F.date_format(other, "yyyy-MM-dd"), "-")
    text = F.when(ahead, F.concat_ws("-", fields)).otherwise(F.concat_ws("-", F.reverse(fields)))
    return F.when(number.between(0, rows * columns - 1), F.replace(text, F.lit("-"), sign))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1)
    changed = permuted(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key)
    first = F.get(changed, F.lit(0)) + 1
    first = first + (first >= 666).cast("int")
    text = F.format_string("%03d-%02d-%04d", first, F.get(changed, F.lit(1)) + 1, F.get(changed, F.lit(2)) + 1)
    return F.when(valid, text)


def _phone(m: Column, key: str) -> Column:
    land = F.regexp_extract(m, r"^(\+[0-9]{1,3})[ .(-]", 1)  # the country code stays
    rest = F.substring(m, F.length(land) + 1, F.length(m))
    digits = _digits(rest)
    return F.when(F.size(digits).between(7, 15), F.concat(land, _laid(rest, permuted(digits, _tens(digits), "phone", key))))


KINDS: list[tuple[str, str, Callable[[Column, str], Column]]] = [
    ("email", "@", _email),
    ("iban", "^[A-Z]", _iban),
    ("ipv4", rf"^{_OCTET}(\.{_OCTET}){{3}}$", _ipv4),
    ("date", r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})$", _date),
    ("ssn", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _ssn),
    ("card", r"^[0-9]{13,19}$|^[0-9]{4}[ -][0-9]{4}[ -]|^[0-9]{4}[ -][0-9]{6}[ -]", _card),
    ("phone", r"[0-9]", _phone),
]


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one found string; the string itself if it fails the check of its kind."""
    found = F.lit(None).cast("string")
    for _, form, change in reversed(KINDS):
        found = F.when(match.rlike(form), change(match, key)).otherwise(found)
    return F.coalesce(found, match)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All rows and columns, with the personal data of ``text_col`` replaced and, if named, their number in ``count_col``.

    Texts are as long as before, but for IPv4 addresses, whose numbers may have more or fewer digits.  Null stays null (count 0), an empty text stays empty; repeated rows get
    equal results; a column that has the count's name is replaced.  Nothing is shuffled.  The key appears
    in query plans: whoever may read these can undo the permutation.
    """
    text = F.col(f"`{text_col}`")
    hinted = text.rlike(HINT)
    marked = docs.select(
        "*",
        F.when(hinted, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("__old"),
        F.when(hinted, F.split(text, ANY, -1)).alias("__gaps"),
    )
    changed = marked.select("*", F.transform("__old", lambda m: pseudonym(m, key)).alias("__new"))
    pieces = F.zip_with("__gaps", "__new", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    whole = F.when(F.size("__old") > 0, F.array_join(pieces, "")).otherwise(text)
    number = F.size(F.filter(F.arrays_zip("__old", "__new"), lambda p: p["__old"] != p["__new"]))
    out = [whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    if count_col is not None:
        out.append(F.when(F.size("__old") > 0, number).otherwise(0).alias(count_col))
    return changed.select(*out)
