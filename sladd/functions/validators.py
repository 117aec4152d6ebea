"""Checksum and shape checks. Each returns a Boolean Column: true, false (reject) or null (unknown)."""

from pyspark.sql import Column, functions as F

from sladd.functions.text import digits_only, in_words, is_upper, let, strip

# Checksum weights.
NATIONAL_ID_WEIGHTS = ((3, 7, 6, 1, 8, 9, 4, 5, 2), (5, 4, 3, 2, 7, 6, 5, 4, 3, 2))
ORG_WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)
NHS_WEIGHTS = (10, 9, 8, 7, 6, 5, 4, 3, 2)
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ACN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 1)


#: Groups of hexadecimal digits, and an IPv4 address as the last two of them.
IPV6_GROUPS = r"\A[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*\z"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_TAIL = rf":(?:{_OCTET}\.){{3}}{_OCTET}\z"


def digit_array(chunk: Column) -> Column:
    """The ASCII digits of a chunk as integers; other digits give null elements."""
    return F.transform(F.split(digits_only(chunk), "(?<=.)(?=.)"), lambda c: c.try_cast("int"))


def weighted_sum(digits: Column, weights) -> Column:
    table = F.expr(f"array({', '.join(map(str, weights))})")
    products = F.zip_with(F.slice(digits, 1, len(weights)), table, lambda d, w: d * w)
    return F.aggregate(products, F.lit(0), lambda total, x: total + x)


def mod11_check(digits: Column, weights) -> Column:
    """11 minus the remainder, 11 counting as 0; 10 equals no digit."""
    return (11 - weighted_sum(digits, weights) % 11) % 11


def _sized(chunk: Column, length: int, check) -> Column:
    """``check`` on the digits when there are ``length`` of them, else false."""
    return let(
        digit_array(chunk),
        lambda d: F.when(F.size(d) == length, F.coalesce(check(d), F.lit(False))).otherwise(F.lit(False)),
    )


def valid_national_id(chunk: Column) -> Column:
    def check(d):
        day, month = d[0] * 10 + d[1], d[2] * 10 + d[3]
        return (
            (day.between(1, 31) | day.between(41, 71))
            & (month.between(1, 12) | month.between(21, 32) | month.between(41, 52))
            & (mod11_check(d, NATIONAL_ID_WEIGHTS[0]) == d[9])
            & (mod11_check(d, NATIONAL_ID_WEIGHTS[1]) == d[10])
        )

    return _sized(chunk, 11, check)


def valid_org_number(chunk: Column) -> Column:
    return _sized(chunk, 9, lambda d: (d[0] >= 8) & (mod11_check(d, ORG_WEIGHTS) == d[8]))


def valid_card(chunk: Column) -> Column:
    return let(
        digits_only(chunk), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d)
    )


def valid_iban(chunk: Column) -> Column:
    """Country and check digits to the back, letters as 10 to 35, remainder 97 of 1; digit by digit."""

    def check(code):
        turned = F.concat(F.substring(code, 5, 34), F.substring(code, 1, 4))

        def step(rest, char):
            value = F.ascii(char) - F.when(char.between("A", "Z"), 55).otherwise(48)
            return F.when(value > 9, (rest * 100 + value) % 97).otherwise((rest * 10 + value) % 97)

        chars = F.split(turned, "", 34)
        shape = code.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
        return F.when(shape, F.aggregate(chars, F.lit(0), step) == 1).otherwise(F.lit(False))

    return let(F.upper(F.regexp_replace(chunk, " ", "")), check)


def valid_nhs(chunk: Column) -> Column:
    return _sized(chunk, 10, lambda d: mod11_check(d, NHS_WEIGHTS) == d[9])


def valid_abn(chunk: Column) -> Column:
    """The first digit counts one less."""
    return _sized(chunk, 11, lambda d: (weighted_sum(d, ABN_WEIGHTS) - ABN_WEIGHTS[0]) % 89 == 0)


def valid_acn(chunk: Column) -> Column:
    return _sized(chunk, 9, lambda d: (10 - weighted_sum(d, ACN_WEIGHTS) % 10) % 10 == d[8])


def valid_dea(chunk: Column) -> Column:
    return _sized(chunk, 7, lambda d: (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6])


def valid_ssn(chunk: Column) -> Column:
    """Unknown, or false for areas and groups that are never issued."""
    bad = chunk.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.when(bad, F.lit(False))


def valid_ipv6(chunk: Column) -> Column:
    """Unknown for an IPv6 address, else false: eight groups, or fewer with one ``::``; four octets at the end count as two groups.

    The bare ``::`` is not an address here, as programs use it as an operator.
    """

    def check(t):
        sides = F.split(t, "::", -1)
        plain = F.forall(sides, lambda s: (s == "") | s.rlike(IPV6_GROUPS))
        n = F.regexp_count(t, F.lit("[0-9a-f]+"))
        return plain & F.when(F.size(sides) == 1, n == 8).otherwise((F.size(sides) == 2) & n.between(1, 7))

    groups = F.regexp_replace(F.lower(chunk), IPV4_TAIL, ":0:0")
    return F.when(~let(groups, check), F.lit(False))


def valid_phone_length(chunk: Column) -> Column:
    return F.when(~F.length(digits_only(chunk)).between(8, 15), F.lit(False))


def valid_postal_city(chunk: Column, common) -> Column:
    """Null without a second word; false for an all-caps or common first word; else true."""

    def check(words):
        city = F.get(words, F.lit(1))
        return (
            F.when(city.isNull(), F.lit(None).cast("boolean"))
            .when(is_upper(city), F.lit(False))
            .when(in_words(F.lower(city), common), F.lit(False))
            .otherwise(F.lit(True))
        )

    return let(F.split(strip(chunk), r"(?U)\s+"), check)


def valid_list_name(chunk: Column, common) -> Column:
    """False for a common word, else unknown."""
    return F.when(in_words(F.lower(strip(chunk)), common), F.lit(False))


def verdict(name: str, chunk: Column, lexicon) -> Column:
    """The named check as true / false / null. A failed checksum counts as unknown, never as a rejection."""
    checksums = {
        "national_id": valid_national_id, "org_number": valid_org_number, "card": valid_card, "iban": valid_iban,
        "nhs": valid_nhs, "abn": valid_abn, "acn": valid_acn, "dea": valid_dea,
    }
    if name in checksums:
        return F.when(checksums[name](chunk), F.lit(True))
    if name == "ssn":
        return valid_ssn(chunk)
    if name == "phone_length":
        return valid_phone_length(chunk)
    if name == "ipv6":
        return valid_ipv6(chunk)
    if name == "postal_city":
        return valid_postal_city(chunk, lexicon.common)
    if name == "list_name":
        return valid_list_name(chunk, lexicon.common)
    raise ValueError(f"unknown validator {name!r}")


def apply_validation(valid: Column, score: Column) -> Column:
    """True gives 1.0, unknown keeps the score, false gives null (the hit is dropped)."""
    return F.when(valid.isNull(), score).when(valid, F.lit(1.0))
