"""Check digits as Column expressions, all on the JVM: EAN-13, modulo 11, modulo 97, recursive modulo 10 and Luhn.

Null values give null; empty and malformed values are invalid (false).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# First row of the carry table of recursive modulo 10 (row r is this row rotated by r), and mod-11 weights.
CARRY = (0, 9, 4, 6, 8, 2, 7, 1, 3, 5)
UID_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ints(d: Column) -> Column:
    return F.transform(F.filter(F.split(d, ""), lambda c: c != ""), lambda c: c.cast("int"))


def ean13_check(first12: Column) -> Column:
    total = F.aggregate(F.transform(_ints(first12), lambda x, i: x * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10))


def _ean13(d: Column) -> Column:
    return d.rlike("^[0-9]{13}$") & (ean13_check(F.substring(d, 1, 12)) == F.substring(d, 13, 1).try_cast("int"))


def valid_ahvn13(value: Column) -> Column:
    d = digits(value)
    return F.when(d.startswith("756"), F.coalesce(_ean13(d), F.lit(False))).when(value.isNotNull(), False)


def valid_gln(value: Column) -> Column:
    return F.when(value.isNotNull(), F.coalesce(_ean13(digits(value)), F.lit(False)))


def uid_check(first8: Column) -> Column:
    """Check digit, or null where the remainder has none."""
    weights = F.array(*[F.lit(w) for w in UID_WEIGHTS])
    total = F.aggregate(F.zip_with(_ints(first8), weights, lambda x, w: x * w), F.lit(0), lambda a, x: a + x)
    check = 11 - total % 11
    return F.when(check == 11, 0).when(check < 10, check)


def valid_uid(value: Column) -> Column:
    core = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    for suffix in ("MWST", "TVA", "IVA", "HR"):
        core = F.regexp_replace(core, f"{suffix}$", "")
    # Nothing but nine digits may follow the country.
    d = F.regexp_extract(core, "^CHE([0-9]{9})$", 1)
    good = (d != "") & (uid_check(F.substring(d, 1, 8)) == F.substring(d, 9, 1).try_cast("int"))
    return F.when(value.isNotNull(), F.coalesce(good, F.lit(False)))


def mod97(compact: Column) -> Column:
    """Remainder of an account number whose first four signs are moved to the end, letters as 10..35; nine digits at a
    time are taken on to the remainder. Null where other signs are left."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    for value in range(10, 36):
        turned = F.replace(turned, F.lit(chr(value + 55)), F.lit(str(value)))

    def rest(number: Column) -> Column:
        r = F.lit("")
        for k in range(8):  # 34 signs have 68 digits at most
            r = (F.concat(r, F.substring(number, 1 + 9 * k, 9)).try_cast("bigint") % 97).cast("string")
        return r.cast("int")

    return bind(turned, rest)


def valid_iban(value: Column, countries: tuple[str, ...] = ("CH", "LI")) -> Column:
    """Without countries, every country counts; Swiss and Liechtenstein numbers have 21 signs."""
    compact = F.upper(F.regexp_replace(value, r"[^A-Za-z0-9]", ""))
    country = F.substring(compact, 1, 2)
    good = F.length(compact).between(15, 34) & compact.rlike("^[A-Z]{2}[0-9]{2}") & (~country.isin("CH", "LI") | (F.length(compact) == 21)) & (mod97(compact) == 1)
    if countries:
        good = good & country.isin(*countries)
    return F.when(value.isNotNull(), F.coalesce(good, F.lit(False)))


def mod10_recursive(number: Column) -> Column:
    table = F.array(*[F.lit(x) for x in CARRY])
    return F.pmod(10 - F.aggregate(_ints(number), F.lit(0), lambda a, x: F.element_at(table, F.pmod(a + x, F.lit(10)) + 1)), F.lit(10))


def valid_qr_reference(value: Column) -> Column:
    d = digits(value)
    good = d.rlike("^[0-9]{27}$") & (mod10_recursive(F.substring(d, 1, 26)) == F.substring(d, 27, 1).try_cast("int"))
    return F.when(value.isNotNull(), F.coalesce(good, F.lit(False)))


def luhn_check(number: Column) -> Column:
    """Check digit to append."""
    rev = F.reverse(_ints(number))
    total = F.aggregate(F.transform(rev, lambda x, i: F.when(i % 2 == 0, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10))


def valid_creditcard(value: Column) -> Column:
    d = digits(value)
    return F.when(value.isNotNull(), F.length(d).between(12, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False)))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "AHVN13": valid_ahvn13,
    "UID": valid_uid,
    "IBAN": valid_iban,
    "QR_REFERENCE": valid_qr_reference,
    "CREDITCARD": valid_creditcard,
    "GLN": valid_gln,
}


def _spread(key: Column, factor: int, width: int) -> Column:
    """A number of the given width from a key: multiplied by a factor prime to the power of ten, so that keys below it
    never meet."""
    return F.lpad(F.pmod(key.cast("decimal(38,0)") * factor, F.lit(str(10**width)).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string"), width, "0")


def make_ahvn13(key: Column) -> Column:
    body = F.concat(F.lit("756"), _spread(key, 7919, 9))
    full = bind(body, lambda b: F.concat(b, ean13_check(b).cast("string")))
    return bind(full, lambda n: F.concat_ws(".", F.substring(n, 1, 3), F.substring(n, 4, 4), F.substring(n, 8, 4), F.substring(n, 12, 2)))


def make_gln(key: Column) -> Column:
    body = F.concat(F.lit("7601"), _spread(key, 7919, 8))
    return F.concat(body, ean13_check(body).cast("string"))


def make_uid(key: Column) -> Column:
    """A number without check digit is replaced by the next one that has one."""
    number = _spread(key, 7919, 8).cast("bigint")
    tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.lpad(F.pmod(number + i, F.lit(10**8)).cast("string"), 8, "0"))
    checked = F.transform(tries, lambda t: F.concat(t, uid_check(t).cast("string")))
    full = F.element_at(F.filter(checked, lambda t: t.isNotNull()), 1)
    return bind(full, lambda n: F.concat(F.lit("CHE-"), F.concat_ws(".", F.substring(n, 1, 3), F.substring(n, 4, 3), F.substring(n, 7, 3))))


def make_iban(key: Column) -> Column:
    account = F.concat(F.lit("00762"), _spread(key, 7919, 12))
    check = F.lpad((98 - mod97(F.concat(F.lit("CH00"), account))).cast("string"), 2, "0")
    full = F.concat(F.lit("CH"), check, account)
    return bind(full, lambda n: F.concat_ws(" ", *[F.substring(n, 1 + 4 * i, 4) for i in range(6)]))


def make_qr_reference(key: Column) -> Column:
    body = _spread(key, 7919, 26)
    full = bind(body, lambda b: F.concat(b, mod10_recursive(b).cast("string")))
    return bind(full, lambda n: F.concat_ws(" ", F.substring(n, 1, 2), *[F.substring(n, 3 + 5 * i, 5) for i in range(5)]))


def make_creditcard(key: Column) -> Column:
    body = F.concat(F.lit("4"), _spread(key, 7919, 14))
    full = bind(body, lambda b: F.concat(b, luhn_check(b).cast("string")))
    return bind(full, lambda n: F.concat_ws(" ", *[F.substring(n, 1 + 4 * i, 4) for i in range(4)]))


GENERATORS: dict[str, Callable[[Column], Column]] = {
    "AHVN13": make_ahvn13,
    "GLN": make_gln,
    "UID": make_uid,
    "IBAN": make_iban,
    "QR_REFERENCE": make_qr_reference,
    "CREDITCARD": make_creditcard,
}
