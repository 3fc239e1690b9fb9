"""Checksum validators and maskers for matched values, as column expressions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .identity import strip

#: The resident-number checksum weights and the entropy floors.
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
ENTROPY_B64 = 4.5
ENTROPY_HEX = 3.0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def resident_number_ok(value: Column) -> Column:
    d = digits(value)
    weighted = F.aggregate(
        F.zip_with(F.split(F.substring(d, 1, 12), ""), F.array(*[F.lit(w) for w in RRN_WEIGHTS]),
                   lambda c, w: c.try_cast("int") * w),
        F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    month, day = F.substring(d, 3, 2).try_cast("int"), F.substring(d, 5, 2).try_cast("int")
    return F.when(F.length(d) == 13,
                  month.between(1, 12) & day.between(1, 31)
                  & ((11 - weighted % 11) % 10 == F.substring(d, 13, 1).try_cast("int"))).otherwise(False)


def card_number_ok(value: Column) -> Column:
    d = digits(value)
    return (F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*$") & F.call_function("luhn_check", d))


def shannon_bits(value: Column) -> Column:
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    total = F.length(value).cast("double")
    return F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda acc, ch: acc - (lambda p: p * F.log2(p))(
            F.size(F.filter(chars, lambda c: c == ch)).cast("double") / total))


def mask_generic(value: Column) -> Column:
    v = strip(value)
    n = F.length(v)
    return F.when(n <= 6, F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), n - 1))).otherwise(
        F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), F.least(F.lit(12), n - 6)), F.right(v, F.lit(2))))


def mask_resident_number(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) == 13, F.concat(F.substring(d, 1, 6), F.lit("-"), F.substring(d, 7, 1),
                                              F.lit("******"))).otherwise(mask_generic(value))


def mask_phone(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) >= 8, F.concat(F.substring(d, 1, 3), F.lit("-****-"), F.right(d, F.lit(4)))
                  ).otherwise(mask_generic(value))


def mask_email(value: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    domain = F.substr(value, F.instr(value, "@") + 1)
    hidden = F.when(F.length(local) > 2, F.concat(F.substring(local, 1, 2), F.lit("***"))).otherwise(
        F.concat(F.substring(local, 1, 1), F.lit("**")))
    return F.when(F.contains(value, F.lit("@")), F.concat(hidden, F.lit("@"), domain)).otherwise(
        mask_generic(value))


def mask_card(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) >= 12, F.concat(F.substring(d, 1, 4), F.lit("-****-****-"), F.right(d, F.lit(4)))
                  ).otherwise(mask_generic(value))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "rrn": resident_number_ok,
    "luhn": card_number_ok,
    "entropy_b64": lambda v: shannon_bits(v) >= ENTROPY_B64,
    "entropy_hex": lambda v: shannon_bits(v) >= ENTROPY_HEX,
}

MASKERS: dict[str, Callable[[Column], Column]] = {
    "rrn": mask_resident_number, "phone": mask_phone, "email": mask_email, "card": mask_card,
    "secret": mask_generic, "generic": mask_generic,
}


def register_validator(name: str, check: Callable[[Column], Column]) -> None:
    VALIDATORS[name] = check


def register_masker(name: str, mask: Callable[[Column], Column]) -> None:
    MASKERS[name] = mask


def validated(name: Column, value: Column) -> Column:
    """Run the validator a rule names; no name accepts everything."""
    out = F.when(name.isNull(), F.lit(True))
    for key, check in VALIDATORS.items():
        out = out.when(name == key, check(value))
    return F.coalesce(out, F.lit(False))


def masked(name: Column, value: Column) -> Column:
    """Run the masker a rule names; ``none`` and unknown names leave the value as it is."""
    out = None
    for key, mask in MASKERS.items():
        out = (F.when(name == key, mask(value)) if out is None else out.when(name == key, mask(value)))
    return out.otherwise(value)
