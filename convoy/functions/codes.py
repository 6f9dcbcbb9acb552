"""VIN check digits and diagnostic trouble codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (ISO 3779): letters with their digits, and one weight per position.
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_DIGITS = "12345678123457923456789"
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
VIN_SHAPE = r"\A[0-9A-HJ-NPR-Z]{17}\z"
CHECK_POSITION = 9

# Fixed values (SAE J2012): shape of a code.
DTC_SHAPE = r"\A[PCBU][0-3][0-9A-F]{3}\z"


def vin_well_formed(vin: Column) -> Column:
    return F.coalesce(vin.rlike(VIN_SHAPE), F.lit(False))


def vin_check_digit(vin: Column) -> Column:
    """The digit position 9 should hold; NULL when the VIN has a bad length or character."""
    digits = F.split(F.translate(vin, VIN_LETTERS, VIN_DIGITS), "")
    weights = F.array(*[F.lit(w) for w in VIN_WEIGHTS])
    weighted = F.zip_with(digits, weights, lambda c, w: F.coalesce(c.try_cast("int") * w, F.lit(0)))
    total = F.aggregate(weighted, F.lit(0), lambda acc, v: acc + v)
    rest = F.pmod(total, F.lit(11))
    return F.when(vin_well_formed(vin), F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string")))


def vin_valid(vin: Column) -> Column:
    return F.coalesce(F.substring(vin, CHECK_POSITION, 1) == vin_check_digit(vin), F.lit(False))


def vin_repaired(vin: Column) -> Column:
    """The VIN with its correct check digit in place."""
    return F.overlay(vin, vin_check_digit(vin), F.lit(CHECK_POSITION), F.lit(1))


def dtc_valid(code: Column) -> Column:
    return F.coalesce(code.rlike(DTC_SHAPE), F.lit(False))


def dtc_system(code: Column) -> Column:
    return F.when(dtc_valid(code), F.substring(code, 1, 1))


def dtc_origin(code: Column) -> Column:
    generic = F.substring(code, 2, 1).isin("0", "2")
    return F.when(dtc_valid(code), F.when(generic, F.lit("generic")).otherwise(F.lit("manufacturer")))


def dtc_specific(code: Column) -> Column:
    return F.when(dtc_valid(code), F.substring(code, 3, 3))


def dtc_between(code: Column, start: str, end: str) -> Column:
    """Same system and ``specific`` in the range; the origin digit plays no part."""
    if start[:1] != end[:1]:
        return F.when(dtc_valid(code), F.lit(False))
    return F.when(
        dtc_valid(code),
        (F.substring(code, 1, 1) == start[:1]) & F.substring(code, 3, 3).between(start[2:], end[2:]),
    )
