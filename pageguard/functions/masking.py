"""What is shown in place of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import REDACTED, digits


def mask_email(m: Column) -> Column:
    user, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    n = F.length(user)
    hidden = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(user, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(user, F.lit(1))))
    return F.concat(hidden, F.lit("@"), domain)


def mask_card(m: Column) -> Column:
    return F.concat(F.lit("**** **** **** "), F.right(digits(m), F.lit(4)))


def mask_phone(m: Column) -> Column:
    d = digits(m)
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(d) - 2)), F.right(d, F.lit(2)))


def mask_ip(m: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o, i: F.when(i < 2, F.repeat(F.lit("*"), F.length(o))).otherwise(o))
    return F.when(F.contains(m, F.lit(".")), F.array_join(octets, ".")).otherwise(F.lit(REDACTED))


def mask_name(m: Column) -> Column:
    return F.concat(F.left(m, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(m) - 1)))


def mask(kind: Column, m: Column) -> Column:
    """The mask of a match of a kind; unknown kinds are redacted whole."""
    return (
        F.when(kind == "EMAIL", mask_email(m))
        .when(kind == "CARD", mask_card(m))
        .when(kind == "PHONE", mask_phone(m))
        .when(kind.isin("IPV4", "IP_ADDRESS"), mask_ip(m))
        .when(kind == "NAME", mask_name(m))
        .otherwise(F.lit(REDACTED))
    )
