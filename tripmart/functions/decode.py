"""Codes to names. A null code stays null; a code outside the table is ``Unrecognized``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PAYMENTS, RATECODES, STORE_AND_FWD, UNRECOGNIZED, VENDORS


def decode(c: Column, names: dict) -> Column:
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for code, name in names.items():
        out = out.when(c == code, name)
    return out.otherwise(UNRECOGNIZED)


def decode_vendor(c: Column) -> Column:
    return decode(c, VENDORS)


def decode_ratecode(c: Column) -> Column:
    return decode(c, RATECODES)


def decode_payment(c: Column) -> Column:
    return decode(c, PAYMENTS)


def decode_store_fwd(c: Column) -> Column:
    return decode(c, STORE_AND_FWD)
