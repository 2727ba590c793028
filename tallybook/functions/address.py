"""Address validation: base58, version byte, checksum.

Base58 is decoded for a whole Arrow batch at once, column by column of the digits: five
digits at a time are added to seven 32-bit limbs. The double hash is Spark's own.
``validate_addresses`` checks distinct well-shaped addresses and joins the verdict back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# base58 alphabet, accepted versions, length range.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
VERSIONS = (22, 30)
SHAPE = f"^[{BASE58}]{{27,35}}$"

_LONGEST = 35
_STEP = 5  # 58 ** 5 and a limb of 32 bits multiply within 64 bits
_LIMBS = 7
_DIGIT = np.zeros(256, np.uint64)
_DIGIT[np.frombuffer(BASE58.encode(), np.uint8)] = np.arange(58)


def decode_base58(addresses: list[str]) -> np.ndarray:
    """The 28 bytes, big end first, of each well-shaped address, as rows of one array."""
    text = "".join(a.rjust(_LONGEST, BASE58[0]) for a in addresses)
    digits = _DIGIT[np.frombuffer(text.encode("ascii"), np.uint8)].reshape(-1, _LONGEST)
    limbs = np.zeros((_LIMBS, len(addresses)), np.uint64)  # the lowest first
    for start in range(0, _LONGEST, _STEP):
        carry = np.zeros(len(addresses), np.uint64)
        for k in range(_STEP):
            carry = carry * np.uint64(58) + digits[:, start + k]
        for limb in limbs:
            carry += limb * np.uint64(58**_STEP)
            limb[:] = carry & np.uint64(0xFFFFFFFF)
            carry >>= np.uint64(32)
    return np.ascontiguousarray(limbs[::-1].T.astype(">u4")).view(np.uint8).reshape(-1, 4 * _LIMBS)


@F.pandas_udf(BinaryType())
def _decoded(addresses: pd.Series) -> pd.Series:
    rows = decode_base58(addresses.tolist())
    width, flat = rows.shape[1], rows.tobytes()
    return pd.Series([flat[i : i + width] for i in range(0, len(flat), width)], addresses.index, object)


def _checked(raw: Column, address: Column) -> Column:
    """Version and checksum of a decoded address: 25 bytes, after three that must be zero.

    An accepted version is not zero, so a leading zero digit would be a second spelling.
    """
    part = lambda start, length: F.substring(raw, start, length)
    digest = F.sha2(F.unhex(F.sha2(part(4, 21), 256)), 256)
    versions = [f"000000{v:02X}" for v in VERSIONS]
    return (
        F.hex(part(1, 4)).isin(*versions)
        & (F.lower(F.hex(part(25, 4))) == F.substring(digest, 1, 8))
        & ~address.startswith(BASE58[0])
    )


def valid_address(address: Column) -> Column:
    """True for a valid address; the UDF only sees well-shaped text."""
    shaped = F.coalesce(address.rlike(SHAPE), F.lit(False))
    # Arrow UDFs run on every row of the batch, so ill-shaped text is replaced.
    raw = _decoded(F.when(shaped, address).otherwise(F.lit(BASE58[0] * 27)))
    return shaped & _checked(raw, address)


def validate_addresses(df: DataFrame, column: str, out: str = "addr_valid") -> DataFrame:
    """Add the verdict for ``column``; each distinct address is checked once."""
    distinct = df.select(F.col(column).alias("_addr")).where(F.col("_addr").rlike(SHAPE)).distinct()
    decoded = distinct.withColumn("_raw", _decoded(F.col("_addr")))
    verdict = decoded.where(_checked(F.col("_raw"), F.col("_addr"))).select("_addr")
    joined = df.join(verdict, F.col(column) == F.col("_addr"), "left")
    return joined.withColumn(out, F.col("_addr").isNotNull()).drop("_addr")
