"""Hashing and column encryption."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import urls as U

# Fixed value: key derivation rounds.
PBKDF2_ROUNDS = 100_000


@F.pandas_udf(T.StringType())
def _blake2b(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else hashlib.blake2b(v.encode("utf-8")).hexdigest())


def hash_text(value, algorithm: str = "sha256", salt: str | None = None) -> Column:
    """Hex digest of the value followed by the salt."""
    text = U._c(value).cast("string")
    if salt:
        text = F.concat(text, F.lit(salt))
    if algorithm == "sha256":
        return F.sha2(text, 256)
    if algorithm == "sha512":
        return F.sha2(text, 512)
    if algorithm == "blake2b":
        return _blake2b(text)
    raise ValueError(f"unsupported hash algorithm: {algorithm}")


def verify_hash(value, hashed, salt: str, algorithm: str = "sha256") -> Column:
    """Does the value hash to the stored digest?"""
    return hash_text(value, algorithm, salt) == U._c(hashed)


def derive_key(password: str, salt: bytes) -> bytes:
    """32-byte key, derived once on the driver and used as a literal."""
    return hashlib.pbkdf2_hmac("sha256", password.encode("utf-8"), salt, PBKDF2_ROUNDS, dklen=32)


def encrypt_text(value, password: str, salt: bytes) -> Column:
    """AES-GCM of a text column, as base64."""
    return F.base64(F.aes_encrypt(U._c(value), F.lit(derive_key(password, salt)), F.lit("GCM")))


def decrypt_text(value, password: str, salt: bytes) -> Column:
    """Inverse of :func:`encrypt_text`; null when key or token do not fit."""
    return F.try_aes_decrypt(F.unbase64(U._c(value)), F.lit(derive_key(password, salt)), F.lit("GCM")).cast("string")
