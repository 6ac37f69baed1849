"""Hashes, encodings, compression and encryption."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import batch_udf, ColumnOrName, col, function, lit, must


@function("HASH")
def hash(*xs: ColumnOrName) -> Column:
    """Signed 64-bit hash of all arguments; stable, but not the value that other engines give."""
    return F.xxhash64(*map(col, xs))


@function("MD5", "MD5_HEX")
def md5(x: ColumnOrName) -> Column:
    return F.md5(col(x))


@function()
def md5_binary(x: ColumnOrName) -> Column:
    return F.unhex(F.md5(col(x)))


@function("MD5_NUMBER_LOWER64")
def md5_number_lower64(x: ColumnOrName) -> Column:
    return F.conv(F.right(F.md5(col(x)), F.lit(16)), 16, 10).cast("decimal(20,0)")


@function("MD5_NUMBER_UPPER64")
def md5_number_upper64(x: ColumnOrName) -> Column:
    return F.conv(F.left(F.md5(col(x)), F.lit(16)), 16, 10).cast("decimal(20,0)")


@function("SHA1", "SHA1_HEX")
def sha1(x: ColumnOrName) -> Column:
    return F.sha1(col(x))


@function()
def sha1_binary(x: ColumnOrName) -> Column:
    return F.unhex(F.sha1(col(x)))


@function("SHA2", "SHA2_HEX")
def sha2(x: ColumnOrName, bits: int = 256) -> Column:
    return F.sha2(col(x), bits)


@function()
def sha2_binary(x: ColumnOrName, bits: int = 256) -> Column:
    return F.unhex(F.sha2(col(x), bits))


@function()
def base64_encode(x: ColumnOrName, line: int = 0, alphabet: str = "") -> Column:
    """Lines of ``line`` characters; ``alphabet`` replaces +, / and =, in this order."""
    e = F.regexp_replace(F.base64(col(x).cast("binary")), "[\r\n]", "")
    if alphabet:
        e = F.translate(e, "+/="[: len(alphabet)], alphabet)
    return F.regexp_replace(e, f"(.{{{line}}})(?!$)", "$1\n") if line else e


def _plain64(x: ColumnOrName, alphabet: str) -> Column:
    e = F.regexp_replace(col(x), "[\r\n]", "")
    return F.translate(e, alphabet, "+/="[: len(alphabet)]) if alphabet else e


@function()
def base64_decode_binary(x: ColumnOrName, alphabet: str = "") -> Column:
    return F.unbase64(_plain64(x, alphabet))


@function()
def base64_decode_string(x: ColumnOrName, alphabet: str = "") -> Column:
    return F.decode(F.unbase64(_plain64(x, alphabet)), "UTF-8")


@function()
def try_base64_decode_binary(x: ColumnOrName, alphabet: str = "") -> Column:
    return F.try_to_binary(_plain64(x, alphabet), F.lit("base64"))


@function()
def try_base64_decode_string(x: ColumnOrName, alphabet: str = "") -> Column:
    return F.decode(try_base64_decode_binary(x, alphabet), "UTF-8")


@function()
def hex_encode(x: ColumnOrName, upper: int = 1) -> Column:
    h = F.hex(col(x).cast("binary"))
    return h if upper else F.lower(h)


@function()
def hex_decode_binary(x: ColumnOrName) -> Column:
    return F.to_binary(col(x), F.lit("hex"))


@function()
def hex_decode_string(x: ColumnOrName) -> Column:
    return F.decode(F.to_binary(col(x), F.lit("hex")), "UTF-8")


@function()
def try_hex_decode_binary(x: ColumnOrName) -> Column:
    return F.try_to_binary(col(x), F.lit("hex"))


@function()
def try_hex_decode_string(x: ColumnOrName) -> Column:
    return F.decode(F.try_to_binary(col(x), F.lit("hex")), "UTF-8")


def _codec(method: str):
    """Compressing and expanding functions of ``zlib(6)``, ``zstd(3)``, ``bz2(9)`` or ``snappy``."""
    name, _, level = method.lower().rstrip(")").partition("(")
    n = int(level) if level else None
    if name in ("zlib", "gzip"):
        import zlib

        return (lambda b: zlib.compress(b, 6 if n is None else n)), zlib.decompress
    if name == "bz2":
        import bz2

        return (lambda b: bz2.compress(b, 9 if n is None else n)), bz2.decompress
    if name in ("zstd", "snappy"):
        import pyarrow as pa

        # sizes go in front: these codecs don't hold them in a form that pyarrow reads
        c = pa.Codec(name, compression_level=n) if name == "zstd" and n is not None else pa.Codec(name)
        return (lambda b: len(b).to_bytes(8, "little") + c.compress(b, asbytes=True)), (lambda b: c.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True))
    raise ValueError(f"{method} is no compression method")


def _bytes_udf(f):
    @batch_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(bytes(x)) for x in s], dtype=object)

    return run


@function()
def compress(x: ColumnOrName, method: str = "snappy") -> Column:
    return _bytes_udf(lambda b: _codec(method)[0](b))(col(x).cast("binary"))


@function()
def decompress_binary(x: ColumnOrName, method: str = "snappy") -> Column:
    return _bytes_udf(lambda b: _codec(method)[1](b))(col(x))


@function()
def decompress_string(x: ColumnOrName, method: str = "snappy") -> Column:
    return F.decode(decompress_binary(x, method), "UTF-8")


def _key(passphrase: str | Column) -> Column:
    return F.unhex(F.sha2(lit(passphrase), 256))


@function()
def encrypt(x: ColumnOrName, passphrase: str | Column) -> Column:
    """AES-GCM under the SHA-256 of the passphrase, a random nonce in front."""
    return F.aes_encrypt(col(x), _key(passphrase), F.lit("GCM"), F.lit("DEFAULT"))


@function()
def decrypt(x: ColumnOrName, passphrase: str | Column) -> Column:
    return F.aes_decrypt(col(x), _key(passphrase), F.lit("GCM"), F.lit("DEFAULT"))


@function()
def try_decrypt(x: ColumnOrName, passphrase: str | Column) -> Column:
    return F.try_aes_decrypt(col(x), _key(passphrase), F.lit("GCM"), F.lit("DEFAULT"))


@function()
def encrypt_raw(x: ColumnOrName, key: ColumnOrName, iv: ColumnOrName | None = None) -> Column:
    """AES-GCM under a key of 16, 24 or 32 bytes."""
    if iv is None:
        return F.aes_encrypt(col(x), col(key), F.lit("GCM"), F.lit("DEFAULT"))
    return F.aes_encrypt(col(x), col(key), F.lit("GCM"), F.lit("DEFAULT"), col(iv))


@function()
def decrypt_raw(x: ColumnOrName, key: ColumnOrName) -> Column:
    return F.aes_decrypt(col(x), col(key), F.lit("GCM"), F.lit("DEFAULT"))


@function()
def try_decrypt_raw(x: ColumnOrName, key: ColumnOrName) -> Column:
    return F.try_aes_decrypt(col(x), col(key), F.lit("GCM"), F.lit("DEFAULT"))


def checked_key(key: ColumnOrName) -> Column:
    k = col(key)
    return must(F.octet_length(k).isin(16, 24, 32), k, "a key has 16, 24 or 32 bytes")
