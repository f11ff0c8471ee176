"""Field-level encryption with Spark's AES-GCM functions. A key is read by a scalar subquery from a table of one row, so that
neither plans nor event logs show it.

A stored value is a struct (__enc, iv, data, alg), with iv and data in base64; data ends with the authentication tag. The
encryption function draws a new iv for every evaluation, so encrypted rows are to be written before they are read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.sources.schema import Attribute, ClassModel, col

IV = 12
STORED = T.StructType(
    [T.StructField("__enc", T.BooleanType()), T.StructField("iv", T.StringType()), T.StructField("data", T.StringType()), T.StructField("alg", T.StringType())]
)


def key_column(spark: SparkSession, key: bytes) -> Column:
    """The key as a column that any frame may use."""
    return spark.createDataFrame([(bytearray(key),)], "k binary").scalar()


def encrypt_value(value: Column, key: Column) -> Column:
    sealed = F.base64(F.aes_encrypt(F.to_json(F.struct(value.alias("v"))).cast("binary"), key, F.lit("GCM")))
    # one use of the sealed bytes, as every use draws an iv; the iv's 12 bytes are the first 16 characters
    parts = F.regexp_replace(sealed, f"(?s)^(.{{{IV * 4 // 3}}})(.*)$", '{"__enc":true,"iv":"$1","data":"$2","alg":"AES-GCM"}')
    return F.when(value.isNotNull(), F.from_json(parts, STORED))


def decrypt_value(stored: Column, key: Column, kind: T.DataType) -> Column:
    """The clear value; null where the key is wrong or the data damaged."""
    clear = F.try_aes_decrypt(F.concat(F.unbase64(stored["iv"]), F.unbase64(stored["data"])), key, F.lit("GCM"))
    return F.from_json(clear.cast("string"), T.StructType([T.StructField("v", kind)]))["v"]


def is_stored(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and "__enc" in kind.fieldNames()


def encrypt(df: DataFrame, model: ClassModel, key: bytes | None) -> DataFrame:
    """df with the model's encrypted attributes sealed."""
    names = [a.name for a in model.encrypted if a.name in df.columns and not is_stored(df.schema[a.name].dataType)]
    if not names:
        return df
    if key is None:
        raise PermissionError(f"{model.name}: {', '.join(names)} can't be encrypted without a key")
    by = key_column(df.sparkSession, key)
    return df.withColumns({n: encrypt_value(col(n), by) for n in names})


def decrypt(df: DataFrame, model: ClassModel, key: bytes | None) -> DataFrame:
    """df with encrypted attributes in clear; without a key they are null, and rows that show nothing else are left out."""
    sealed: list[Attribute] = [a for a in model.encrypted if a.name in df.columns and is_stored(df.schema[a.name].dataType)]
    if not sealed:
        return df
    if key is not None:
        by = key_column(df.sparkSession, key)
        return df.withColumns({a.name: decrypt_value(col(a.name), by, a.spark_type()) for a in sealed})
    visible = [a.name for a in model.attributes if a not in sealed and a.name in df.columns]
    shown = F.coalesce(*(F.when(col(n).isNotNull(), True) for n in visible), F.lit(False)) if visible else F.lit(False)
    return df.where(shown).withColumns({a.name: F.lit(None).cast(a.spark_type()) for a in sealed})


def wrap_key(spark: SparkSession, key: bytes, by: bytes) -> str:
    """A key sealed by another one, in base64."""
    keys = spark.createDataFrame([(bytearray(key), bytearray(by))], "key binary, by binary")
    return keys.select(F.base64(F.aes_encrypt("key", "by", F.lit("GCM")))).first()[0]


def unwrap_key(spark: SparkSession, wrapped: str, by: bytes) -> bytes | None:
    """The sealed key; None if `by` is not the key that sealed it."""
    keys = spark.createDataFrame([(wrapped, bytearray(by))], "wrapped string, by binary")
    found = keys.select(F.try_aes_decrypt(F.unbase64("wrapped"), "by", F.lit("GCM"))).first()[0]
    return bytes(found) if found is not None else None
