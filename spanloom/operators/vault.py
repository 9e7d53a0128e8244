"""The vault as a table and as a sealed document: JSON of a session's entries, encrypted with AES-GCM under a scrypt key."""

from __future__ import annotations

import base64
import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The document's shape and the key derivation.
MAGIC, VERSION = "spanloom-vault", 1
SCRYPT = {"n": 1 << 15, "r": 8, "p": 1, "dklen": 32, "maxmem": 64 << 20}
SALT_BYTES, NONCE_BYTES = 16, 12
ROW_SQL = "doc_id long, token string, entity_type string, value string, action string, occurrences array<struct<start:int,end:int>>"
ENTRY_SQL = "struct<magic:string,version:int,session_id:string,entries:array<struct<doc_id:bigint,token:string,entity_type:string,value:string,action:string,occurrences:array<struct<start:int,end:int>>>>>"


def session_id() -> str:
    return os.urandom(8).hex()


def merged(*vaults: DataFrame) -> DataFrame:
    """One row for each document and token: the value of the first vault that has it stays, occurrences add up."""
    rows = vaults[0].withColumn("rank", F.lit(0))
    for k, v in enumerate(vaults[1:], 1):
        rows = rows.unionByName(v.withColumn("rank", F.lit(k)))
    found = rows.groupBy("doc_id", "token").agg(
        F.min_by(F.struct("value", "entity_type", "action"), F.struct("rank", "value")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("occurrences")))).alias("occurrences")
    )
    return found.select("doc_id", "token", "r.entity_type", "r.value", "r.action", "occurrences")


def values(vault: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of the vault for (doc_id, token)."""
    return vault.join(tokens, ["doc_id", "token"], "left_semi")


def to_documents(vault: DataFrame, session: str) -> DataFrame:
    """(doc_id, json): one document for each source document."""
    entry = F.struct("doc_id", "token", "entity_type", "value", "action", "occurrences")
    body = vault.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token", entry.alias("e")))).alias("es"))
    made = F.struct(F.lit(MAGIC).alias("magic"), F.lit(VERSION).alias("version"), F.lit(session).alias("session_id"), F.transform("es", lambda x: x["e"]).alias("entries"))
    return body.select("doc_id", F.to_json(made).alias("json"))


def from_documents(documents: DataFrame) -> DataFrame:
    """Vault rows of (json); a document of another kind raises."""
    parsed = documents.select(F.from_json("json", ENTRY_SQL).alias("d"))
    checked = F.when(F.coalesce(F.col("d.magic") == MAGIC, F.lit(False)), F.col("d.entries")).otherwise(F.raise_error(F.lit("not a vault document")))
    return parsed.select(F.inline(checked))


def _key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, **SCRYPT)


def _with_key(rows: DataFrame, key: bytes) -> DataFrame:
    """The rows with the key as a column `key`, from a table of one row: as a literal it would show in plans and event logs."""
    return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(bytearray(key),)], "key binary")))


def save(vault: DataFrame, path: str, passphrase: str | None = None, *, allow_plaintext: bool = False, session: str | None = None) -> str:
    """Write the vault as a table of sealed documents; refuses plain text unless it is asked for. Gives the session's id."""
    session = session or session_id()
    documents = to_documents(vault, session)
    if passphrase is None:
        if not allow_plaintext:
            raise ValueError("a vault without a passphrase is written only with allow_plaintext=True")
        documents.select("doc_id", F.lit(False).alias("encrypted"), F.lit(None).cast("binary").alias("salt"), F.col("json").cast("binary").alias("data")).write.parquet(path)
        return session
    salt = os.urandom(SALT_BYTES)
    # Spark draws a new nonce for every row and puts it before the cipher text.
    sealed = F.aes_encrypt(F.col("json").cast("binary"), F.col("key"), F.lit("GCM"))
    _with_key(documents, _key(passphrase, salt)).select("doc_id", F.lit(True).alias("encrypted"), F.lit(salt).alias("salt"), sealed.alias("data")).write.parquet(path)
    return session


def load(spark: SparkSession, path: str, passphrase: str | None = None) -> DataFrame:
    """Rows of a saved vault. A missing or wrong passphrase raises ValueError."""
    sealed = spark.read.parquet(path)
    first = sealed.select("encrypted", "salt", "data").head(1)
    if not first:
        return spark.createDataFrame([], ROW_SQL)
    data = F.col("data")
    if first[0]["encrypted"]:
        if passphrase is None:
            raise ValueError("the vault is encrypted: a passphrase is needed")
        sealed = _with_key(sealed, _key(passphrase, bytes(first[0]["salt"])))
        data = F.try_aes_decrypt("data", F.col("key"), F.lit("GCM"))
        if sealed.select(data.alias("d")).where("d is null").head(1):
            raise ValueError("wrong passphrase, or the vault was changed")
    return from_documents(sealed.select(data.cast("string").alias("json")))


def envelope(payload: dict, passphrase: str | None, spark: SparkSession) -> str:
    """One JSON document for a small vault that travels as text: base64 of salt, nonce and cipher text, or the plain payload."""
    body = json.dumps({"magic": MAGIC, "version": VERSION, **payload})
    if passphrase is None:
        return json.dumps({"magic": MAGIC, "encrypted": False, "data": json.loads(body)})
    salt = os.urandom(SALT_BYTES)
    one = _with_key(spark.createDataFrame([(bytearray(body.encode()),)], "body binary"), _key(passphrase, salt))
    row = one.select(F.aes_encrypt("body", F.col("key"), F.lit("GCM")).alias("x")).first()
    raw, b64 = bytes(row["x"]), lambda x: base64.b64encode(x).decode()
    return json.dumps({"magic": MAGIC, "encrypted": True, "kdf": "scrypt", "salt": b64(salt), "nonce": b64(raw[:NONCE_BYTES]), "ct": b64(raw[NONCE_BYTES:])})


def opened(text: str, passphrase: str | None, spark: SparkSession) -> dict:
    data = json.loads(text)
    if data.get("magic") != MAGIC:
        raise ValueError("not a vault document")
    if not data["encrypted"]:
        return data["data"]
    if passphrase is None:
        raise ValueError("the vault is encrypted: a passphrase is needed")
    key = _key(passphrase, base64.b64decode(data["salt"]))
    raw = base64.b64decode(data["nonce"]) + base64.b64decode(data["ct"])
    row = _with_key(spark.createDataFrame([(bytearray(raw),)], "raw binary"), key).select(F.try_aes_decrypt("raw", F.col("key"), F.lit("GCM")).alias("x")).first()
    if row["x"] is None:
        raise ValueError("wrong passphrase, or the vault was changed")
    return json.loads(bytes(row["x"]))
