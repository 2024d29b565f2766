"""Scans: census CSV, catalog JSON, pages, binary bodies, file digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from noticeflow.functions import text

# Columns the census must have.
CENSUS_COLUMNS = (
    "NU_ANO_CENSO", "NO_REGIAO_IES", "SG_UF_IES", "NO_MUNICIPIO_IES", "CO_MUNICIPIO_IES",
    "TP_ORGANIZACAO_ACADEMICA", "TP_CATEGORIA_ADMINISTRATIVA", "TP_REDE", "CO_IES", "NO_IES", "SG_IES",
)

# Windows-1252 letters that Latin-1 reads as C1 controls, from the codec itself.
_C1 = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252 = bytes(ord(c) for c in _C1).decode("cp1252")

PAGE_SCHEMA = "page_id long, url string, html string"


def latin1_as_cp1252(col: Column) -> Column:
    return F.translate(col, _C1, _CP1252)


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """Census rows as text; a missing required column is an error."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="ISO-8859-1")
    missing = sorted(set(CENSUS_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"census is missing required columns: {missing}")
    return raw.select(*[latin1_as_cp1252(F.col(c)).alias(c) for c in CENSUS_COLUMNS])


def read_documents(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """JSON files as one typed-on-demand value per document (``doc``).

    A variant keeps every value's JSON type, so later rules can tell 1 from "1".
    """
    return (
        spark.read.option("singleVariantColumn", "doc")
        .option("multiLine", str(multi_line).lower())
        .json(path)
    )


def _field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("doc", f"$.{name}", kind)


def read_manifests(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Manifest entries: region, verified_at, entry_pos, entry (variant)."""
    docs = read_documents(spark, path, multi_line)
    return docs.select(
        _field("region").alias("region"),
        _field("verified_at").alias("verified_at"),
        F.posexplode(_field("institutions", "array<variant>")).alias("entry_pos", "entry"),
    )


def manifest_sources(entries: DataFrame) -> DataFrame:
    """Source grain of manifest entries: official_code, source_pos, source (variant)."""
    return entries.select(
        "region",
        F.try_variant_get("entry", "$.official_code", "string").alias("official_code"),
        F.posexplode(F.try_variant_get("entry", "$.sources", "array<variant>")).alias("source_pos", "source"),
    )


def read_overlay(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Post-census institutions: entry_pos, entry (variant)."""
    docs = read_documents(spark, path, multi_line)
    return docs.select(F.posexplode(_field("institutions", "array<variant>")).alias("entry_pos", "entry"))


LEGACY_SCHEMA = (
    "name string, initials string, state string, official_site_url string, "
    "sources array<struct<name:string,url:string,source_type:string,replaces:array<string>>>"
)


def read_legacy_seed(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Legacy institutions: the root is a list, one row per element."""
    return spark.read.schema(LEGACY_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)


def read_pages(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def stream_pages(spark: SparkSession, path, max_files: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)
    )


@F.pandas_udf(T.StringType())
def _decode_declared(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    """Bodies in the declared charset; an unknown one is read as UTF-8. Null bodies stay null."""

    def decode(body, charset):
        if body is None:
            return None
        try:
            return bytes(body).decode(charset, "replace")
        except LookupError:
            return bytes(body).decode("utf-8", "replace")

    return pd.Series([decode(b, c) for b, c in zip(bodies, charsets)], dtype=object)


# Spellings of the charsets that Spark decodes itself.
VAGUE = ("", "iso-8859-1", "latin-1", "latin1", "iso8859-1")
WINDOWS = ("windows-1252", "cp1252")
ASCII = ("us-ascii", "ascii")
UTF8 = ("utf-8", "utf8")


def decode_pages(pages: DataFrame) -> DataFrame:
    """Text of binary bodies: page_id, url, charset, body in, html added.

    A missing or Latin-1 declaration is distrusted: valid UTF-8 wins, Latin-1 is the rest. Every
    other declaration is honoured; what Spark has no decoder for goes through one Arrow batch
    function, which gets only those bodies. Undecodable bytes are replaced.
    """
    declared = F.regexp_replace(F.lower(F.coalesce("charset", F.lit(""))), "^[\\s\"']+|[\\s\"']+$", "")
    vague = declared.isin(*VAGUE)
    as_utf8 = F.col("body").cast("string")
    latin = latin1_as_cp1252(F.decode("body", "ISO-8859-1"))
    other = ~declared.isin(*VAGUE, *WINDOWS, *ASCII, *UTF8) & ~declared.startswith("utf-16")
    html = (
        F.when(vague & F.is_valid_utf8(as_utf8), as_utf8)
        .when(vague | declared.isin(*WINDOWS), latin)
        .when(declared.isin(*ASCII), F.decode("body", "US-ASCII"))
        .when(declared.startswith("utf-16"), F.decode("body", "UTF-16"))
        .when(other, _decode_declared(F.when(other, F.col("body")), declared))
        .otherwise(F.make_valid_utf8(as_utf8))
    )
    return pages.withColumn("html", html)


def verify_contents(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Digests of (name, content) against ``expected`` (name, sha256, md5); ok=false is a mismatch."""
    digests = files.select(
        "name",
        F.octet_length("content").cast("long").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        F.md5("content").alias("md5"),
    )
    wanted = expected.select("name", F.col("sha256").alias("_s"), F.col("md5").alias("_m"))
    return digests.join(wanted, "name", "left").select(
        "name",
        "size",
        "sha256",
        "md5",
        (F.col("sha256").eqNullSafe(F.col("_s")) & F.col("md5").eqNullSafe(F.col("_m"))).alias("ok"),
    )


def verify_files(spark: SparkSession, path, expected: DataFrame) -> DataFrame:
    """Digest check of raw files, by file name."""
    files = spark.read.format("binaryFile").load(path)
    return verify_contents(files.select(F.substring_index("path", "/", -1).alias("name"), "content"), expected)
