"""Page sources: text and binary files, and the names under which pages are cached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charset import decode


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, html): whole files that hold UTF-8 text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("html"))


def html_bodies(spark: SparkSession, path: str, content_type: str | None = None, on_unknown: str = "error") -> DataFrame:
    """(file, html, n_bytes): whole files of any encoding, decoded as responses are."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file"), decode("content", F.lit(content_type).cast("string"), on_unknown).alias("html"), F.col("length").alias("n_bytes"))


# fixed values: parts of a host that its file's name leaves out
DROPPED_PARTS = ("www.", ".com", ".de", ".org")


def cache_name(url: str | Column = "url", extension: str = ".html") -> Column:
    """The file a page of a url is cached as: its host without ``www. .com .de .org``."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    for part in DROPPED_PARTS:
        host = F.replace(host, F.lit(part), F.lit(""))
    return F.when(host != "", F.concat(host, F.lit(extension)))


def with_cached(urls: DataFrame, cache: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(those of ``urls`` whose page is in ``cache``, with its html; the rest, to fetch).
    ``cache`` is (file, html) of ``html_files``; names compare by their last part."""
    names = urls.withColumn("_name", cache_name(url))
    have = cache.select(F.element_at(F.split("file", "/"), -1).alias("_name"), "html").dropDuplicates(["_name"])
    return names.join(have, "_name").drop("_name"), names.join(have, "_name", "left_anti").drop("_name")
