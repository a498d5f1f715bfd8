"""Text operators as column expressions: all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words of the tokeniser.
STOPWORDS = (
    "the be to of and in that have it for not on with he as you do at this but his by from they we say her she or an "
    "will my one all would there their what so up out if about who get which go me when make can like no just him "
    "know take come could than look use into some them see other then now only its also after way our how more been "
    "was were are is am has had did does let may should must shall very much too"
).split()
# Suffixes in the order in which they are tried.
SUFFIXES = "tion sion ment ness able ible ful less ous ive ing ied ies ers est ely ed ly er es al en s".split()
# Bytes of a snippet and of a command prefix.
SNIPPET, CMD_PREFIX = 300, 100


# A stem of four bytes or more, shortest first: one to three characters that are not all ASCII, or four.
_STEM = r"[\x{10000}-\x{10FFFF}]|[\u0800-\uFFFF].|.[\u0800-\uFFFF]|[^\x00-\x7F]{2}|(?=[\x00-\x7F]{0,2}[^\x00-\x7F]).{3}|.{4,}?"


def stem(w: Column) -> Column:
    """Strip the first suffix that leaves more than three bytes, once.

    Longer suffixes come before the shorter ones they end in, so the first that fits is
    the one with the shortest stem, which one expression finds.
    """
    return F.regexp_replace(w, rf"^({_STEM})(?:{'|'.join(SUFFIXES)})$", "$1")


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits of two bytes or more, without stop words, stemmed; null text has none."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    kept = F.filter(runs, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOPWORDS))
    return F.transform(kept, stem)


def query_terms(query: str) -> list[str]:
    """The tokens of a query, for the driver; the same rules as :func:`tokenize`."""
    stop = set(STOPWORDS)
    words = [w for w in re.findall(r"[^\W_]+", query.lower()) if len(w.encode()) >= 2 and w not in stop]
    cut = lambda w: next((w[: -len(s)] for s in SUFFIXES if len(w.encode()) > len(s) + 3 and w.endswith(s)), w)
    return [cut(w) for w in words]


def truncate_bytes(text: Column, n: int) -> Column:
    """The longest prefix of at most *n* bytes that splits no character."""
    # A cut inside a character leaves up to three bytes of it; the decoder shows them as U+FFFD.
    cut = F.substring(F.encode(text, "UTF-8"), 1, n)
    whole = F.filter(F.array(*[F.substring(cut, 1, n - k) for k in range(4)]), lambda b: F.is_valid_utf8(b.cast("string")))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.get(whole, 0).cast("string"))


def first_snippet(text: Column, n: int = SNIPPET) -> Column:
    """The first *n* bytes, with '...' if there are more."""
    return F.when(F.octet_length(text) > n, F.concat(truncate_bytes(text, n), F.lit("..."))).otherwise(text)


def kwic(df: DataFrame, text: str, terms: list[str], out: str, width: int = SNIPPET) -> DataFrame:
    """Add *out*: a window of *width* around the earliest term, aligned to spaces and cut hard where it has none.

    Texts of at most *width* bytes come whole; without a term the start is given. Cut
    sides carry '...'; null stays null. Positions are characters, so no character is ever
    split. Each step is a column of its own, so none is computed twice.
    """
    low = F.lower(text)
    at = F.array_min(F.array(*[F.nullif(F.locate(t, low), F.lit(0)) for t in terms])) - 1 if terms else F.lit(None).cast("int")
    d = df.withColumn("_n", F.char_length(text)).withColumn("_at", F.when(F.octet_length(text) > width, at))
    d = d.withColumn("_end", F.least(F.greatest(F.col("_at") - width // 2, F.lit(0)) + width, F.col("_n")))
    d = d.withColumn("_start", F.greatest(F.least(F.col("_at") - width // 2, F.col("_end") - width), F.lit(0)))
    d = d.withColumn("_gap", F.locate(" ", F.substring(F.col(text), F.col("_start") + 1, F.col("_end") - F.col("_start"))))
    d = d.withColumn("_start", F.when((F.col("_start") > 0) & (F.col("_gap") > 0), F.col("_start") + F.col("_gap")).otherwise(F.col("_start")))
    d = d.withColumn("_back", F.locate(" ", F.reverse(F.substring(F.col(text), F.col("_start") + 1, F.col("_end") - F.col("_start")))))
    d = d.withColumn("_end", F.when((F.col("_end") < F.col("_n")) & (F.col("_back") > 0), F.col("_end") - F.col("_back") + 1).otherwise(F.col("_end")))
    piece = F.concat(F.when(F.col("_start") > 0, "...").otherwise(""), F.substring(F.col(text), F.col("_start") + 1, F.col("_end") - F.col("_start")), F.when(F.col("_end") < F.col("_n"), "...").otherwise(""))
    return d.withColumn(out, F.when(F.col("_at").isNotNull(), piece).otherwise(first_snippet(F.col(text), width))).drop("_n", "_at", "_end", "_start", "_gap", "_back")


def round2(x: Column) -> Column:
    """Two decimals, halves away from zero, for scores that are not negative."""
    return F.floor(x * 100 + 0.5) / 100


def sanitise_path(path: Column) -> Column:
    """A path as a directory name: every other character than letters and digits becomes '-'."""
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "-")


def iso_utc(ts: Column) -> Column:
    """A timestamp as RFC 3339 text in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_instant(text: Column) -> Column:
    """RFC 3339 text, with or without fractions, as a timestamp without zone in UTC; null if it is none."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
