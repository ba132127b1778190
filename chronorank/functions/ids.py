"""Row keys and identifier paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Visible ASCII characters that are hex-encoded all the same, and
# the single-character swaps applied afterwards.
ENCODED_PUNCTUATION = ['"', "*", "+", ",", "<", "=", ">", "?", "\\", "^", "|"]
SWAP_FROM, SWAP_TO = "/:.", "=+,"
SEGMENT = 2


def row_key(query_id: Column, date_bin: Column, stream_id: Column) -> Column:
    """``%02d%04d.stream_id``; null without a known hour."""
    return F.when(date_bin >= 0, F.format_string("%02d%04d.%s", query_id, date_bin, stream_id))


def stream_id_of(key: Column | str) -> Column:
    return F.split(key, r"\.")[1]


def update_id(stream_id: Column | str, sent_num: Column | str) -> Column:
    return F.concat_ws("-", stream_id, sent_num)


def id_to_path(identifier: Column) -> Column:
    """Identifier to a path of two-character segments.

    Bytes outside the visible ASCII range and some punctuation become ``^hh``
    (always two digits, so that the way back exists).
    """
    unsafe = [f"{ord(c):02X}" for c in ENCODED_PUNCTUATION]
    pairs = F.regexp_extract_all(F.hex(F.encode(identifier, "UTF-8")), F.lit("(..)"), F.lit(1))
    encoded = F.transform(
        pairs,
        lambda h: F.when(
            (h < "21") | (h > "7E") | h.isin(unsafe), F.concat(F.lit("^"), F.lower(h))
        ).otherwise(F.decode(F.unhex(h), "UTF-8")),
    )
    clean = F.translate(F.array_join(encoded, ""), SWAP_FROM, SWAP_TO)
    return F.array_join(F.regexp_extract_all(clean, F.lit(f"(.{{1,{SEGMENT}}})"), F.lit(1)), "/")


def path_to_id(path: Column) -> Column:
    """Inverse of :func:`id_to_path`."""
    clean = F.translate(F.replace(path, F.lit("/"), F.lit("")), SWAP_TO, SWAP_FROM)
    units = F.regexp_extract_all(clean, F.lit(r"(\^[0-9a-f]{2}|.)"), F.lit(1))
    as_hex = F.transform(
        units,
        lambda u: F.when(F.length(u) == 3, F.substring(u, 2, 2)).otherwise(F.hex(F.encode(u, "UTF-8"))),
    )
    return F.decode(F.unhex(F.array_join(as_hex, "")), "UTF-8")


def shard_path(stream_id: Column | str) -> Column:
    """Storage path of a stream id, dashes dropped."""
    return id_to_path(F.replace(stream_id, F.lit("-"), F.lit("")))
