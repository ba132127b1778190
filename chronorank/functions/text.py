"""Tokenization and time expressions, all built-in and evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
WORD = r"[\p{L}\p{N}]+"
NON_SPACE = r"[^ \t\n\r\f]+"
HOUR_FORMAT = "yyyy-MM-dd-HH"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so ``body`` may use it often."""
    return F.transform(F.array(value), body)[0]


#: Stopwords: literals, or a column with an array of a few terms.  For long lists
#: see ``sources.side_files.without_stopwords``.
Stop = Sequence[str] | Column


def stops(stop: Stop) -> bool:
    """Whether there are stopwords at all."""
    return isinstance(stop, Column) or len(stop) > 0


def without(tokens: Column, stop: Stop) -> Column:
    """``tokens`` minus stopwords, duplicates kept."""
    if not stops(stop):
        return tokens
    if isinstance(stop, Column):
        return let(stop, lambda terms: F.filter(tokens, lambda t: ~F.array_contains(terms, t)))
    return F.filter(tokens, lambda t: ~t.isin(list(stop)))


def words(text: Column | str, stop: Stop = (), pattern: str = WORD) -> Column:
    """Lower-case word tokens of ``text``; the one place the tokenizer is defined."""
    col = F.col(text) if isinstance(text, str) else text
    return without(F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(0)), stop)


def space_tokens(text: Column | str) -> Column:
    """Runs of characters other than blank, tab, newline, return and form feed."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(col, F.lit(NON_SPACE), F.lit(0))


def has_text(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return col.isNotNull() & (F.length(col) > 0)


def zulu_to_epoch_ms(zulu: Column | str) -> Column:
    """ISO-8601 timestamp to epoch milliseconds; null if missing or malformed."""
    return F.unix_millis(F.try_to_timestamp(zulu))


def hour_label(epoch_ms: Column | str) -> Column:
    """``yyyy-MM-dd-HH`` of an instant in UTC, whatever the session's zone."""
    col = F.col(epoch_ms) if isinstance(epoch_ms, str) else epoch_ms
    hours = F.floor(col / 3_600_000)
    day = F.date_from_unix_date(F.floor(hours / 24).cast("int")).cast("string")
    return F.concat(day, F.lit("-"), F.lpad(F.pmod(hours, F.lit(24)).cast("string"), 2, "0"))


def sentence_texts(sentences: Column) -> Column:
    """Array of sentence texts: tokens, each followed by one blank.

    Sentences without a token list are left out.
    """
    usable = F.filter(sentences, lambda s: s["tokens"].isNotNull())
    # an empty last token leaves the blank after the last one, and nothing if there is none
    return F.transform(usable, lambda s: F.array_join(F.array_append(s["tokens"]["token"], F.lit("")), " "))


def numbered(array: str, position: str, value: str) -> list[Column]:
    """Positions and values of a computed array; an empty one gives a null position.

    The outer form keeps the optimizer from deriving a ``size(...) > 0`` filter,
    which would evaluate the array's whole expression a second time.
    """
    return [F.posexplode_outer(array).alias(position, value)]
