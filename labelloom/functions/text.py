"""Column expressions over text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import settings
from labelloom.functions import chars


def clean(text: Column, mark_aware: bool = False) -> Column:
    """Drop URLs and mentions, keep hashtag words, collapse whitespace; NULL becomes ''.

    The plain mention class stops at a combining mark; ``mark_aware`` removes
    whole Devanagari mentions.
    """
    mention = chars.MENTION_WITH_MARKS if mark_aware else chars.MENTION
    out = F.coalesce(text, F.lit(""))
    for pattern, keep in ((chars.HTTP_URL, ""), (chars.WWW_URL, ""), (mention, ""),
                          (chars.HASHTAG, "$1"), (chars.SPACE_RUN, " ")):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(keep))
    return F.trim(out)


def null_tokens_to_null(text: Column) -> Column:
    return F.when(~text.isin(settings.NA_TOKENS), text)


def tokens(text: Column, pattern: str = chars.TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def ngrams(toks: Column, least: int = 1, most: int = 2) -> Column:
    """All runs of ``least`` to ``most`` neighbouring tokens, shorter runs first.

    Zipping slices keeps this linear: an index lookup inside a lambda makes the optimiser
    re-evaluate the token array for every element.
    """
    grams, runs = [], toks
    for n in range(1, most + 1):
        if n > 1:
            rest = F.greatest(F.size(runs) - 1, F.lit(0))
            runs = F.zip_with(F.slice(runs, F.lit(1), rest), F.slice(toks, F.lit(n), rest), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= least:
            grams.append(runs)
    return F.concat(*grams)


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), chars.SPACE_RUN), lambda w: w != "")


def char_count(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def class_count(text: Column, char_class: str) -> Column:
    """Number of characters of ``text`` in a one-character class, counted run by run."""
    return F.length(text) - F.length(F.regexp_replace(text, F.lit(char_class + "+"), F.lit("")))


def shorten(text: Column, n: int = settings.PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def snippet(text: Column, n: int = 60) -> Column:
    """First ``n`` characters on one line."""
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))


def text_key(text: Column) -> Column:
    """32-byte identity of a text, so count-only jobs shuffle digests instead of documents."""
    return F.unhex(F.sha2(text, 256))


def seeded_key(value: Column, seed: int = settings.SEED) -> Column:
    """Deterministic pseudo-random sort key, the same on every run and cluster."""
    return F.md5(F.concat(F.lit(f"{seed}|"), value.cast("string")))


def class_name(label: Column) -> Column:
    names = F.array(*[F.lit(n) for n in settings.LABEL_NAMES])
    return F.get(names, label)
