"""Text normalisation as Column builders; every step but NFC is a JVM expression."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters whose UTF-8 was read as Latin-1 and what they stand for, in the order of repair.
MOJIBAKE = [
    ("\u00c3\u00a1", "á"),
    ("\u00c3\u00a9", "é"),
    ("\u00c3\u00ad", "í"),
    ("\u00c3\u00b3", "ó"),
    ("\u00c3\u00ba", "ú"),
    ("\u00c3\u00a3", "ã"),
    ("\u00c3\u00b5", "õ"),
    ("\u00c3\u00a7", "ç"),
    ("\u00c3\u00a0", "à"),
    ("\u00c3\u00a2", "â"),
    ("\u00c3\u00aa", "ê"),
    ("\u00c3\u00ae", "î"),
    ("\u00c3\u00b4", "ô"),
    ("\u00c3\u00bb", "û"),
    ("\u00c3\u00bc", "ü"),
    ("\u00c3\u00b1", "ñ"),
    ("\u00c3\u0081", "Á"),
    ("\u00c3\u0089", "É"),
    ("\u00c3\u008d", "Í"),
    ("\u00c3\u0093", "Ó"),
    ("\u00c3\u009a", "Ú"),
    ("\u00c3\u0083", "Ã"),
    ("\u00c3\u0095", "Õ"),
    ("\u00c3\u0087", "Ç"),
]

# Punctuation and spaces, one to one; two more cases.
PUNCT_FROM = "\u201c\u201d\u2018\u2019\u00ab\u00bb\u2013\u2014\u00a0\u2002\u2003\u2009\u0092\u0093\u0094\u0096\u0097"
PUNCT_TO = "\"\"''\"\"--    '\"\"--"
ZERO_WIDTH, ELLIPSIS = "\u200b", "\u2026"

CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
# The characters of White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition; ASCII texts, which it never changes, skip Python."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(text)).otherwise(text)


def fix_mojibake(text: Column) -> Column:
    out = text
    for bad, good in MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.when(F.contains(text, F.lit("\u00c3")), out).otherwise(text)


def punctuation(text: Column) -> Column:
    return F.replace(F.translate(text, PUNCT_FROM + ZERO_WIDTH, PUNCT_TO), F.lit(ELLIPSIS), F.lit("..."))


def drop_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def whitespace(text: Column) -> Column:
    """Runs of blanks to one space, of line breaks (with blanks around) to one line break."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t\n]*", "\n"), r"[ \t]+", " ")


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def normalize(text: Column, compose: bool = True, mojibake: bool = True) -> Column:
    text = nfc(text) if compose else text
    text = fix_mojibake(text) if mojibake else text
    return trim(whitespace(drop_control(punctuation(text))))
