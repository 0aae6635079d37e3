"""Unicode helpers on string columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Soft hyphen, zero-width space/non-joiner/joiner, word joiner, byte-order mark.
INVISIBLE = "­​‌‍⁠﻿"
# ASCII white space and all characters of Unicode's separator categories.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Below U+0300 every character is its own canonical composition.
MAY_COMPOSE = "[^\\u0000-\\u02FF]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Canonical composition; only strings with a character from U+0300 on go through Python."""
    needs = c.rlike(MAY_COMPOSE)
    return F.when(needs, _nfc(F.when(needs, c))).otherwise(c)


def strip_blanks(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def fold_name(c: Column) -> Column:
    """A name without case and outer blanks."""
    return F.lower(strip_blanks(c))


def clean_term(c: Column) -> Column:
    """A term without invisible characters and outer blanks, in lower case and NFC."""
    return nfc(F.lower(strip_blanks(F.translate(c, INVISIBLE, ""))))
