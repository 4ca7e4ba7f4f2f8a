"""Text as the rules read it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, and the separators among the control characters.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """text without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def filled(text: Column) -> Column:
    """text, stripped; null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))
