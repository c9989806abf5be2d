"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode white space (fixed values).
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def tidy(c: Column | str) -> Column:
    """Lower case without outer white space (any Unicode white space)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c, F.lit(WHITE)))
