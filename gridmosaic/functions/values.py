"""Values that an expression names several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it.

    Inside array functions Spark shares no common parts, so each mention of a
    column there is worked out again, and mentions inside mentions multiply.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
