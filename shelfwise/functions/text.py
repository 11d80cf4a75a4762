"""Text templates filled from columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced; NULL as soon as one value is."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)
