"""JSON texts as VARIANT, whole texts alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands behind a text to see whether it ends there.
END = "cairnflow: end"


def parsed(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing more; else null.

    Spark's parser takes a value and leaves what follows; so the text must also stand as one
    element of a list in front of another.
    """
    ended = F.get_json_object(F.concat(F.lit("["), text, F.lit(f',"{END}"]')), "$[1]") == END
    return F.when(ended, F.try_parse_json(text))


def parsed_or_raise(text: Column) -> Column:
    """The same, but a text that isn't one JSON value raises when it is read; null stays null."""
    shown = F.concat(F.lit("not JSON: "), F.substring(text, 1, 200))
    return F.coalesce(parsed(text), F.when(text.isNotNull(), F.raise_error(shown).cast("variant")))
