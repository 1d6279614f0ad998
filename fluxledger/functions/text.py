"""Names, quoting and anchored patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOPIC_NAME = r"^[a-zA-Z0-9._-]{1,249}$"
_FLAGS = re.compile(r"^\(\?[a-zA-Z]+\)")


def valid_topic_name(name: Column) -> Column:
    return F.coalesce(name.rlike(TOPIC_NAME) & ~name.isin(".", ".."), F.lit(False))


def anchored(pattern: str) -> str:
    """A pattern that must match whole names; leading flags stay in front, and a broken pattern raises re.error."""
    re.compile(pattern)
    flags = m[0] if (m := _FLAGS.match(pattern)) else ""
    return f"{flags}^(?:{pattern[len(flags):]})$"


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
