"""Event details: JSON objects without prohibited keys, their texts redacted, still JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Named, col, redacted

#: Keys that no event keeps, in any case.
PROHIBITED = ("access_token", "refresh_token", "authorization", "client_secret", "password", "signed_url", "connection_string")
DEPTH = 4
CAP = 500


def _quoted(s: Column) -> Column:
    """A JSON string."""
    t = F.to_json(F.array(s))
    return F.substr(t, F.lit(2), F.char_length(t) - 2)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(v), F.lit("{")) & F.json_object_keys(v).isNotNull(), F.lit(False))


def _is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(v), F.lit("[")) & F.json_array_length(v).isNotNull(), F.lit(False))


def _object(v: Column, depth: int, cap: int) -> Column:
    kept = F.filter(F.map_entries(F.from_json(v, "map<string,string>")), lambda e: ~F.lower(e["key"]).isin(*PROHIBITED))
    return F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _value(e["value"], depth, cap))), ","), F.lit("}"))


def _value(v: Column, depth: int, cap: int) -> Column:
    out = F.when(v.isNull(), "null")
    if depth:
        items = F.transform(F.from_json(v, "array<string>"), lambda x: _value(x, depth - 1, cap))
        out = out.when(_is_object(v), _object(v, depth - 1, cap)).when(_is_array(v), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    else:
        out = out.when(_is_object(v) | _is_array(v), '"[REDACTED]"')
    return out.otherwise(_quoted(redacted(v, cap)))


def sanitized(c: Named, depth: int = DEPTH, cap: int = CAP) -> Column:
    """Details as JSON again: prohibited keys gone at every level, every text redacted and capped by itself.

    Leaves are texts afterwards (numbers and truth values as they are written, null stays null). Objects and arrays more than ``depth``
    levels down are one '[REDACTED]'. A text that holds a JSON object is treated like the object. What is no JSON object is redacted as text.
    """
    x = col(c)
    return F.when(_is_object(x), _object(x, depth, cap)).otherwise(redacted(x, cap))
