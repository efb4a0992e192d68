"""String columns: normal forms, masks, formats, predicates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Named = Column | str


def col(c: Named) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Named, cap: int | None = None) -> Column:
    """Trimmed, runs of white space as one space, at most ``cap`` characters."""
    out = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.left(out, F.lit(cap)) if cap else out


def extension(c: Named) -> Column:
    """Lower-cased and trimmed, without one leading dot; null is ''."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), r"^\.", "")


def destination_extension(c: Named) -> Column:
    """As ``extension``, without any leading dots."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), r"^\.+", "")


def mime_type(c: Named) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit(""))))


def path(c: Named) -> Column:
    """Slashes only, no empty parts, lower case."""
    parts = F.split(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\\"), F.lit("/")), "/")
    return F.lower(F.array_join(F.filter(parts, lambda x: x != ""), "/"))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern, made when the plan is."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "]") else i + 1) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > i:
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner.replace("[", "\\[")) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_any(c: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        if p:
            found = found | c.rlike(glob_regex(p))
    return found


def redacted(c: Named, cap: int = 500) -> Column:
    """Values of secret-like assignments replaced, white space collapsed, capped."""
    out = F.regexp_replace(col(c), r"(?i)(bearer|access[_ -]?token|refresh[_ -]?token|client_secret|service[_ -]?role|password|authorization)\s*[:=]\s*\S+", "$1=[REDACTED]")
    return collapse(out, cap)


def short_id(c: Named) -> Column:
    x = col(c)
    return F.when(F.char_length(x) > 12, F.concat(F.left(x, F.lit(8)), F.lit("…"), F.right(x, F.lit(4)))).otherwise(x)


def masked_filename(c: Named) -> Column:
    x = col(c)
    ext = F.left(F.regexp_replace(F.regexp_extract(x, r"(\.[^.]*)$", 1), "[^.A-Za-z0-9]", ""), F.lit(10))
    return F.concat(F.lit("Restricted file"), F.lower(ext))


def masked_email(c: Named) -> Column:
    x = col(c)
    return F.concat(F.left(x, F.lit(1)), F.lit("***@"), F.substring_index(x, "@", -1))


def format_bytes(c: Named) -> Column:
    """'n B', then KB without and larger units with one decimal, halves up; null is a dash."""
    x = col(c)
    out = F.when(x.isNull(), "—").when(x < 1024, F.concat(x.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        digits = 0 if power == 1 else 1
        value = F.round(x.cast("decimal(30,10)") / F.lit(1024**power).cast("decimal(20,0)"), digits).cast(f"decimal(20,{digits})")
        out = out.when(x < 1024 ** (power + 1), F.concat(value.cast("string"), F.lit(f" {unit}")))
    value = F.round(x.cast("decimal(30,10)") / F.lit(1024**4).cast("decimal(20,0)"), 1).cast("decimal(20,1)")
    return out.otherwise(F.concat(value.cast("string"), F.lit(" TB")))


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def nfc(c: Named) -> Column:
    """Canonical composition. No built-in function composes, so texts go to Python in Arrow batches."""
    return _composed(col(c))


#: Names that some file systems keep for devices (fixed values).
DEVICES = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
#: What parts the pieces of a stem: two or more of white space, control characters, slashes, dots, lines and hyphens, or one that a stem can't hold.
PARTED = r"(?U)[\s\x00-\x1f/\\._-]{2,}|[\s\x00-\x1f/\\-]"


def safe_stem(name: Named, ext: Named) -> Column:
    """A portable stem of a file's name: its pieces in composed form, joined by hyphens.

    A piece holds no white space, control character or slash; single dots and lines within are kept, at the ends of the stem
    they aren't. ``ext`` at the end of the name is no part of it. Names of devices give ''.
    """
    bare = F.regexp_replace(nfc(name), F.concat(F.lit(r"(?iU)[.]\Q"), col(ext), F.lit(r"\E\s*$")), F.lit(""))
    stem = F.btrim(F.array_join(F.filter(F.split(bare, PARTED), lambda piece: piece != ""), "-"), F.lit("._"))
    return F.when(stem.rlike(DEVICES), "").otherwise(stem)


def looks_sensitive(stem: Named) -> Column:
    x = col(stem)
    return (x == "") | F.contains(x, F.lit("@")) | F.lower(x).rlike(r"\b(?:patient|mrn|dob|mobile|phone|email)\b") | x.rlike(r"[0-9]{7,}")


def destination_name(asset_hex: Named, ext: Named, original: Named | None = None, most: int = 120) -> Column:
    """``<stem>__<8 hex>.<ext>``; the stem is 'asset' where there is none that is safe."""
    e = destination_extension(ext)
    tail = F.concat(F.left(F.regexp_replace(col(asset_hex), "-", ""), F.lit(8)), F.lit("."), e)
    stem = F.lit("") if original is None else safe_stem(original, e)
    prefix = F.when(F.lit(original is None) | looks_sensitive(stem), "asset__").otherwise(F.concat(stem, F.lit("__")))
    cut = F.regexp_replace(F.left(prefix, F.lit(most) - F.char_length(tail)), r"[ .-]+$", "")
    return F.concat(F.when(cut == "", "asset__").otherwise(cut), tail)


def folder_id(url: Named) -> Column:
    """Folder id of an https folder link without user or port, else null."""
    return F.nullif(F.regexp_extract(F.trim(col(url)), r"^(?i:https)://(?i:drive\.google\.com)/drive/(?:u/[0-9]+/)?folders/([A-Za-z0-9_-]+)/?(?:[?#].*)?$", 1), F.lit(""))


def trigrams(c: Named) -> Column:
    """Distinct trigrams of lower-cased words of letters and digits, padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_similarity(a: Named, b: Named) -> Column:
    """Shared over all trigrams; 0 where there are none."""
    x, y = trigrams(a), trigrams(b)
    both, total = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


def byte_range(header: Named, size: Named) -> Column:
    """struct(start, end) of a single ``bytes=`` range within ``size``, else null."""
    a, b, n = F.regexp_extract(col(header), r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(col(header), r"^bytes=(\d*)-(\d*)$", 2), col(size).cast("long")
    first, last = F.expr("null").cast("long"), F.expr("null").cast("long")
    start = F.when((a == "") & (b != ""), F.greatest(F.lit(0).cast("long"), n - F.try_to_number(b, F.lit("9" * 18)).cast("long"))).when(a != "", a.try_cast("long")).otherwise(first)
    end = F.when((a == "") | (b == ""), n - 1).when(b != "", F.least(n - 1, b.try_cast("long"))).otherwise(last)
    return F.when(start.isNotNull() & (start <= end) & (start < n), F.struct(start.alias("start"), end.alias("end")))


def boolean(c: Named) -> Column:
    """true/yes/1/on and false/no/0/off in any case; else null."""
    x = F.lower(F.trim(col(c)))
    return F.when(x.isin("true", "yes", "1", "on"), True).when(x.isin("false", "no", "0", "off"), False)


def joined_path(*parts: Named) -> Column:
    """Parts joined by one slash; outer slashes and empty parts go."""
    clean = F.array(*[F.regexp_replace(F.coalesce(col(p), F.lit("")), r"^/+|/+$", "") for p in parts])
    return F.array_join(F.filter(clean, lambda x: x != ""), "/")


def path_depth(c: Named) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), "/"), lambda x: x != ""))


def cache_key(c: Named, cap: int = 120) -> Column:
    """A key that is safe as a file name."""
    return F.left(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), F.lit(cap))


def with_offset(c: Named, zone: str, offset: str) -> Column:
    """A time (of a session in UTC) as ISO text of a zone, with its fixed offset."""
    return F.concat(F.date_format(F.from_utc_timestamp(col(c), zone), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))
