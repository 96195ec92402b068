"""Text functions: accents, templates, traces, exact casts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Letters that stand for two, and letters with a stroke.
LIGATURES = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss"}
STROKES = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L"}


def _accented() -> tuple[str, str]:
    """Every Latin letter that decomposes into a base letter and marks, with its base."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.combining(m) for m in marks):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccent(c: Column) -> Column:
    """Text without accents; case is kept."""
    source, target = _accented()
    out = F.translate(c, source + "".join(STROKES), target + "".join(STROKES.values()))
    for letter, pair in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.regexp_replace(out, r"\p{Mn}", "")


def same_unaccented(a: Column, b: Column) -> Column:
    """Equality that ignores accents and keeps case."""
    return unaccent(a) == unaccent(b)


def interpolate(template: str, meta: str = "meta", env: Mapping[str, str] | None = None) -> Column:
    """`${_meta.k}` and `${! meta("k")}` read metadata, `${NAME}` the environment; unknown names give ''."""
    parts, last = [], 0
    for found in re.finditer(r"\$\{([^}]+)\}", template):
        parts.append(F.lit(template[last : found.start()]))
        name, last = found.group(1), found.end()
        called = re.match(r'!\s*meta\(\s*"([^"]+)"\s*\)', name)
        key = called.group(1) if called else name.removeprefix("_meta.") if name.startswith("_meta.") else None
        if key is not None:
            parts.append(F.coalesce(F.try_element_at(meta, F.lit(key)), F.lit("")))
        else:
            parts.append(F.lit((env or {}).get(name, "")))
    return F.concat(*parts, F.lit(template[last:]))


def traceparent(c: Column) -> Column:
    """The text when it is a W3C trace parent, else ''."""
    return F.coalesce(F.when(c.rlike(r"^[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$"), c), F.lit(""))


def cast_exact(c: Column, kind: str) -> Column:
    """Text as `kind`; text that does not cast is an error, null stays null."""
    made = c.try_cast(kind)
    return F.when(c.isNotNull() & made.isNull(), F.raise_error(F.concat(F.lit(f"not a {kind}: "), c))).otherwise(made)
