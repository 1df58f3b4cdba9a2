"""Text cleaning as column expressions (JVM side, no Python per row).

The patterns spell out Unicode classes where the regex engines of the JVM and of the
definitions disagree: a word character is a letter, a number or ``_`` (no combining marks),
and whitespace includes the separators U+001C..U+001F.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product
from string import digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.schemas import MIN_MEANINGFUL_LENGTH

# Character classes, patterns, entities and placeholders.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f"
TAG_PATTERN = r"<[^>]++>"
URL_PATTERN = rf"(?U)(?i)(?:https?://|www\.)[^{SPACE}]+"
SPACE_PATTERN = rf"(?U)[{SPACE}]+"
URL_STARTS = ("://", *["".join(www) + "." for www in product("wW", repeat=3)])
EMAIL_PATTERN = rf"(?U)(?:\G|(?<![{WORD}.+-]))[{WORD}.+-]++@[{WORD}-]+\.[a-zA-Z]{{2,}}"
PHONE_PATTERN = rf"(?U)(?<![{WORD}])(?:\+?\p{{Nd}}[\p{{Nd}}{SPACE}().-]{{7,}}\p{{Nd}})(?![{WORD}])"
EMAIL_MASK = "[EMAIL]"
PHONE_MASK = "[PHONE]"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _where(c: Column, given: Callable[[Column], Column], changed: Callable[[Column], Column]) -> Column:
    """``changed`` for the texts that may hold a match, which a plain look shows; others pass as they are.

    The text is bound to a name: repeated in nested steps its expression would grow without end.
    """
    return F.transform(F.array(c), lambda x: F.when(given(x), changed(x)).otherwise(x))[0]


def _has(*parts: str) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(part)) for part in parts])


def _icu(class_name: str, method: str, c: Column) -> Column:
    """Call a static (String, boolean) method of the Unicode library Spark ships with.

    Only rows with a non-ASCII character pay for the call.
    """
    return F.when(
        c.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit(class_name), F.lit(method), c, F.lit(True))
    ).otherwise(c)


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC; ASCII rows pass through untouched."""
    return _icu("com.ibm.icu.text.Normalizer", "compose", _column(c))


def casefold(c: Column | str) -> Column:
    """Full Unicode case folding; ASCII rows use plain ``lower``."""
    col = _column(c)
    folded = F.reflect(
        F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), col, F.lit(True)
    )
    return F.when(col.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(col))


def strip_html(c: Column | str) -> Column:
    """Tags become a space, then six entities are unescaped.

    No replacement can complete another entity except ``&``, so replacing ``&amp;`` last
    gives the result of a single pass: ``&amp;lt;`` becomes ``&lt;``, not ``<``.
    """

    def unescaped(out: Column) -> Column:
        for entity, char in ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(char))
        return out

    bare = _where(_column(c), _has("<"), lambda x: F.regexp_replace(x, TAG_PATTERN, " "))
    return _where(bare, _has("&"), unescaped)


def strip_urls(c: Column | str) -> Column:
    return _where(_column(c), _has(*URL_STARTS), lambda x: F.regexp_replace(x, URL_PATTERN, " "))


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_column(c), SPACE_PATTERN, " "))


def normalize_text(c: Column | str) -> Column:
    """NFKC, then tags and entities, then URLs, then whitespace; the order matters."""
    return collapse_whitespace(strip_urls(strip_html(nfkc(c))))


def mask_email(c: Column | str) -> Column:
    """E-mail addresses become a placeholder.

    A match can only start where a run of address characters starts (or where the last
    match ended), so long unbroken runs stay linear.
    """
    return _where(_column(c), _has("@"), lambda x: F.regexp_replace(x, EMAIL_PATTERN, EMAIL_MASK))


def mask_phone(c: Column | str) -> Column:
    return _where(_column(c), lambda x: _has(*digits)(x) | (F.octet_length(x) != F.length(x)), lambda x: F.regexp_replace(x, PHONE_PATTERN, PHONE_MASK))


def mask_pii(c: Column | str) -> Column:
    return mask_phone(mask_email(c))


def content_hash(c: Column | str) -> Column:
    """SHA-256 hex digest of the UTF-8 text."""
    return F.sha2(_column(c), 256)


def is_meaningful(c: Column | str) -> Column:
    return F.length(_column(c)) >= MIN_MEANINGFUL_LENGTH
