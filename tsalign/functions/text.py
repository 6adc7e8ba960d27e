"""Text columns: cleaning, combining, asset detection, hashing, token counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Asset word patterns.
ASSET_PATTERNS = {
    "BTC": [r"\bbtc\b", r"\bbitcoin\b"],
    "ETH": [r"\beth\b", r"\bethereum\b"],
}

# U+001C..U+001F count as white space besides the Unicode set behind (?U)\s.
_URL = r"(?U)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
_NON_ASCII = r"[^\x00-\x7F]"
# Runs of blanks that are not already one plain space, so most spaces are left alone.
_BLANKS = r" [\s\x1c-\x1f]+|[\t-\r\x1c-\x1f][\s\x1c-\x1f]*"
_TOKEN = r"[^\s\x1c-\x1f]+"


def clean_text(c: Column) -> Column:
    """URLs to a space, non-ASCII removed, blanks collapsed, trimmed; NULL to ``''``."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), _URL, " ")
    c = F.regexp_replace(c, _NON_ASCII, "")
    return F.trim(F.regexp_replace(c, _BLANKS, " "))


def combine_post_text(title: Column, body: Column) -> Column:
    return F.trim(combine_news_text(title, body))


def combine_news_text(title: Column, body: Column) -> Column:
    """``title + ' ' + body`` with NULL as ``''``, not stripped."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def _asset_hits(c: Column, patterns: Mapping[str, Sequence[str]]) -> list[Column]:
    low = F.lower(c)
    return [F.when(low.rlike("|".join(words)), F.lit(asset)) for asset, words in sorted(patterns.items())]


def detect_assets(c: Column, patterns: Mapping[str, Sequence[str]] = ASSET_PATTERNS) -> Column:
    """Sorted array of the assets any of whose word patterns occurs in the lower-cased (clean) text."""
    return F.array_except(F.array(*_asset_hits(c, patterns)), F.array(F.lit(None).cast("string")))


def asset_list(c: Column, patterns: Mapping[str, Sequence[str]] = ASSET_PATTERNS) -> Column:
    """The detected assets joined by commas, ``'OTHER'`` when there are none."""
    return F.regexp_replace(F.concat_ws(",", *_asset_hits(c, patterns)), "^$", "OTHER")


def text_hash(c: Column) -> Column:
    """SHA-256 hex digest of the lower-cased text."""
    return F.sha2(F.lower(c), 256)


def token_count(c: Column) -> Column:
    """White-space separated tokens; 0 for blank text."""
    return F.regexp_count(c, F.lit(_TOKEN))
