"""Words of a text, whatever its case, compatibility forms, markup, line breaks, quoting and invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

#: Inline tags, whose removal joins what they stood in; any other tag parts words.
INLINE_TAGS = "a abbr b big cite code em font i kbd mark s small span strike strong sub sup tt u var wbr"

_INLINE = re.compile(r"</?(?:" + "|".join(INLINE_TAGS.split()) + r")(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,400}>|<!--.*?-->", re.S)
_STARS = re.compile(r"(?<=[^\W_])[*`~]{1,3}(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def visible(text: str) -> str:
    """``text`` without characters that aren't seen: format characters, joiners and variation selectors."""
    if text.isascii():
        return text
    return "".join(c for c in text if not (unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or c == "͏"))


def without_markup(text: str) -> str:
    """``text`` without tags, character references and emphasis marks inside words."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return text


def plain(text: str) -> str:
    """Markup and invisible characters removed, compatibility forms and case folded."""
    text = visible(without_markup(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return _STARS.sub("", text) if "*" in text or "`" in text or "~" in text else text


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the plain text; null and empty texts have none."""
    return _WORD.findall(plain(text)) if text else []
