"""Texts as they are rendered, and their words."""

from __future__ import annotations

import html
import re
import unicodedata

#: Tags that end a line or block when rendered; other tags vanish without a gap.
BREAKING = re.compile(r"(?is)</?(?:p|div|br|hr|li|ul|ol|h[1-6]|table|tr|td|th|thead|tbody|title|head|body|html|pre|blockquote|section|article|header|footer|noscript)(?:\s[^<>]*)?/?>")
TAG = re.compile(r"(?s)<!--.*?-->|</?[a-zA-Z][a-zA-Z0-9-]*(?:\s+[a-zA-Z_:][^<>]*)?\s*/?>")
INLINE = re.compile(r"(?is)</?(?:a|b|code|em|font|i|img|input|link|mark|meta|q|s|script|small|span|strong|style|sub|sup|u)(?:\s[^<>]*)?/?>|<!--.*?-->")
WORD = re.compile(r"[^\W_]+")


def _drop_format(s: str) -> str:
    if s.isascii():
        return s
    hidden = {c for c in set(s) if unicodedata.category(c) == "Cf"}
    return s.translate({ord(c): None for c in hidden}) if hidden else s


def rendered(text: str, *, all_tags: bool = True) -> str:
    """Tags removed, character references resolved (twice), compatibility forms made equal, format characters dropped.

    ``all_tags=False`` removes only the tags of HTML, so that ``<name>`` stays.
    """
    if "<" in text:
        text = (TAG if all_tags else INLINE).sub("", BREAKING.sub("\n", text))
    if "&" in text:
        once = html.unescape(text)
        text = html.unescape(once) if "&" in once else once
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _drop_format(text))
    return text


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the rendered text, case ignored."""
    return WORD.findall(rendered(text).casefold())
