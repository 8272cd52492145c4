"""Text as compared by the text operators: letters and digits only, whatever the dress.

Every step is a regular expression or table over the whole text, so cost is linear in its length.
Offsets are kept on demand: each step is a list of replaced spans, from which positions map back.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right

#: Cyrillic and Greek letters that look like Latin ones, lower case after case folding.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһԛԝкмтвпνοαρτυικεβγηχωɡɩ", "aeopcyxijsdhqwkmtbnvoaptuikebynxwgi"))
#: Tags that end a word; all other tags stand inside one.
BREAKING_TAGS = ("br", "p", "div", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "hr", "section", "article")

_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,30});")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrt]))")
_PERCENT = re.compile(r"%([2-7][0-9a-fA-F])")
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>|<!--[^<>]*-->")
_LINK = re.compile(r"\]\([^()\s]*(?:\s\"[^\"]*\")?\)")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑¬][ \t]*\r?\n[ \t>*#|]*(?=[^\W\d_])")
#: What every match of _HYPHEN holds; quick to look for.
_MAY_HYPHEN = re.compile(r"[-‐‑¬][ \t]*\r?\n")
_EMPHASIS = re.compile(r"(?<=[^\W_])(?:\*{1,3}|_{2,3}|~~|`)(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def _entity(m: re.Match) -> str:
    return html.unescape(m.group())


def _escape(m: re.Match) -> str:
    return chr(int(m.group(1) or m.group(2), 16)) if not m.group(3) else " "


def _tag(m: re.Match) -> str:
    return " " if (m.group(1) or "br").lower() in BREAKING_TAGS else ""


def _fold(text: str) -> str:
    """Case folded, compatibility forms and accents removed, look-alikes as Latin letters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    return text.translate(_LOOK)


_LOOK = str.maketrans(LOOK_ALIKES)
#: (needed in the text, pattern, replacement), in order. Entities twice: they may be escaped themselves.
_STEPS = (
    ("&", _ENTITY, _entity), ("&", _ENTITY, _entity), ("\\", _ESCAPE, _escape), ("%", _PERCENT, lambda m: chr(int(m.group(1), 16))),
    ("<", _TAG, _tag), ("](", _LINK, lambda m: "] "), (None, _INVISIBLE, lambda m: ""), ("\n", _HYPHEN, lambda m: ""), (None, _EMPHASIS, lambda m: ""),
)


def plain(text: str, emphasis: bool = False) -> str:
    """The text without markup, escapes, invisible characters and hyphenation; case and punctuation stay.
    emphasis: leave asterisks and the like inside words."""
    for needs, pattern, by in _STEPS:
        if needs is None:
            if emphasis and pattern is _EMPHASIS or pattern is _INVISIBLE and text.isascii() or pattern is _EMPHASIS and not ("*" in text or "`" in text or "__" in text or "~~" in text):
                continue
        elif needs not in text or pattern is _HYPHEN and not _MAY_HYPHEN.search(text):
            continue
        text = pattern.sub(by, text)
    return text


def words(text: str) -> list[str]:
    """Runs of letters and digits of the plain, folded text."""
    return _WORD.findall(_fold(plain(text)))


def words_with_offsets(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """words(text) and, for each, the (start, end) it takes up in the original text."""
    maps = []
    for _, pattern, by in _STEPS:
        out, edits, at, shift = [], [], 0, 0
        for m in pattern.finditer(text):
            new = by(m)
            out += [text[at : m.start()], new]
            at = m.end()
            # (first position after the replacement in the new text, its position in the old text, where the replaced begins)
            edits.append((m.start() + shift, len(new), m.start(), m.end()))
            shift += len(new) - (m.end() - m.start())
        if edits:
            text = "".join(out) + text[at:]
            maps.append(edits)
    folded, origin = [], []
    for i, c in enumerate(text):
        f = _fold(c)
        folded.append(f)
        origin += [i] * len(f)

    def back(p: int, end: bool) -> int:
        for edits in reversed(maps):
            k = bisect_right(edits, p, key=lambda e: e[0]) - 1
            if k >= 0:
                new_at, n, old_at, old_end = edits[k]
                if p < new_at + n:
                    p = old_end - 1 if end else old_at
                else:
                    p = old_end + (p - new_at - n)
        return p

    found, spans = [], []
    for m in _WORD.finditer("".join(folded)):
        found.append(m.group())
        spans.append((back(origin[m.start()], False), back(origin[m.end() - 1], True) + 1))
    return found, spans
