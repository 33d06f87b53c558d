"""How a text ends: completely, as a list, link, code or label does, or broken off."""

from __future__ import annotations

import re

COMPLETE, NATURAL, OPEN, MARKED, NOTHING = range(5)

#: Patterns that both Java's and Python's regular expressions read alike; they look at the last line, without blanks behind it.
TERMINAL = r"""[.!?。！？।॥؟۔｡]["'”’»」』）)\]】*_]*$"""
#: What a writer of logs puts where it cut.
MARK = r"(?:\[(?:cut|truncated|trimmed|snip|\.\.\.|…)\]|\((?:cut|truncated|trimmed)\)|<(?:cut|truncated)>|[^\s.…]…|�)$"
LINK = r"https?://\S+$"
CODE = r"`[^`\n]+`$"
FENCE = r"```$"
LABEL = r"(?:^|\s)[^\W\d_]+ ?[:：] ?\d+$"
ITEM = r"^\s*(?:\d+[.)]|[-*•])\s+\S.*$"
JSON = r"[\]}]$"
#: Stand-ins for nothing, between signs that are no letters or digits.
STAND_INS = frozenset(("null", "none", "nil", "nan", "undefined", "n/a", "n /a", "n/ a", "n / a", "na", "empty", "void", "no answer", "no response", "no output"))
#: Scripts that end sentences without a mark.
UNMARKED = r"[฀-໿]$"

_MARK, _UNMARKED, _ITEM = (re.compile(p) for p in (MARK, UNMARKED, ITEM))
_NATURAL = [re.compile(p) for p in (LINK, CODE, FENCE, LABEL)]
_FINAL, _CLOSERS = frozenset(".!?。！？।॥؟۔｡"), "\"'”’»」』）)】*_]"
_SIGN = re.compile(r"[^\W_]")


def core(text: str) -> str:
    """``text`` without the signs around its first and last letter or digit; empty if it has none."""
    first = _SIGN.search(text)
    if not first:
        return ""
    last = len(text)
    while not _SIGN.match(text, last - 1):
        last -= 1
    return text[first.start() : last]


def holds_nothing(text: str) -> bool:
    """Nothing but signs, or a stand-in for nothing."""
    held = core(text)
    return not held or len(held) <= 11 and held.lower() in STAND_INS


def ending(text: str) -> int:
    """One of the constants above, from the whole text."""
    if holds_nothing(text):
        return NOTHING
    text = text.rstrip()
    line = text[text.rfind("\n") + 1 :]
    if line.endswith("[...]"):
        return MARKED
    if line.rstrip(_CLOSERS)[-1:] in _FINAL:
        return COMPLETE
    if _MARK.search(line):
        return MARKED
    if line[-1] in "]}" and text.lstrip()[:1] in "[{":
        return COMPLETE
    if any(p.search(line) for p in _NATURAL) or _ITEM.match(line) or _UNMARKED.search(line):
        return NATURAL
    return OPEN
