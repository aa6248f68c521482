"""Sentences of a block: cuts at terminal punctuation before layout space, but for vetoes.

A cut stands after `.`, `!` or `?` with any closing marks, followed by line ends or by spaces,
if what comes next can open a sentence (a capital, digit, quote or opening bracket). It is
vetoed where the text before it ends in an ellipsis, an abbreviation or a person's initial.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from vellum.functions import fixed

_CLOSER = f"[{re.escape(fixed.CLOSERS)}]*"
_OPENS = r"(?=[A-Z0-9\"'(\[])"
CUT = re.compile(rf"[.!?]{_CLOSER}(?:(?:[ \t]*\n)+[ \t]*|[ \t]+){_OPENS}")
ELLIPSIS = re.compile(r"(?:\.\s*){2,}$")
DOTTED = re.compile(r"([A-Za-z.]+)\.$")
LAST_WORD = re.compile(r"([A-Za-z][A-Za-z.']*)[^A-Za-z.]*$")
INNER_CUT = re.compile(rf"[.!?]{_CLOSER}[ \t]+{_OPENS}")
#: Only so much before a cut can matter to a veto; it bounds the work on very long blocks.
VETO_REACH = 400


class Sentence(NamedTuple):
    text: str
    start: int
    end: int


def last_word(text: str) -> str | None:
    found = LAST_WORD.search(text[-VETO_REACH:])
    return found[1].lower() if found else None


def vetoed(fragment: str) -> bool:
    """Whether a fragment, up to a possible cut, does not end a sentence after all."""
    trimmed = fragment[-VETO_REACH:].rstrip()
    tail = trimmed.rstrip(fixed.CLOSERS)
    if ELLIPSIS.search(tail):
        return True
    found = DOTTED.search(tail)
    if not found:
        return False
    token = found[1].lower().removesuffix(".")
    if token in fixed.ABBREVIATIONS:
        return True
    if len(token) != 1:
        return False
    # A single letter is an initial if nothing, another initial, an opening mark or a name's introducer precedes it.
    before = trimmed[: len(trimmed) - len(found[1]) - 1].rstrip()
    return not before or bool(re.search(r"\b[A-Z]\.", before, re.A)) or before[-1] in "[]('\"“‘" or last_word(before) in fixed.NAME_INTRODUCERS


def split(text: str) -> list[Sentence]:
    """The sentences with their offsets, trimmed of white space, none of them empty."""
    cuts = [0]
    for m in CUT.finditer(text):
        if not vetoed(text[max(cuts[-1], m.end() - VETO_REACH) : m.end()]):
            cuts.append(m.end())
    cuts.append(len(text))
    out = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        piece = text[low:high]
        left = len(piece) - len(piece.lstrip(fixed_space))
        body = piece.strip(fixed_space)
        if body:
            out.append(Sentence(body, low + left, low + left + len(body)))
    return out


fixed_space = "".join(c for c in map(chr, range(0x10000)) if re.match(fixed.SPACE_CLASS, c))
