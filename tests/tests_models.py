"""Plain-Python models shared by tests."""

from __future__ import annotations


def lines_model(text, width=45):
    total = 0
    for paragraph in text.split("\n"):
        used = 0
        for w in paragraph.split():
            if used and used + 1 + len(w) <= width:
                used += 1 + len(w)
            else:
                total, used = total + 1, len(w)
    return total


ENDS, OPENERS = set(".!?…"), set("ĄĆĘŁŃÓŚŹŻ—–-") | {chr(c) for c in range(ord("A"), ord("Z") + 1)}


def sentence_model(t):
    """A scan over signs: white space between a sign that ends sentences and one that opens them is a cut."""
    pieces, own = [], ""
    for k, c in enumerate(t):
        rest = t[k:].lstrip()
        if c.isspace() and own and own.rstrip()[-1:] in ENDS and own[-1:] in ENDS and rest and rest[0] in OPENERS:
            pieces.append(own)
            own = ""
        elif own or not c.isspace() or not pieces:
            own += c
    found = [p.strip() for p in [*pieces, own] if p.strip()]
    return found or [""]
