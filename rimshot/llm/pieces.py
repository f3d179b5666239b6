"""Cutting a text where byte-level BPE pre-tokenisation always has a boundary, and a bounded memo over the cuts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: A word with the space before it, or one line feed.
_COARSE = re.compile(r" ?\S+|\n")
#: Besides, letters and digits apart from other signs.
_FINE = re.compile(r" ?[^\W_]+| ?(?:[^\w\s]|_)+|\n")


def pieces(text: str) -> list[str] | None:
    """The text cut before each single space and around each single line feed; None if it has other white space.

    Between two characters that are no white space, a lone space or line feed starts a new pre-token under the
    pattern of byte-level BPE whatever stands around it, so the pieces can be encoded one by one. Runs of white
    space, white space at an end and other white space do not have this property: the caller encodes such a
    text whole. A text of Latin-1 characters without an apostrophe is also cut between letters or digits and
    other signs, which the pattern always parts (beyond Latin-1, libraries differ on what is a letter).
    """
    if "\n\n" in text or " \n" in text or "\n " in text or text[-1:] == "\n" or text[:1] in (" ", "\n"):
        return None
    pattern = _COARSE
    if "'" not in text:
        try:
            text.encode("latin-1")
            pattern = _FINE
        except UnicodeEncodeError:
            pass
    found = pattern.findall(text)
    # what the pattern leaves out is other white space, or a space before white space
    return found if sum(map(len, found)) == len(text) else None


class Memo:
    """piece -> encoded ids (bytes of little-endian uint32), with at most ``limit`` entries (about 200 bytes each), then begun anew."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 800_000, longest: int = 256):
        self.encode, self.limit, self.longest, self.known = encode, limit, longest, {}

    def ids(self, texts: list[list[str]]) -> Iterable[bytes]:
        """Ids of each text, given as its pieces; every unknown piece of all texts is encoded once, together."""
        wanted = set().union(*texts) if texts else set()
        fresh = list(wanted.difference(self.known))
        if len(self.known) + len(fresh) > self.limit:
            self.known, fresh = {}, list(wanted)
        self.known.update(zip(fresh, self.encode(fresh)))
        for t in texts:
            yield b"".join(map(self.known.__getitem__, t))
        if len(self.known) > self.limit:
            self.known = {}
        for p in fresh:
            if len(p) > self.longest:
                self.known.pop(p, None)


def slices(texts: list[str], most_chars: int) -> Iterable[list[str]]:
    """Consecutive slices of at most ``most_chars`` characters (or one text)."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > most_chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part
