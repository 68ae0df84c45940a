"""Words of texts, cut fast: lower case, ASCII letters and digits and all bytes beyond ASCII make words."""

from __future__ import annotations

_WORD = {*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)}
#: Every other byte becomes a space; in LINES line ends stay, in SENTENCES full stops and their like become line ends.
PLAIN = bytes(b if b in _WORD else 32 for b in range(256))
LINES = bytes(b if b in _WORD or b == 10 else 32 for b in range(256))
SENTENCES = bytes(b if b in _WORD else 10 if b in b"\n.!?" else 32 for b in range(256))


def _lower(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    return _lower(text).translate(PLAIN).split()


def lines(text: str | None) -> list[list[bytes]]:
    """The words of each line (of text between line ends)."""
    return [x.split() for x in _lower(text).translate(LINES).split(b"\n")]


def sentences(text: str | None) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    return [w for x in _lower(text).translate(SENTENCES).split(b"\n") if (w := x.split())]
