"""Token ids of whole texts with the tokenizers library.

The library's pipeline takes most of its time on words it has seen before.
Texts are cut where the vocabulary's own pre-tokenizer cuts them, the
library's model encodes each piece that is new, and its ids are kept per
worker in a dictionary of bounded size.  Texts with characters outside the
ranges below (where the pre-tokenizer's and Python's Unicode tables could
differ, or normalisation could change them), or with the string of an added
token, are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from array import array

_PLAIN = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"

# The pre-tokenizers' patterns, as the vocabulary files state
# them, with letters and numbers spelt out for the characters of _PLAIN.
_CUTS = {
    "word": rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+",
    "byte": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+",
}


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}


_BYTES = _byte_characters()


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kind: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # a text with the string of an added token goes to the library, whatever its letters' case
        self.added = [re.compile(re.escape(t.content), re.I).search for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.cut = re.compile(_CUTS[kind]).findall
        self.lower = kind == "word"
        self.most, self.seen = most, {}

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalpha()):
            piece = piece.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        out, seen = [], self.seen
        get = seen.__getitem__
        for text in texts:
            if _PLAIN.search(text) or any(find(text) for find in self.added):
                out.append(array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            pieces = self.cut(text.lower() if self.lower else text)
            try:
                out.append(b"".join(map(get, pieces)))
            except KeyError:
                for p in [p for p in set(pieces) if p not in seen]:
                    seen[p] = self._piece(p)
                out.append(b"".join(map(get, pieces)))
                if len(seen) > self.most:
                    seen.clear()
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One per Python worker."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
