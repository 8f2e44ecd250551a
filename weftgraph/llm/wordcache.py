"""Fast exact encoding with the tokenizers library through a bounded cache.

Both supported pre-tokenizers cut a text into pieces that the model encodes one
by one, so ids of a piece never depend on its neighbours. A text of plain Latin
characters is cut here; each piece's ids come from a cache, whose misses go to
the library's model. The cache is bounded in bytes: a full young half becomes the
old one, and pieces still in use move over from there. Any other text (other
scripts, control characters, special-token strings) is given to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from .common import one_model

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[^\t\n\r\x20-\x7e{LETTER}]")
CUT = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+"),
}
#: Bytes that the cache may take, in two halves; bounds a worker's memory.
CACHE_BYTES = 110_000_000
#: What an entry takes besides its characters and ids (two objects and a dictionary slot).
ENTRY_BYTES = 190
#: Characters that are cut at once, and where a text may be parted: no piece crosses
#: from a letter to the single space after it.
STRETCH = 200_000
SEAM = re.compile(rf"[{LETTER}](?= [{LETTER}])")
#: The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
SPACE = chr(BYTE_CHARS[32])


class WordCache:
    """Encoder of one tokenizer file; ``encode`` gives little-endian uint32 ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.word = self.tok.normalizer is not None
        self.cut = CUT["word" if self.word else "byte"]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if PLAIN.search(text) or ("<|" in text and any(s in text for s in self.special)):
            return self.whole(text)
        out = []
        start, n = 0, len(text)
        if self.word:
            text = text.lower()
        # Long texts go in stretches, so the list of their pieces stays short.
        while start < n:
            end = n if n - start <= 2 * STRETCH else self._seam(text, start + STRETCH)
            out.append(self._plain(self.cut.findall(text, start, end)))
            start = end
        return out[0] if len(out) == 1 else b"".join(out)

    @staticmethod
    def _seam(text: str, at: int) -> int:
        """A place from ``at`` on where no piece crosses: before a single space between letters."""
        m = SEAM.search(text, at)
        return m.start() + 1 if m else len(text)

    def _plain(self, words: list[str]) -> bytes:
        pieces = self.pieces
        missing = set(words).difference(pieces)
        if 2 * self.held > CACHE_BYTES:
            self.old, self.pieces, self.held = pieces, {}, 0
            pieces, missing = self.pieces, set(words)
        old = self.old
        for w in missing:
            raw = old.get(w)
            if raw is None:
                raw = self._model(w)
            pieces[w] = raw
            self.held += ENTRY_BYTES + len(w) + len(raw)
        return b"".join(map(pieces.__getitem__, words))

    def _model(self, w: str) -> bytes:
        shown = w.replace(" ", SPACE) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(BYTE_CHARS)
        tokens = self.tok.model.tokenize(shown)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


def encoder(path: str) -> WordCache:
    """The worker's encoder of a file."""
    return one_model(("words", path), lambda: WordCache(path))
