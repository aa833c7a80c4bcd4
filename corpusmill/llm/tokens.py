"""Token ids of whole texts with the tokenizers library, with the ids of words kept between texts."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: Words whose ids a worker keeps; beyond that it forgets the older half.
KEPT_WORDS = 300_000

#: Texts of these characters only are cut into words here: on them the patterns below mean the same as the
#: library's own. Any other text goes through the library whole.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧₠-₿]*")
_LETTERS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
#: How byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on.
_BYTES = {**{b: b for b in _SHOWN}, **{b: 256 + i for i, b in enumerate(_HIDDEN)}}
_BLANK = chr(_BYTES[32])


def _shown(part: str) -> str:
    """How a byte-level vocabulary writes a string."""
    if part.isascii() and part.isprintable():
        return part.replace(" ", _BLANK)
    return part.encode().decode("latin-1").translate(_BYTES)


@lru_cache(maxsize=2)
def shared_encoder(path: str, words: bool) -> Encoder:
    """The encoder of this process; tasks that follow one another in a worker share it and the words that it keeps."""
    return Encoder(path, words)


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, the same as encode(text, add_special_tokens=False) gives.

    ``words``: the vocabulary lower-cases and drops white space, so texts are cut there; otherwise
    words keep the blank before them.
    """

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.known = Tokenizer.from_file(path), words, {}
        self.number = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _unit(self, part: str) -> bytes:
        return b"".join([self.number[t.id] for t in self.tokenizer.model.tokenize(_shown(part))])

    def _word(self, word: str) -> bytes:
        if not self.words or word.isascii() and word.isalpha():
            return self._unit(word)
        known, found = self.known, []
        for part in _PARTS.findall(word):
            # A part alone has the same ids, so words with a comma behind them cost a lookup.
            ids = known.get(part)
            if ids is None:
                ids = known[part] = self._unit(part)
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        units, known = text.lower().split() if self.words else _LETTERS.findall(text), self.known
        try:
            return b"".join(map(known.__getitem__, units))
        except KeyError:
            pass
        if len(known) > KEPT_WORDS:
            for word in list(islice(known, len(known) // 2)):
                del known[word]
        new = set(units).difference(known)
        if len(new) > KEPT_WORDS:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for u in new:
            known[u] = self._word(u)
        return b"".join(map(known.__getitem__, units))
