"""Token ids of whole texts, looked up word by word.

The vocabulary's pre-tokenizer never joins across white space, so the ids of a
text are those of its words one after the other; a worker remembers the words
it has seen.  A word of Latin letters with signs behind it, the common case,
is given to the model in those two parts directly; any other is encoded as
a text of its own.  Tests hold the result against encoding whole texts.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

#: Words that a worker remembers; further ones are encoded each time.
REMEMBERED = 250_000
_PARTS = re.compile(r"([^\W\d_]*)([.,;:!?*$%&#|]*)")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself
    if printable, else one of those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordIds(dict):
    """UTF-8 word -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        found = _PARTS.fullmatch(text)
        if found and (word.isascii() or max(text) < "ɐ" and "İ" not in text and unicodedata.is_normalized("NFC", text)):
            ids = self._part(found[1].lower()) + self._part(found[2])
        else:
            ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            written = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            ids = _packed([t.id for t in self.tokenizer.model.tokenize(written)])
            if len(self.parts) < REMEMBERED:
                self.parts[part] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table for each worker process and vocabulary."""
    return WordIds(path)


def encode(text: str | None, path: str) -> bytes:
    """A text's ids, packed (null: none)."""
    return b"".join(map(word_ids(path).__getitem__, (text or "").encode().split()))
