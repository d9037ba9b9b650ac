"""Token ids of whole texts through a bounded cache of encoded words."""

from __future__ import annotations

import os
import re
from array import array

#: White space is a token boundary for this family of vocabularies, so a text's ids are the ids of its pieces between
#: ASCII white space. Lower-casing the ASCII letters first is neutral, except where a letter meets a combining mark or
#: a special token may be spelled.
_MARK = re.compile(rb"\xcc[\x80-\xbf]|\xcd[\x80-\xaf]|<\|")
_TAIL = b",.!?;:%&*#$"


class WordEncoder:
    """Encodes texts as the tokenizers library does, each distinct word once while it stays in the cache.

    The cache holds at most ``capacity`` words, which bounds the memory of a task: two generations of half of them, the
    older one going when the younger is full. Words that return move to the younger one.
    """

    def __init__(self, path: str, capacity: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}
        self.capacity, self.known, self.older = capacity, {}, {}

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        raw = text.encode("utf-8")
        low = raw.lower()
        pieces = raw.split() if _MARK.search(low) else low.split()
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > self.capacity // 2:
                self.known, self.older = {}, self.known
            missing = {p for p in pieces if p not in self.known}
            again = missing & self.older.keys()
            self.known.update((p, self.older[p]) for p in again)
            self._learn(missing - again)
            found = list(map(self.known.__getitem__, pieces))
        return b"".join(found)

    def _learn(self, pieces: set[bytes]) -> None:
        """Encode new pieces; a word followed by marks is put together from the word and the marks."""
        split, words, others, known, older = [], set(), set(), self.known, self.older
        for piece in pieces:
            core = piece.rstrip(_TAIL)
            whole = core.isalpha()
            if not whole:
                word = core.decode("utf-8")
                # A letter that lower-cases to a letter and a mark would be joined by the marks after it.
                whole = word.isalpha() and len(word.lower()) == len(word)
            if whole:
                if core in older:
                    known[core] = older[core]
                elif core not in known:
                    words.add(core)
                if core != piece:
                    tail = piece[len(core) :]
                    split.append((piece, core, tail))
                    if tail not in known:
                        others.add(tail)
            else:
                others.add(piece)
        self._encode_words(sorted(words))
        self._encode_each(sorted(others))
        for piece, core, tail in split:
            known[piece] = known[core] + known[tail]

    def _encode_words(self, words: list[bytes]) -> None:
        """Words of letters end at a token that closes a word, so many of them share one call."""
        for start in range(0, len(words), 5000):
            block = words[start : start + 5000]
            ids, parts, begin = self._call(b" ".join(block).decode("utf-8")), [], 0
            for at, token in enumerate(ids, 1):
                if token in self.ends:
                    parts.append(ids[begin:at])
                    begin = at
            if len(parts) == len(block):
                self.known.update(zip(block, (array("I", p).tobytes() for p in parts), strict=True))
            else:
                self._encode_each(block)

    def _encode_each(self, pieces: list[bytes]) -> None:
        for piece in pieces:
            self.known[piece] = array("I", self._call(piece.decode("utf-8"))).tobytes()

    def _call(self, text: str) -> list[int]:
        # Without the places of the tokens in the text, which the plain call keeps.
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary; the path is local to every worker, as installed software."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
