"""Exact tokenisation by the ``tokenizers`` library, with a bounded memo of words.

Both vocabularies split a text into words before they merge bytes, so a word's
ids depend on the word alone.  A worker keeps the ids of words that it has met
and asks the library's model for new ones.  The memo serves texts whose
characters every regular-expression engine classes alike (``PLAIN``) and that
hold no added token; all other texts go to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array

from tokenizers import Tokenizer

#: A character outside this set sends a text to the library: digits and letters other than Latin ones, marks, controls.
NOT_PLAIN = re.compile("[^\t-\r\x20-\x7e -±´-¸º»¿-ɏ‐-‧‰-⁞]")
#: Between plain letters or digits an ASCII space always ends one word and begins the next, in either vocabulary.
SAFE_CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: The vocabularies' word patterns, with [^\W\d_] for letters and \d for digits of plain texts.
BYTE_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
LOWER_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Words in the memo; about 100 MB.
MEMO_WORDS = 500_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


_BYTES = _byte_letters()


class _Memo(dict):
    def __init__(self, model, code: str):
        self.model, self.code = model, code

    def __missing__(self, word: str) -> bytes:
        ids = array(self.code, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts as packed unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.words = LOWER_WORDS if self.lower else BYTE_WORDS
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.memo = _Memo(self.library.model, "H" if self.width == 2 else "I")

    def plain(self, text: str) -> bool:
        return not NOT_PLAIN.search(text) and not self.added.search(text)

    def encode(self, text: str, piece: int = 1 << 20) -> bytes:
        """Longer texts are encoded from one safe cut to the next, which bounds memory."""
        out = []
        a = 0
        while a < len(text):
            cut = SAFE_CUT.search(text, a + piece) if len(text) - a > piece else None
            b = cut.start() if cut else len(text)
            out.append(self._piece(text[a:b]))
            a = b
        return b"".join(out)

    def _piece(self, text: str) -> bytes:
        if self.plain(text):
            return b"".join(map(self.memo.__getitem__, self.words.findall(text.lower() if self.lower else text)))
        return array("H" if self.width == 2 else "I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        """Where each word of a chunk begins and how many tokens it has."""
        if self.plain(text) and len(low := text.lower() if self.lower else text) == len(text):
            found = [(m.start(), len(self.memo[m[0]]) // self.width) for m in self.words.finditer(low)]
        else:
            e = self.library.encode(text, add_special_tokens=False)
            found, last = [], object()
            for (start, _), word in zip(e.offsets, e.word_ids):
                if word is None or word != last:
                    found.append((start, 1))
                else:
                    found[-1] = (found[-1][0], found[-1][1] + 1)
                last = word
        return [s for s, _ in found], [n for _, n in found]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process; its memo outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
