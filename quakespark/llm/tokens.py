"""Token ids of whole texts with a tokenizers file, without encoding the same word twice.

The tokenizer used here drops white space before it splits, so the tokens of
a text are those of its parts between ASCII white space, one after another.
That holds for its normaliser as well (NFC and lower case of single
characters never look over a space). Each part is encoded once by a Python
worker and kept, its ids as bytes: a text's are one join of them. When STORE
parts are held, a new store begins, and the last one serves until the new one
is full too. Parts of Latin-1 letters, with a run of ASCII marks at most after
them, are a piece or two for the library's BPE model; all others go through
the whole tokenizer.
"""

from __future__ import annotations

import numpy as np

#: At most so many parts of at most LONG characters are in a store: two of them take some 60 MB.
STORE, LONG = 120_000, 40
#: Runs of marks of at most MARK characters are kept apart, a hundredth as many.
MARK = 8
#: Marks that may end a word: the tokenizer splits a run of them from the letters before.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> dict[int, str]:
    """What byte-level BPE writes for each Latin-1 character: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbol = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {c: "".join(symbol[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.numbers = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.symbols = _byte_symbols()
        self.kept: dict[str, bytes] = {"": b""}
        self.last: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a word of lower-case Latin-1 letters."""
        return b"".join([self.numbers[t.id] for t in self.model.tokenize(word if word.isascii() else word.translate(self.symbols))])

    def _mark(self, mark: str) -> bytes:
        """Ids of a run of marks."""
        code = self.marks.get(mark)
        if code is None:
            code = self._word(mark)
            if len(mark) <= MARK and len(self.marks) < STORE // 100:
                self.marks[mark] = code
        return code

    def _fresh(self, part: str) -> bytes:
        code = self.last.get(part)
        if code is not None:
            self._keep(part, code)
            return code
        stem = part.rstrip(MARKS)
        mark, word = part[len(stem) :], stem.lower()
        if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            code = self.kept.get(word) or self.last.get(word)
            if code is None:
                code = self._word(word)
                self._keep(word, code)
            if mark:
                code += self._mark(mark)
        else:
            code = b"".join([self.numbers[i] for i in self.tokenizer.encode(part, add_special_tokens=False).ids])
        self._keep(part, code)
        return code

    def _keep(self, part: str, code: bytes) -> None:
        if len(part) <= LONG:
            if len(self.kept) >= STORE:
                self.last, self.kept = self.kept, {"": b""}
            self.kept[part] = code

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of a text; null counts as empty."""
        if not text:
            return np.zeros(0, dtype="<u4")
        for mark in "\n\t\r":
            if mark in text:
                text = text.replace(mark, " ")
        parts = text.split(" ")
        codes = list(map(self.kept.get, parts))
        if None in codes:
            codes = [(self.kept.get(part) or self._fresh(part)) if code is None else code for code, part in zip(codes, parts, strict=True)]
        return np.frombuffer(b"".join(codes), dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process, which outlives its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
