"""Byte-pair vocabularies: files, byte symbols, and a bounded cache by piece of text."""

from __future__ import annotations

import json
import os

#: Unicode's White_Space, for use in a character class.
WHITE = r"\t-\r\x20\x85\xa0  -     　"


def locate(tokenizer: str) -> str:
    """The file of a tokenizer, given by path or by its public name."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """ids by symbol, ranks by pair of symbols, special strings with their ids."""

    def __init__(self, tokenizer: str):
        with open(locate(tokenizer), encoding="utf-8") as f:
            data = json.load(f)
        self.ids: dict[str, int] = data["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        self.ranks: dict[tuple[str, str], int] = {p: i for i, p in enumerate(pairs)}
        self.suffix: str = data["model"]["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.texts: dict[int, str] = {i: s for s, i in (self.ids | self.special).items()}
        self.bytes = byte_symbols()

    def symbols(self, piece: str) -> list[str]:
        out = [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        if out and self.suffix:
            out[-1] += self.suffix
        return out


class Cache(dict):
    """What `make` gives for a piece, kept for up to `most` pieces of at most `longest` characters."""

    def __init__(self, make, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value


_made: dict[tuple, object] = {}


def once(key: tuple, make):
    """One object for each Python worker, which serves many tasks."""
    if key not in _made:
        _made.clear()  # a worker that goes on to another operator gives back what the last one held
        _made[key] = make()
    return _made[key]


def release() -> None:
    """Give back what an earlier operator keeps in this worker."""
    _made.clear()
