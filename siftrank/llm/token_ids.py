"""Ids of public tokenizers in Arrow batches, each distinct piece of text encoded once per worker.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the
ids of the parts in a row are the ids of the whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa

from siftrank.llm.common import string_groups, worker_state

CACHE_PIECES = 700_000  # distinct pieces a worker remembers; it then starts anew

LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
RARE_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def plain_latin(text: str) -> bool:
    """All characters in Latin-1, and no white space but single spaces and line ends."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in RARE_SPACE)


def cut_bytes(text: str) -> list[str]:
    """Parts of a text for the byte-level pattern: ' word', '.', line ends."""
    if "\0" in text:
        return [text]
    if plain_latin(text) and not any(s in text for s in ("  ", " \n", "\n ", "\n\n")):
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return LONE_SPACE.sub("\0 ", text).split("\0")


def cut_words(text: str) -> list[str]:
    """Parts of a text for the lower-casing word pattern, which drops white space."""
    if plain_latin(text):
        text = text.replace("\n", " ")
        if "<|" not in text:
            text = text.lower()
    return text.split(" ")


# Pieces of Latin letters alone; the word pattern's are lower-case by then.
WORD_PIECE = {"bytes": re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+"), "words": re.compile("[a-zß-öø-ÿ]+")}

CUTS = {"bytes": cut_bytes, "words": cut_words}


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: itself, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


class IdEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; as a mapping, those of a piece.

    A piece of letters alone (with a space in front for the byte pattern) is
    one pre-token, so the tokenizer's model gets it as it is; others go through
    the whole tokenizer.
    """

    def __init__(self, path: str, cut: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cut = CUTS[cut]
        self.plain = WORD_PIECE[cut].fullmatch
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if self.plain(piece):
            mapped = piece.encode().decode("latin-1").translate(self.letters)
            ids = [token.id for token in self.model.tokenize(mapped)]
        elif piece[-1:] in (".", ",") and self.plain(piece[:-1]):  # the stop is a pre-token of its own
            found = self[piece] = self[piece[:-1]] + self[piece[-1]]
            return found
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        found = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self) > CACHE_PIECES:
            self.clear()
        for text in texts:
            yield b"".join(map(self.__getitem__, self.cut(text)))


def encoder(path: str, cut: str) -> IdEncoder:
    """The worker's encoder for a tokenizer file."""
    found = worker_state("id_encoders")
    if (path, cut) not in found:
        found[path, cut] = IdEncoder(path, cut)
    return found[path, cut]


def encode_texts(path: str, cut: str, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
    """Id bytes of each text in order."""
    own = encoder(path, cut)
    for group in string_groups(texts):
        yield from own.encode(group)
