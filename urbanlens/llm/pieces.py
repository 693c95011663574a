"""Texts cut where a byte-level BPE tokenizer always cuts them, so that equal pieces are encoded once.

The byte-level pre-tokenizer never joins a non-space character to a white-space character that follows, nor a
letter to a full stop, comma, colon, semicolon, exclamation or question mark that follows. Cutting a text there
and encoding the pieces gives the ids of the whole text, special strings included (they hold no such place).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

from urbanlens.llm.common import SPACE, Remembered, kept

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(f"[{SPACE}]*[{_LETTER}]++(?=[{SPACE}.,;:!?]|\\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_WORD = re.compile(f" ?[{_LETTER}]+")
_CUT = re.compile(f"[^{SPACE}](?=[{SPACE}])")
#: Characters of text that are cut into pieces at a time, and bytes of new pieces that one call of the library encodes.
SEGMENT_CHARS, CALL_BYTES = 1 << 18, 1 << 18


def segments(text: str, most: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text in parts of about ``most`` characters, each cut before white space that follows another character.
    A run without such a place stays whole."""
    start = 0
    while len(text) - start > most and (m := _CUT.search(text, start + most - 1)):
        yield text[start : m.end()]
        start = m.end()
    yield text[start:] if start else text


def pieces(text: str) -> list[str]:
    return _PIECE.findall(text)


def byte_batches(strings: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Lists of strings of about equal total bytes."""
    batch, size = [], 0
    for s in strings:
        batch.append(s)
        size += len(s.encode())
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def coder(path: str, kind: str, value: Callable[[list[int]], object]) -> Remembered:
    """What ``value`` makes of the ids of a piece, remembered in this worker process for the tasks that follow."""
    def make() -> Remembered:
        tokenizer = load_tokenizer(path)

        model, characters = tokenizer.model, byte_characters()
        blank, feed = characters[32], [x.id for x in model.tokenize(characters[10])]

        def compute(strings: list[str]) -> list:
            """A piece that is one word for the pre-tokenizer goes to the library's model at once, others through the whole tokenizer."""
            whole, tokenize = _WORD.fullmatch, model.tokenize
            found: list = [None] * len(strings)
            rest = []
            for i, s in enumerate(strings):
                # a line feed before a word, or before the blank before it, is a word by itself
                first, word = (feed, s[1:]) if s[0] == "\n" else ([], s)
                if whole(word):
                    # of ASCII letters and a blank, only the blank has another character
                    written = word.replace(" ", blank) if word.isascii() else word.encode().decode("latin-1").translate(characters)
                    found[i] = value(first + [x.id for x in tokenize(written)])
                else:
                    rest.append(i)
            coded = (e.ids for b in byte_batches([strings[i] for i in rest]) for e in tokenizer.encode_batch_fast(b, add_special_tokens=False))
            for i, ids in zip(rest, coded, strict=True):
                found[i] = value(ids)
            return found

        return Remembered(compute)

    return kept(("pieces", path, kind), make)
