"""Token ids of whole texts, exactly as the tokenizers library gives them."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Entries kept by a worker for white-space separated chunks, and for the words within them.
CHUNKS = 400_000
WORDS = 400_000
#: Chunks and words of more characters are encoded anew each time, so the tables are bounded in bytes too.
LONGEST = 64

_ENCODERS: dict[str, Callable[[bytes | None], np.ndarray]] = {}


def encoder(path: str) -> Callable[[bytes | None], np.ndarray]:
    """A function from a UTF-8 text to its ids (uint32), made once in each worker.

    The library drops white space before it looks at words, so the ids of a text are
    those of its chunks between ASCII white space, one after another. Chunks repeat, and
    a bounded table keeps their ids. Chunks of plain letters, digits and signs go to the
    library's BPE model word by word; all others go through the whole tokenizer. A vocabulary
    with another pipeline than word_bpe_49k is encoded whole.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = _make(path)
    return _ENCODERS[path]


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _make(path: str) -> Callable[[bytes | None], np.ndarray]:
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
    shape = [x.get("type") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]

    def library(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")

    if steps != ["NFC", "Replace", "Lowercase"] or shape != ["Split", "ByteLevel"] or made["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
        return lambda text: library((text or b"").decode("utf-8", "replace"))

    model, letters = whole.model, _byte_letters()
    # Printable ASCII and the letters of Latin-1: lower-casing and composition change nothing else in them.
    plain = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
    words_of = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+").findall

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
            ids = np.array([t.id for t in model.tokenize(mapped)], "<u4").tobytes()
            if len(self) < WORDS and len(word) <= LONGEST:
                self[word] = ids
            return ids

    class Chunks(dict):
        def __missing__(self, chunk: bytes) -> bytes:
            s = chunk.decode("utf-8", "replace")
            if plain(s) and "<|" not in s:
                ids = b"".join(map(word_ids, words_of(s.lower())))
            else:
                ids = library(s).tobytes()
            if len(self) < CHUNKS and len(chunk) <= LONGEST:
                self[chunk] = ids
            return ids

    word_ids = Words().__getitem__
    chunk_ids = Chunks().__getitem__

    def encode(text: bytes | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(chunk_ids, (text or b"").split())), "<u4")

    return encode
