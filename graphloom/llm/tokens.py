"""Word-cached encoding with the tokenizers library.

The tokenizer's normaliser folds white space and its pre-tokeniser never joins across
it, so the ids of a text are those of its space-separated words in turn.  Each distinct
word is encoded once by the library and its ids kept as little-endian bytes, in a
bounded cache that lives as long as the worker process.
"""

from __future__ import annotations

import re
import sys
import types

import numpy as np

#: Most entries of each cache; a full cache is emptied, so memory is bounded and results never change.
CACHE_ENTRIES = 600_000
TOKENIZER = "word_bpe_49k.json"


def _state() -> dict:
    """State that outlives a task: pickled functions bring no globals of their own."""
    return sys.modules.setdefault("_graphloom_worker", types.ModuleType("_graphloom_worker")).__dict__


def word_encoder(path: str, entries: int = CACHE_ENTRIES):
    """A function from text to the bytes of its ids (little-endian, 32 bits each)."""
    key = ("tokens", path, entries)
    if key in _state():
        return _state()[key]
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tok = Tokenizer.from_file(path)
    model, normal, pre = tok.model, tok.normalizer, tok.pre_tokenizer
    # Words of ASCII and Latin-1 letters are split by the pre-tokeniser's pattern as it reads on them; any other word is left to the library.
    latin = "\xdf-\xf6\xf8-\xff"
    simple = re.compile(f"[\x21-\x7e\xc0-\xd6\xd8-\xde{latin}]*").fullmatch
    plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{latin}]+|[0-9]|[^a-z0-9{latin}]+").findall
    byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
    little = [i.to_bytes(4, "little") for i in range(tok.get_vocab_size())]
    as_bytes = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    class Pieces(dict):
        def __missing__(self, piece):
            ids = b"".join([little[t.id] for t in model.tokenize(piece)])
            if len(self) >= entries:
                self.clear()
            if len(piece) < 64:
                self[piece] = ids
            return ids

    pieces = Pieces()

    class Words(dict):
        def __missing__(self, word):
            if "<|" in word:
                ids = np.array(tok.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif simple(word):
                found = plain(word.lower())
                ids = b"".join([pieces[p if p.isascii() else p.translate(as_bytes)] for p in found])
            else:
                ids = b"".join([pieces[p] for p, _ in pre.pre_tokenize_str(normal.normalize_str(word))])
            if len(self) >= entries:
                self.clear()
            if len(word) < 64:
                self[word] = ids
            return ids

    words = Words()

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" ")))

    _state()[key] = encode
    return encode


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
