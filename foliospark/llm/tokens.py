"""Byte-level BPE token ids for the packing and shard operators.

The vocabulary is a ``tokenizers`` JSON file, named by path. Its ids come from
the tokenizers library's file, but texts, split on the file's added tokens as the
library splits them, are run through the rank engine of ``tiktoken`` built from
that same file: the two give equal ids (tested), and the tokenizers library needs
about six times the CPU (README).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the pattern's engine has it (Python's ``\\s`` has four characters more).
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The engine fails on runs of about a million; from this length on they bypass its pattern.
LONG_RUN = 100_000
_LONG_RUN = re.compile(f"[{BLANK}]{{{LONG_RUN},}}")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it prints in Latin-1, else
    the next free code point from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in printing else next(spare)) for b in range(256)}


class Encoder:
    """The ids of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, json_path: str):
        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        special = {t["content"] for t in added if t.get("special")}
        to_byte = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self._engine = tiktoken.Encoding(json_path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._added = {t["content"]: t["id"] for t in added}
        # Of tokens that begin at one place the longest counts, as in the library.
        self._split = re.compile("|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if added else None
        # Tokens that take blanks beside them or need word edges are left to the library.
        plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        self._library = None if plain else Tokenizer.from_file(json_path)
        #: One more than the largest id.
        self.n_vocab = 1 + max([*ranks.values(), *self._added.values()])

    def encode(self, text: str) -> list[int]:
        """What the library gives with ``add_special_tokens=False``: an added token
        that stands in the text is its id."""
        if self._split is None or not self._split.search(text):
            return self.encode_ordinary(text)
        if self._library is not None:
            return self._library.encode(text, add_special_tokens=False).ids
        ids, at = [], 0
        for m in self._split.finditer(text):
            ids += self.encode_ordinary(text[at : m.start()])
            ids.append(self._added[m[0]])
            at = m.end()
        return ids + self.encode_ordinary(text[at:])

    def encode_ordinary(self, text: str) -> list[int]:
        """The same with strings of added tokens taken as ordinary text.

        The pattern makes a run of white space one piece but for its last character
        if more text follows; a long run is encoded as that piece directly."""
        if len(text) < LONG_RUN:
            return self._engine.encode_ordinary(text)
        ids, at = [], 0
        for m in _LONG_RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            ids += self._engine.encode_ordinary(text[at : m.start()])
            ids += self._engine._encode_single_piece(text[m.start() : end])
            at = end
        return ids + self._engine.encode_ordinary(text[at:])


@lru_cache(maxsize=4)
def encoder(json_path: str) -> Encoder:
    return Encoder(json_path)
