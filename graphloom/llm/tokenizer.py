"""Token ids of whole texts from a public byte-level BPE file.

The file's pre-tokenizer cuts a text into pieces that are encoded each on its own,
so a piece has the same ids wherever it stands.  Pieces come back again and again:
a bounded table of piece to ids saves almost all merges.  The table is emptied
when full, which costs time and changes no result.  A worker holds the merges and
that table, and nothing of the file else.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable

import numpy as np

#: Pieces kept per Python worker, and their longest; about 200 bytes each with their ids.
MOST_PIECES, LONGEST = 120_000, 32
#: What the file's pre-tokenizer must be: its pattern is fixed below, another file's ids would be wrong.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False}

#: The pre-tokenizer's pattern for texts whose letters are those of `_PLAIN`: there `re` and Unicode classes agree.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ \t\n\x0b\x0c\r{_LETTER}0-9]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+")
#: ASCII but \x1c-\x1f, Latin letters, and common marks that are neither letters, digits nor white space.
_PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7f{_LETTER}¡§«°·»¿–—‘’“”„†•…€]*")
_EXACT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _read(path: str) -> tuple[dict, Callable[[str], list[int]] | None]:
    """(vocabulary, merging by rank in native code); no merging if the file's ids don't follow the order of its merges."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    pre = whole.get("pre_tokenizer") or {}
    if any(pre.get(k) != v for k, v in PRE_TOKENIZER.items()) or not pre.get("use_regex", True) or whole.get("normalizer"):
        raise ValueError(f"{path}: only byte-level files without a normalizer, a prefix space or a pattern of their own")
    model = whole["model"]
    vocab = model["vocab"] | {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    alphabet = _byte_of()
    if made != sorted(made) or any(c not in alphabet for t in model["vocab"] for c in t):
        return vocab, None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if len(t) == 1 or i >= made[0]}
    if len({*map(len, ranks)} - {0}) == 0 or sum(len(t) == 1 for t in ranks) != 256 or len(ranks) != 256 + len(made):
        return vocab, None
    return vocab, tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _slow(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings are ordinary text
    return lambda x: t.encode(x, add_special_tokens=False).ids


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        vocab, merge = _read(path)
        #: UTF-8 bytes that each id stands for: one character of the byte alphabet per byte.
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int32)
        self.lengths[list(vocab.values())] = [*map(len, vocab)]
        self.merge = merge or _slow(path)

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    def __init__(self, path: str):
        import regex

        self.pieces = _Pieces(path)
        self.exact = regex.compile(_EXACT)
        self.path = path

    def cut(self, text: str) -> list[str]:
        return (_FAST if _PLAIN.fullmatch(text) else self.exact).findall(text)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        get = self.pieces.__getitem__
        return np.frombuffer(b"".join(map(get, self.cut(text))), dtype="<u4")

    @property
    def byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for."""
        return self.pieces.lengths


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
