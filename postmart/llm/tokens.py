"""Tokenizers of public files as encoders that remember the tokens of words."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Words whose tokens a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 300_000, 64
#: Where texts may be cut: at a space with something else than white space on both sides.
CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others, in
    order, for the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_level(path: str) -> tuple[list[bytes], dict[bytes, int] | None]:
    """(bytes of each id, ranks) of a byte-level BPE file.  ``ranks`` is None unless merging by id gives the same
    as merging by the file's list: plain byte-level splitting, no normaliser, and merges in the order of their ids."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of, model = _byte_of(), spec["model"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ids = model["vocab"] | special
    decoded = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        decoded[i] = token.encode() if token in special else bytes([byte_of[c] for c in token])
    ordinary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    pre = spec.get("pre_tokenizer") or {}
    plain = (
        pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
        and [ordinary.get(m) for m in merged] == list(range(256, 256 + len(merged)))
        and len(ordinary) == 256 + len(merged)
    )
    return decoded, {decoded[i]: i for i in ordinary.values()} if plain else None


def byte_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by a byte-level BPE file; strings of special tokens are ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    ranks = byte_level(path)[1]
    if ranks is not None:
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def piece_bytes(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece model: its piece with the word mark as space, or the byte it names."""
    n = model.get_piece_size()
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]


def cuts_at_spaces(model) -> bool:
    """Whether no piece has a word mark after anything else, so that none reaches over a cut."""
    return not any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()) if not model.is_byte(i))


class PairEncoder:
    """Ids of a space and a text by two tokenizers, as little-endian 32-bit numbers.

    Both begin anew where a text may be cut, so a text is encoded cut by cut and recent units are remembered.  A
    model that may reach over cuts gets whole texts."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self._first, self._second = byte_encoder(byte_path), lambda text: pieces.encode(text, num_threads=1)
        self.first_bytes, self.second_bytes = byte_level(byte_path)[0], piece_bytes(pieces)
        self.cuts = cuts_at_spaces(pieces)
        self._known: dict[str, tuple[bytes, bytes] | None] = {}

    def units(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def encode(self, unit: str) -> tuple[bytes, bytes] | None:
        """None if the joined bytes of either tokenizer are not those of a space and the unit."""
        if unit in self._known:
            return self._known[unit]
        whole = (" " + unit).encode()
        a, b = self._first(" " + unit), self._second(unit)
        found = None
        if b"".join([self.first_bytes[i] for i in a]) == whole == b"".join([self.second_bytes[i] for i in b]):
            found = np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()
        if len(unit) < LONGEST:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[unit] = found
        return found


@lru_cache(maxsize=2)
def pair_encoder(byte_path: str, piece_path: str) -> PairEncoder:
    """One for each worker, so that tasks share what it remembers."""
    return PairEncoder(byte_path, piece_path)
