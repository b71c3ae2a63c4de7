"""Tokenising whole texts piece by piece, with the pieces' ids remembered.

A text of simple characters (ASCII and accented Latin letters) is split by the vocabulary's own
rule; its pieces are merged from the vocabulary's ranks (``tiktoken``) when a worker first meets
them and then looked up. Other texts are split where white space begins after another
character, where both public vocabularies always split, and each such chunk is encoded by the
``tokenizers`` library itself unless it is simple. Texts that name a special token or hold
unusual white space never take the short way. Merging by rank gives the library's ids because
every entry of the vocabularies encodes to itself (tested).

The table of pieces stops growing at ``most`` entries, so memory is bounded; results do not
depend on it.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

# White space beyond ASCII, and control characters that some rules count as white space.
_ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WITH_SPACE = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# ASCII, and Latin-1 letters whose lower case, class and normal form are the same everywhere.
_SIMPLE_BYTES = bytes([*range(9, 14), *range(0x20, 0x7F), *(byte for byte in range(0xC0, 0x100) if byte not in (0xD7, 0xF7))])
_KNOWN_LENGTH = 48
# Fixed value: the splitting rule of the byte-level vocabulary.
_BYTE_RULE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The rules of both vocabularies for simple characters, the second for lower case; letters come first, for speed.
_SIMPLE_BYTE_RULE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
_WORD_RULE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9ß-öø-ÿ]+")
# Stands for the end of a word; no UTF-8 text holds this byte.
_END = b"\xff"


def load(path: str, plain: bool = False) -> Tokenizer:
    """A tokenizer of the library; padding and truncation of the file are not used."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = plain
    return tokenizer


def is_simple(text: str) -> bool:
    """Whether a text holds nothing but ASCII and accented Latin letters, without control characters."""
    try:
        return not text.encode("latin-1").translate(None, _SIMPLE_BYTES)
    except UnicodeEncodeError:
        return False


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in own]
    return {chr(byte): byte for byte in own} | {chr(256 + n): byte for n, byte in enumerate(others)}


def token_bytes(path: str) -> tuple[dict[bytes, int], dict[str, int], str]:
    """Bytes of each token with its id, the special tokens, and the mark of word ends ('' if none)."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = {item["content"]: item["id"] for item in told["added_tokens"]}
    mark, letters = told["model"].get("end_of_word_suffix") or "", byte_alphabet()
    ranks = {}
    for token, number in told["model"]["vocab"].items():
        if token in special:
            continue
        ended = bool(mark) and token.endswith(mark)
        body = token[: -len(mark)] if ended else token
        ranks[bytes(letters[letter] for letter in body) + _END * ended] = number
    return ranks, special, mark


class ChunkEncoder(dict):
    """Texts to ids, packed as little-endian unsigned 32-bit integers; itself the table of known pieces.

    ``plain`` reads the strings of special tokens as ordinary text.
    """

    def __init__(self, path: str, most: int = 150_000, plain: bool = False) -> None:
        super().__init__()
        self.tokenizer, self.most = load(path, plain), most
        ranks, special, mark = token_bytes(path)
        self.keeps_space = not mark
        self.rule = _SIMPLE_BYTE_RULE if self.keeps_space else _WORD_RULE
        self.special = re.compile("|".join(map(re.escape, [] if plain else special)) or "(?!)")
        self.merger = tiktoken.Encoding("own", pat_str=_BYTE_RULE, mergeable_ranks=ranks, special_tokens={})

    def by_library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def by_rank(self, text: str) -> bytes:
        """Ids of a simple text without special tokens."""
        return b"".join(map(self.__getitem__, self.rule.findall(text if self.keeps_space else text.lower())))

    def __missing__(self, piece: str | bytes) -> bytes:
        if isinstance(piece, str):  # of the rule
            ids = array("I", self.merger._encode_single_piece(piece.encode() + (b"" if self.keeps_space else _END))).tobytes()
        else:  # between white space
            text = piece.decode()
            simple = is_simple(text) and not self.special.search(text)
            ids = self.by_rank(text) if simple else self.by_library(text)
        if len(piece) <= _KNOWN_LENGTH and len(self) < self.most:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of one text; the library takes it whole where it holds unusual white space."""
        if is_simple(text) and not self.special.search(text):
            return self.by_rank(text)
        if any(map(text.__contains__, _ODD_SPACE)):
            return self.by_library(text)
        data = text.encode()
        return b"".join(map(self.__getitem__, _WITH_SPACE.findall(data) if self.keeps_space else data.split()))
