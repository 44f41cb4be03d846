"""Token ids of whole texts by the ``tokenizers`` library, each word encoded once.

A byte-level vocabulary cuts a text into words, numbers, runs of marks and runs of white
space, and encodes each of these pieces by itself.  So the ids of a text are those of its
pieces one after the other, and a piece that was met before need not be encoded again.

The cutting is repeated here only for texts of plain characters, over which the rule is
certain.  In other texts the pieces are what lies between single spaces that stand between
two visible characters: such a space begins a piece whatever the characters are.  Texts with
the name of a special token, and vocabularies that cut in any other way, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np

CACHED_PIECES = 1_000_000   # pieces kept per worker; others are encoded each time they come
CACHED_LENGTH = 40          # longer pieces are not kept
GROUP_CHARS = 1 << 19       # characters of the texts that are cut at one time

# Characters that are letters, digits, marks or white space in every version of Unicode.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[\t\n\r {_LETTERS}0-9{_MARKS}]*")
# Fixed value: how byte-level vocabularies cut, over these characters.
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+"
                    r"|\s+(?!\S)|\s+")
# Byte-level vocabularies show visible Latin-1 bytes as they are and the
# others, in their order, from this character on.
_FIRST_HIDDEN = 256
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_VISIBLE = {b: _FIRST_HIDDEN + i for i, b in enumerate(_HIDDEN)}
_SPACE = chr(_VISIBLE[ord(" ")])
_OLD_SPACE = "᠎"       # white space in older versions of Unicode


def public_vocabulary() -> str:
    import public_tokenizers as files
    return files.path("byte_bpe_50k.json")


def _cuts_byte_level(plain: dict) -> bool:
    """Is this the byte-level cutting without anything before or beside it?"""
    cutter = plain.get("pre_tokenizer") or {}
    return (plain.get("normalizer") is None
            and cutter.get("type") == "ByteLevel"
            and not cutter.get("add_prefix_space", True)
            and cutter.get("use_regex", True)
            and plain.get("model", {}).get("type") == "BPE"
            and not plain["model"].get("dropout")
            and not any(t.get("lstrip") or t.get("rstrip")
                        for t in plain.get("added_tokens", [])))


_KEPT = "flowcascade_kept_encoders"


def shared_encoder(vocabulary: str) -> "PieceEncoder":
    """An encoder that stays, with its pieces, in the worker process from task to task.

    The functions of a task are made anew for each, so what is kept hangs on a module that
    only this process has.
    """
    kept = sys.modules.setdefault(_KEPT, ModuleType(_KEPT)).__dict__
    if vocabulary not in kept:
        kept[vocabulary] = vars(PieceEncoder(vocabulary))
    encoder = PieceEncoder.__new__(PieceEncoder)
    encoder.__dict__ = kept[vocabulary]
    return encoder


def _blank(c: str) -> bool:
    return c.isspace() or c == _OLD_SPACE


def between_spaces(text: str) -> list[str]:
    """Parts of any text whose ids may be joined: cut at spaces between visible characters."""
    words = text.split(" ")
    runs = [[words[0]]]
    for before, word in zip(words, words[1:]):
        if before and word and not _blank(before[-1]) and not _blank(word[0]):
            runs.append(["", word])
        else:
            runs[-1].append(word)
    return [" ".join(run) for run in runs]


class PieceEncoder:
    """Ids of texts, in two bytes if the vocabulary allows, else in four (``kind``)."""

    def __init__(self, vocabulary: str, cached_pieces: int = CACHED_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        plain = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in plain.get("added_tokens", [])]
        ids = self.tokenizer.get_vocab(with_added_tokens=True).values()
        self.kind = np.dtype("<u2" if max(ids, default=0) < 1 << 16 else "<u4")
        self.by_piece = _cuts_byte_level(plain)
        self.cached_pieces = cached_pieces
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that are encoded one by one."""
        if any(name in text for name in self.special):
            return [text]
        if _PLAIN.fullmatch(text):
            return _PIECE.findall(text)
        found = []
        for part in between_spaces(text):
            if _PLAIN.fullmatch(part):
                found += _PIECE.findall(part)
            else:
                found.append(part)
        return found

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """New pieces: what the cutting rule made goes straight to the vocabulary's merges."""
        found, rest = {}, []
        tokenize, pack, size = self.tokenizer.model.tokenize, struct.pack, self.kind.itemsize
        letter = "H" if size == 2 else "I"
        for piece in pieces:
            if not _PIECE.fullmatch(piece) or piece in self.special:
                rest.append(piece)
                continue
            # byte-level vocabularies write every byte as one visible character
            visible = (piece.replace(" ", _SPACE) if piece.isascii() and piece.lstrip(" ").isprintable()
                       else piece.encode().decode("latin-1").translate(_VISIBLE))
            ids = [t.id for t in tokenize(visible)]
            found[piece] = pack(f"<{len(ids)}{letter}", *ids)
        found.update(zip(rest, self._whole(rest)))
        return found

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        ids = [list(map(self.known.get, pieces)) for pieces in cut]
        holes = [[i for i, x in enumerate(found) if x is None] for found in ids]
        wanted = dict.fromkeys(pieces[i] for pieces, at in zip(cut, holes) for i in at)
        if wanted:
            fresh = self._encode_pieces(list(wanted))
            for pieces, found, at in zip(cut, ids, holes):
                for i in at:
                    found[i] = fresh[pieces[i]]
            room = self.cached_pieces - len(self.known)
            short = [p for p in fresh if len(p) <= CACHED_LENGTH]
            self.known.update((p, fresh[p]) for p in short[:max(room, 0)])
        return [b"".join(found) for found in ids]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text, in order; the texts are cut in groups of bounded size."""
        work = self._by_piece if self.by_piece else self._whole
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from (np.frombuffer(b, self.kind) for b in work(group))
                group, chars = [], 0
        if group:
            yield from (np.frombuffer(b, self.kind) for b in work(group))
