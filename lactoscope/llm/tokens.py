"""Encoding of whole texts with public tokenizers, at a bounded cost per distinct word.

Byte-pair merges never cross a pre-token, and for the two pre-tokenizers known here
white space bounds pre-tokens. A text is therefore cut at white space, each distinct
piece is encoded by the tokenizer itself once and kept in a bounded table, and the
ids of the text are those of its pieces in order. Texts in which the cut could differ
from the tokenizer's own (white space beyond ASCII, special strings) and tokenizers
of any other make are encoded whole.
"""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np

# Pieces kept per worker process before the table is emptied (some 150 MB), none of them
# longer than this many characters.
KEPT_PIECES, KEPT_LENGTH = 900_000, 64
# Characters that one of the libraries, but not Python's ASCII classes, takes as white space.
_ODD = "\x1c-\x1f\x85\xa0  -     　"
# White space, letters, digits and other signs of the plain alphabet: in a text of these
# alone the runs below are the tokenizers' own pre-tokens. The apostrophe is not among
# them, as it starts contractions.
_SPACE, _LETTERS, _SIGNS = r" \t\n\r\x0b\x0c", "A-Za-zÀ-ÖØ-öø-ÿ", r'!-&(-/:-@\[-`{-~'
_UNPLAIN = re.compile(f"[^{_SPACE}{_LETTERS}{_SIGNS}0-9]")
# For each make: pieces of any text, and pieces of a plain text.
_WORDS = (re.compile(f"[^{_SPACE}]+"), re.compile(f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+"))
_SPACED = (
    re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
    re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
)


def _pieces_of(spec: dict) -> tuple[re.Pattern, re.Pattern] | None:
    """How a tokenizer's texts may be cut; None for one that is not known."""
    model, before, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if model.get("type") != "BPE" or model.get("dropout") or spec.get("truncation") or spec.get("padding"):
        return None
    if spec.get("post_processor"):
        return None
    if any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
        return _SPACED if normal is None else None
    steps = before.get("pretokenizers", [])
    removes = bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    words_only = removes and steps[0]["pattern"].get("Regex", "").endswith(r"|[^\s\p{L}\p{N}]+")
    plain = [n["type"] for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    return _WORDS if words_only and plain else None


def _byte_signs(spec: dict, cuts) -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte, as their pre-tokenizer gives it."""
    if cuts is None:
        return {}
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    signs = {}
    for byte in range(128):
        signs[byte] = level.pre_tokenize_str(chr(byte))[0][0]
    for code in range(0xC0, 0x100):  # both bytes of each letter of two bytes
        first, second = level.pre_tokenize_str(chr(code))[0][0]
        signs[chr(code).encode()[0]], signs[chr(code).encode()[1]] = first, second
    return signs


class Encoder:
    """Ids or counts of whole texts, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.cuts, self.special, self.lowers = None, None, False
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: processor.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.cuts = _pieces_of(spec)
            # Noted once: a later task brings new copies of this module's names.
            self.lowers = self.cuts is _WORDS
            self.model, self.byte_signs = tokenizer.model, _byte_signs(spec, self.cuts)
            strings = [re.escape(t["content"]) for t in spec["added_tokens"]]
            self.special = re.compile("|".join([f"[{_ODD}]", *strings]))
        # Kept apart, as a worker that counts has no use for the ids.
        self.known: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}

    def _of_pieces(self, text: str, table: dict, of) -> list | None:
        """What ``of`` gives for each piece of a text, by the table; None for a text to encode whole."""
        if self.cuts is None or self.special.search(text):
            return None
        plain = not _UNPLAIN.search(text)
        # Case is dropped by the words-only make; dropping it here lets pieces meet.
        pieces = self.cuts[plain].findall(text.lower() if plain and self.lowers else text)
        missing = [p for p in set(pieces) if p not in table]
        if missing:
            if len(table) > KEPT_PIECES:
                table.clear()
                missing = list(set(pieces))
            table.update(zip(missing, map(of, self._merged(missing) if plain else self.encode(missing))))
        found = list(map(table.__getitem__, pieces))
        for piece in missing:
            if len(piece) > KEPT_LENGTH:
                del table[piece]
        return found

    def _merged(self, pieces: list[str]):
        """Ids of plain pieces, each a pre-token, from the tokenizer's own merges."""
        for piece in pieces:
            signs = piece.encode().decode("latin-1").translate(self.byte_signs)
            yield [token.id for token in self.model.tokenize(signs)]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype=np.uint32).tobytes()

    def ids(self, text: str) -> np.ndarray:
        found = self._of_pieces(text, self.known, self._packed)
        if found is None:
            return np.array(self.encode([text])[0], dtype=np.uint32)
        return np.frombuffer(b"".join(found), dtype=np.uint32)

    def count(self, text: str) -> int:
        found = self._of_pieces(text, self.counts, len)
        return len(self.encode([text])[0]) if found is None else sum(found)


def encoder(path: str) -> Encoder:
    """The encoder of a file, made once in a worker process and used by its later tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("_lactoscope_encoders", types.ModuleType("_lactoscope_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
