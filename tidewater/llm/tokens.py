"""Token ids of whole texts, as bytes of little-endian unsigned integers, at the speed of a dictionary."""

from __future__ import annotations

import os
import re
from array import array
from itertools import compress, count, repeat
from operator import is_

#: Pieces that a worker remembers at most (about 200 bytes each), in two generations, and the longest piece that is remembered.
REMEMBERED, LONGEST = 900_000, 64
#: White space besides the space and the line end, as far as either regex library counts it.
SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
RUNS = ("  ", "\n\n", " \n", "\n ", *SPACES)
#: In words of Latin letters, digits and ASCII signs without apostrophe: the pre-tokenizers part these classes only.
CLASS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+")


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves, the others
    follow from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordTokenizer:
    """Encodes with a tokenizer file of the ``tokenizers`` library, each different piece of text once.

    Before a space that is followed by anything but white space, the pre-tokenizers of the files used here always split,
    and nothing is normalised across it; so a text's ids are those of the pieces between such places. Pieces of plain
    words go to the library's model directly, all others through its whole encoder."""

    def __init__(self, path: str, drops_space: bool, dtype: str = "<u4", special_as_text: bool = False) -> None:
        """``special_as_text``: strings of special tokens in a text are ordinary text; else they give the tokens' ids, as the
        library's plain call does."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        added = [] if special_as_text else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = min((t[:2] for t in added), default=None) if len({t[:2] for t in added}) < 2 else ""
        self.tokenize = self.whole.model.tokenize
        self.code, self.drops_space = {"<u2": "H", "<u4": "I"}[dtype], drops_space
        self.seen, self.old, self.words = {"": b""}, {}, {}
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))

    def _pieces(self, text: str) -> list[str]:
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        if "\x00" in text:
            return ["\x00" + text]
        if text[0] not in " \n" and text[-1] not in " \n" and not any(r in text for r in RUNS):  # a line end parts, too
            return ("\x00" + text.replace("\n", " \n\x00")).split(" ")
        whole: list[str] = []
        for p in ("\x00" + text).split(" "):
            if whole and (not p or p[0].isspace()):  # white space before a space: no place to split
                whole[-1] += " " + p
            else:
                whole.append(p)
        return whole

    def _model(self, part: str) -> bytes:
        """Ids of one part in byte letters, by the library's model alone."""
        return array(self.code, [t.id for t in self.tokenize(part)]).tobytes()

    def _ids(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():  # most pieces: nothing to part, each byte its own letter
            return self._model(piece.lower() if self.drops_space else "Ġ" + piece)
        last = piece[-1]
        if last in ".,;:?!" and piece[-2:-1].isalpha() and CLASS.fullmatch(piece, 0, len(piece) - 1):
            return self._known(piece[:-1]) + self._known_part(last)  # a word, then a sign: parted between them
        if self.drops_space:
            lead, word = "", piece
        elif piece[0] == "\x00":  # a place without a space before it
            lead, word = "", piece[1:]
        elif piece[:2] == "\n\x00":
            lead, word = "\n", piece[2:]
        else:
            lead, word = " ", piece
        parts = CLASS.findall(word)
        if not parts or sum(map(len, parts)) != len(word):  # other letters, an apostrophe, white space
            ids = self.whole.encode(lead + word, add_special_tokens=False).ids
            return array(self.code, ids).tobytes()
        if self.drops_space:
            parts = [x for p in parts for x in (p if p[0].isdigit() else (p.lower(),))]
        elif lead == " ":
            parts[0] = "Ġ" + parts[0]
        elif lead:
            parts.insert(0, "Ċ")
        return b"".join(map(self._known_part, parts))

    def _known_part(self, part: str) -> bytes:
        ids = self.words.get(part)
        if ids is None:
            if part.isascii() or part == "Ċ":  # bytes that are printable ASCII stand for themselves
                letters = part
            else:
                own = part.removeprefix("Ġ")
                letters = part[: len(part) - len(own)] + own.encode().decode("latin-1").translate(self.letters)
            if len(self.words) >= REMEMBERED // 6:
                self.words = {}
            ids = self.words[part] = self._model(letters)
        return ids

    def _known(self, piece: str) -> bytes:
        """Ids of a piece, remembered: what was not asked for since the last two changes of generation is forgotten."""
        ids = self.seen.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = self._ids(piece)
            if len(piece) <= LONGEST:
                self.seen[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (null: none), without special tokens."""
        if not text:
            return b""
        if self.special is not None and self.special in text:  # the whole encoder finds special tokens in it, or none
            return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = self._pieces(text)
        found = list(map(self.seen.get, pieces))
        for i in list(compress(count(), map(is_, found, repeat(None)))):
            found[i] = self._known(pieces[i])
        if len(self.seen) > REMEMBERED // 2:
            self.old, self.seen = self.seen, {"": b""}
        return b"".join(found)
