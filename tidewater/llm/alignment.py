"""Alignment of two tokenizers over the same bytes: groups of tokens between common ends, links, and corpus-wide counts of linked ids."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, staged, unstage
from tidewater.llm.tokens import RUNS, SPACES, WordTokenizer, _byte_letters

#: Units that a worker remembers at most between chunks (some 300 bytes each), and the longest that is remembered.
REMEMBERED, LONGEST = 500_000, 64
#: A chunk has at most so many documents and, if it is of more than one batch, so many units: what one task holds when counts come back.
CHUNK_DOCS, CHUNK_UNITS = 4096, 1 << 20
#: Both tokenizers end a token before a single space that something but white space follows, and around such a line end.
CUT = re.compile(r"(?<! ) (?=[^\s\u180e])|(?<=[^\s\u180e])\n(?=[^\s\u180e])")
#: Words that the pre-tokenizers leave whole, see tokens.CLASS.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Texts for units(): all others are parted at single spaces and line ends.
ODD = f"\\A[ \n]|[ \n]\\z|[ \n][ \n]|[{SPACES}]"
ROWS = "chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, x array<int>, y array<int>, z array<int>, code long, docs long"


def units(text: str) -> list[str]:
    """A text, with a space before it, cut where both tokenizers end a token. A unit's leading space is left out, unless white space
    follows it; a unit that begins with a line end has none."""
    if text[0] not in " \n" and text[-1] not in " \n" and not any(r in text for r in RUNS):
        return text.replace("\n", " \n").split(" ")
    whole = " " + text
    at = [0, *(m.start() for m in CUT.finditer(whole) if m.start()), len(whole)]
    parts = [whole[i:j] for i, j in zip(at, at[1:])]
    return [p[1:] if p[0] == " " and p[1:2] not in ("", " ", "\n") else p for p in parts]


def spelled(unit: str) -> str:
    """The text that a unit stands for."""
    return unit if unit[0] in " \n" else " " + unit


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as numbers of A and of B tokens so far: the ends that both have, by dictionaries end -> index."""
    at_a, at_b = dict(zip(ends_a.tolist(), count(1))), dict(zip(ends_b.tolist(), count(1)))
    both = sorted(at_a.keys() & at_b.keys())
    return np.fromiter(map(at_a.__getitem__, both), np.int64, len(both)), np.fromiter(map(at_b.__getitem__, both), np.int64, len(both))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class _Growing:
    """A numpy array with room for more rows."""

    def __init__(self, kind: type, *width: int) -> None:
        self.room, self.n = np.empty((1024, *width), kind), 0

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, new: np.ndarray) -> None:
        end = self.n + len(new)
        if end > len(self.room):
            room = np.empty((max(end, len(self.room) * 3 // 2), *self.room.shape[1:]), self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : end] = new
        self.n = end

    def set(self, rows: np.ndarray) -> None:
        self.room, self.n = rows.copy(), len(rows)


class Aligner:
    """Aligns a byte-level vocabulary of the ``tokenizers`` library (A) with a model of ``sentencepiece`` (B), each different unit once.

    A unit has a number, by which columns hold what is known of it: ``nums`` (n_a, n_b, n_groups, n_links), ``said`` (its groups as
    text, a semicolon after each), ``codes`` (the distinct linked pairs as a * 2^32 + b) and ``times`` (how often each is linked).
    Number 0 are all units whose tokens' bytes aren't those of the text. A number holds until ``forget()``."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a, self.b = WordTokenizer(path_a, drops_space=False, special_as_text=True), sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: i for i, c in enumerate(_byte_letters())}
        names = [self.a.whole.id_to_token(i) or "" for i in range(self.a.whole.get_vocab_size())]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        self.bytes_b = [piece(i) for i in range(self.b.vocab_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in all_], np.int64) for all_ in (self.bytes_a, self.bytes_b))
        # each id as text with what follows it: within a group, and at its side's end
        self.spoken = pa.array([f"{i}{sign}".encode() for n, signs in ((len(names), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for sign in signs], pa.large_binary())
        self.index: dict[str, int] = {}
        self.nums, self.said, self.codes, self.times = _Growing(np.int64, 4), _Growing(np.uint8), _Growing(np.int64), _Growing(np.int32)
        self.said_at, self.codes_at, self.uses = _Growing(np.int64), _Growing(np.int64), _Growing(np.int32)
        for at in (self.said_at, self.codes_at):
            at.add(np.zeros(1, np.int64))
        self._add(np.zeros((1, 4), np.int64), np.zeros(0, np.uint8), [0], np.zeros(0, np.int64), np.zeros(0, np.int32), [0])
        # signs that no piece of B joins to a letter before them: after a plain word they are a token of their own in both
        joined = {y for i in range(len(self.bytes_b)) if not self.b.is_byte(i) for x, y in zip(self.b.id_to_piece(i), self.b.id_to_piece(i)[1:]) if x.isalpha()}
        self.signs = {}
        for c in sorted(set(".,;:?!") - joined):
            a, b = self.a.whole.encode(c, add_special_tokens=False).ids, self.b.piece_to_id(c)
            if len(a) == 1 and self.bytes_a[a[0]] == self.bytes_b[b] == c.encode():
                self.signs[c] = int(self.aligned([c.encode()], [array("I", a).tobytes()], [[b]])[0])
        self.fixed = self.nums.n

    def _add(self, nums: np.ndarray, said: np.ndarray, said_sizes, codes: np.ndarray, times: np.ndarray, codes_sizes) -> np.ndarray:
        """Appends to the columns; the new numbers."""
        own = np.arange(self.nums.n, self.nums.n + len(nums))
        for at, sizes in ((self.said_at, said_sizes), (self.codes_at, codes_sizes)):
            at.add(at.all[-1] + np.cumsum(sizes))
        for column, new in ((self.said, said), (self.codes, codes), (self.times, times), (self.uses, np.zeros(len(nums), np.int32)), (self.nums, nums)):
            column.add(new)
        return own

    def _joined(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Numbers of units that are one unit and another one after it, which have no pair in common."""
        sizes, columns = [], []
        for at, of in ((self.said_at.all, (self.said,)), (self.codes_at.all, (self.codes, self.times))):
            both = np.stack([first, then], 1).ravel()
            size = at[both + 1] - at[both]
            places = _ranges(at[both], size)
            sizes.append(size.reshape(-1, 2).sum(1))
            columns.append([column.all[places] for column in of])
        return self._add(self.nums.all[first] + self.nums.all[then], columns[0][0], sizes[0], *columns[1], sizes[1])

    def _ids_a(self, unit: str) -> bytes:
        if LETTERS.fullmatch(unit):  # most units: nothing to part
            return self.a._model("Ġ" + (unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.a.letters)))
        if "\x00" in unit or unit[0] == " ":
            return array("I", self.a.whole.encode(spelled(unit), add_special_tokens=False).ids).tobytes()
        return self.a._ids("\n\x00" + unit[1:] if unit[0] == "\n" else unit)

    def aligned(self, texts: list[bytes], ids_a: list[bytes], ids_b: list[list[int]]) -> np.ndarray:
        """Numbers of texts with their ids (A's as bytes of 32-bit numbers), all in one go."""
        n_a, n_b = np.array([len(i) // 4 for i in ids_a]), np.array([len(i) for i in ids_b])
        a, b = np.frombuffer(b"".join(ids_a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(ids_b), np.int64, n_b.sum())
        from_a, from_b = _starts(n_a), _starts(n_b)
        sizes = np.array([len(t) for t in texts])
        as_long = lambda ids, table, at: np.diff(_starts(table[ids])[at]) == sizes
        good = as_long(a, self.sizes_a, from_a) & as_long(b, self.sizes_b, from_b)
        whole = b"".join(texts)
        if not good.all() or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
            own = lambda u, ids, at, table: b"".join(map(table.__getitem__, ids[at[u] : at[u + 1]].tolist()))
            right = [u for u, (t, g) in enumerate(zip(texts, good)) if g and own(u, a, from_a, self.bytes_a) == t and own(u, b, from_b, self.bytes_b) == t]
            out = np.zeros(len(texts), np.int64)
            if right:
                out[right] = self.aligned(*([x[u] for u in right] for x in (texts, ids_a, ids_b)))
            return out
        to_a, to_b = common_ends(np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b]))
        groups_a, groups_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        until = np.searchsorted(to_a, from_a[1:], side="left") + 1  # groups up to each text's end
        # groups as text: a group's A ids and its B ids, each as it is spoken
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[to_a - 1] = last_b[to_b - 1] = True
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(to_b - groups_b, groups_a)] = 2 * a + last_a
        order[np.arange(len(b)) + np.repeat(to_a, groups_b)] = 2 * (len(self.bytes_a) + b) + last_b
        said, ends = _taken(self.spoken, order)
        # links: each A token of a group with each B token of it
        per_a = np.repeat(groups_b, groups_a)
        links = np.diff(_starts(groups_a * groups_b)[np.concatenate([[0], until])])
        bits_a, bits_b = len(self.bytes_a).bit_length(), len(self.bytes_b).bit_length()
        keys = np.repeat(np.arange(len(texts)), links) << bits_a  # unit, A's and B's id in one number
        keys = np.sort((keys | np.repeat(a, per_a)) << bits_b | b[_ranges(np.repeat(to_b - groups_b, groups_a), per_a)])
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times, keys = np.diff(np.append(first, len(keys))), keys[first]
        codes = (keys >> bits_b & (1 << bits_a) - 1) << 32 | keys & (1 << bits_b) - 1
        nums = np.stack([n_a, n_b, np.diff(until, prepend=0), links], 1)
        return self._add(nums, said, np.diff(ends[from_a + from_b]), codes, times, np.bincount(keys >> bits_a + bits_b, minlength=len(texts)))

    def numbers(self, wanted: list[str]) -> np.ndarray:
        """Numbers of different units; those that aren't remembered are aligned together."""
        index, signs = self.index, self.signs
        new = [u for u, i in zip(wanted, map(index.get, wanted)) if i is None]
        if new:
            signed = [u for u in new if u[-1] in signs and u[:-1].isalpha()]
            if signed:
                own, words = set(signed), dict.fromkeys([u[:-1] for u in signed])
                new = [*dict.fromkeys([*(u for u in new if u not in own), *(w for w in words if w not in index)])]
            if new:
                # B sets a space before what it gets: of a unit that begins with a line end it comes off again
                ids_b = self.b.encode([u[1:] if u[0] == " " else u for u in new], num_threads=1)
                ids_b = [i if u[0] != "\n" else i[1:] if i and self.bytes_b[i[0]] == b" " else [] for u, i in zip(new, ids_b)]
                own = self.aligned([spelled(u).encode() for u in new], list(map(self._ids_a, new)), ids_b)
                index.update(zip(new, own.tolist()))
            if signed:
                words = np.array([index[u[:-1]] for u in signed])
                own = np.zeros(len(signed), np.int64)
                own[words > 0] = self._joined(words[words > 0], np.array([signs[u[-1]] for u in signed])[words > 0])
                index.update(zip(signed, own.tolist()))
        return np.fromiter(map(index.__getitem__, wanted), np.int64, len(wanted))

    def number_of_whole(self, text: str) -> int:
        """A text's number without cutting it."""
        ids = array("I", self.a.whole.encode(" " + text, add_special_tokens=False).ids).tobytes()
        return int(self.aligned([b" " + text.encode()], [ids], [self.b.encode(text)])[0])

    def spoken_units(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of units as text, one after the other, and where each begins and the last one ends."""
        said, at = pa.py_buffer(self.said.all), pa.py_buffer(self.said_at.all)
        return _taken(pa.Array.from_buffers(pa.large_binary(), self.nums.n, [None, at, said]), numbers)

    def _record(self, number: int) -> tuple | None:
        said, _ = self.spoken_units(np.array([number]))
        return (said.tobytes()[:-1].decode(), *self.nums.all[number].tolist()) if number else None

    def records(self, wanted: Iterable[str]) -> dict[str, tuple | None]:
        """``(groups as text, n_a, n_b, n_groups, n_links)`` of units, None for those whose tokens' bytes aren't theirs."""
        wanted = list(dict.fromkeys(wanted))
        return {u: self._record(i) for u, i in zip(wanted, self.numbers(wanted).tolist())}

    def whole(self, text: str) -> tuple | None:
        """A text's record without cutting it."""
        return self._record(self.number_of_whole(text))

    def forget(self) -> None:
        """If there are too many units or too much text of theirs, keeps half of them, those that most chunks used, the newest first."""
        if self.nums.n <= REMEMBERED and self.said.n <= 64 * REMEMBERED:
            return
        names, own = list(self.index), np.fromiter(self.index.values(), np.int64, len(self.index))
        named = np.zeros(self.nums.n, bool)
        named[own] = [len(u) <= LONGEST for u in names]
        named[: self.fixed] = False
        kept = np.flatnonzero(named)
        kept = kept[np.sort(np.argsort(self.uses.all[kept], kind="stable")[-min(self.nums.n, REMEMBERED) // 2 :])]
        kept = np.concatenate([np.arange(self.fixed), kept])
        renumbered = np.zeros(self.nums.n, np.int64)
        renumbered[kept] = np.arange(len(kept))
        numbers = renumbered[own]
        self.index = dict(zip(compress(names, numbers > 0), numbers[numbers > 0].tolist()))
        said, said_at = self.spoken_units(kept)
        sizes = np.diff(self.codes_at.all)[kept]
        places = _ranges(self.codes_at.all[kept], sizes)
        self.said.set(said)
        self.said_at.set(said_at)
        self.codes.set(self.codes.all[places])
        self.times.set(self.times.all[places])
        self.codes_at.set(_starts(sizes))
        self.nums.set(self.nums.all[kept])
        self.uses.set(self.uses.all[kept] // 2)
        self.a.seen, self.a.old = {"": b""}, {}


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """A worker's own, which its next tasks find with what it remembers."""
    return Aligner(path_a, path_b)


def _taken(table: pa.LargeBinaryArray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a table one after the other, and where each begins and the last one ends."""
    if not len(places):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = table.take(pa.array(places)).buffers()
    at = np.frombuffer(at, np.int64)[: len(places) + 1]
    return np.frombuffer(data or b"", np.uint8)[: at[-1]], at


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Units of texts, see units(): the different ones, and all of them as places among these, and how many each text has."""
    odd = pc.fill_null(pc.match_substring_regex(texts, ODD), False)
    plain = pc.fill_null(pc.and_(pc.invert(odd), pc.not_equal(texts, "")), False)
    lists = pc.split_pattern(pc.replace_substring(texts.filter(plain), "\n", " \n"), " ")
    sizes = np.zeros(len(texts), np.int64)
    sizes[plain.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
    flat = lists.flatten()
    if pc.any(odd).as_py():
        at, pieces, done = _starts(sizes), [], 0
        for i in pc.indices_nonzero(odd).to_pylist():
            own = units(texts[i].as_py())
            pieces += [flat[done : at[i]], pa.array(own, flat.type)]
            done, sizes[i] = at[i], len(own)
        flat = pa.concat_arrays([*pieces, flat[done:]])
    flat = flat.dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(), sizes


class _Chunk:
    """Documents whose units are counted together."""

    def __init__(self, number: int, model: Aligner, with_groups: bool) -> None:
        self.number, self.model, self.with_groups, self.n = number, model, with_groups, 0
        self.ids, self.units, self.sizes, self.hashes, self.groups = [], [], [], [], []

    def add(self, ids: pa.Array, units: np.ndarray, sizes: np.ndarray) -> None:
        """Documents: their ids, the numbers of their units, how many each has."""
        said, at = self.model.spoken_units(units)
        said, cut = memoryview(said), at[_starts(sizes)].tolist()
        said = [said[i : max(i, j - 1)] for i, j in zip(cut, cut[1:])]
        self.hashes += [hashlib.sha256(own).hexdigest() if len(own) else "" for own in said]
        self.groups += [bytes(own).decode() if self.with_groups else None for own in said]
        self.ids.append(ids)
        self.units.append(units)
        self.sizes.append(sizes)
        self.n += len(units)

    def batches(self, id_col: str) -> Iterator[pa.RecordBatch]:
        """The documents (their units in x, how often in y), one row of the units' pairs (offsets in x, places among the chunk's
        sorted codes in y, times in z) and the codes with the chunk's number of documents that link them."""
        model, sizes = self.model, np.concatenate(self.sizes)
        unit = np.concatenate(self.units)
        used = np.zeros(model.nums.n, bool)
        used[unit] = True
        numbers = np.flatnonzero(used)  # a number for each of the chunk's units
        model.uses.all[numbers] += 1
        keys = np.sort(np.repeat(np.arange(len(sizes)), sizes) * len(numbers) + (np.cumsum(used) - 1)[unit])
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
        often, keys = np.diff(np.append(first, len(keys))), keys[first]
        doc, unit = np.divmod(keys, max(len(numbers), 1))
        ends = _starts(np.bincount(doc, minlength=len(sizes)))
        nums, starts, sizes = model.nums.all[numbers], model.codes_at.all[numbers], np.diff(model.codes_at.all)[numbers]
        places = _ranges(starts, sizes)
        offsets, codes, times = _starts(sizes), model.codes.all[places], model.times.all[places]
        own, place = np.unique(codes, return_inverse=True)
        held, mark = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        sums = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(nums[unit] * often[:, None], axis=0)])[ends], axis=0)
        for i in range(0, len(self.hashes), 256):
            to = ends[i : i + 257]
            part = unit[to[0] : to[-1]]
            at = place[_ranges(offsets[part], sizes[part])]
            cut = _starts(sizes[part])[to - to[0]].tolist()
            for x, y in zip(cut, cut[1:]):  # a document counts once for a pair
                pairs, ranks = at[x:y], np.arange(y - x)
                mark[pairs] = ranks
                held[pairs[mark[pairs] == ranks]] += 1
        ids = pa.concat_arrays(self.ids)
        names = [id_col, *(f.split()[0] for f in ROWS.split(", "))]
        kinds = [ids.type, *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.int64(), pa.int64()]

        def rows(n: int, **cols) -> pa.RecordBatch:
            chunk = pa.array(np.full(n, self.number, np.int64))
            return pa.RecordBatch.from_arrays([chunk if c == "chunk" else cols[c].cast(k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

        for i in range(0, len(ids), 256):
            j = min(i + 256, len(ids))
            columns = {c: pa.array(sums[i:j, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            yield rows(j - i, **{id_col: ids[i:j]}, **columns, groups_sha256=pa.array(self.hashes[i:j]), groups=pa.array(self.groups[i:j], pa.string()), x=_lists(unit, ends[i : j + 1]), y=_lists(often, ends[i : j + 1]))
        if len(own):
            yield rows(1, x=_lists(offsets), y=_lists(place), z=_lists(times))
        for i in range(0, len(own), 1 << 16):
            yield rows(len(own[i : i + (1 << 16)]), code=pa.array(own[i : i + (1 << 16)]), docs=pa.array(held[i : i + (1 << 16)]))


def _lists(flat: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """Lists that end at places of a flat array, without ends all of it as one list."""
    ends = np.array([0, len(flat)]) if ends is None else ends
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(flat[ends[0] : ends[-1]].astype(np.int32)))


def aligned_rows(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """The chunks' rows, see _Chunk.batches()."""
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = docs.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbers, chunk = aligner(path_a, path_b), count(TaskContext.get().partitionId() << 32), None
        for b in batches:
            while b.num_rows:
                part = b[: CHUNK_DOCS - len(chunk.hashes) if chunk else CHUNK_DOCS]
                b = b[part.num_rows :]
                texts = part.column("__text")
                names, places, sizes = parted(texts)
                if chunk and chunk.n + len(places) > CHUNK_UNITS:
                    yield from chunk.batches(id_col)
                    chunk = None
                    model.forget()
                own = model.numbers(names.to_pylist())[places]
                if not own.all():  # where a unit's bytes differ, the whole text decides
                    cut, parts = _starts(sizes), []
                    for i, text in enumerate(texts):
                        at = own[cut[i] : cut[i + 1]]
                        if not at.all():
                            at = np.array([n for n in [model.number_of_whole(text.as_py())] if n], np.int64)
                            sizes[i] = len(at)
                        parts.append(at)
                    own = np.concatenate(parts)
                chunk = chunk or _Chunk(next(numbers), model, with_groups)
                chunk.add(part.column("__id"), own, sizes)
                if len(chunk.hashes) >= CHUNK_DOCS:
                    yield from chunk.batches(id_col)
                    chunk = None
                    model.forget()
        if chunk:
            yield from chunk.batches(id_col)
            model.forget()

    return arrow_map(docs, run, f"`{id_col}` {kind}, {ROWS}")


def _counted_back(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links: of counts, and of links whose count is the greatest of their A id."""
    pairs = rows.filter(pc.is_valid(rows.column("z")))
    docs = rows.filter(pc.is_valid(rows.column("n_a")))
    best, total = [0] * docs.num_rows, [0] * docs.num_rows
    if pairs.num_rows:
        offsets, place, times = (pairs.column(c).chunk(0)[0].values.to_numpy() for c in "xyz")
        order = np.argsort(counts.column("code").to_numpy())
        n, top = counts.column("n").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[offsets])
        unit_total, unit_best = sums(n[place] * times), sums(np.where(top[place], times, 0))
        for i, (unit, often) in enumerate(zip(docs.column("x"), docs.column("y"))):
            unit, often = unit.values.to_numpy(), often.values.to_numpy().astype(np.int64)
            best[i], total[i] = int(unit_best[unit] @ often), int(unit_total[unit] @ often)
    return docs.drop_columns(["chunk", "x", "y", "z"]).append_column("n_best", pa.array(best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(code, n, best)``: how many documents link the pair of ids, and whether that is the most that its A id has with any B id."""
    counts = rows.where("code IS NOT NULL").groupBy("code").agg(F.sum("docs").alias("n"))
    most = counts.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("n").alias("most"))  # a row an id of A's vocabulary
    return counts.join(F.broadcast(most), F.shiftright("code", 32) == most.a).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``. Documents: ``(id, n_a, n_b, n_groups, n_links, groups_sha256, groups, n_best, count_sum)``, a row for
    each row of ``docs``; pairs: ``(a, b, n)``, in how many documents ids a and b are linked.

    A encodes a space and the text, B the text (it adds the space); no string in a text is a special token. Offsets in bytes where
    tokens of both end cut the two id lists into groups, written ``a1,a2|b1;a3|b2,b3`` in ``groups`` (null without ``with_groups``).
    Links are all pairs of tokens of one group. n_best: links whose pair is in as many documents as any of its A id; count_sum: the
    pairs' documents, summed over links.

    Null and empty texts, and texts whose tokens spell other bytes, have no tokens: zeros and an empty string. Repeated rows
    count as often as they stand, ids may be null, an empty table gives empty ones; other columns are ignored. Texts may be of any
    length: a long one has its own chunk or shares it with its batch.

    Every different piece of text between places where both tokenizers split is aligned once a worker. Documents stay in their
    chunk, whose distinct pairs go out to be counted and come back with their counts; what is shuffled are a chunk's
    distinct pairs, never links."""
    rows = staged(aligned_rows(docs, path_a, path_b, id_col, text_col, with_groups))
    counts = staged(pair_counts(rows))
    back = rows.where("code IS NOT NULL").select(F.col("chunk").alias("of"), "code").join(counts, "code")
    kind = docs.schema[id_col].dataType.simpleString()
    cols = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    own = rows.where("code IS NULL").select("chunk", *cols, "x", "y", "z")
    out = own.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_counted_back, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long")
    out = staged(out)
    unstage(rows)
    return out, counts.select(F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)[0].drop("groups")
