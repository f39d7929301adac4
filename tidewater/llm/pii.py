"""Personal data: detection, and surrogates that keep type, format and who is who."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.llm.common import arrow_map, cut, salted_join, staged

#: Titles and the gender they tell, and given and family names by gender and script.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Г-н": "m", "Г-жа": "f", "Господин": "m", "Госпожа": "f", "Dr": "n", "Prof": "n",
}
GIVEN = {
    "latin": {"m": "Adam Boris Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karim Liam Marco Noel Oscar Paul Quentin Robert Simon Tomas".split(), "f": "Anna Bella Clara Diana Elena Flora Greta Hanna Irene Julia Karla Lina Maria Nora Olga Paula Rosa Sofia Tina Vera".split()},
    "cyrillic": {"m": "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Семён Фёдор".split(), "f": "Алина Вера Галина Дарья Елена Жанна Инна Кира Лариса Мария Нина Ольга Полина Раиса София Ульяна".split()},
}
FAMILY = {
    "latin": "Abel Bauer Costa Dunn Evans Fuchs Garcia Haas Ivers Jansen Klein Lopez Moreau Neumann Ortiz Petit Quinn Roth Silva Torres Ullman Vidal Weber Young Zeller".split(),
    "cyrillic": "Абрамов Белов Волков Громов Данилов Ершов Жуков Зайцев Ильин Козлов Лебедев Морозов Новиков Орлов Павлов Романов Соколов Титов Фролов Шубин".split(),
}
#: Short words inside names, and degrees that stand between a title and a name.
PARTICLES = frozenset("af al av bin da dal de degli dei del della den der des di do dos du el ibn la las le los op ten ter van vom von zu zum zur де дер ла фон".split())
DEGREES = frozenset("agr c dent dipl h habil ing iur jur med mult nat oec pharm phil pol rer theol vet".split())
#: Endings of made-up names by script and gender.
ENDINGS = {
    ("given", "latin"): {"m": "an el in on or us".split(), "f": "a ana ela ia ina ora".split()},
    ("given", "cyrillic"): {"m": "ан ей ил ир ор".split(), "f": "ана ила ина ира ора".split()},
    ("family", "latin"): "ard berg ell er ez man ner sen ski ton".split(),
    ("family", "cyrillic"): "анов аров енов еров илов оров".split(),
}
SYLLABLES = {"latin": ("bcdfghjklmnprstvwz", "aeiou"), "cyrillic": ("бвгджзклмнпрстфх", "аеиоу")}
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ", "".join(map(chr, range(0x3B1, 0x3CA))), "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))))
ALPHABET = {c: a for a in _ALPHABETS for c in a}

#: Lengths and first digits by which card issuers are told.
CARDS = re.compile(
    r"4\d{12}(?:\d{3}){0,2}|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}"
    r"|35(?:2[89]|[3-8]\d)\d{12}(?:\d{3})?|(?:50|5[6-8]|6\d)\d{10,17}"
)
#: Words that begin sentences and are no given names.
OPENERS = frozenset("a an and after all also as at because before but by did do does for from had has he her here his how i if in is it its my no not now of on once or our she since so that the their then there they this though to under until was we were what when where while who why with yes yet you your aber als auch da das dann der die ein eine er es für ihr im in mit nach sie so und von wenn wir zu car ce ces de des elle en et il je la le les mais ou par pour que qui si son sur un une el la los las pero por que su un una y а в и как когда на но он она они по с то у что это".split())

_NAME = r"[^\W\d_](?:['’-]?[^\W\d_])*"
TITLE = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})\.?(?=[ \u00a0])")
#: What may follow a title: a word, or letters with a stop (an initial, a degree, a further title).
PART = re.compile(rf"[ \u00a0]({_NAME})(\.?)")
WORD = re.compile(rf"(?<![\w-]){_NAME}")
#: In scripts without case nothing tells where a name ends; there it has at most so many words.
CASELESS = 3
SECRET = re.compile(r"(?<![0-9A-Za-z])(?:(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})|(?:sk|pk|ghp|AKIA)[-_]?[0-9A-Za-z]{16,64})(?![0-9A-Za-z])")
#: Telephone numbers: international ones (groups of up to four digits, then at most one longer), groups around a bracket or with
#: their signs, those with a trunk 0 (city and number, pairs, or at one go), and ten digits at one go as North America writes them.
PHONE = re.compile(
    r"(?<![\w+])(?:"
    r"(?:\+|00)[1-9]\d{0,2}(?:[ ./-]?\(\d{1,5}\))?(?:[ ./-]?\d{1,4}(?!\d)){0,5}?(?:[ ./-]?\d{5,10}|(?:[ ./-]\d{1,4}){2,5})(?![\d-])"
    r"|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}(?:[ .-]\d{2,4}){1,3}(?![\d-])"
    r"|\(0\d{1,5}\)[ ./-]?\d{3,9}(?:[ -]\d{2,5})?(?![\d-])"
    r"|0[1-9]\d{0,1}([ .-])\d\d(?:\1\d\d){3}(?![\d-])"
    r"|0[1-9]\d{1,4}[ /-]\d{5,9}(?![\d-])"
    r"|0[1-9]\d{1,4}[ /-]\d{3}[ -]\d{3,5}(?![\d-])"
    r"|0[1-9]\d{7,10}(?!\d|[.-]\d)"
    r"|[2-9](?!11)\d\d[2-9](?!11)\d{6}(?!\d|[.-]\d)"
    r")"
)
#: Kinds in the order in which they take a place in the text; names come after them.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]++@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])")),
    ("secret", SECRET),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("mac", re.compile(r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}([:-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Za-z:-])")),
    ("ipv6", re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?::\b|::)?(?![\w:])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("card", re.compile(r"(?<![\d+-])(?:\d{12,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?![\d-]|\.\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", PHONE),
]
_DIGIT, _CODE = re.compile(r"\d"), re.compile(r"(?:sk|pk|ghp|AKIA)[-_]?[0-9A-Za-z]{16}")
#: From these tries on the space of surrogates grows with every try (e-mails by a label, codes by a suffix).
LABEL, SUFFIX = 2, 16


def _is_ipv6(found: str) -> bool:
    """A valid address that no time of day, code or scope of a program looks like: eight groups, or a double colon after a group of three or four."""
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return False
    return _DIGIT.search(found) is not None and ("::" not in found or len(found.partition(":")[0]) > 2)


def _is_card(found: str) -> bool:
    digits = "".join(str(unicodedata.digit(c)) for c in found if c.isdecimal())
    return bool(CARDS.fullmatch(digits)) and _luhn(digits[:-1]) == int(digits[-1])


#: Kinds whose form alone doesn't tell them.
CHECKS = {"card": _is_card, "ipv6": _is_ipv6}


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the places taken blank for later kinds; ``spans`` don't overlap and are in order."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], "\0" * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def _after_title(text: str, at: int) -> tuple[str, list[tuple[int, int]], int]:
    """``(genders told, words, end)`` of the name behind a title that ends at ``at``: further titles and degrees are passed over, initials and
    particles belong to the name if more of it follows. A name ends before a word in small letters and before one of OPENERS."""
    told, words, open_, caseless = "", [], [], 0
    while m := PART.match(text, at):
        w, stop = m[1], m[2]
        if not words and not open_ and (w in TITLES or stop and w.lower() in DEGREES):
            told, at = told + TITLES.get(w, ""), m.end()
            continue
        if words and w in TITLES:
            break
        script = _script(w)
        initial = stop and len(w) == 1 and w.isupper()
        if not initial and w in PARTICLES:
            open_.append(m.span(1))
        elif script == "other" and not w[0].isupper():
            caseless += 1
            if caseless > CASELESS:
                break
            words += [*open_, m.span(1)]
            open_ = []
        elif not w[0].isupper() or (words or open_) and not initial and w.lower() in OPENERS:
            break
        elif initial:
            open_.append(m.span(1))
        else:
            words += [*open_, m.span(1)]
            open_ = []
        at = m.end()
        if stop and not initial:
            break  # the end of a sentence
    if not words:  # an initial alone is all that is told of the name
        words = [x for x in open_ if text[x[0]].isupper()][:1]
    return told, words, at


def _names(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, gender:name)``: names after a title, and everywhere in the same text mentions of their family names,
    with given names, initials and particles before them or alone. A title without gender, or none, takes that of a titled mention with
    the same given and family name, else with the same family name. The time is linear in the text."""
    titled, pos = [], 0
    while m := TITLE.search(text, pos):
        told, spans_, pos = _after_title(text, m.end())
        if not spans_:
            continue
        a, b = spans_[0][0], spans_[-1][1]
        if text[b - 2 : b] in ("'s", "’s"):
            b -= 2
        pos = b
        gender = next((g for g in TITLES[m[1]] + told if g != "n"), "n")
        words = [text[x:y] for x, y in spans_[:-1]] + [text[spans_[-1][0] : b]]
        titled.append((a, b, gender, words))
    if not titled:
        return []
    genders: dict[tuple[str, ...], set[str]] = {}
    for _, _, g, words in titled:
        if g != "n":
            for k in ((words[0], words[-1]), (words[-1],)):
                genders.setdefault(k, set()).add(g)

    def told_by(g: str, words: list[str]) -> str:
        for k in ((words[0], words[-1]), (words[-1],)) if g == "n" else ():
            if len(genders.get(k, ())) == 1:
                return next(iter(genders[k]))
        return g

    givens = {w for *_, words in titled for w in words[:-1] if len(w) > 1 and w not in PARTICLES}
    families = {f for x in titled for f in (x[3][-1], x[3][-1].upper())}
    sizes = sorted({len(re.split("['’]", f)) for f in families}, reverse=True)
    rest = _blank(text, [x[:2] for x in titled])
    small: list[set[str]] = []
    taken: list[tuple[int, int, str]] = []
    before: list[tuple[int, int]] = []  # words in a row, each one space (after an initial, a stop and a space) behind the last

    def joined(a: int) -> bool:
        return bool(before) and (rest[before[-1][1] : a] in (" ", "\u00a0") or rest[before[-1][1] : a] in (". ", ".\u00a0") and before[-1][1] - before[-1][0] == 1)

    def is_given(a: int, b: int) -> bool:
        """Whether a word just before a family name is a given name: no word that opens sentences or that the text has in small letters."""
        w = rest[a:b]
        if w in givens or len(w) == 1 and w.isupper() and rest[b : b + 1] == ".":
            return True
        if not w[0].isupper() or w.lower() in OPENERS or w.title() in TITLES:
            return False
        if not small:
            small.append(set(re.findall(r"(?<![\w-])[^\W\d_]+", rest)))
        return w.lower() not in small[0]

    for m in WORD.finditer(rest):
        a, b = m.span()
        if not joined(a):
            before = []
        ends = [a + x.start() for x in re.finditer("['’]", m[0])]
        if not (b < len(rest) and (rest[b] == "-" or rest[b].isalnum() or rest[b] == "_")):
            ends.append(b)
        starts, k, used = [a, *(e + 1 for e in ends if e < b)], 0, False
        while k < len(starts):
            end = next((ends[k + n - 1] for n in sizes if k + n <= len(ends) and rest[starts[k] : ends[k + n - 1]] in families), None)
            if end is None:
                k += 1
                continue
            first = starts[k]
            if k == 0:
                i = len(before)
                while i and rest[before[i - 1][0] : before[i - 1][1]] in PARTICLES:
                    i -= 1
                if i and is_given(*before[i - 1]):
                    i -= 1
                    while i and (rest[before[i - 1][0] : before[i - 1][1]] in givens or rest[before[i - 1][1]] == "." and is_given(*before[i - 1])):
                        i -= 1
                    first = before[i][0]
            words = [rest[x:y] for x, y in before if x >= first] + [rest[starts[k] : end]]
            taken.append((first, end, f"{told_by('n', words)}:{rest[first:end]}"))
            used = True
            k = ends.index(end) + 1
        before = [] if used else [*before, (a, b)]
    return taken + [(a, b, f"{told_by(g, words)}:{text[a:b]}") for a, b, g, words in titled]


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, entity)`` of a whole text without overlaps, in order; the earlier kind wins a place. Numbers are
    cards only if an issuer's length, first digits and check digit hold."""
    if not text:
        return []
    taken: list[tuple[int, int, str, str]] = []
    digits, work = _DIGIT.search(text), text
    for kind, pattern in PATTERNS:
        if not ("@" in text if kind == "email" else digits or kind == "secret" and _CODE.search(text)):
            continue
        new = [(*m.span(), kind, m[0]) for m in pattern.finditer(work) if CHECKS.get(kind, bool)(m[0])]
        if new:
            taken += new
            work = _blank(work, [x[:2] for x in new])
    if any(t in text for t in TITLES):
        taken += [(a, b, "name", e) for a, b, e in _names(work)]
    return sorted(taken)


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "latin" if name.startswith("LATIN") else "cyrillic" if name.startswith("CYRILLIC") else "other"


def _feminine(word: str) -> bool:
    return word.lower().endswith(("ова", "ева", "ёва", "ина"))


def name_words(entity: str) -> list[tuple[int, str, str, str]]:
    """A name's words as ``(offset, kind, key, word)``: given names and initials with the gender, the family name by itself, so that it is the
    same after any title and alone; Russian feminine family names go with the masculine ones. Particles are left out: they stay."""
    gender, _, name = entity.partition(":")
    words = [(m.start(), m[0]) for m in re.finditer(r"[^ \u00a0.]+", name)]
    at, family = words.pop()
    last = family.lower()
    found = [(i, "initial" if len(w) == 1 and name[i + 1 : i + 2] == "." else "given", f"{gender}:{w.lower()}", w) for i, w in words if w not in PARTICLES]
    return [*found, (at, "family", last[:-1] if _feminine(last) else last, family)]


def initial_surrogate(letter: str, key: bytes) -> str:
    """Another letter of the same alphabet: a keyed cycle through all of it, so that different letters stay different."""
    own = sorted(_own(letter), key=lambda c: _mix(key, "initial", c))
    return own[(own.index(letter) + 1) % len(own)] if own else letter


def _mix(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


@lru_cache(maxsize=65_536)
def _own(c: str) -> str:
    """Characters that may stand for c: those of its alphabet, for other letters and digits those of the same Unicode class
    within its 256 code points; none for signs."""
    if c in ALPHABET or not c.isalnum():
        return ALPHABET.get(c, "")
    start, kind = ord(c) & ~0xFF, unicodedata.category(c)
    if kind == "Nd":
        start = ord(c) - unicodedata.digit(c)
        return "".join(map(chr, range(start, start + 10)))
    return "".join(x for x in map(chr, range(start, start + 256)) if unicodedata.category(x) == kind)


def _label(size: int, key: bytes, *parts: object) -> str:
    return _same_format("x" * size, key, "label", *parts)


def _same_format(text: str, key: bytes, *tweak: object) -> str:
    """Each letter and digit replaced by one of its own alphabet (script and case, or _own(); hexadecimal stays so); all else stays."""
    n, out = _mix(key, text, *tweak), []
    letters = 6 if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", text) else 99
    for c in text:
        own = _own(c)
        own = own if c.isdecimal() else own[:letters]
        if own:
            if n < 1 << 32:
                n = _mix(key, n, len(out), text, *tweak)
            n, k = divmod(n, len(own))
            c = own[k]
        out.append(c)
    return "".join(out)


def _valid_iban(code: str) -> int:
    """The remainder by 97, 1 for a valid code."""
    c = code.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97


def word_surrogate(kind: str, word: str, key: bytes, attempt: int = 0) -> str:
    """A given or family name of the same script (and gender) for a lower-case one. The lists are short: later tries make names up from
    syllables with an ending of their kind, one syllable more every other try."""
    gender, _, bare = word.rpartition(":")
    script, pick = _script(bare), lambda *tweak: _mix(key, kind, word, *tweak)
    if script == "other":
        return _same_format(bare + bare[-1] * attempt, key, kind, gender, attempt)
    sex = "mf"[pick("gender") & 1] if gender == "n" else gender
    own = FAMILY[script] if kind == "family" else GIVEN[script][sex]
    if not attempt:
        return own[pick() % len(own)]
    ends, (first, second) = ENDINGS[kind, script], SYLLABLES[script]
    ends = ends if kind == "family" else ends[sex]
    new = ""
    for i in range(1 + attempt // 2):
        n = pick("syllable", attempt, i)
        new += first[n % len(first)] + second[(n >> 32) % len(second)]
    n = pick("end", attempt)
    return (new + first[n % len(first)] + ends[(n >> 32) % len(ends)]).capitalize()


def _worn(new: str, word: str) -> str:
    """A name's surrogate in the form of the word whose place it takes."""
    if _script(word) == "cyrillic" and _feminine(word):
        new = "-".join(x + "а" if x.endswith(("ов", "ев", "ин")) else x for x in new.split("-"))
    return new.upper() if len(word) > 1 and word.isupper() and _script(word) != "other" else new


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """format_surrogate(), with a keyed suffix that grows with later attempts where that alone finds no free one."""
    if kind in ("given", "family"):
        return word_surrogate(kind, entity, key, attempt)
    new = format_surrogate(kind, entity, key, attempt)
    if kind in ("email", "name") or attempt < SUFFIX:
        return new
    return f"{new}-{_label(attempt - SUFFIX + 2, key, kind, entity, attempt)}"


def format_surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """A replacement of the same kind and format, the same for the same key, entity and attempt.

    Digits stay digits, letters keep script and case. E-mails move to a reserved example domain of the same
    depth unless they are there already, from attempt LABEL on below a keyed label that grows; card numbers keep their first
    four digits and a valid check digit, IBANs their country and, if they were valid, validity; IP addresses have no first
    number 0; telephone numbers keep country code, trunk 0 and a 555; IPv6 and MAC addresses keep which places are digits; keys keep
    their prefix; names go word by word, with given names of the title's gender, other initials and the same particles."""
    if kind == "email":
        local, _, domain = entity.partition("@")
        head = domain if re.search(r"(?:^|\.)example\.(?:com|net|org)$", domain) else "example.org"
        parts = head.split(".")
        if attempt >= LABEL:
            parts = [_label(attempt - LABEL + 4, key, entity, attempt), *parts[-2:]]
            return _same_format(local, key, kind, domain, attempt) + "@" + ".".join(parts)
        return _same_format(local, key, kind, domain, attempt) + "@" + ".".join([_same_format(p, key, kind, "host", entity, attempt) for p in parts[:-2]] + parts[-2:])
    if kind == "ip":
        n = _mix(key, kind, entity, attempt)
        return ".".join(str(x) for x in (1 + n % 223, n >> 16 & 255, n >> 32 & 255, n >> 48 & 255))
    if kind == "card":
        head = [i for i, c in enumerate(entity) if c.isdecimal()][3] + 1
        new = entity[:head] + _same_format(entity[head:], key, kind, entity[:head], attempt)
        digits = [str(unicodedata.digit(c)) for c in new if c.isdecimal()]
        return new[:-1] + chr(ord(entity[-1]) - unicodedata.digit(entity[-1]) + _luhn("".join(digits[:-1])))
    if kind == "iban":
        new = entity[:4] + _same_format(entity[4:], key, kind, entity[:4], attempt)
        if _valid_iban(entity) != 1:
            return entity[:2] + _same_format(entity[2:4], key, kind, entity, attempt) + new[4:]
        return f"{new[:2]}{98 - _valid_iban(new[:2] + '00' + new[4:]):02d}{new[4:]}"
    if kind == "phone":
        m = re.match(r"(?:\+|00[1-9])\d{0,3}(?=\D)|\(?0[1-9]", entity)
        head = m[0] if m else ""
        rest = entity[len(head) :]
        new = _same_format(rest, key, kind, head, attempt)
        at = rest.find("555")
        return head + (new[:at] + "555" + new[at + 3 :] if at >= 0 else new)
    if kind in ("ipv6", "mac"):
        n, out = _mix(key, kind, entity, attempt), []
        for c in entity:
            own = ALPHABET["0"] if c.isdigit() else ("abcdef" if c.islower() else "ABCDEF") if c.isalpha() else c
            n, k = divmod(n if n >= 1 << 32 else _mix(key, kind, n, len(out), entity, attempt), len(own))
            out.append(own[k])
        return "".join(out)
    if kind == "name":
        name, out, at = entity.partition(":")[2], [], 0
        for i, k, w, word in name_words(entity):
            out += [name[at:i], initial_surrogate(word, key) if k == "initial" else _worn(word_surrogate(k, w, key, attempt), word)]
            at = i + len(word)
        return "".join([*out, name[at:]])
    if kind == "secret":
        m = re.match(r"(?:sk|pk|ghp|AKIA)[-_]?(?=[0-9A-Za-z]{16})", entity)
        head = m[0] if m else ""
        return head + _same_format(entity[len(head) :], key, kind, head, attempt)
    return _same_format(entity, key, kind, attempt)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, entity, surrogate)`` for distinct ``(kind, entity)``. No two entities of a kind share a surrogate and none is an
    entity that stands in the corpus; where a try fails that, the entity of least hash keeps it and the others try again, in a
    space that grows with each try. For codes letter case tells entities apart, for given and family names it doesn't."""
    secret, entities = hashlib.blake2b(key.encode()).digest(), cut(entities.distinct())

    def run(attempt: int):
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [surrogate(k, e, secret, attempt) for k, e in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), pa.array(new, pa.string())], ["kind", "entity", "surrogate"])
        return one

    word = F.col("kind").isin("given", "family")
    own = F.when(word, F.regexp_replace("entity", "^[mfn]:", "")).when(F.col("kind") == "name", F.regexp_replace("entity", "^[mfn]:", "")).otherwise(F.col("entity"))
    real = entities.select("kind", own.alias("form")).distinct()
    open_, done = entities, None
    for attempt in count():
        new = arrow_map(open_, run(attempt), "kind string, entity string, surrogate string").withColumn("form", F.when(word, F.lower("surrogate")).otherwise(F.col("surrogate")))
        new = new.join(real, ["kind", "form"], "left_anti")
        new = new.groupBy("kind", "form").agg(F.min(F.struct(F.xxhash64("entity").alias("h"), "entity", "surrogate")).alias("s")).select("kind", "s.entity", "s.surrogate", "form")
        new = cut(new if done is None else new.join(done.select("kind", "form"), ["kind", "form"], "left_anti"))
        done = new if done is None else cut(done.unionByName(new))
        open_ = cut(open_.join(new, ["kind", "entity"], "left_anti"))
        if open_.isEmpty():
            return done.drop("form")


SPANS = "__spans array<struct<start:int,stop:int,kind:string,entity:string>>, __uid long"


def spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """Places to replace: those of find(), names word by word."""
    out = []
    for a, b, kind, entity in find(text):
        if kind != "name":
            out.append((a, b, kind, entity))
            continue
        out += [(a + i, a + i + len(word), k, w) for i, k, w, word in name_words(entity)]
    return out


def _found(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId() << 33, 0
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("entity", pa.string())]))
        for b in batches:
            rows = [[dict(zip(("start", "stop", "kind", "entity"), s)) for s in spans(t.as_py())] or None for t in b.column(text_col)]
            cols = [*b.columns, pa.array(rows, kind), pa.array(range(task + serial, task + serial + b.num_rows), pa.int64())]
            serial += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "__spans", "__uid"])

    return run


def _replace(names: list[str], text_col: str, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, kinds = [], [], []
            for t, where, new in zip(b.column(text_col).to_pylist(), b.column("__spans").to_pylist(), b.column("__new").to_pylist()):
                by, out, at = {(n["kind"], n["entity"]): n["surrogate"] for n in new}, [], 0
                for s in where:
                    word = t[s["start"] : s["stop"]]
                    other = initial_surrogate(word, key) if s["kind"] == "initial" else by[s["kind"], s["entity"]]
                    out += [t[at : s["start"]], _worn(other, word) if s["kind"] in ("given", "family") else other]
                    at = s["stop"]
                texts.append("".join([*out, t[at:]]))
                counts.append(sum(s["kind"] not in ("given", "initial") for s in where))
                kinds.append(",".join(sorted({"name" if s["kind"] in ("given", "initial", "family") else s["kind"] for s in where})))
            cols = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*names, "__n", "__kinds"])

    return run


def session_key(spark: SparkSession) -> str:
    """The key of surrogates: the session's ``spark.tidewater.pii.key``. Where none is set, a random one is made for the session:
    then nobody can compute the surrogates again, but other sessions give other ones."""
    key = spark.conf.get("spark.tidewater.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("spark.tidewater.pii.key", key)
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents, all columns, with surrogates in the text, and ``__n`` (places replaced) and ``__kinds`` (sorted, with commas).

    Whole texts are searched, once: a written copy holds each row with its places, and only rows that have some are shuffled,
    to meet their surrogates. The same entity has the same surrogate throughout the table, different ones have different
    ones (see surrogates()); an entity that stands in very many texts is joined in salted parts. Without ``key`` that of the
    session is used. Null and empty texts stay; repeated rows are treated alike; an empty table gives an empty one. Columns
    may have any names but those that begin with two underscores. Initials have a surrogate by their letter alone; those of a name and its
    full form need not agree."""
    key = key or session_key(docs.sparkSession)
    names = docs.columns
    found = staged(arrow_map(docs, _found(text_col), StructType([*docs.schema, *StructType.fromDDL(SPANS)])))
    some = found.where(F.col("__spans").isNotNull())
    held = some.select("__uid", F.explode("__spans").alias("s")).where("s.kind <> 'initial'").select("__uid", F.struct("s.kind", "s.entity").alias("__e")).distinct()
    new = staged(surrogates(held.select("__e.kind", "__e.entity"), key).select(F.struct("kind", "entity").alias("__e"), "surrogate"))
    new = salted_join(held, new, "__e", F.col("__uid"), "inner", F.length("__e.entity") + F.length("surrogate"))
    new = new.groupBy("__uid").agg(F.collect_list(F.struct("__e.kind", "__e.entity", "surrogate")).alias("__new"))
    some = arrow_map(some.join(new, "__uid").drop("__uid"), _replace(names, text_col, hashlib.blake2b(key.encode()).digest()), StructType([*docs.schema, *StructType.fromDDL("__n long, __kinds string")]))
    return some.unionByName(found.where(F.col("__spans").isNull()).select(*names, F.lit(0).cast("long").alias("__n"), F.lit("").alias("__kinds")))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("__n").alias("n_replaced"), F.col("__kinds").alias("kinds"))
