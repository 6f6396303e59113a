"""PII surrogates: keyed, type-consistent replacements that keep distinctness and coreference."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.bitmaps import BITS, holds, marked, spread
from statloom.session import materialize

#: Rounds of the keyed permutation.
ROUNDS = 8
#: Given names by gender and script (fixed values); a name of a pool is replaced by one of its pool.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carla Clara Diana Elena Emma Eva Helen Ines Julia Karen Laura Linda Lucia Maria Marie Martha Nina Olivia Paula Rosa Sarah Sofia Sophie Susan Teresa Ursula Vera".split(),
    ("m", "latin"): "Adam Albert Anton Carlos Daniel David Diego Erik Felix Frank George Hans Henry Hugo James Jan John Jorge Juan Karl Louis Luis Martin Michael Oscar Pablo Paul Peter Robert Thomas".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга София Татьяна".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Дмитрий Иван Максим Николай Олег Пётр Сергей".split(),
}
#: Titles and the gender they state (fixed values).
TITLES = {
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle Госпожа".split(),
    "m": "Mr Herr Señor Sr Monsieur Господин".split(),
    "": "Dr Prof".split(),
}
#: Letters that change places with one another: vowels and consonants of a script, digits. Letters of no
#: class listed here change places with the other such letters of their script.
CLASSES = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "0123456789",
    "äëïöü", "âêîôû", "åæøœãõ", "çñšžčćđłńśźżřťďňğş", "іїєё", "йў", "ьъ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ",
    *("".join(map(chr, range(*ends))) for ends in ((0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0x3042, 0x3094), (0x30A2, 0x30F5))),
]
#: Characters by which a surrogate gets longer each time its format has been tried often enough.
LONGER = 4

_MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c) in ("Mn", "Mc"))
_LETTER = rf"(?:[^\W\d_]|[{_MARKS}])"
_INITIALS = "".join(sorted({t[0] for group in TITLES.values() for t in group}))
_TITLE = "|".join(t for group in TITLES.values() for t in group)
_CAPITAL = rf"[^\W\d_a-zа-я]{_LETTER}+"
#: Characters of an IBAN after its check digits, by country (the public register).
IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH CR HR LI LV", 18: "BG BH DE GB GE IE ME RS VA",
    19: "AE GI IL IQ OM SO TL", 20: "AD CZ DZ ES MD PK RO SA SE SK TN TR VG", 21: "LY PT ST", 22: "IS IT SM", 23: "AO BF BI CG CM DJ FR GA GR HN MC MG MR MZ SN TF",
    24: "AL AZ BJ BY CI CV CY DO EG GT GW HU KM LB MA ML NE NI PL PM PS SV TD TG UA WF YT", 25: "BR JO KW MU QA", 27: "MT SC YE", 28: "LC", 29: "RU",
}
#: Country codes of telephone numbers of one and two digits; all others have three (fixed values).
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_IBAN = "|".join(rf"(?:{'|'.join(codes.split())})\d{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, codes in IBAN_LENGTHS.items())
#: As before the area code a country code; E.164 without separators; groups after a country code; pairs of
#: digits; an area code in brackets; ten digits, or eleven after a trunk zero.
_PHONES = [
    r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]\d{3,4}[ .\-]?\d{3,4}",
    r"(?:\+|00)[1-9]\d{6,14}",
    r"(?:\+|00)[1-9]\d{0,2}(?:[ .\-]?\(\d{1,5}\))?(?:[ .\-]?\d{1,5}){2,6}",
    r"\d{2}(?P<gap>[ .\-])\d{2}(?:(?P=gap)\d{2}){2,4}",
    r"(?:\d[ .\-])?\(\d{2,5}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}",
    r"[2-9]\d{9}|1[2-9]\d{9}|0[1-9]\d{8,9}",
]
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
#: The part of a name before an underscore is the kind. Every run is bounded, or starts where no longer one does.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{{0,254}}@{_LABEL}(?:\.{_LABEL}){{0,32}}\.[A-Za-z]{{2,63}}",
    "iban": rf"\b(?=[A-Z]{{2}}\d{{2}})(?:{_IBAN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card_long": r"(?<![\w.\-+])(?:[2-6]\d{3}(?P<hyphen>[ \-])(?:\d{4}(?P=hyphen)){3}\d{3}|3\d{3}[ \-]\d{6}[ \-]\d{4,5}|[2-6]\d{12,14}|[2-6]\d{16,18})(?![\w\-])",
    "card": r"(?<![\w.\-])(?:\d{4}[ \-]?){3}\d{4}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": rf"(?<![\w+])(?=[\d+(])(?:{'|'.join(_PHONES)})(?![\w\-])",
    "person": rf"\b(?=[{_INITIALS}])(?:{_TITLE})\.?[ ]{_CAPITAL}(?:[ ]{_CAPITAL})?",
    "ip_six": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{1,4}|(?<=::))(?![\w:])",
}
_SINGLE = {k: re.compile(v) for k, v in PATTERNS.items()}


@cache
def _finder(without: frozenset[str]) -> re.Pattern:
    """All patterns as one, but for those that a text has nothing for."""
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items() if k not in without))


#: Given names of the pools, folded, and the pool of each.
POOLS = {name.casefold(): [x.casefold() for x in pool] for pool in GIVEN.values() for name in pool}
_WORDS = re.compile(rf"(?<![^\W_]){_CAPITAL}")
#: A name of several words without a title: given names of the pools, then another word.
_GIVEN = "|".join(name for pool in GIVEN.values() for name in pool)
_FULL = re.compile(rf"(?:(?:{_GIVEN})[ ])+{_CAPITAL}")
_ANY_WORD = re.compile(rf"(?<![^\W_])[^\W\d_]{_LETTER}+")
_PAIR = re.compile(rf"({_CAPITAL})[ ]({_CAPITAL})")


def _permute(number: int, size: int, key: bytes) -> int:
    """A keyed permutation of 0 … size - 1: a balanced Feistel network, walked until it lands inside."""
    if size < 2:
        return number
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, max(16, (half + 7) // 8)
    while True:
        left, right = number >> half, number & mask
        for r in range(ROUNDS):
            # Beyond what one digest holds it seeds a stream of as many bytes as half the number has.
            digest = hashlib.blake2b(b"%d:%x" % (r, right), key=key, digest_size=min(width, 64)).digest()
            stream = digest if width <= 64 else hashlib.shake_256(digest).digest(width)
            left, right = right, left ^ (int.from_bytes(stream, "big") & mask)
        number = (left << half) | right
        if number < size:
            return number


def _until(number: int, size: int, key: bytes, fits: Callable[[int], bool]) -> int:
    """The permutation walked on until the result `fits`; a bijection among the numbers that fit, as this one does."""
    while True:
        number = _permute(number, size, key)
        if fits(number):
            return number


_LETTERS = list(CLASSES)
_CLASS = {c: k for k, letters in enumerate(CLASSES) for c in letters}


def _kind(c: str) -> int:
    """The class of a letter or digit, -1 of anything else; the classes of further scripts are made when first needed."""
    if c not in _CLASS and len(_LETTERS) == len(CLASSES) and c.isalpha():
        scripts: dict[str, list[str]] = {}
        for x in map(chr, range(0x80, 0x32400)):
            if x.isalpha() and x not in _CLASS and x.casefold() == x and len(x.upper()) == 1 and x.upper().casefold() == x:
                scripts.setdefault(unicodedata.name(x, "OTHER").split()[0], []).append(x)
        scripts["OTHER"] = [*scripts.get("OTHER", []), *(x[0] for x in scripts.values() if len(x) == 1)]
        _LETTERS.extend("".join(scripts[name]) for name in sorted(scripts) if len(scripts[name]) > 1)
        _CLASS.update({x: k for k, letters in enumerate(_LETTERS) for x in letters})
    return _CLASS.get(c, -1)


def _key(secret: bytes, *parts: object) -> bytes:
    return hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=secret, digest_size=32).digest()


def _letters(text: str, key: bytes, longer: int = 0) -> str:
    """Every letter and digit moved within its class, all of them together as one number; the rest stays.

    `longer` more letters, of the largest class that the text has, take part at the end.
    """
    if longer:
        text += max((c for c in text if _kind(c) >= 0), key=lambda c: len(_LETTERS[_kind(c)]), default="b") * longer
    kinds = [_kind(c) for c in text]
    size, number = 1, 0
    for c, k in zip(text, kinds, strict=True):
        if k >= 0:
            size, number = size * len(_LETTERS[k]), number * len(_LETTERS[k]) + _LETTERS[k].index(c)
    shape = "".join("." if k < 0 else chr(97 + k) for k in kinds) + "|" + "".join(c for c, k in zip(text, kinds, strict=True) if k < 0)
    number = _permute(number, size, _key(key, shape))
    out = []
    for c, k in zip(reversed(text), reversed(kinds), strict=True):
        if k >= 0:
            number, at = divmod(number, len(_LETTERS[k]))
            c = _LETTERS[k][at]
        out.append(c)
    return "".join(reversed(out))


def _digits(digits: str, key: bytes, fits: Callable[[str], bool] = lambda d: True) -> str:
    n = len(digits)
    whole = lambda i: str(i).zfill(n)
    return whole(_until(int(digits), 10**n, key, lambda i: fits(whole(i)))) if n else digits


def _luhn(digits: str) -> int:
    """The check digit that would follow `digits`."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _national(found: str) -> str:
    """A telephone number without country code and trunk zero."""
    digits = re.sub(r"\D", "", found.replace("(0)", ""))
    if found[0] == "+" or (digits[:2] == "00" and len(digits) > 10):
        digits = digits[2:] if found[0] != "+" else digits
        digits = digits[next((n for n in (1, 2) if digits[:n] in COUNTRY_CODES), 3) :]
    elif len(digits) == 11 and digits[0] == "1":
        digits = digits[1:]
    return digits[1:] if digits[0] == "0" else digits


def canonical(kind: str, found: str) -> str:
    """What two mentions of one entity have in common."""
    if kind == "email":
        return found.lower()
    if kind == "phone":
        return _national(found)
    if kind == "person":
        names = _names(found)
        if names == [found] and found.casefold() in POOLS:
            return f"?:{found.casefold()}"
        return f"{_gender(found) if len(names) > 1 else ''}:{' '.join(names).casefold()}"
    if kind == "ip":
        return str(ipaddress.ip_address(found if ":" in found else ".".join(str(int(x)) for x in found.split("."))))
    return re.sub(r"[ \-]", "", found)


def _names(found: str) -> list[str]:
    """The words of a mention of a person without the title."""
    words = found.split()
    return words[1:] if words[0].rstrip(".") in _GENDERS and len(words) > 1 else words


def _valid(kind: str, found: str, before: str = "") -> bool:
    """What a pattern cannot tell: check digits, numbers of digits, addresses, and whether groups of digits are but numbers."""
    if kind == "iban":
        whole = found.replace(" ", "")
        return whole[2:4] == _iban_check(whole[:2], whole[4:])
    if kind == "card_long":
        digits = re.sub(r"\D", "", found)
        return _luhn(digits[:-1]) == int(digits[-1])
    if kind == "phone":
        if not (found[0] in "+0(" or "-" in found or "(" in found or found.isdigit() or _CALLED(before)):
            # Groups apart by blanks or dots alone: three, three and four digits are a telephone number, others may count anything.
            if [len(x) for x in re.split(r"[ .]", found)][-3:] != [3, 3, 4]:
                return False
        return sum(c.isdigit() for c in found) <= (17 if found.startswith("00") else 16 if "(0)" in found else 15) and len(_national(found)) >= 5
    if kind == "ip_six":
        try:
            # One group of letters before or after two colons is a name in some code.
            return int(ipaddress.IPv6Address(found)) > 0 and (any(c.isdigit() for c in found) or len(re.findall(r"\w+", found)) > 1)
        except ValueError:
            return False
    return True


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{account}{country}00')) % 97:02d}"


def parts(kind: str, entity: str) -> list[tuple[str, str]]:
    """The entities that get a surrogate of their own: of a person every word but given names of the pools."""
    if kind != "person":
        return [(kind, entity)]
    gender, _, name = entity.partition(":")
    *given, surname = name.split()
    if gender == "?":
        return []
    return [("name", x) for x in given if x not in POOLS] + [("name", surname)]


def _pooled(word: str, secret: bytes) -> str:
    """Another given name of the same pool, the next one in an order by the key."""
    order = sorted(POOLS[word], key=lambda x: _key(secret, "given", x))
    return order[(order.index(word) + 1) % len(order)]


def person(entity: str, secret: bytes, surrogate_of: Callable[[str], str]) -> str:
    """Every word of a name moves by itself, so that mentions of some of them agree; given names stay in their pool."""
    gender, _, name = entity.partition(":")
    *given, surname = name.split()
    if gender == "?":
        return f"?:{_pooled(surname, secret)}"
    return f"{gender}:{' '.join([*(_pooled(x, secret) if x in POOLS else surrogate_of(x) for x in given), surrogate_of(surname)])}"


def _range_of(ip: int) -> str:
    a = ipaddress.ip_address(ip)
    return "loopback" if a.is_loopback else "multicast" if a.is_multicast else "reserved" if a.is_reserved else "private" if a.is_private else "global"


def surrogate(kind: str, entity: str, secret: bytes, attempt: int = 0, longer: int = 0) -> str:
    """The canonical surrogate of a canonical entity: for one secret and attempt, distinct entities get distinct ones.

    With `longer` it leaves the format, by so many characters; an IPv4 address then becomes an IPv6 one.
    """
    key = _key(secret, kind, attempt)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_letters(local, _key(key, 'local'), longer)}@{_letters(host, _key(key, 'host', top))}.{top}"
    if kind == "ip":
        number = int(ipaddress.ip_address(entity))
        if ":" in entity:
            return str(ipaddress.IPv6Address((number >> 112 << 112) + _permute(number & ((1 << 112) - 1), 1 << 112, _key(key, number >> 112))))
        if longer:
            return str(ipaddress.IPv6Address((0x20010DB8 << 96) + _permute(number, 1 << 96, _key(key, "longer"))))
        return str(ipaddress.ip_address(_until(number, 1 << 32, key, lambda i: _range_of(i) == _range_of(number))))
    if kind == "card":
        off = (int(entity[-1]) - _luhn(entity[:-1])) % 10
        body = entity[0] + _digits(entity[1:-1] + "0" * longer, _key(key, entity[0], off))
        return body + str((_luhn(body) + off) % 10)
    if kind == "ssn":
        return _digits(entity + "0" * longer, key, lambda d: (d[:3] in ("000", "666") or d[0] == "9") == (entity[:3] in ("000", "666") or entity[0] == "9"))
    if kind == "phone":
        return _digits(entity + "0" * longer, _key(key, len(entity)), lambda d: "01".find(d[0]) == "01".find(entity[0]))
    if kind == "iban":
        account = _letters(entity[4:].lower(), _key(key, entity[:2]), longer).upper()
        return f"{entity[:2]}{_iban_check(entity[:2], account)}{account}"
    if kind == "person":
        return person(entity, secret, lambda word: surrogate("name", word, secret, attempt, longer))
    fits = (lambda x: x not in POOLS) if entity not in POOLS else (lambda x: True)
    while (entity := _letters(entity, key, longer)) and not fits(entity):
        longer = 0
    return entity


def in_format(kind: str, found: str, replacement: str) -> str:
    """The replacement written as the mention was: its separators, prefixes, title and capitals."""
    if kind == "person":
        old, new = _names(found), replacement.partition(":")[2].split()
        return " ".join([*found.split()[: -len(old)], *(_cased(n, o) for n, o in zip(new, old, strict=True))])
    if kind == "email":
        return _cased(replacement, found)
    if kind == "ip":
        return replacement
    if kind == "phone" and "(0)" in found:
        at = found.index("(0)") + 3
        return found[:at] + in_format(kind, found[at:], replacement)
    fresh, out = list(replacement), []
    skip = sum(c.isalnum() for c in found) - len(fresh)
    for c in found:
        if c.isalnum():
            skip -= 1
            if skip < 0:
                c = fresh.pop(0)
        out.append(c)
    return "".join(out + fresh)


def _cased(new: str, like: str) -> str:
    if len(new) == len(like):
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, like, strict=True))
    return new.upper() if like.isupper() else new if like.islower() else new.capitalize()


_GENDERS = {title: gender for gender, titles in TITLES.items() for title in titles}


def _gender(found: str) -> str:
    return _GENDERS.get(found.split()[0].rstrip("."), "")


_DIGIT = re.compile(r"\d").search
#: What is written before a telephone number, in the last letters before it.
_CALLED = re.compile(r"(?i)(?:\b(?:tel|fon|fono|phone|telefon|telefono|teléfono|téléphone|mobile?|móvil|handy|cell|fax|call|dial|ring|ruf|llame|appele[rz]|whatsapp|sms)|тел(?:ефон)?|факс|電話|电话|手机)\w{0,6}[^\w]{0,4}(?:\w{1,8}[^\w]{1,3})?$").search
_COLONS = re.compile(r"(?<!\w)[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:").search
_DIGITS_ONLY = frozenset(PATTERNS) - {"email", "person", "ip_six"}
_TITLES = [f"{t}{end}" for group in TITLES.values() for t in group for end in (" ", ". ")]
_POOL_NAMES = [name for pool in GIVEN.values() for name in pool]


def mentions(text: str | None, known: frozenset[str] = frozenset()) -> Iterator[tuple[str, re.Match]]:
    """(kind, match) from left to right; `known` are folded words of names that count without a title too.

    Every pattern needs an @, a digit, two colons or a title; texts without any hold none.
    """
    if not text:
        return
    at = 0
    there = {"email": "@" in text, "person": any(t in text for t in _TITLES), "ip_six": _COLONS(text) is not None}
    missing = frozenset(k for k, is_there in there.items() if not is_there) | (frozenset() if _DIGIT(text) else _DIGITS_ONLY)
    for kind, m in _patterned(text, _finder(missing)) if len(missing) < len(PATTERNS) else ():
        yield from _untitled(text, at, m.start(), known)
        yield kind, m
        at = m.end()
    yield from _untitled(text, at, len(text), known)


def _patterned(text: str, finder: re.Pattern) -> Iterator[tuple[str, re.Match]]:
    at = 0
    while m := finder.search(text, at):
        name = m.lastgroup
        before = text[max(0, m.start() - 24) : m.start()]
        if not _valid(name, m[0], before):
            # What the first pattern claims may still have the form of a later one.
            names = list(_SINGLE)
            later = ((k, _SINGLE[k].match(text, m.start())) for k in names[names.index(name) + 1 :])
            name, m = next(((k, x) for k, x in later if x and _valid(k, x[0], before)), (None, m))
        if name:
            yield name.partition("_")[0], m
        at = m.end() if name else m.start() + 1


def _untitled(text: str, start: int, end: int, known: frozenset[str]) -> Iterator[tuple[str, re.Match]]:
    """Names without a title between two places: given names of the pools with a capitalized word after them, and known words."""
    if not known and not any(text.find(name, start, end) >= 0 for name in _POOL_NAMES):
        return
    at = start
    while m := _WORDS.search(text, at, end):
        word = m[0].casefold()
        full = word in POOLS and _FULL.match(text, m.start(), end)
        pair = word in known and _PAIR.match(text, m.start(), end)
        if full:
            m = full
        elif pair and pair[2].casefold() in known:
            m = pair
        if m is full or m is pair or word in known:
            yield "person", m
        at = m.end()


def replace(documents: DataFrame, secret: bytes, attempts: int = 16) -> DataFrame:
    """`documents` with surrogates in text, plus n_entities (mentions) and kinds (kind, mentions) sorted by kind.

    A mention of an e-mail, IBAN, IP, card, social security or phone number, or of a person, is replaced by a
    keyed surrogate of the same type and format: e-mails keep their shape and top domain, cards their first
    digit and check, IBANs their country, addresses their range, phones their prefix, persons their title,
    gender and script. Persons are found behind a title, after a given name of the pools, and wherever a
    word stands alone that some title of the table names and that the table has capitalized at least as
    often as not. Mentions of one entity get one surrogate in every document, and distinct entities distinct
    ones, since each surrogate is a permutation within its format; every word of a name has its own. A check
    over all entities of the table draws again for surrogates that are themselves an entity of the table
    or equal another one (given names of the pools apart, which stay in them). What still clashes after
    `attempts` draws leaves its format: each further draw is LONGER characters longer, so that formats most
    of whose values occur get distinct surrogates too.
    A null text stays null; an empty one has no mentions; rows are neither lost nor merged; columns of the
    new names are replaced; other columns stay; texts are read whole.
    """
    kept = documents.drop("n_entities", "kinds")
    texts = kept.select(F.col("text").cast("string").alias("text")).withColumn("texthash", F.xxhash64("text"))
    found = materialize(texts.mapInArrow(_entities, "texthash bigint, kind string, entity string"), "mentions")
    titled = materialize(found.where("kind = 'known'").select(F.col("entity").alias("word")).distinct(), "titled")
    held = found.where("kind <> 'known'")
    redrawn = _redrawn(held.select("kind", "entity").distinct(), secret, attempts)
    words = materialize(_known(texts, titled), "known")

    # What a text has to know: its names without a title, and its entities that were drawn again. Few texts do;
    # the others are replaced where they lie, and a bitmap of fixed size tells them apart.
    held = held.unionByName(words.select("texthash", F.lit("name").alias("kind"), F.col("word").alias("entity"))).distinct()
    told = held.join(redrawn, ["kind", "entity"]).select("texthash", F.struct("kind", "entity", "attempt").alias("again"), F.lit(None).cast("string").alias("word"))
    told = told.unionByName(words.select("texthash", F.lit(None).cast(told.schema["again"].dataType).alias("again"), "word"))
    told = materialize(told.groupBy("texthash").agg(F.collect_set("again").alias("__again"), F.collect_set("word").alias("__known")), "told")
    marks = spread(told, "texthash")

    keyed = kept.withColumn("__texthash", F.xxhash64(F.col("text").cast("string")))
    schema = kept.select("*", F.lit(0).cast("bigint").alias("n_entities"), F.expr("cast(map() as map<string,bigint>) as kinds")).schema

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _replaced((b.filter(pc.invert(marked(b["__texthash"], marks))) for b in batches), secret, attempts)

    plain = keyed.mapInArrow(alone, schema)
    asked = holds(keyed, "__texthash", marks).join(told, F.col("__texthash") == F.col("texthash"), "left").drop("texthash")
    return plain.unionByName(asked.mapInArrow(lambda batches: _replaced(batches, secret, attempts), schema))


def _entities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(texthash, kind, entity) of what gets a surrogate, and of kind "known" the words that count without a title too."""
    for batch in batches:
        found = set()
        for h, t in zip(batch["texthash"].to_pylist(), batch["text"], strict=True):
            for k, m in mentions(t.as_py()):
                entity = canonical(k, m[0])
                found.update((h, *part) for part in parts(k, entity))
                if k == "person":
                    titled = m[0].split()[0].rstrip(".") in _GENDERS
                    found.update((h, "known", x) for x in entity.partition(":")[2].split() if titled or x in POOLS)
        columns = list(zip(*sorted(found), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["texthash", "kind", "entity"])


def _known(texts: DataFrame, titled: DataFrame) -> DataFrame:
    """(texthash, word): the words of a text that titles name, of those the table has capitalized at least as often as not."""
    may: Broadcast = spread(titled.select(F.xxhash64("word").alias("hash")), "hash")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, met = may.value, {}
        for batch in batches if bits.any() else ():  # no title, no name to look for
            rows = []
            for texthash, text in zip(batch["texthash"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seen: dict[str, list[int]] = {}
                for word in _ANY_WORD.findall(text or ""):
                    if word not in met:
                        if len(met) >= 1 << 18:
                            met.clear()
                        at = xxhash.xxh64_intdigest(word.casefold().encode(), seed=42) & (BITS - 1)
                        met[word] = (word.casefold(), int(word[0].islower())) if bits[at >> 3] >> np.uint8(at & 7) & 1 else None
                    if met[word]:
                        seen.setdefault(met[word][0], [0, 0])[met[word][1]] += 1
                rows += [(texthash, word, upper, lower) for word, (upper, lower) in seen.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["texthash", "word", "upper", "lower"])

    seen = materialize(texts.mapInArrow(count, "texthash bigint, word string, upper bigint, lower bigint"), "words")
    counted = seen.groupBy("word").agg(F.sum("upper").alias("up"), F.sum("lower").alias("low")).where("up >= low")
    names = materialize(counted.join(titled, "word", "left_semi").select("word"), "names")
    return seen.where("upper > 0").join(names, "word").select("texthash", "word").distinct()


def _longer(attempt: int, attempts: int) -> int:
    return LONGER * max(0, attempt - attempts + 1)


def _redrawn(entities: DataFrame, secret: bytes, attempts: int) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate clashes, with the attempt that does not."""

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("kind", "entity", "attempt")), strict=True)
            made = [surrogate(k, e, secret, a, _longer(a, attempts)) for k, e, a in rows]
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["entity"], batch["attempt"], pa.array(made, pa.string())], ["kind", "entity", "attempt", "made"])

    entities = materialize(entities, "entities")
    drawn = entities.select("kind", "entity", F.lit(0).alias("attempt"))
    while True:
        drawn = materialize(drawn.mapInArrow(draw, "kind string, entity string, attempt int, made string"), "drawn")
        taken = drawn.join(entities.select("kind", F.col("entity").alias("made")), ["kind", "made"], "left_semi").select("kind", "entity")
        # Of equal surrogates the earliest attempt, then the smallest entity, keeps it.
        first = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = drawn.join(first, ["kind", "made"]).where("entity <> first.entity").select("kind", "entity")
        clash = materialize(taken.unionByName(later).distinct().withColumn("again", F.lit(1)), "clash")
        if clash.limit(1).count() == 0:
            return drawn.where("attempt > 0").select("kind", "entity", "attempt")
        drawn = drawn.join(clash, ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("again", F.lit(0))).cast("int").alias("attempt"))


def _replaced(batches: Iterable[pa.RecordBatch], secret: bytes, attempts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, kinds = [], [], []
        told = [batch[c].to_pylist() if c in batch.schema.names else [None] * len(batch) for c in ("text", "__again", "__known")]
        for text, again, known in zip(*told, strict=True):
            drawn = {(x["kind"], x["entity"]): x["attempt"] for x in again or ()}
            parts, at, met = [], 0, {}

            def made_of(kind: str, entity: str, drawn: dict = drawn) -> str:
                attempt = drawn.get((kind, entity), 0)
                return surrogate(kind, entity, secret, attempt, _longer(attempt, attempts))

            for kind, m in mentions(text, frozenset(known or ())):
                entity = canonical(kind, m[0])
                made = person(entity, secret, lambda word: made_of("name", word)) if kind == "person" else made_of(kind, entity)
                parts += [text[at : m.start()], in_format(kind, m[0], made)]
                at, met[kind] = m.end(), met.get(kind, 0) + 1
            texts.append("".join([*parts, text[at:]]) if parts else text)
            counts.append(sum(met.values()))
            kinds.append(sorted(met.items()))
        columns = {name: batch[name] for name in batch.schema.names if name not in ("__texthash", "__again", "__known")}
        columns["text"] = pa.array(texts, batch.schema.field("text").type)
        columns["n_entities"], columns["kinds"] = pa.array(counts, pa.int64()), pa.array(kinds, pa.map_(pa.string(), pa.int64()))
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
