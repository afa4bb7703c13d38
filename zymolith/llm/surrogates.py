"""Personal data replaced by keyed, type-consistent surrogates.

Detected entities (emails, IP addresses, IBANs, social security numbers,
phone numbers, card numbers, person names) are replaced in whole texts.  A
surrogate keeps the format: digits stay digits, letters stay letters of the same
script and case, separators stay; card numbers keep whether they pass the Luhn
test, IBANs whether their check digits are right; listed given names are exchanged
within their gender and script.  In other names vowels stay vowels and consonants
consonants, and the ending that shows a gender stays.

Persons are found by listed given names, by what stands before them (titles,
introductions, salutations, closings of letters), by what joins them to a person that
was found (``Anna Stone met Bob Reed and Wei Chen``), and by the corpus: two or three
capitalised words in a row, each of which at most one document in twenty that has it so
has in small letters.  Chinese names are found by a family name before a title, after an
introduction or alone between other scripts.  A name is two kinds of entity,
given names and family names, each with its own surrogates; where a document
names a person, the given or family name alone is the same entity there and
everywhere: ``Ms Stone`` follows ``Anna Stone``.

Replacement is a keyed permutation of each format's values (a Feistel network
over the digits or letters of a run, walked in cycles where a property must be
kept), so one entity has one surrogate in every document and two entities never
share one.  What a permutation cannot rule out is that a surrogate is another
entity of the corpus.  That is checked over all entities: such a surrogate is
drawn again under another tweak until it is neither an entity nor taken.  Where
a format has too few values for that, as listed given names have once half of their
group's names are entities, all of its entities share one permutation that leaves
none as it is: surrogates are distinct, but may be other entities of that format.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sides import small_side
from .packs import cells_of, map_packs, packed, unpacked
from .shared import written
from .text import string_bytes

# Given names by (gender, script).
NAMES = {
    ("female", "latin"): "Alice Anna Carmen Charlotte Claire Elena Emma Hannah Ingrid Isabel Julia Laura Lucia Maria Marie Olivia Sarah Sofia Sophie Susan".split(),
    ("male", "latin"): "Andreas Carlos David Diego Francisco Hans Henri James Jean John Jorge Klaus Lukas Michael Pablo Paul Peter Robert Thomas William".split(),
    ("female", "cyrillic"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("male", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "".join(map(chr, range(0x4E00, 0x9FA6))))
VOWELS = set("aeiouyаеиоуыэюяαεηιουωàáâãäåæèéêëìíîïòóôõöøùúûüý")
KINDS = ("email", "ip", "iban", "ssn", "phone", "card", "name")

_MARKS = string.punctuation + "“”‘’«»„…—–"
_GROUP = {name: key for key, names in NAMES.items() for name in names}
_ALPHABET = {c: k for k, letters in enumerate(ALPHABETS) for c in letters}
_AT = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_RULES = {
    # from the start of a run of its letters, so that a long run is read once
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+" + _AT,
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?!\.?\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\w./+-])0\d{2,4}[ /-]\d{5,8}(?![\d./-]?\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
_PLAIN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _RULES.items()))
#: An email that begins where another match ends.
_HERE = re.compile(r"(?P<email>[A-Za-z0-9._%+-]{1,64}" + _AT + ")")
_FULL = re.compile(_PLAIN.pattern + "|(?P<name>\\b(?:" + "|".join(sorted(_GROUP, key=len, reverse=True)) + r")\b(?: [A-ZÀ-ÞА-Я][a-zß-ÿа-я]+)?)")


# What stands before a person's name.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Monsieur Madame Mme".split()
INTRODUCTIONS = ("my name is", "mein Name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "меня зовут", "yours sincerely,", "kind regards,", "best regards,")
JOINS = "and und y et и met with".split()
SALUTATIONS = "Dear Hi Hello Hey Liebe Lieber Hallo Chère Cher Querida Querido Hola Estimada Estimado Дорогая Дорогой Уважаемая Уважаемый Привет".split()
# Words that name no person beside another capitalised word, or after a salutation.
NO_PERSON = set(
    "All Customer Customers Colleague Colleagues Everyone Friend Friends Madam Santa Sir Sirs Team World "
    "New San Los Las Saint Mount Lake Lago Fort Port North South East West Northern Southern Eastern Western Great "
    "Street Road Avenue Boulevard Square City County State States Kingdom Republic Island Islands River Valley Beach Park Airport Station "
    "Inc Corp Ltd Company Group Bank University College School Institute Museum Hotel Hospital Church Committee Council Foundation License Public "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December".split()
)
PLACES = set("San Santa Saint Mount Lake Port Fort".split())
# Frequent Chinese family names that begin few other words, and what stands before and after a name.
FAMILIES = "王李张刘陈杨黄赵吴周徐孙朱胡郭林罗郑梁谢宋唐许韩冯邓曹彭曾肖董袁潘蒋蔡杜苏魏吕丁沈姚卢姜崔钟谭陆汪廖贾邹孟熊秦邱薛阎侯邵戴"
HAN_INTRODUCTIONS, HAN_TITLES = "我叫 名叫 我是".split(), "先生 女士 小姐 教授 博士 医生 老师 经理".split()
# Endings of Russian family names, and words before a bare telephone number.
RUSSIAN_FAMILY = re.compile(r"(?:[оеё]ва?|[иы]на?|ск(?:ий|ая)|енко|ук|юк)$")
CALLS = "phone telephone telefon tel mobile mob cell fax call whatsapp".split()

_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_CAP = rf"[{_UPPER}][{_LOWER}]+(?:[-'’][{_UPPER}][{_LOWER}]+)*"
_TITLE = rf"(?:{'|'.join(TITLES)})\b"
_INTRO = "(?i:" + "|".join(re.escape(x).replace("\\ ", r"\s") for x in INTRODUCTIONS) + ")"
_CONTEXT = re.compile(rf"(?<!\w)(?:{_TITLE}\.?[ \u00a0]){{1,3}}(?!{_TITLE})(?P<titled>{_CAP}(?:[ \u00a0]{_CAP})?)(?!\w)|(?<!\w){_INTRO}\s{{1,4}}(?P<intro>{_CAP}(?:[ \u00a0]{_CAP})?)(?!\w)")
_HELLO = re.compile(rf"(?<!\w)(?:{'|'.join(SALUTATIONS)}),? (?!{_TITLE})(?P<hello>{_CAP}(?: {_CAP})?)(?=[ \u00a0]?(?:[,!.:;\n]|$))")
_RUN = re.compile(rf"(?<!\w){_CAP}(?: {_CAP})+(?!\w)")
_BEFORE = re.compile(rf"(?<!\w)({_CAP}) $")
_CALLED = re.compile(rf"(?i:\b(?:{'|'.join(CALLS)})\b)(?i:[ .:#]| me| at| us| on| no| is){{1,5}}(?P<phone>\d{{10,11}})(?![\w]|\.\d)")
_H = "\u4e00-\u9fa5"
_HAN = re.compile(rf"(?:{'|'.join(HAN_INTRODUCTIONS)})(?P<a>[{FAMILIES}][{_H}]{{1,2}})(?![{_H}])|(?<![{_H}])(?P<b>[{FAMILIES}][{_H}]{{1,2}})(?![{_H}])|(?P<c>[{FAMILIES}][{_H}]{{0,2}}?)(?={'|'.join(HAN_TITLES)})")
_ANY_HAN = re.compile(f"[{FAMILIES}]")
_IS_HAN = re.compile(rf"[{_H}]+$")
_JOINED = re.compile(rf",? (?:{'|'.join(JOINS)}) (?P<name>{_CAP} {_CAP})(?!\w)")
_WORD = re.compile(rf"(?<!\w){_CAP}(?!\w)")


@lru_cache(1 << 16)
def _permuted(key: bytes, tweak: str, letters: str, run: str) -> str:
    """A keyed permutation of the strings over ``letters`` of the length of ``run``."""
    n, base = len(run), len(letters)
    value = lambda s: int(hashlib.blake2b(s.encode(), key=key, digest_size=24).hexdigest(), 16)
    if n == 1 and base > 64:  # as two digits, walked until they are a letter again
        side = math.isqrt(base - 1) + 1
        digits, at = "".join(map(chr, range(side))), letters.index(run)
        while True:
            high, low = _permuted(key, tweak, digits, digits[at // side] + digits[at % side])
            if (at := ord(high) * side + ord(low)) < base:
                return letters[at]
    if n == 1:
        order = sorted(letters, key=lambda c: value(f"{tweak}|1|{c}"))
        return order[letters.index(run)]
    number = 0
    digits = [letters.index(c) for c in run]
    half = n // 2
    left = right = 0
    for d in digits[:half]:
        left = left * base + d
    for d in digits[half:]:
        right = right * base + d
    for r in range(4):
        left = (left + value(f"{tweak}|{n}|{r}a|{right}")) % base**half
        right = (right + value(f"{tweak}|{n}|{r}b|{left}")) % base ** (n - half)
    number = left * base ** (n - half) + right
    out = []
    for _ in range(n):
        number, d = divmod(number, base)
        out.append(letters[d])
    return "".join(reversed(out))


def _letters(key: bytes, tweak: str, text: str) -> str:
    """Permutes each run of one alphabet; case and all other characters stay."""
    out, at = [], 0
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    while at < len(text):
        kind, to = _ALPHABET.get(low[at]), at + 1
        while to < len(text) and _ALPHABET.get(low[to]) == kind:
            to += 1
        run = text[at:to]
        if kind is not None:
            new = _permuted(key, tweak, ALPHABETS[kind], "".join(low[at:to]))
            run = "".join(b.upper() if a != b_low else b for a, b, b_low in zip(run, new, low[at:to], strict=True))
        out.append(run)
        at = to
    return "".join(out)


def _sort_of_letter(c: str) -> tuple[int, bool] | None:
    kind = _ALPHABET.get(c)
    return None if kind is None else (kind, c in VOWELS)


_SORTS = {sort: "".join(c for c in ALPHABETS[sort[0]] if (c in VOWELS) == sort[1]) for k, letters in enumerate(ALPHABETS) for sort in {(k, c in VOWELS) for c in letters}}


def _kept_ending(kind: str, text: str) -> int:
    """Letters at the end of a name that may show a gender."""
    if _IS_HAN.match(text):
        return 0
    return 1 if kind == "given" else 2 if _ALPHABET.get(text[-1:].lower()) == 2 and len(text) > 4 else 0


def _sounds(key: bytes, tweak: str, kind: str, text: str) -> str:
    """Permutes the vowels and the consonants of a name, each kind as one run; its ending, case and other characters stay."""
    stem = text[: len(text) - _kept_ending(kind, text)]
    low = [c.lower() if len(c.lower()) == 1 else c for c in stem]
    new = list(low)
    for sort in sorted({x for x in map(_sort_of_letter, low) if x}):
        at = [k for k, c in enumerate(low) if _sort_of_letter(c) == sort]
        run = _permuted(key, f"{tweak}|{sort[0]}{sort[1]:d}", _SORTS[sort], "".join(low[k] for k in at))
        for k, c in zip(at, run, strict=True):
            new[k] = c
    return "".join(b.upper() if a != c else b for a, b, c in zip(stem, new, low, strict=True)) + text[len(stem) :]


def _iban_check(country: str, rest: str) -> str:
    """The check digits that make an account number right."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in (rest + country).upper()) + '00') % 97:02d}"


def _iban(key: bytes, tweak: str, text: str) -> str:
    """Check digits stay right or wrong; spaces stay where they are."""
    flat = text.replace(" ", "")
    country, check, rest = flat[:2], flat[2:4], flat[4:]
    new = _letters(key, tweak, rest)
    right, new_right = _iban_check(country, rest), _iban_check(country, new)
    if check != right:
        wrong = _permuted(key, f"{tweak}|check|{new.lower()}", ALPHABETS[0], check)
        new_right = wrong if wrong != new_right else _permuted(key, f"{tweak}|check|{new.lower()}", ALPHABETS[0], right)
    it = iter(country + new_right + new)
    return "".join(c if c == " " else next(it) for c in text)


def _groups(text: str) -> list[str]:
    """The eight groups of an IPv6 address, four digits each."""
    left, _, right = text.lower().partition("::")
    left, right = ([x for x in part.split(":") if x] for part in (left, right))
    return [x.zfill(4) for x in [*left, *["0"] * (8 - len(left) - len(right)), *right]]


def _is_personal_ip6(text: str) -> bool:
    """An address of eight groups, of which two or more are not zero; ``a::b`` and other scopes of programs are none."""
    parts = [x for x in text.split(":") if x]
    full = len(parts) == 8 if "::" not in text else len(parts) < 8
    return full and sum(int(x, 16) > 0 for x in parts) > 1 and any(c.isdecimal() for c in text) and (len(parts) > 2 or len(parts[0]) == 4)


def _ip6(key: bytes, tweak: str, text: str) -> str:
    """The first group says what sort of address it is and stays, as do zeros; the others are one run of digits."""
    groups = _groups(text)
    at = [k for k in range(1, 8) if groups[k] != "0000"]
    run = "".join(groups[k] for k in at)
    while True:
        run = _permuted(key, f"{tweak}|{groups[0]}|{at}", "0123456789abcdef", run)
        if all(run[k : k + 4] != "0000" for k in range(0, len(run), 4)):
            break
    for n, k in enumerate(at):
        groups[k] = run[4 * n : 4 * n + 4]
    left, gap, right = text.partition("::")
    n_left, n_right = (sum(map(bool, x.split(":"))) for x in (left, right))
    short = [f"{int(x, 16):x}" for x in groups]
    return ":".join(short[:n_left]) + gap + ":".join(short[8 - n_right :] if n_right else [])


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _format(kind: str, text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() and c.isascii() else c for c in text)


def normal(kind: str, text: str) -> str:
    """What two mentions of one entity have in common."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if text.startswith("+") else "") + re.sub(r"\D", "", text)
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "ip6":
        return ":".join(_groups(text))
    return text.replace(" ", "").lower() if kind == "iban" else text.lower() if kind == "email" else text


def surrogate(kind: str, text: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a mention; its normal form depends only on the mention's normal form."""
    tweak = f"{kind}{attempt}"
    if kind in ("phone", "card", "ssn"):
        digits = re.sub(r"\D", "", text)
        if kind == "card":
            new = _permuted(key, tweak, ALPHABETS[0], digits)
            while _luhn(new) != _luhn(digits):
                new = _permuted(key, tweak, ALPHABETS[0], new)
        else:
            fixed = 1 if text.startswith("+") else 0
            new = digits[:fixed] + _permuted(key, tweak + "+" * fixed + digits[:fixed], ALPHABETS[0], digits[fixed:])
        return _format(kind, text, new)
    if kind == "ip":
        value = "".join(f"{int(x):08b}" for x in text.split("."))
        new = _permuted(key, tweak, "01", value)
        return ".".join(str(int(new[k : k + 8], 2)) for k in (0, 8, 16, 24))
    if kind == "email":
        name, _, domain = text.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_letters(key, tweak + 'local', name)}@{_letters(key, tweak + 'domain', host)}.{top}"
    if kind == "iban":
        return _iban(key, tweak, text)
    if kind == "ip6":
        return _ip6(key, tweak, text)
    if kind == "name":
        return "".join(surrogate(k, t, key, attempt) if k else t for k, t in name_parts(kind, text))
    if kind == "given" and text in _GROUP:
        names = NAMES[_GROUP[text]]
        order = sorted(names, key=lambda n: hashlib.blake2b(f"{tweak}|{n}".encode(), key=key, digest_size=16).digest())
        return order[(order.index(text) + 1) % len(order)]
    return _sounds(key, tweak, kind, text)


def name_parts(kind: str, text: str) -> list[tuple[str, str]]:
    """(kind, text) of the parts of a mention: ``given`` and ``family`` names, and what is between them with an empty kind."""
    if kind not in ("name", "family"):
        return [(kind, text)]
    if _IS_HAN.match(text):
        return [("family", text[:1]), ("given", text[1:])][: len(text)]
    parts = re.split(r"([ \u00a0])", text)
    given = 0 if kind == "name" else -1
    if given == 0 and len(parts) == 3 and parts[2] in _GROUP and parts[0] not in _GROUP:
        given = 2  # the family name stands first
    return [("" if k % 2 else "given" if k == given else "family", part) for k, part in enumerate(parts)]


#: Whether a text may hold a name: RE2's word ends are those of ASCII, so wherever the rule's stand, these do; other scripts go without.
_MAY_NAME = "|".join(rf"\b{n}\b" if n.isascii() else n for n in sorted(_GROUP, key=len, reverse=True))


_MAY_CONTEXT = rf"(?:{'|'.join(TITLES)})\.?[ \x{{a0}}]\pL|{_INTRO}|(?:{'|'.join(SALUTATIONS)}),? \pL|(?i:{'|'.join(CALLS)})\b[^\d\n]{{1,30}}\d{{10}}"
_MAY_RUN = r"\p{Lu}\pL+(?:[-'’]\pL+)* \p{Lu}\p{Ll}"


def _matches(rule: re.Pattern, text: str) -> Iterator[tuple[str, int, int, str]]:
    at = 0
    while m := (_HERE.match(text, at) if at else None) or rule.search(text, at):
        if m.lastgroup != "ip6" or _is_personal_ip6(m[0]):
            yield m.lastgroup, m.start(), m.end(), m[0]
        at = m.end()


def _in_runs(text: str, names: set[str]) -> Iterator[tuple[int, int]]:
    """Two or three words of ``names`` in a row that stand in no longer row of them."""
    for m in _RUN.finditer(text):
        words = m[0].split(" ")
        if NO_PERSON.isdisjoint(words):
            at, begin, many = m.start(), m.start(), 0
            for word in [*words, ""]:
                if word in names:
                    many += 1
                else:
                    if 1 < many < 4:
                        yield begin, at - 1
                    begin, many = at + len(word) + 1, 0
                at += len(word) + 1


def _persons(text: str, found: list[tuple[str, int, int, str]], context: bool, names: set[str]) -> list[tuple[str, int, int, str]]:
    """``found`` with the persons that the context and the corpus show, and with later mentions of parts of a name."""
    # a listed name in the name of a place: San Francisco
    found = [x for x in found if x[0] != "name" or not ((m := _BEFORE.search(text, max(0, x[1] - 40), x[1])) and m[1] in PLACES)]
    for k, (kind, a, b, mention) in enumerate(found):  # a family name before a listed given name
        if kind == "name" and mention in _GROUP and (m := _BEFORE.search(text, max(0, a - 40), a)):
            if m[1] not in _GROUP and m[1] not in NO_PERSON and (RUSSIAN_FAMILY.search(m[1]) or m[1] in names) and (not k or found[k - 1][2] <= m.start()):
                found[k] = (kind, m.start(), b, text[m.start() : b])
    taken = sorted((a, b) for _, a, b, _ in found)
    starts = [a for a, _ in taken]

    def add(kind: str, a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)
        if k and taken[k - 1][1] > a:
            return False
        taken.insert(k, (a, b))
        starts.insert(k, a)
        found.append((kind, a, b, text[a:b]))
        return True

    if context:
        for m in _CONTEXT.finditer(text):
            kind = m.lastgroup
            add("family" if kind == "titled" and len(re.split(r"[ \u00a0]", m[kind])) == 1 else "name", *m.span(kind))
        for m in _HELLO.finditer(text):
            if NO_PERSON.isdisjoint(m["hello"].split(" ")):
                add("name", *m.span("hello"))
        for m in _CALLED.finditer(text):
            add("phone", *m.span("phone"))
    for span in _in_runs(text, names) if names else ():
        add("name", *span)
    if _ANY_HAN.search(text):
        full = set()
        for m in _HAN.finditer(text):
            if add("family" if len(m[m.lastgroup]) == 1 else "name", *m.span(m.lastgroup)) and len(m[m.lastgroup]) > 2:
                full.add(m[m.lastgroup])
        for m in re.finditer("|".join(sorted(full, key=len, reverse=True)), text) if full else ():
            add("name", *m.span())
    for kind, _, end, mention in list(found):
        while kind == "name" and len(mention.split()) > 1 and (m := _JOINED.match(text, end)) and add("name", *m.span("name")):
            end, mention = m.end(), m["name"]
    known = {}
    for kind, _, _, mention in found:
        parts = [x for x in name_parts(kind, mention) if x[0] in ("given", "family")] if kind in ("name", "family") and not _IS_HAN.match(mention) else []
        if len(parts) > 1 or kind == "family":
            known |= {t: k for k, t in parts if k == "given" and t not in known or k == "family"}
    if known:
        for m in _WORD.finditer(text):
            if m[0] in known:
                add("name" if known[m[0]] == "given" else "family", *m.span())
    return sorted(found, key=lambda x: x[1])


def mentions(texts: pa.Array, names: Iterable[str] = ()) -> Iterator[tuple[int, list[tuple[str, int, int, str]]]]:
    """(row, [(kind, start, end, text)]) of the texts that mention an entity; a ``family`` is a family name alone.

    ``names``: capitalised words that the corpus takes for names.
    """
    data, doc = string_bytes(texts)
    names = set(names)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58), dtype=np.int64)])
    at = np.concatenate([[0], np.cumsum(data == 0x40, dtype=np.int64)])
    has = lambda rule: pc.fill_null(pc.match_substring_regex(texts, rule), False).to_numpy(zero_copy_only=False)
    plain = (digits[doc[1:]] - digits[doc[:-1]] >= 4) | (at[doc[1:]] > at[doc[:-1]]) | has("[0-9A-Fa-f]::[0-9A-Fa-f]")
    named, context = has(_MAY_NAME), has(_MAY_CONTEXT)
    more = has(f"[{FAMILIES}]")
    if names:
        more = more | has(_MAY_RUN)
    for d in np.flatnonzero(plain | named | context | more).tolist():
        text = texts[d].as_py()
        found = list(_matches(_FULL if named[d] else _PLAIN, text)) if plain[d] or named[d] else []
        if named[d] or context[d] or more[d]:
            found = _persons(text, found, context[d], names)
        if found:
            yield d, found


def large_words(texts: pa.Array) -> dict[str, int]:
    """In how many texts a capitalised word stands beside another one that differs."""
    runs = pc.fill_null(pc.match_substring_regex(texts, _MAY_RUN), False).to_numpy(zero_copy_only=False)
    large = Counter()
    for d in np.flatnonzero(runs).tolist():
        rows = (set(m[0].split(" ")) for m in _RUN.finditer(texts[d].as_py()))
        large.update(set().union(*(r for r in rows if len(r) > 1 and NO_PERSON.isdisjoint(r))).difference(TITLES, SALUTATIONS))
    return large


def small_words(texts: pa.Array) -> dict[str, int]:
    """In how many texts a word of small letters occurs."""
    small = Counter()
    for text in texts.to_pylist():
        small.update({w for t in set(text.split()) if (w := t.strip(_MARKS)).islower() and w.isalpha()})
    return small


#: Bits of the table of capitalised words; small words whose bit is not set are no name's and stay where they are.
WORD_BITS = 1 << 24


def _bit(word: str) -> int:
    return xxhash.xxh64_intdigest(word) % WORD_BITS


#: A word is a name if the documents that have it in small letters are at most this share of those that have it in a row of capitalised words.
SMALL_SHARE = 0.05


def names_of_packs(packs: DataFrame) -> DataFrame:
    """(pack, names): for each pack the words of its rows of capitalised words that the whole corpus takes for names.

    Words meet in cells of packs before they meet each other, so a name that every
    pack has is a row a cell.  A table of bits of fixed size keeps most small words that
    no capitalised one equals from moving; which words are names does not depend on it.
    """

    cell = F.pmod(F.xxhash64("pack"), F.lit(cells_of(packs))).cast("int").alias("cell")

    def find_large(pack: int, rows: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
        large = large_words(rows.column(1))
        words = [w.lower() for w in large]
        yield pa.RecordBatch.from_arrays(
            [pa.array([pack] * len(large), pa.int64()), pa.array(list(large), pa.string()), pa.array(words, pa.string()), pa.array([_bit(w) for w in words], pa.int64()), pa.array(list(large.values()), pa.int64())],
            ["pack", "name", "word", "bit", "large"],
        )

    rows = map_packs(packs, find_large, "pack long, name string, word string, bit long, large long")
    rows = written(rows.select("*", cell), "large-words")
    # as many rows as the table has longs, whatever the corpus
    slots = rows.groupBy(F.expr("bit div 64").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(WORD_BITS // 64, np.int64)
    table[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    sent = packs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def find_small(pack: int, rows: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
        words = small_words(rows.column(1))
        bits = np.array([_bit(w) for w in words], np.uint64)
        mine = (sent.value[bits // np.uint64(64)] >> (bits % np.uint64(64))) & np.uint64(1) > 0
        arrays = [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([pack] * len(words), pa.int64()), *arrays], ["pack", "word", "small"]).filter(pa.array(mine, pa.bool_()))

    small = map_packs(packs, find_small, "pack long, word string, small long").select("word", cell, "small", F.lit(0).alias("large"))
    both = small.unionByName(rows.select("word", "cell", F.lit(0).alias("small"), "large"))
    cells = written(both.groupBy("word", "cell").agg(F.sum("small").alias("small"), F.sum("large").alias("large")), "word-cases")
    total = cells.groupBy("word").agg(F.sum("small").alias("s"), F.sum("large").alias("l")).where((F.col("l") > 0) & (F.col("s") <= F.col("l") * SMALL_SHARE))
    named = cells.where("large > 0").join(total, "word").select("word", "cell")
    mine = rows.join(named, ["word", "cell"])
    return written(mine.groupBy("pack").agg(F.collect_list("name").alias("names")), "names")


def shape(kind: str, norm: str) -> str:
    """The format of an entity: all permutations map the entities of one format onto that format."""
    if kind == "ip":
        return ""
    if kind == "ip6":
        return norm[:4] + "".join(" 0"[x == "0000"] for x in norm.split(":"))
    if kind == "iban":
        return norm[:2] + str(_iban_check(norm[:2], norm[4:]) == norm[2:4]) + "".join(f"<{_ALPHABET.get(c)}>" for c in norm[4:])
    if kind == "given" and norm in _GROUP:
        return " ".join(_GROUP[norm])
    kept = _kept_ending(kind, norm) if kind in ("given", "family") else 0
    sort = _sort_of_letter if kind in ("given", "family") else _ALPHABET.get
    return "".join(c if k is None else f"<{k}{'^' * (c != low)}>" for c in norm[: len(norm) - kept] for low in [c.lower()] for k in [sort(low)]) + norm[len(norm) - kept :]


def _crowded_names(entities: DataFrame) -> list[str]:
    """The listed given names whose group has no name left for each of them: a list no longer than NAMES."""
    listed = [r["norm"] for r in entities.where((F.col("kind") == "given") & F.col("norm").isin(*_GROUP)).select("norm").distinct().collect()]
    groups = [_GROUP[n] for n in listed]
    return [n for n, g in zip(listed, groups, strict=True) if 2 * groups.count(g) > len(NAMES[g])]


def _shaped(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [shape(k, n) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.string())], [*batch.schema.names, "shape"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "shape string"]))


def _common_attempts(rows: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, attempt): for all entities of a format the first permutation, of 64, that gives none of them itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, shapes, norms = (batch.column(c).to_pylist() for c in ("kind", "shape", "norm"))
            own = [[t for t in range(64) if normal(k, surrogate(k, n, key, t)) == n] for k, n in zip(kinds, norms, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(shapes), pa.array(own, pa.list_(pa.int32()))], ["kind", "shape", "own"])

    own = rows.mapInArrow(run, "kind string, shape string, own array<int>").select("kind", "shape", F.explode_outer("own").alias("own"))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(63)), F.collect_set("own")))
    chosen = own.groupBy("kind", "shape").agg(F.coalesce(free, F.lit(0)).alias("attempt"))
    return rows.join(chosen, ["kind", "shape"]).where("attempt > 0").select("kind", "norm", "attempt")


def entity_attempts(entities: DataFrame, key: bytes, most: int = 30) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate would be an entity or another's surrogate.

    ``entities``: distinct (kind, norm, surrogate).  Formats without enough free
    values, and those in which ``most`` attempts leave an entity without one, have one
    attempt in common, the first unless it gives an entity itself.
    """
    spark = entities.sparkSession

    def again(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, norms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                new = [normal(k, surrogate(k, n, key, attempt)) for k, n in zip(kinds, norms, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(new, pa.string())], ["kind", "norm", "surrogate"])

        return run

    real = entities.select("kind", F.col("norm").alias("surrogate"))
    crowded = _crowded_names(entities)
    settled, pending, out = None, entities.where(~((F.col("kind") == "given") & F.col("norm").isin(crowded))) if crowded else entities, None
    attempt = 0
    while True:
        taken = real if settled is None else real.unionByName(settled)
        if attempt:  # few are left: what they meet moves to them, not all entities
            taken = taken.join(small_side(pending.select("kind", "surrogate").distinct()), ["kind", "surrogate"], "left_semi")
        first = Window.partitionBy("kind", "surrogate").orderBy("norm")
        judged = pending.join(taken.withColumn("hit", F.lit(True)).distinct(), ["kind", "surrogate"], "left").withColumn("nth", F.row_number().over(first))
        judged = written(judged.withColumn("ok", F.col("hit").isNull() & (F.col("nth") == 1)), f"surrogates-{attempt}")
        good = judged.where("ok").select("kind", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        if attempt:
            won = judged.where("ok").select("kind", "norm", F.lit(attempt).alias("attempt"))
            out = won if out is None else out.unionByName(won)
        pending = judged.where("not ok").select("kind", "norm")
        if pending.isEmpty():
            break
        attempt += 1
        if attempt > most:
            stuck = _shaped(pending).select("kind", "shape").distinct()
            common = _common_attempts(_shaped(entities.select("kind", "norm")).join(stuck, ["kind", "shape"]), key)
            out = common if out is None else _shaped(out).join(stuck, ["kind", "shape"], "left_anti").select("kind", "norm", "attempt").unionByName(common)
            break
        pending = written(pending.mapInArrow(again(attempt), "kind string, norm string, surrogate string"), f"pending-{attempt}")
    return spark.createDataFrame([], "kind string, norm string, attempt int") if out is None else out


def replace_personal_data(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_iban, n_ssn, n_phone, n_card, n_name, text), one row per row of ``docs``.

    ``text`` is the whole text with every mention replaced; ``n_*`` count mentions,
    ``n_ip`` addresses of both versions.  Which capitalised words are names follows from
    all texts of ``docs``.
    ``key`` is the secret that makes surrogates irreversible: who has it can undo them.
    Null text stays null-free: it becomes empty.  Null or repeated ids are carried
    as they are; equal texts get equal results.  Other columns are ignored; an
    empty table gives an empty result.
    """
    packs = packed(docs, "personal", id_col, text_col, in_buckets=True)
    names = names_of_packs(packs).hint("shuffle_hash")
    named = packs.join(names, "pack", "left").select("pack", "blob", "names")

    def collect(pack: int, rows: pa.RecordBatch, found) -> Iterator[pa.RecordBatch]:
        seen = {}
        for _, items in mentions(rows.column(1), found.to_pylist() if found is not None else ()):
            for kind, _, _, mention in items:
                for k, text in name_parts(kind, mention):
                    if k:
                        seen.setdefault((k, normal(k, text)), text)
        if seen:
            kinds, norms = zip(*seen, strict=True)
            new = [normal(k, surrogate(k, t, key)) for (k, _), t in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([pack] * len(seen)), pa.array(kinds), pa.array(norms), pa.array(new)], ["pack", "kind", "norm", "surrogate"])

    where = written(map_packs(named, collect, "pack long, kind string, norm string, surrogate string"), "mentions")
    entities = written(where.groupBy("kind", "norm").agg(F.min("surrogate").alias("surrogate")), "entities")
    odd = written(entity_attempts(entities, key), "attempts")
    if odd.isEmpty():
        odd_of = named
    else:
        item = F.struct("kind", "norm", "attempt")
        odd_of = named.join(where.join(odd, ["kind", "norm"]).groupBy("pack").agg(F.collect_list(item).alias("odd")).hint("shuffle_hash"), "pack", "left").select("pack", "blob", "names", "odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = unpacked(batch.column(1)[k].as_py())
                odd = (batch.column(3)[k].as_py() or ()) if batch.num_columns > 3 else ()
                yield _replaced(rows, batch.column(2)[k].as_py() or (), {(x["kind"], x["norm"]): x["attempt"] for x in odd}, key)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return odd_of.mapInArrow(run, f"doc_id long, {counts}, text string")


def _replaced(rows: pa.RecordBatch, names: Iterable[str], attempts: dict, key: bytes) -> pa.RecordBatch:
    texts = rows.column(1).to_pylist()
    counts = np.zeros((len(KINDS), len(texts)), np.int64)
    for d, items in mentions(rows.column(1), names):
        out, at, text = [], 0, texts[d]
        for kind, start, end, mention in items:
            counts[KINDS.index({"family": "name", "ip6": "ip"}.get(kind, kind)), d] += 1
            out.append(text[at:start])
            out += [surrogate(k, t, key, attempts.get((k, normal(k, t)), 0)) if k else t for k, t in name_parts(kind, mention)]
            at = end
        texts[d] = "".join([*out, text[at:]])
    return pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, counts), pa.array(texts, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "text"])
