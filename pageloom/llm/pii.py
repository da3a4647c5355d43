"""Personal data replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import stored

#: Collided originals of up to this number are broadcast to the tasks that replace; beyond it they are joined.
BROADCAST_ROWS = 100_000
#: Tweaks that keep an entity's length.
PLAIN_TWEAKS = 8

#: Given names by gender and script. A name is replaced by another one of its own list.
NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carla Carmen Clara Diana Elena Emma Eva Greta Hanna Helen Ines Irene Jane Julia Karin Laura Lena Linda Lucia Maria Marta Mary Monika Nina Olga Paula Petra Rosa Sandra Sarah Sofia Susan Teresa Ursula Vera".split(),
    ("m", "latin"): "Adam Albert Alan Bruno Carlos Daniel David Diego Erik Felix Frank Fritz Georg Hans Henri Hugo Ivan James Jan Jean John Jorge Juan Karl Klaus Leo Louis Luis Marco Mark Martin Michael Miguel Nico Otto Paul Pedro Peter Pierre Ralf Robert Simon Stefan Thomas Victor".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Екатерина Елена Ирина Лариса Людмила Марина Мария Надежда Наталья Нина Ольга Светлана Софья Татьяна Юлия".split(),
    ("m", "cyrillic"): "Алексей Андрей Антон Борис Василий Виктор Владимир Григорий Дмитрий Иван Игорь Кирилл Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
}
_LIST_OF = {n: key for key, names in NAMES.items() for n in names}

#: Words before a family name, and words inside a name.
_TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Herrn Señor Señora Sr Sra Monsieur Madame Mme господин госпожа".split()
_INSIDE = "van von der den de del della da di dos du la le bin al".split()

_TYPES = [
    ("email", r"(?<![A-Za-z0-9_+-])[A-Za-z0-9_+-]{1,64}(?:\.[A-Za-z0-9_+-]{1,64}){0,8}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[opsur]_[0-9A-Za-z]{36}|(?:sk|pk|rk)[-_](?:[a-z]{2,8}[-_])?[0-9A-Za-z]{20,64}|xox[abeprs]-[0-9A-Za-z-]{10,72})(?![0-9A-Za-z])"),
    ("ipv6", r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("phone", r"(?<![\w+])(?:(?:\+|00)[1-9]\d{0,2}(?:[ -]?\(0?\d{1,4}\))?[ ./-]?\d{1,12}(?:[ ./-]\d{1,12}){0,5}|\(0?\d{2,5}\)[ -]?\d{3,4}(?:[ .-]?\d{2,5}){1,2}|\d{3}([-. ])\d{3}\1\d{4}|0[1-9]\d{1,3}(?:[ /]|-| / )\d{3,4}(?:[ -]?\d{2,5}){1,2})(?![\w-]|\.\d)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])|(?<!\d)\d{13,19}(?!\d)"),
]
_ANY = re.compile("|".join(f"(?P<{n}>{p})" for n, p in ((n, p.replace("([-. ])", "(?P<gap>[-. ])").replace(r"\1", "(?P=gap)")) for n, p in _TYPES)))
#: Digits of a phone number.
_DIGITS = (7, 15)
#: First digits of cards by their number of digits.
_CALLED_CARD = re.compile(r"(?i)(?:card|karte|carte|tarjeta|visa|mastercard)(?: (?:no|nr|number|nummer))?\W{0,3}$")
_ISSUERS = {13: "4", 14: "3", 15: "3", 16: "23456", 17: "456", 18: "456", 19: "456"}
#: Every entity but a name starts in a token with a digit or an @, or right before one; so many characters after that token are searched at once, other text is passed over. An entity with white space has LONGEST characters at most.
_ANCHOR, _REACH, _LONGEST = re.compile(r"[@\d]"), 160, 80
_SPACE = re.compile(r"\s")
_UPPER_, _LOWER_ = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_WORD = rf"(?:[{_UPPER_}]['’])?[{_UPPER_}](?:[{_LOWER_}]+(?:[{_UPPER_}][{_LOWER_}]+)?|[{_UPPER_}]+)"
_GIVEN = re.compile(rf"(?<!\w)([{_UPPER_}]\w+)(?= )")
_REST = re.compile(rf" (?:(?:[{_UPPER_}]\.|{'|'.join(_INSIDE)}) ){{0,3}}({_WORD}(?:-{_WORD})?)(?![\w])")
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(_TITLES)})\.? ({_WORD}(?:-{_WORD})?)(?!\w)")
#: Ends of hosts that are kept, as nobody owns them.
_RESERVED = re.compile(r"(?:(?:^|\.)example\.(?:com|net|org)|\.(?:test|example|invalid|localhost))$")
#: IPv4 ranges that stay what they are, as (first address, free bits).
_RANGES = [(10 << 24, 24), (127 << 24, 24), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (0, 24), (224 << 24, 29)]

_LOWER = ("bcdfghjklmnpqrstvwxz", "aeiouy", "бвгджзйклмнпрстфхцчшщ", "аеиоуыэюя", "0123456789")
_HEX = "0123456789abcdef"


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the entities of a whole text, left to right and apart; at one place the first type of the list wins, and full names go before family names after a title. Time is linear in the text."""
    if not text:
        return []
    found, done = [], 0
    while anchor := _ANCHOR.search(text, done):
        start = anchor.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, anchor.start())
        end = space.start() if space else len(text)
        limit = end + _REACH
        while hit := _ANY.search(text, start, limit):
            if hit.start() >= end and hit.end() >= limit:
                break  # it may go on beyond what is searched
            start = hit.end()
            if _holds(hit.lastgroup, hit[0], text[max(0, hit.start() - 24) : hit.start()]):
                found.append((hit.lastgroup, *hit.span()))
            elif hit.lastgroup == "phone":
                start = hit.start() + 1
        # All that begins a good way before the limit has been seen whole.
        whole = max((text.rfind(c, end, max(end, limit - _LONGEST)) for c in " \n\t"), default=-1)
        done = max(end, whole, start if hit is None else end)
    names = []
    for given in _GIVEN.finditer(text):
        if given[1].title() in _LIST_OF and (rest := _REST.match(text, given.end())):
            names.append(("name", given.start(), rest.end()))
    names.sort(key=lambda e: e[1])
    if any(t in text for t in _TITLES):
        names += [("surname", *m.span(1)) for m in _TITLED.finditer(text) if m[1].title() not in _LIST_OF]
    if not names:
        return found
    kept: list[tuple[str, int, int]] = []
    for entity in sorted(found + names, key=lambda e: (e[1], e[0] == "surname")):
        if not kept or entity[1] >= kept[-1][2]:
            kept.append(entity)
    return kept


def _holds(kind: str, value: str, before: str) -> bool:
    """Whether what looks like a phone number has as many digits as one, a card starts as one of its length does and has the right check digit, and an IBAN the right remainder. Times in milliseconds and order numbers are no cards; sixteen digits that the words before them call a card are one, mistyped or not."""
    if kind == "phone":
        return _DIGITS[0] <= sum(map(str.isdigit, value)) <= _DIGITS[1]
    if kind == "card":
        digits = "".join(filter(str.isdigit, value))
        return digits[0] in _ISSUERS.get(len(digits), "") and _check("card", digits) == int(digits[-1]) or len(digits) == 16 and _CALLED_CARD.search(before) is not None
    if kind == "iban":
        signs = "".join(filter(str.isalnum, value))
        return _check("iban", signs) == int(signs[2:4])
    return True


def canonical(kind: str, value: str) -> str:
    """What tells two entities of a type apart: case and separators don't, nor does a (0) inside a phone number or 00 for +."""
    if kind == "phone":
        value = re.sub(r"^00(?=[1-9])", "+", value.replace("(0)", ""))
    return re.sub(r"[ ()./-]", "", value) if kind in ("phone", "card", "iban") else value.lower()


@lru_cache(maxsize=64)
def _keys(key: str, kind: str, tweak: int) -> tuple[int, ...]:
    seed = hashlib.sha256(f"{key}/{kind}/{tweak}".encode()).digest()
    return tuple(int.from_bytes(hashlib.sha256(seed + bytes([r])).digest()[:8], "little") for r in range(6))


def permuted(value: int, n: int, key: str, kind: str, tweak: int = 0) -> int:
    """Keyed permutation of 0..n-1 for integers of any size: Feistel rounds, walked until the value is below n."""
    if n < 2:
        return 0
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, data = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for k in _keys(key, kind, tweak):
            f = int.from_bytes(hashlib.blake2b(right.to_bytes(data, "little"), key=k.to_bytes(8, "little"), digest_size=min(64, data)).digest(), "little")
            left, right = right, left ^ (f & mask)
        value = (left << half) | right
        if value < n:
            return value


def _classes(kind: str, low: str) -> list[str | None]:
    """The letters that each character may become; None where it stays."""
    if kind == "ipv6":
        return [_HEX if i >= low.index(":") and c in _HEX else None for i, c in enumerate(low)]  # the first group says what range it is
    if kind == "secret" and set(low) <= set(_HEX):
        return [_HEX] * len(low)
    found: list[str | None] = [next((c for c in _LOWER if x in c), None) for x in low]
    keep = 0
    if kind == "secret":
        keep = 4 if "_" not in low[:9] and "-" not in low[:9] else max(low.rfind("_", 0, 12), low.rfind("-", 0, 12)) + 1
    if kind == "email":
        at = low.index("@")
        reserved = _RESERVED.search(low[at + 1 :])
        tail = at + 1 + reserved.start() if reserved else low.rindex(".")
        found[tail:] = [None] * (len(low) - tail)
        found[at] = None
    if kind == "phone" and (m := re.match(r"(?:\+|00)[1-9]\d{0,2}(?=\D)|\+\d|00?\d?", low)):
        keep = m.end()
        found = [None if low[max(0, i - 1) : i + 2] == "(0)" else c for i, c in enumerate(found)]
    if kind == "iban":
        keep = 4
    if kind == "card":
        keep = 1
    found[:keep] = [None] * keep
    return found


def _check(kind: str, low: str) -> int:
    """Check digits that belong to the other characters: of a card by Luhn's rule, of an IBAN by remainder 97."""
    signs = [c for c in low if c.isalnum()]
    if kind == "card":
        doubled = [int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(signs[:-1]))]
        return -sum(x - 9 if x > 9 else x for x in doubled) % 10
    return 98 - int("".join(str(int(c, 36)) for c in [*signs[4:], *signs[:2], "0", "0"])) % 97


def surrogate(kind: str, value: str, key: str, tweak: int = 0) -> str:
    """The replacement of an entity: the same type, length, separators, script, case and, for names, gender; the same validity of check digits, the same range of addresses, the same reserved host. Under one key and tweak it is a permutation of all values of the same format, so distinct entities stay distinct and one entity is replaced alike everywhere. From tweak PLAIN_TWEAKS on, surrogates get longer by a character each time (IPv4 addresses leave their range)."""
    longer = max(0, tweak - PLAIN_TWEAKS + 1)
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        number = sum(p << (8 * (3 - i)) for i, p in enumerate(parts))
        base, bits = next((r for r in _RANGES if number >> r[1] == r[0] >> r[1]), (0, 32)) if not longer else (0, 32)
        out = base + permuted(number - base, 1 << bits, key, f"ip{base}/{bits}", tweak)
        while bits == 32 and any(out >> r[1] == r[0] >> r[1] for r in _RANGES):
            out = permuted(out, 1 << 32, key, "ip0/32", tweak)
        return ".".join(str(out >> (8 * (3 - i)) & 255) for i in range(4))
    if kind == "surname":
        return _walk("family", value + "n" * longer, key, tweak)
    if kind == "name":
        given, rest = value.split(" ", 1)
        inside, family = rest[: rest.rfind(" ") + 1], rest[rest.rfind(" ") + 1 :]
        listed = _LIST_OF[given.title()]
        names = NAMES[listed]
        new = names[permuted(names.index(given.title()), len(names), key, "given" + "".join(listed), tweak)]
        new = new.upper() if given.isupper() else new.lower() if given.islower() else new
        return f"{new} {inside}{_walk('family', family + ('N' if family.isupper() else 'n') * longer, key, tweak)}"
    if longer:
        at = value.index("@") if kind == "email" else len(value)
        value = value[:at] + "0" * longer + value[at:]
    return _walk(kind, value, key, tweak)


def _walk(kind: str, value: str, key: str, tweak: int) -> str:
    low = value.lower()
    if len(low) != len(value):
        low = value
    classes = _classes(kind, low)
    last = max((i for i, c in enumerate(low) if c.isdigit()), default=0)
    if kind == "card":
        classes[last] = None
    rank, total = 0, 1
    for c, x in zip(classes, low):
        if c:
            rank, total = rank * len(c) + c.index(x), total * len(c)
    # The format is part of the permutation's name, so that values of another format don't matter; separators don't change it.
    rank = permuted(rank, total, key, kind + ",".join(str(len(c)) for c in classes if c), tweak)
    out: list[str] = []
    for c, x in zip(reversed(classes), reversed(low)):
        if c:
            rank, i = divmod(rank, len(c))
            x = c[i]
        out.append(x)
    out.reverse()
    if kind == "card":
        out[last] = str((_check(kind, "".join(out)) + int(low[last]) - _check(kind, low)) % 10)
    if kind == "iban":
        out[2:4] = f"{(_check(kind, ''.join(out)) + int(low[2:4]) - _check(kind, low)) % 97 if int(low[2:4]) != _check(kind, low) else _check(kind, ''.join(out)):02d}"
    return "".join(a.upper() if b.isupper() else a for a, b in zip(out, value))


def replaced(text: str | None, key: str, tweaks: dict[tuple[str, str], int]) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, original, surrogate) of each entity in order. Where a text holds a full name, its given and family name on their own, type mention, become those of the first such name's surrogate; a family name that stands after a title somewhere becomes the same elsewhere in the text."""
    spans = find(text)
    if not spans:
        return text, []
    new = {k: surrogate(*k, key, tweaks.get((k[0], canonical(*k)), 0) if tweaks else 0) for k in dict.fromkeys((kind, text[a:b]) for kind, a, b in spans)}
    parts: dict[str, str] = {}
    titled = {value.lower(): other.lower() for (kind, value), other in new.items() if kind == "surname"}
    for (kind, value), other in new.items():
        if kind == "name":
            for i in (-1, 0):
                parts.setdefault(value.split(" ")[i].lower(), other.split(" ")[i].lower())
    if parts or titled:
        words = {f(w) for w in {**titled, **parts} for f in (str.title, str.upper)} | {v.split(" ")[i] for k, v in new if k in ("name", "surname") for i in (-1, 0)}
        alone, at, free = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(words)))})(?!\w)"), 0, []
        for kind, a, b in [*spans, ("", len(text), len(text))]:
            free += [("mention", *m.span()) for m in alone.finditer(text, at, a)]
            at = b
        spans = sorted([e for e in spans if e[0] != "surname" or text[e[1] : e[2]].lower() not in parts] + free + [("mention", a, b) for k, a, b in spans if k == "surname" and text[a:b].lower() in parts], key=lambda e: e[1])
    found, out, last = [], [], 0
    for kind, start, end in spans:
        value = text[start:end]
        other = _as_written(parts.get(value.lower()) or titled[value.lower()], value) if kind == "mention" else new[kind, value]
        out += [text[last:start], other]
        found.append((kind, value, other))
        last = end
    return "".join([*out, text[last:]]), found


def _as_written(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.title()


_FOUND = "array<struct<kind:string,original:string,surrogate:string>>"


def _rows(found: list) -> list:
    return [[{"kind": k, "original": o, "surrogate": s} for k, o, s in f] for f in found]


def entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(kind, canonical, surrogate, times), one row for each distinct entity of all texts."""

    @F.pandas_udf("array<struct<kind:string,canonical:string,surrogate:string>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "canonical": canonical(k, o), "surrogate": canonical(k, s)} for k, o, s in replaced(t, key, {})[1] if k != "mention"] for t in texts])

    return docs.select(F.explode(of(F.col(text_col))).alias("e")).groupBy("e.kind", "e.canonical").agg(F.min("e.surrogate").alias("surrogate"), F.count("*").alias("times"))


def _surrogates(key: str, tweak: int):
    @F.pandas_udf("string")
    def of(kinds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([canonical(k, surrogate(k, v, key, tweak)) for k, v in zip(kinds, values)], dtype=object)

    return of


def collisions(known: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, tweak) of entities whose first surrogate is that of another entity or is itself an entity of the corpus. Each gets the first tweak whose surrogate is neither, and which no other entity of the round took. Rounds go on until none is left; as surrogates get longer from PLAIN_TWEAKS on (addresses have more room than any corpus fills), they end."""
    known = stored(known.select("kind", "canonical", "surrogate"), "entities")
    taken = known.select("kind", F.col("canonical").alias("value")).unionByName(known.select("kind", F.col("surrogate").alias("value")))
    twice = known.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    real = known.select("kind", F.col("canonical").alias("surrogate")).distinct()
    late = known.join(twice, ["kind", "surrogate"]).where(F.col("canonical") != F.col("first")).select("kind", "canonical")
    bad = stored(known.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canonical").unionByName(late).distinct(), "collided")
    done, tweak = None, 0
    while not bad.isEmpty():
        tweak += 1
        tried = stored(bad.withColumn("value", _surrogates(key, tweak)("kind", "canonical")), "tried")
        free = tried.join(taken, ["kind", "value"], "left_anti").groupBy("kind", "value").agg(F.min("canonical").alias("canonical"))
        good = stored(free.select("kind", "canonical", "value", F.lit(tweak).alias("tweak")), "resolved")
        done = good if done is None else done.unionByName(good)
        taken = taken.unionByName(good.select("kind", "value"))
        bad = stored(bad.join(good, ["kind", "canonical"], "left_anti"), "collided")
    return (done if done is not None else bad.withColumn("tweak", F.lit(1))).select("kind", "canonical", "tweak")


def surrogate_column(key: str, tweaks: dict[tuple[str, str], int], text_col: str = "text") -> Column:
    """struct<text, found> of each whole text."""

    @F.pandas_udf(f"text string, found {_FOUND}")
    def of(texts: pd.Series) -> pd.DataFrame:
        both = [replaced(t, key, tweaks) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in both], "found": _rows([f for _, f in both])})

    return of(F.col(text_col))


def with_surrogates(docs: DataFrame, key: str = "surrogates-1", text_col: str = "text") -> DataFrame:
    """docs with every detected entity of text_col replaced, and a column entities: array<struct<kind, original, surrogate>> in order.

    A surrogate is a keyed permutation within the entity's own format, so one entity reads alike in all documents and two never read alike; a first job gathers the distinct entities and gives another tweak to the few whose surrogate is a real entity of the corpus (names have short lists, for instance). A given or family name on its own is replaced where its text holds the full name, a family name also where its text has it after a title. Numbers that only look like cards or IBANs stay.

    Null and empty texts stay, very long ones are read whole in linear time, repeated rows are treated alike, other columns are kept; a column called entities is replaced. An empty table gives an empty one.
    """
    odd = collisions(entities(docs, key, text_col), key)
    rows = odd.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        column = surrogate_column(key, {(r[0], r[1]): r[2] for r in rows}, text_col)
        return _spread(docs.select(F.struct(*docs.columns).alias("row"), column.alias("new")), docs.columns, text_col)
    return _with_joined(docs, odd, key, text_col)


def _with_joined(docs: DataFrame, odd: DataFrame, key: str, text_col: str) -> DataFrame:
    """The same where collided entities are too many to broadcast: those of each text are joined to it by a hash of the text."""

    @F.pandas_udf("array<struct<kind:string,canonical:string>>")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({(k, canonical(k, t[a:b])) for k, a, b in find(t)}) for t in texts]).map(lambda x: [{"kind": k, "canonical": c} for k, c in x])

    @F.pandas_udf(f"text string, found {_FOUND}")
    def of(texts: pd.Series, tweaks: pd.Series) -> pd.DataFrame:
        both = [replaced(t, key, {(x["kind"], x["canonical"]): x["tweak"] for x in (w if w is not None else [])}) for t, w in zip(texts, tweaks)]
        return pd.DataFrame({"text": [t for t, _ in both], "found": _rows([f for _, f in both])})

    key_of = F.sha2(F.col(text_col), 256)
    own = docs.select(key_of.alias("h"), known(F.col(text_col)).alias("es")).where(F.size("es") > 0).dropDuplicates(["h"])
    listed = own.select("h", F.explode("es").alias("e")).select("h", "e.kind", "e.canonical").join(odd, ["kind", "canonical"]).groupBy("h").agg(F.collect_list(F.struct("kind", "canonical", "tweak")).alias("w"))
    out = docs.select(F.struct(*docs.columns).alias("row"), key_of.alias("own")).join(stored(listed, "tweaks"), F.col("own") == F.col("h"), "left")
    return _spread(out.select("row", of(F.col(f"row.{text_col}"), F.col("w")).alias("new")), docs.columns, text_col)


def _spread(rows: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The columns of row with the new text, and entities."""
    return rows.select(*(F.col("new.text").alias(c) if c == text_col else F.col(f"row.{c}") for c in columns if c != "entities"), F.col("new.found").alias("entities"))
