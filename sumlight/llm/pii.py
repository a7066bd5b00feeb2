"""PII: detected entities get keyed surrogates that match their type, gender, script and format.

Emails, phone numbers, IPv4 and IPv6 addresses, payment card numbers, bank account numbers (IBAN), social security numbers
and names are found by regular expressions: names after a title, and listed given names with a capitalised word after
them. In a document where a name is found, its other mentions, whole or a word of it, are mentions of it too. An entity is
its canonical form (a phone number's digits, without the country code 1; an email in lower case; a name in title case), and
its surrogate follows from the key and that form alone, so all mentions found of an entity in any document get one
surrogate, each in the format in which it is written; a word of a name gets that word of its surrogate.

A surrogate is a keyed permutation of the strings of one shape: digits stay digits, vowels and consonants of a script
stay such, separators and top-level domains stay; a known given name becomes another one of its gender and script; another
given name after a title that tells the gender becomes a listed one of that gender, and belongs to the canonical form
with it, while the family name's surrogate is the same with any title; a card number that passes the Luhn check still
does, and an IBAN keeps valid check digits; an IPv4 address stays unicast, an IPv6 address keeps its first 16 bits.
Permutations keep entities of one shape distinct. The collision check covers the rest, over the whole corpus: a surrogate
that equals some real entity, or another's surrogate, is replaced by the one of the next attempt, until none is left. From
LONGER attempts on, names and emails get longer by a letter an attempt and names leave the list, so a shape whose strings
are all in use is no trap; after MOST_ATTEMPTS an error is raised.

The key: whoever has it can invert the permutations, so none is in this file. `configured` takes it from the session's
setting KEY_SETTING; without one it draws a random key, which holds for that one result and isn't written anywhere.
Surrogates agree between runs only if the setting does.

Nulls and odd rows: a null text stays null and has no entities; a null doc_id is kept; repeated rows stay and get equal
surrogates; an empty table gives an empty result. `replace` keeps all other columns; a column of the input may have
any name.

Scale: distinct entities are aggregated before the collision check; what needs another attempt (nothing, mostly) is
joined to documents by row, and broadcast if its measured size is at most MOST_BROADCAST. No entity is collected to the
driver.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, giving_back, prepare, read

KEY_SETTING = "spark.sumlight.pii.key"
LONGER, MOST_ATTEMPTS = 4, 200
MOST_BROADCAST = 16 << 20
KINDS = ("email", "iban", "card", "ssn", "ipv6", "phone", "ip", "name")

# Given names by gender and script, titles by gender.
NAMES = {
    ("f", "latin"): "Anna Maria Julia Laura Emma Sophie Claire Lucia Elena Marta Paula Sarah Emily Olivia Grace Alice Helen Diana Irene Carla Ines Rosa Nina Clara Amelie Camille Greta Ingrid Heidi Monika Kate Katherine Elizabeth Susan Linda Mary Karen Lisa Nancy Sandra Ashley Jessica Jennifer Patricia Barbara Margaret Charlotte Hannah Rachel Rebecca Victoria Martha Teresa Isabel Carmen Pilar Sofia Chiara Giulia Francesca Petra Sabine Ursula Birgit Élise Manon Chloé Agnès".split(),
    ("m", "latin"): "John James Robert Michael William David Thomas Peter Paul Mark Daniel Lucas Martin Felix Hans Karl Jürgen Pierre Jean Louis Antoine Carlos Juan Pedro Miguel Diego Pablo Henry George Oscar Joseph Charles Christopher Matthew Anthony Steven Andrew Joshua Kenneth Kevin Brian Edward Richard Ronald Timothy Jason Jeffrey Ryan Jacob Nicholas Eric Stephen Jonathan Frank Walter Patrick Simon Philip Luca Marco Giovanni Francesco Stefan Wolfgang Uwe Klaus Nicolas Julien Étienne Javier".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Дарья".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай Павел Олег".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης".split(),
}
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña".split(), "": "Dr Prof".split()}

_TITLES = {title: gender for gender, titles in TITLES.items() for title in titles}
_LISTED = {name: (kind, i) for kind, names in NAMES.items() for i, name in enumerate(names)}

#: Letters of a shape's classes, lower case; upper case goes along.
_CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "ýÿñçðþß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_CLASS = {c: (k, i) for k, letters in enumerate(_CLASSES) for i, c in enumerate(letters)}



def _one_of(words: Iterable[str]) -> str:
    """An expression for any of the words, the longest first, that looks at their first letters first."""
    by: dict[str, list[str]] = {}
    for word in sorted(words, key=len, reverse=True):
        by.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items())) + ")"


_PATTERNS = {
    "host": r"@[^\W_](?:[\w.-]*[^\W_])?\.(?:xn--[A-Za-z0-9-]+|[^\W\d_]{2,})",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])(?:1[ .-])?(?:\d{3}[.-]\d{3}[.-]|[2-9]\d{2} \d{3} )\d{4}(?![\w-])|(?<![\w.-])[2-9]\d{9}(?![\w-]|\.\d)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "name": r"(?<!\w)" + _one_of(_TITLES) + r"\.? (?:[^\W\d_a-z][^\W\d_]+)(?: [^\W\d_a-z][^\W\d_]+)?",
}
_DIGITS = re.compile("|".join(f"(?P<{k}>{_PATTERNS[k]})" for k in ("card", "ssn", "phone", "ip")))
#: Listed given names and a capitalised word; to begin with letters makes the search fast, so found() looks at what is before.
_GIVEN = _one_of(_LISTED)
_FULL, _CAPITAL = re.compile(rf"{_GIVEN}(?: {_GIVEN})* [^\W\d_a-z][^\W\d_]+"), re.compile(r"[^\W\d_a-z][^\W\d_]+(?!\w)")
#: What a text with entities has, for Spark's regular expressions; ranges of capitals are tested faster than each initial.
_MAYBE = f"(?=[A-ZÀ-ÞΆ-ΩЀ-Я]){_one_of([*_TITLES, *_LISTED])}|[0-9@]|::"
_IBAN, _IPV6 = re.compile(_PATTERNS["iban"]), re.compile(_PATTERNS["ipv6"])
_HOST, _NAME, _LOCAL = re.compile(_PATTERNS["host"]), re.compile(_PATTERNS["name"]), re.compile(r"[\w.%+-]*")


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """From each @ with a host, back over what may precede it; so a long run of letters without one costs nothing."""
    upto = 0
    for m in _HOST.finditer(text):
        at = m.start()
        local = _LOCAL.match(text[upto:at][::-1])[0][::-1].lstrip("_.%+-")
        if local:
            yield at - len(local), m.end(), "email"
        upto = m.end() if local else at + 1


def _ibans(text: str) -> Iterator[tuple[int, int, str]]:
    """What has valid check digits; a group that only happens to follow is left off."""
    for m in _IBAN.finditer(text):
        end = m.end()
        while _starts_word(text, m.start()) and end - m.start() >= 15:
            if _iban_rest(text[m.start() : end].replace(" ", "")) == 1:
                yield m.start(), end, "iban"
                break
            end = text.rfind(" ", m.start(), end)


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _ipv6s(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _IPV6.finditer(text):
        if _starts_word(text, m.start()) and text[m.start() - 1 : m.start()] != ":" and (m[0].count(":") == 7 or "::" in m[0]) and re.search(r"\d", m[0]) and len(m[0]) > 3:
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            yield m.start(), m.end(), "ipv6"


def _starts_word(text: str, at: int) -> bool:
    return not at or not (text[at - 1].isalnum() or text[at - 1] == "_")


def mentions(text: str) -> list[tuple[int, int, str, str, int | None]]:
    """Entities as (start, end, kind, canonical form, which word of a name or None for all), in order, not overlapping.

    Of two that overlap, the one of the earlier kind; of names, one after a title, then a listed one, then those that
    have been found elsewhere in the text.
    """
    spans = list(_emails(text))
    spans += [(m.start(), m.end(), m.lastgroup) for m in _DIGITS.finditer(text)]
    spans += _ibans(text)
    if text.count(":") > 1:
        spans += _ipv6s(text)
    spans.sort(key=lambda s: (KINDS.index(s[2]), s[0]))
    titled = {m.start() + m[0].index(" ") + 1: (m.end(), _TITLES[m[0][: m[0].index(" ")].rstrip(".")]) for m in _NAME.finditer(text)}
    spans += [(start, end, "name") for start, (end, _) in titled.items()]
    spans += [(m.start(), m.end(), "name") for m in _FULL.finditer(text) if _starts_word(text, m.start()) and m[0][m[0].rindex(" ") + 1].isupper()]
    starts, taken = [], []  # in order, side by side

    def take(start: int, end: int, *what: object) -> None:
        i = bisect_right(starts, start)
        if (not i or taken[i - 1][1] <= start) and (i == len(taken) or end <= starts[i]):
            starts.insert(i, start)
            taken.insert(i, (start, end, *what))

    for start, end, kind in spans:
        take(start, end, kind, canonical(kind, text[start:end], titled.get(start, (0, ""))[1] if kind == "name" else ""), None)
    # A name without a title is the first one so called, with the gender of that one's title.
    names: dict[str, str] = {}
    for s in taken:
        if s[2] == "name" and (bare := s[3].partition("/")[0]) not in names:
            names[bare] = s[3]
    if names:
        parts: dict[str, tuple[str, int]] = {}
        for bare, canon in names.items():
            for k, word in enumerate(bare.split(" ")):
                parts.setdefault(word, (canon, k))
        words = [m.span() for m in _CAPITAL.finditer(text) if _starts_word(text, m.start()) and text[m.start()].isupper() and m[0].title() in parts]
        longest = max(name.count(" ") + 1 for name in names)
        for i, (start, end) in enumerate(words):
            for _, last in reversed(words[i : i + longest]):
                if (name := text[start:last].title()) in names:
                    take(start, last, "name", names[name], None)
                    break
        for start, end in words:
            take(start, end, "name", *parts[text[start:end].title()])
    return taken


def found(text: str) -> list[tuple[int, int, str]]:
    """Entities as (start, end, kind)."""
    return [s[:3] for s in mentions(text)]


def canonical(kind: str, mention: str, gender: str = "") -> str:
    """gender: what a title says; it is kept, after a slash, with a given name that isn't listed."""
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", mention)
        if kind == "phone" and len(digits) == 11 and digits[0] == "1":
            return digits[1:]
        return ("+" if mention.startswith("+") else "") + digits
    if kind == "ip":
        return ".".join(str(int(x)) for x in mention.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(mention).exploded
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "email":
        return mention.lower()
    name = mention.title()
    return f"{name}/{gender}" if gender and " " in name and name.split(" ")[0] not in _LISTED else name


def _round(key: bytes, tweak: bytes, n: int, value: int, bits: int) -> int:
    size = (bits + 7) // 8
    seed = hashlib.blake2b(tweak + bytes([n]) + value.to_bytes(size, "little"), key=key[:64], digest_size=min(64, max(8, size))).digest()
    while len(seed) < size:
        seed += hashlib.blake2b(seed, key=key[:64]).digest()
    return int.from_bytes(seed[:size], "little") & ((1 << bits) - 1)


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): Feistel rounds on a power of four, walked until inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for n in range(8):
            left, right = right, left ^ _round(key, tweak, n, right, half)
        value = (left << half) | right
        if value < size:
            return value


def _shape(text: str) -> tuple[str, int, int]:
    """What a string's surrogate keeps, its number among the strings of that shape, and how many there are."""
    shape, value, size = [], 0, 1
    for c in text:
        if (known := _CLASS.get(c.lower())) is None or len(c.lower()) > 1:
            shape.append(c)
        else:
            k, i = known
            shape.append(chr(0xE000 + 2 * k + (c != c.lower())))
            value, size = value * len(_CLASSES[k]) + i, size * len(_CLASSES[k])
    return "".join(shape), value, size


def reshaped(text: str, key: bytes, tweak: bytes) -> str:
    shape, value, size = _shape(text)
    value = permute(value, size, key, tweak + shape.encode())
    out = []
    for c in reversed(shape):
        if 0xE000 <= ord(c) < 0xE000 + 2 * len(_CLASSES):
            letters = _CLASSES[(ord(c) - 0xE000) // 2]
            value, i = divmod(value, len(letters))
            c = letters[i].upper() if (ord(c) - 0xE000) % 2 else letters[i]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit that goes after digits."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """The surrogate of an entity, in canonical form."""
    tweak = f"{kind}:{attempt}:".encode()
    more = "a" * max(0, attempt - LONGER + 1)
    if kind == "card":
        body = reshaped(canon[:-1], key, tweak)
        return body + str((int(canon[-1]) - _luhn(canon[:-1]) + _luhn(body)) % 10)
    if kind == "phone" and canon.startswith("+"):
        code = max(1, len(canon) - 11)  # what is before the last ten digits stays, as does a short number's first
        return canon[: code + 1] + reshaped(canon[code + 1 :], key, tweak + canon[: code + 1].encode())
    if kind == "iban":
        body = reshaped(canon[4:].lower(), key, tweak + canon[:2].encode()).upper()
        return f"{canon[:2]}{98 - _iban_rest(canon[:2] + '00' + body):02d}{body}"
    if kind == "ipv6":
        value = int(ipaddress.IPv6Address(canon))
        return ipaddress.IPv6Address((value >> 112 << 112) + permute(value & ((1 << 112) - 1), 1 << 112, key, tweak + canon[:4].encode())).exploded
    if kind == "ip":
        a, *rest = map(int, canon.split("."))
        unicast = range(1, 224)
        if a in unicast:
            n = permute(((a - 1) * 256 + rest[0]) * 65536 + rest[1] * 256 + rest[2], 223 << 24, key, tweak)
            a = (n >> 24) + 1
        else:
            n = permute(rest[0] * 65536 + rest[1] * 256 + rest[2], 1 << 24, key, tweak + bytes([a]))
        return f"{a}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}"
    if kind == "email":
        name, _, host = canon.partition("@")
        labels = host.split(".")
        return reshaped(name + more, key, tweak + host.encode()) + "@" + ".".join([*[reshaped(x, key, tweak) for x in labels[:-1]], labels[-1]])
    if kind == "name":
        name, _, gender = canon.partition("/")
        first, *rest = name.split(" ")
        return " ".join([_given(first, gender, key, tweak) if gender and not more else _name(first + more, key, tweak), *(_name(word + more, key, tweak) for word in rest)])
    return reshaped(canon, key, tweak)


def _name(word: str, key: bytes, tweak: bytes) -> str:
    if word in _LISTED:
        which, i = _LISTED[word]
        names = NAMES[which]
        return names[permute(i, len(names), key, tweak + repr(which).encode())]
    return reshaped(word, key, tweak)


def _given(word: str, gender: str, key: bytes, tweak: bytes) -> str:
    """A listed name of the gender and of the word's script."""
    script = "cyrillic" if "\u0400" <= word[0] <= "\u04ff" else "greek" if "\u0370" <= word[0] <= "\u03ff" else "latin"
    names = NAMES[gender, script]
    return names[_round(key, tweak + gender.encode(), 0, int.from_bytes(word.encode(), "little"), 8 * len(word.encode())) % len(names)]


def formatted(kind: str, mention: str, new: str) -> str:
    """A surrogate in the format of a mention."""
    if kind in ("card", "ssn", "phone"):
        own = re.sub(r"\D", "", mention)
        digits = iter(own[: len(own) - len(new.removeprefix("+"))] + new.removeprefix("+"))  # a country code that isn't in the canonical form
        return re.sub(r"\d", lambda m: next(digits), mention)
    if kind == "iban":
        letters = iter(new)
        return re.sub(r"\S", lambda m: next(letters), mention)
    if kind == "ipv6":
        short = new if len(mention) == len(new) else ipaddress.IPv6Address(new).compressed
        return short.upper() if mention == mention.upper() else short
    if kind == "email" and mention != mention.lower():
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new, strict=True)) if len(mention) == len(new) else new
    if kind == "name" and mention.isupper():
        return new.upper()
    return new


def replaced(text: str, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities' spans in the text as it was."""
    spans, out, at = mentions(text), [], 0
    for start, end, kind, canon, part in spans:
        new = surrogate(kind, canon, attempts.get((kind, canon), 0), key)
        out += [text[at:start], formatted(kind, text[start:end], new if part is None else new.split(" ")[part])]
        at = end
    return "".join([*out, text[at:]]), [s[:3] for s in spans]


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rk, text in zip(batch.column("rk").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            rows += sorted({(rk, kind, canon) for _, _, kind, canon, _ in mentions(text)})
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["rk", "kind", "canon"])


def _try(key: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(*x, key) for x in zip(*(batch.column(c).to_pylist() for c in ("kind", "canon", "attempt")), strict=True)]
            yield batch.append_column("new", pa.array(new, pa.string()))

    return run


def attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, attempt of the entities whose first surrogate is another's, or some real entity."""
    schema = "kind string, canon string, attempt int, new string"
    now = entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).mapInArrow(giving_back(_try(key)), schema).checkpoint()
    real = now.select("kind", F.substring_index("canon", "/", 1).alias("new")).distinct()
    for _ in range(MOST_ATTEMPTS):
        place = F.row_number().over(W.partitionBy("kind", "new").orderBy("attempt", "canon"))
        twice = now.withColumn("place", place).where("place > 1").drop("place")
        # A permutation may leave an entity as it is; that is no surrogate, either.
        bad = twice.union(now.join(real, ["kind", "new"], "left_semi").select(twice.columns)).distinct().checkpoint()
        if bad.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt")
        again = bad.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")).mapInArrow(giving_back(_try(key)), schema)
        now = now.join(bad.select("kind", "canon"), ["kind", "canon"], "left_anti").select(twice.columns).union(again).checkpoint()
    raise RuntimeError(f"surrogates still collide after {MOST_ATTEMPTS} attempts")


def configured(spark: SparkSession) -> bytes:
    """The key of the session's setting, or a random one if there is none."""
    named = spark.conf.get(KEY_SETTING, None)
    return hashlib.sha256(named.encode()).digest() if named else secrets.token_bytes(32)


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """All columns of docs, the text with surrogates, and pii_spans, 'kind:start:end' of each entity before.

    If docs has a pii_spans, the new column is pii_spans_.
    """
    if not key:
        raise ValueError("surrogates need a key")
    prepare(docs.sparkSession)
    rk, again, into = free(docs, "pii_rk"), free(docs, "pii_more"), free(docs, "pii_spans")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "text")
    entities = texts.where(F.col("text").rlike(_MAYBE)).mapInArrow(giving_back(_entities), "rk long, kind string, canon string").checkpoint()
    more = attempts(entities, key).checkpoint()
    names = docs.columns
    keyed = docs.select("*", F.xxhash64("doc_id", "text").alias(rk))
    if more.isEmpty():
        keyed = keyed.withColumn(again, F.lit(None).cast("array<struct<kind:string,canon:string,attempt:int>>"))
    else:
        own = entities.join(more, ["kind", "canon"]).groupBy(F.col("rk").alias(rk)).agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias(again)).checkpoint()
        size = own.agg(F.sum(F.octet_length(F.to_json(again)) + 32)).first()[0] or 0
        keyed = keyed.join(F.broadcast(own) if size <= MOST_BROADCAST else own, rk, "left")
    schema = keyed.select(*names).schema.add(into, "string")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                new, own = (None, []) if text is None else replaced(text, {(m["kind"], m["canon"]): m["attempt"] for m in more or ()}, key)
                texts.append(new)
                spans.append(",".join(f"{kind}:{a}:{b}" for a, b, kind in own))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.string())], [*names, into])

    return keyed.select(*names, again).mapInArrow(giving_back(run), schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = replace(read(spark, sf_dir, "documents").select("doc_id", "text"), configured(spark))
    counts = [F.regexp_count("pii_spans", F.lit(rf"\b{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return new.select("doc_id", "text", *counts, F.col("pii_spans").alias("spans"))
