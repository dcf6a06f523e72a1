"""Personal data replaced by keyed surrogates.

Detected entities (e-mail addresses, phone, card, account and social security numbers, IP addresses,
names of persons) are replaced by others of the same type and format. A surrogate is a keyed
permutation of all strings of the entity's format: a Feistel network over its characters, in which
digits stay digits, vowels vowels, consonants consonants and separators as they are. It works on the
entity's canonical form, so that an address in other case or a number with other separators gets the
same surrogate, to which case and separators are put back. Names are replaced part by part: given
names by others of their gender and script, surnames by letters, so that a part that stands alone
in a text with the whole name gets the same surrogate. Card and account numbers that pass their
check digits keep passing them; addresses of private networks stay private.

What a permutation alone can't rule out is checked over the whole corpus: a surrogate must not be a
real entity of the corpus, nor another's surrogate. Entities that fail are drawn anew in a further
round and checked again. If a format has no string left, it is widened by letters or digits, and at
last given up for a placeholder that names the kind, so there is a surrogate for every text.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "phone", "card", "iban", "ip", "ip6", "ssn", "name", "mention")
#: Surrogates that a task remembers.
KNOWN = 50_000
#: The first round whose formats are widened, and the one of placeholders, which is the last.
WIDER, PLACEHOLDER = 6, 14
#: Entities with a further round that are sent to all tasks; more are looked up by the text that holds them.
SENT_ROUNDS = 100_000
#: Rounds of the Feistel network, and draws of one round until a surrogate differs from its entity.
_FEISTEL, _DRAWS = 8, 16

# Given names by script and gender.
GIVEN_NAMES = {
    ("latin", "female"): "Aisha Alice Ana Anna Barbara Camille Carla Carmen Catherine Charlotte Claire Clara Elena Elizabeth Emily Emma Eva Fatima Giulia Hannah Heidi Ines Ingrid Isabel Jane Jennifer Jessica Julia Karen Laura Linda Lucia Maria María Marie Martha Mary Mei Nina Olivia Patricia Priya Sabine Sarah Sofia Susan Ursula Yuki".split(),
    ("latin", "male"): "Adam Ahmed Alexander Andreas Antonio Brian Carlos Charles Christian Daniel David Diego Edward Felix Fernando Frank François George Hans Henry Hugo Jack James Jean John Jorge José Joseph Juan Jules Jürgen Kenji Kevin Klaus Luca Luis Marc Mario Martin Michael Miguel Mohammed Oliver Omar Oscar Pablo Paul Pedro Peter Pierre Rajesh Robert Stefan Thomas Wei William Wolfgang".split(),
    ("cyrillic", "female"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "male"): "Александр Алексей Андрей Борис Владимир Дмитрий Иван Игорь Михаил Николай Павел Сергей".split(),
    ("greek", "female"): "Αικατερίνη Άννα Βασιλική Ειρήνη Ελένη Μαρία Σοφία".split(),
    ("greek", "male"): "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
# Titles before a name, words between given name and surname, two-digit country codes.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
PARTICLES = ("de la", "de los", "van den", "van der", "von der", "al", "bin", "da", "de", "del", "di", "dos", "du", "el", "van", "von", "zu")
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_OF_GIVEN = {n.lower(): group for group, names in GIVEN_NAMES.items() for n in names}

#: Sets of letters within which a letter may change; others stay as they are.
_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöøùúûüýÿ", "çñšžčćřťďňłßś", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ"]
_PLACE_OF = {c: (cls, i) for cls in _CLASSES for i, c in enumerate(cls)}
_HEX = {c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")}

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[._%+-]*[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBERS = re.compile(
    rf"(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,3}(?!\w|\.\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))",
    re.ASCII,
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)
_IBAN_HINT = re.compile(r"[A-Z]{2}\d{2}", re.ASCII)
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\w)", re.ASCII)
_DIGIT = re.compile("[0-9]")


def _any_of(words: set[str]) -> str:
    """A pattern of any of the words, the longest that fits, letter by letter."""
    begun: dict[str, set[str]] = {}
    for w in words - {""}:
        begun.setdefault(w[0], set()).add(w[1:])
    tried = [f"{re.escape(c)}{_any_of(rest)}" for c, rest in sorted(begun.items())]
    return f"(?:{'|'.join(tried)}){'?' * ('' in words)}" if tried else ""


_LETTER = r"[^\W\d_]"
_SURNAME = rf"{_LETTER}(?:['’]{_LETTER})?{_LETTER}+(?:-{_LETTER}+)*"
_WRITTEN = {w for names in GIVEN_NAMES.values() for n in names for w in (n, n.upper())}
_NAME = re.compile(
    rf"(?<!\w)(?=[{''.join(sorted({n[0] for n in (*_WRITTEN, *TITLES)}))}])(?:"
    rf"(?P<given>{_any_of(_WRITTEN)})(?P<initials>(?: {_LETTER}\.)*)(?: (?i:{'|'.join(PARTICLES)}))? (?P<surname>{_SURNAME})(?!\w)"
    rf"|(?:{_any_of(set(TITLES))})\.? (?P<first>{_SURNAME})(?: (?P<second>{_SURNAME}))?(?!\w))"
)
_WORD = re.compile(rf"{_LETTER}+(?:['’-]{_LETTER}+)*")


def _fold(text: str) -> str:
    """Lower case, character by character, so that lengths stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _name_parts(text: str, at: int = 0) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """(start, end, parts) of the names in a text; parts: (start, end, given, initial or surname)."""
    pos = at
    while (m := _NAME.search(text, pos)) is not None:
        pos = m.end()
        if m["given"] is not None:
            if not m["surname"][0].isupper():
                pos = m.end("given")
                continue
            initials = [(m.start("initials") + i.start(), m.start("initials") + i.start() + 1, "initial") for i in re.finditer(_LETTER, m["initials"])]
            yield m.start(), m.end(), [(*m.span("given"), "given"), *initials, (*m.span("surname"), "surname")]
        else:
            parts = [(*m.span(g), "given" if g == "first" and m["second"] and _fold(m[g]) in _OF_GIVEN else "surname") for g in ("first", "second") if m[g] and m[g][0].isupper()]
            if not m["first"][0].isupper():
                pos = m.start("first")
                continue
            yield parts[0][0], parts[-1][1], parts
            pos = parts[-1][1]


def iban_remainder(value: str) -> int:
    """An account number's remainder of 97, 1 for valid ones."""
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _is_ip6(value: str) -> bool:
    if sum(bool(g) for g in value.split(":")) < 3:
        return False
    try:
        return not ipaddress.IPv6Address(value).is_loopback
    except ValueError:
        return False


def _found(text: str) -> list[tuple[int, int, str, list]]:
    """(start, end, kind, parts of a name) in order, disjoint."""
    found: list[tuple[int, int, str, list]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", []) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), m.lastgroup, []) for m in _NUMBERS.finditer(text)]
        if _IBAN_HINT.search(text):
            found += [(m.start(), m.end(), "iban", []) for m in _IBAN.finditer(text) if iban_remainder(m[0].replace(" ", "")) == 1]
    if ":" in text:
        found += [(m.start(), m.end(), "ip6", []) for m in _IP6.finditer(text) if _is_ip6(m[0])]
    found += [(start, end, "name", parts) for start, end, parts in _name_parts(text)]
    out: list[tuple[int, int, str, list]] = []
    for start, end, kind, parts in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end, kind, parts))
    return out


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, disjoint; of overlapping ones the first, then the longest."""
    return [x[:3] for x in _found(text)]


def pieces_of(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, sort) of what is replaced, in order and disjoint. The sort is that of the
    surrogate: given, initial or surname in names, else the kind. Parts of a name after its first
    have an empty kind. A given name or a surname that stands alone, capitalised, in a text with the
    whole name is a mention."""
    found = _found(text)
    out = [(s, e, k, k) for s, e, k, parts in found if k != "name"]
    parts_of: dict[str, str] = {}
    for *_, kind, parts in found:
        out += [(s, e, "" if i else "name", sort) for i, (s, e, sort) in enumerate(parts)]
        for s, e, sort in parts:
            if sort != "initial":
                parts_of.setdefault(_fold(text[s:e]), sort)
    at = 0
    for m in _WORD.finditer(text) if parts_of else ():
        word = m[0]
        if not word[0].isupper():
            continue
        while word and _fold(word) not in parts_of:  # "Smith" in "Smith's" or "Smith-like"
            word = word[: max(map(word.rfind, "'’-")) if any(c in word for c in "'’-") else 0]
        end = m.start() + len(word)
        while at < len(found) and found[at][1] <= m.start():
            at += 1
        if word and (at == len(found) or found[at][0] >= end):
            out.append((m.start(), end, "mention", parts_of[_fold(word)]))
    return sorted(out)


def canonical(sort: str, value: str) -> str:
    """The form that all ways to write an entity share."""
    if sort == "phone":
        digits = "".join(c for c in value if c.isdigit())
        return f"+{digits}" if value.startswith("+") else f"+1{digits}"
    if sort in ("card", "ssn"):
        return "".join(c for c in value if c.isdigit())
    if sort == "iban":
        return value.replace(" ", "")
    if sort == "ip6":
        return ipaddress.IPv6Address(value).exploded
    return value if sort == "ip" else _fold(value)


class Surrogates:
    """Keyed surrogates of entities in canonical form."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()

    def _bytes(self, n: int, *parts: object) -> bytes:
        """n bytes that the key and the parts decide."""
        hashed = hashlib.shake_256(self.key)
        for p in parts:
            p = p if isinstance(p, bytes) else str(p).encode("utf-8", "surrogatepass")
            hashed.update(len(p).to_bytes(8, "big") + p)
        return hashed.digest(n)

    def permute(self, x: int, n: int, tweak: str) -> int:
        """x under a keyed permutation of 0 to n - 1: a Feistel network over the next even number of
        bits, walked until it falls below n."""
        if n < 2:
            return x
        half = max(1, math.ceil((n - 1).bit_length() / 2))
        mask, size = (1 << half) - 1, (half + 7) // 8
        while True:
            left, right = x >> half, x & mask
            for i in range(_FEISTEL):
                left, right = right, left ^ (int.from_bytes(self._bytes(size, tweak, n, i, right.to_bytes(size, "big")), "big") & mask)
            x = left << half | right
            if x < n:
                return x

    def letters(self, text: str, tweak: str, places: dict[str, tuple[str, int]] = _PLACE_OF) -> str:
        """text with each letter or digit in its class, as one permutation of all such texts: each
        half in turn is moved by what the other half decides, in time linear in the length."""
        at = [places.get(c) for c in text]
        free = [p for p in at if p is not None]
        shape = "".join(c if p is None else p[0][0] for c, p in zip(text, at))
        middle = len(free) // 2
        sizes = [len(p[0]) for p in free]
        halves, of_half = [[p[1] for p in free[:middle]], [p[1] for p in free[middle:]]], [sizes[:middle], sizes[middle:]]
        for i in range(_FEISTEL):
            moved, still = halves[1 - i % 2], halves[i % 2]
            stream = memoryview(self._bytes(4 * len(moved), tweak, shape, i, bytes(still))).cast("I") if moved else ()
            halves[1 - i % 2] = [(x + s) % n for x, s, n in zip(moved, stream, of_half[1 - i % 2])]
        new = iter(halves[0] + halves[1])
        return "".join(c if p is None else p[0][next(new)] for c, p in zip(text, at))

    def __call__(self, kind: str, value: str, round: int = 0) -> str:
        """The surrogate of an entity as it is written."""
        if kind != "name":
            return written(kind, value, self.draw(kind, canonical(kind, value), round))
        out, at = "", 0
        for start, end, _, sort in pieces_of(value):
            out, at = f"{out}{value[at:start]}{self(sort, value[start:end], round)}", end
        return out + value[at:]

    def draw(self, sort: str, value: str, round: int = 0) -> str:
        """The surrogate of a canonical value, canonical too. It differs from the value. Names of which
        more than half the letters are in no class get a placeholder."""
        fixed = sum(c.isalpha() and c not in _PLACE_OF for c in value) if sort in ("surname", "initial") else 0
        if round >= PLACEHOLDER or 2 * fixed > len(value):
            return f"[{sort} {self._bytes(16, sort, value).hex()}]"
        for draw in range(_DRAWS if round < WIDER else 0):
            new = getattr(self, f"_{sort}")(value, f"{sort}\x1f{round}\x1f{draw}")
            if new != value:
                return new
        return self._wider(sort, value, f"{sort}\x1f{round}", max(1, round - WIDER + 1))

    def _wider(self, sort: str, value: str, tweak: str, by: int) -> str:
        """A surrogate with `by` more characters; addresses move to a reserved network instead."""
        if sort == "ip":
            return ".".join(map(str, (0xF0000000 | int.from_bytes(self._bytes(4, tweak, value), "big") >> 4).to_bytes(4, "big")))
        more = "".join(("0123456789" if sort in ("phone", "card", "ssn", "iban", "ip6") else "bcdfghjklmnpqrstvwxyz")[b % 10] for b in self._bytes(by, tweak, value, "more"))
        if sort == "email":
            local, _, domain = self._email(value, tweak).rpartition("@")
            return f"{local}{more}@{domain}"
        return getattr(self, f"_{sort}")(value, tweak) + more

    def _email(self, value: str, tweak: str) -> str:
        local, _, domain = value.rpartition("@")
        name, dot, top = domain.rpartition(".")
        # a domain has one surrogate in all rounds
        return f"{self.letters(local, f'{tweak}\x1f{domain}')}@{self.letters(name, 'domain')}{dot}{top}"

    def _phone(self, value: str, tweak: str) -> str:
        # the country's code stays
        code = 2 if value[1] in "17" else 3 if value[1:3] in TWO_DIGIT_CODES else 4
        return value[:code] + self.letters(value[code:], f"{tweak}\x1f{value[:code]}")

    def _ssn(self, value: str, tweak: str) -> str:
        return self.letters(value, tweak)

    def _card(self, value: str, tweak: str) -> str:
        good = luhn(value)
        while True:  # a walk along the permutation to the next of its own sort
            # the issuer's digit stays
            value = value[0] + self.letters(value[1:], f"{tweak}\x1f{value[0]}")
            if luhn(value) == good:
                return value

    def _iban(self, value: str, tweak: str) -> str:
        # the country stays and the check digits follow from the rest
        own = self.letters(_fold(value[4:]), f"{tweak}\x1f{value[:2]}").upper()
        return f"{value[:2]}{98 - iban_remainder(f'{value[:2]}00{own}'):02d}{own}"

    def _ip(self, value: str, tweak: str) -> str:
        number = lambda v: int.from_bytes(bytes(map(int, v.split("."))), "big")
        private = is_private(value)
        while True:
            value = ".".join(map(str, self.permute(number(value), 1 << 32, tweak).to_bytes(4, "big"))) if not private else self._within(value, number, tweak)
            if is_private(value) == private:
                return value

    def _within(self, value: str, number, tweak: str) -> str:
        bits = next(b for net, b in _PRIVATE if number(value) >> b == net)
        x = number(value)
        return ".".join(map(str, (x >> bits << bits | self.permute(x & ((1 << bits) - 1), 1 << bits, f"{tweak}\x1f{x >> bits}")).to_bytes(4, "big")))

    def _ip6(self, value: str, tweak: str) -> str:
        # the first group, which tells the kind of address, stays
        return value[:4] + self.letters(value[4:], f"{tweak}\x1f{value[:4]}", _HEX)

    def _given(self, value: str, tweak: str) -> str:
        names = [_fold(n) for n in GIVEN_NAMES[_OF_GIVEN[value]]]
        # going on from a permuted place, never to itself
        ring = sorted(names, key=lambda n: self._bytes(16, tweak, "ring", n))
        return ring[(ring.index(value) + 1) % len(ring)]

    def _initial(self, value: str, tweak: str) -> str:
        return self.letters(value, tweak)

    def _surname(self, value: str, tweak: str) -> str:
        return self.letters(value, tweak)


def written(sort: str, value: str, new: str) -> str:
    """A canonical surrogate in the way in which the entity it stands for is written: its separators
    and its case. What a wider surrogate has more comes at the end."""
    if new.startswith("["):
        return new
    if sort in ("phone", "card", "ssn", "iban"):
        rest = list(new[1:] if sort == "phone" else new)
        if sort == "phone" and not value.startswith("+"):
            del rest[0]  # the country's code, which isn't written
        rest.reverse()
        out = [rest.pop() if c.isalnum() else c for c in value]
        return "".join(out + rest[::-1])
    if sort == "ip6":
        try:
            return ipaddress.IPv6Address(new).compressed
        except ValueError:  # a wider one
            return new
    if sort == "given" or sort == "surname" and len(new) != len(value):
        return new.upper() if value.isupper() else "-".join(x.capitalize() for x in new.split("-"))
    if sort == "ip" or value == _fold(value):
        return new
    local = value.rpartition("@")[0] if sort == "email" else value
    more = len(new) - len(value)  # of a wider address, before its domain
    shape = local + "." * more + value[len(local) :]
    return "".join(c.upper() if s.isupper() and len(c.upper()) == 1 else c for c, s in zip(new, shape))


#: Private networks: the address without the last so many bits.
_PRIVATE = ((10, 24), (0xAC1, 20), (0xC0A8, 16), (127, 24))


def is_private(ip: str) -> bool:
    x = int.from_bytes(bytes(map(int, ip.split("."))), "big")
    return any(x >> bits == net for net, bits in _PRIVATE)


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


#: Sorts whose surrogates aren't checked: there are few given names and initials, and each is used by
#: many persons, so their surrogates are always real; a permutation keeps different ones different.
UNCHECKED = ("given", "initial")


def entities_of(docs: DataFrame, text: str = "text", by_text: bool = False) -> DataFrame:
    """(sort, value) of all entities that are checked, canonical, once each; by_text: for each text,
    with its hash in column of."""
    common.ship(docs.sparkSession)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for of, t in zip(batch["of"], batch["text"]):
                found |= {(of, sort, canonical(sort, t[s:e])) for s, e, _, sort in pieces_of(t) if sort not in UNCHECKED}
            yield pd.DataFrame(sorted(found), columns=["of", "sort", "value"])

    of = F.xxhash64(text) if by_text else F.lit(0).cast("long")
    found = docs.filter(F.col(text).isNotNull()).select(of.alias("of"), F.col(text).alias("text")).mapInPandas(find, "of long, sort string, value string")
    return (found if by_text else found.drop("of")).distinct()


def further_rounds(entities: DataFrame, key: bytes) -> DataFrame:
    """(sort, value, round) of the entities whose surrogate of round 0 is a real entity or another's
    surrogate, with a round for which it is neither. Of equal surrogates the one of the least round,
    then value, stays.

    A round draws only what failed in the one before, and checks it against all that is real or
    settled. The last round's placeholders can't fail, so this ends.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surrogate = Surrogates(key)
        for batch in batches:
            yield batch.assign(surrogate=[surrogate.draw(*x) for x in zip(batch["sort"], batch["value"], batch["round"])])

    real = entities.select("sort", F.col("value").alias("surrogate"))
    now, settled = entities.withColumn("round", F.lit(0)), None
    for round in range(PLACEHOLDER + 1):
        drawn = now.mapInPandas(draw, "sort string, value string, round int, surrogate string")
        same = Window.partitionBy("sort", "surrogate").orderBy("value")
        taken = real if settled is None else real.unionByName(settled.select("sort", "surrogate"))
        judged = drawn.withColumn("_at", F.row_number().over(same)).join(taken.distinct().withColumn("_taken", F.lit(True)), ["sort", "surrogate"], "left")
        good = F.col("_taken").isNull() & (F.col("_at") == 1) | F.lit(round == PLACEHOLDER)
        judged = common.durable(judged.select("sort", "value", "round", "surrogate", good.alias("good")))
        kept = judged.filter("good").drop("good")
        settled = kept if settled is None else settled.unionByName(kept)
        now = judged.filter(~F.col("good")).select("sort", "value", (F.col("round") + 1).alias("round"))
        if not now.take(1):
            break
    return settled.filter("round > 0").select("sort", "value", "round")


def _with_rounds(docs: DataFrame, extra: DataFrame, text: str) -> DataFrame:
    """The rows with _rounds: (sort, value, round) of their entities that have a further round.

    Texts are named by their hash, so copies share a row. Those rows are written and read again, so
    that Spark knows their size and only broadcasts them below its threshold, and else deals both
    sides by the name. A row holds entities of one text (or of two whose hashes are equal).
    """
    spark = docs.sparkSession
    held = entities_of(docs, text, True).join(extra, ["sort", "value"]).groupBy("of").agg(F.collect_set(F.struct("sort", "value", "round")).alias("_rounds"))
    at = common.fresh_dir(spark, "surrogate-rounds")
    held.write.parquet(at)
    named = spark.read.parquet(at).withColumnRenamed("of", "_of")
    return docs.join(named, F.xxhash64(text) == F.col("_of"), "left").drop("_of")


def replace_entities(docs: DataFrame, secret: bytes, text: str = "text", sent_rounds: int = SENT_ROUNDS) -> DataFrame:
    """Every row with the entities of its text replaced by surrogates, and n_<kind>: how many of each.

    The same secret gives the same surrogates for the same corpus. n_name counts names of two parts
    or with a title, n_mention parts of them that stand alone. Null texts stay null and have no
    entities; empty ones stay empty. Texts and entities may be of any length; an entity whose format
    has no other string gets a wider surrogate. Keys aren't looked at, so null and repeated ones
    change nothing. Columns n_<kind> are replaced, others stay. Repeated rows stay and agree.
    """
    extra = common.durable(further_rounds(common.durable(entities_of(docs, text)), secret))
    made = [f"n_{k}" for k in KINDS]
    kinds = "array<struct<sort:string,value:string,round:int>>"
    first = extra.limit(sent_rounds + 1).collect()
    few = {(r["sort"], r["value"]): r["round"] for r in first} if len(first) <= sent_rounds else {}
    rounded = _with_rounds(docs, extra, text) if len(first) > sent_rounds else docs.withColumn("_rounds", F.lit(None).cast(kinds))
    # sent_rounds entities at most
    sent = docs.sparkSession.sparkContext.broadcast(few)

    def replace(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        surrogate, known = Surrogates(secret), {}
        for texts, rounds in batches:
            rows = []
            for t, own in zip(texts, rounds):
                round_of = sent.value if own is None else {(x["sort"], x["value"]): x["round"] for x in own}
                counts, parts, at = dict.fromkeys(KINDS, 0), [], 0
                pieces = pieces_of(t) if t else []
                for start, end, kind, sort in pieces:
                    value = t[start:end]
                    plain = canonical(sort, value)
                    entity = (sort, plain, round_of.get((sort, plain), 0))
                    if kind:
                        counts[kind] += 1
                    if entity not in known:
                        if len(known) > KNOWN:
                            known.clear()
                        known[entity] = surrogate.draw(*entity)
                    parts += [t[at:start], written(sort, value, known[entity])]
                    at = end
                rows.append((None if t is None else "".join([*parts, t[at:]]), *counts.values()))
            yield pd.DataFrame(rows, columns=["text", *made])

    kind = ", ".join(["text string", *(f"{m} long" for m in made)])
    out = rounded.withColumn("_r", F.pandas_udf(replace, kind)(F.col(text), F.col("_rounds")))
    return out.withColumns({text: F.col("_r.text")} | {m: F.col(f"_r.{m}") for m in made}).drop("_r", "_rounds")


def op4_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, b"lodestone surrogates")
