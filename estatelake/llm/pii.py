"""Surrogates for personal data: detected entities get keyed, type-consistent replacements.

A replacement is drawn from HMAC-SHA256 of the entity's type and normal form, so an entity gets the same one everywhere, in the
format of each place: digits for digits, the same separators, the same case. Cards keep their first digit and stay valid, IBANs
keep the country and stay valid, addresses of one mail domain share a domain and those of different domains do not, names keep
gender and script, and a surname is replaced alike with and without a given name. Titles, also chains of them, are no names.

Draws may collide. All distinct entities of the corpus form a table; of those that drew the same replacement the one that had it
first (then the smallest) keeps it, and no replacement may be a real entity; the others draw again until nothing collides. Names,
mail domains and the local parts of addresses grow with the attempts, so they never run out; numbers have to keep their format, and
if the corpus holds so much of one format that draws still collide after ``MOST_ATTEMPTS``, the job ends with an error. Only
the exceptions have to be known when texts are rewritten.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf

from estatelake.llm.common import stored

BROADCAST_EXCEPTIONS = 100_000
MOST_ATTEMPTS = 64  # with two thirds of a format in use, one entity in 10^11 would still collide then
FOUND = "array<struct<kind:string,norm:string>>"

# Titles and given names that mark a person, by gender (f, m, or n for unknown). Fixed values.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "госпожа", "κυρία"],
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"],
    "n": ["Dr", "Prof", "Professor"],
}
GIVEN = {
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Maria", "Emma", "Laura",
          "Julia", "Sophie", "Claire", "Camille", "Carmen", "Lucía", "Анна", "Мария", "Елена", "Ольга", "Μαρία", "Ελένη"],
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Peter", "Paul", "Hans",
          "Klaus", "Jürgen", "Pierre", "Jean", "José", "Carlos", "Иван", "Сергей", "Дмитрий", "Γιώργος", "Νίκος"],
}
GENDER = {name.lower(): g for g, names in GIVEN.items() for name in names}

# Syllables of invented names, and endings of given names by gender, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве га да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те".split(),
    "greek": "βα βε γα γε δα δε ζα κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε".split(),
}
ENDINGS = {
    "latin": {"f": "a ina ela ia".split(), "m": "o en or us".split(), "n": "is ey".split()},
    "cyrillic": {"f": "на ина ея".split(), "m": "ан ей ор".split(), "n": "ко".split()},
    "greek": {"f": "α ινα".split(), "m": "ος ης".split(), "n": "ι".split()},
}

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_CARD = re.compile(r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_NAME = r"[^\W\d_]+(?:-[^\W\d_]+)*"
_TITLE = f"(?:{'|'.join(sum(TITLES.values(), []))})"
_PERSON = rf"(?!{_TITLE}(?![\w-])){_NAME}"
_TITLED = re.compile(rf"(?<!\w)((?:{_TITLE}\.?[ \u00a0])+)(?:({_PERSON})[ \u00a0])?({_PERSON})")
_GIVEN = re.compile(rf"(?<!\w)({'|'.join(sum(GIVEN.values(), []))})(?:[ \u00a0]({_PERSON}))?(?!\w)")
_ONE_TITLE = re.compile(_TITLE)
_WORD_OF_NAME = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_CODE = re.compile(r"\+(\d{1,3})(?=\D)")


def luhn(digits: str) -> int:
    """Checksum modulo 10 of a card number; 0 for a valid one."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script_of(word: str) -> str:
    first = word[:1]
    return "cyrillic" if "Ѐ" <= first <= "ԯ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a whole text, in order, never overlapping; the kind that comes first
    in this function has precedence. Kinds of names end in gender and script."""
    found: list[tuple[int, int, str, str]] = []  # in order

    def take(start: int, end: int, kind: str, norm: str) -> None:
        i = bisect_right(found, start, key=lambda f: f[0])
        if norm and (i == 0 or found[i - 1][1] <= start) and (i == len(found) or end <= found[i][0]):
            insort(found, (start, end, kind, norm))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            take(*m.span(), "email", m[0].rstrip(".").lower())
    if any(d in text for d in "0123456789"):
        for m in _IP.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                take(*m.span(), "ip", m[0])
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if plain.isascii() and _mod97(plain) == 1:
                take(*m.span(), "iban", plain)
        for m in _PHONE.finditer(text):
            digits = _digits(m[0])
            if 7 <= len(digits) <= 15:
                code = _CODE.match(m[0])
                take(*m.span(), f"phone+{code[1]}" if code else "phone", digits)
        for m in _SSN.finditer(text):
            take(*m.span(), "ssn", _digits(m[0]))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if digits[0] in "3456" and (luhn(digits) == 0 or len(digits) == 16):
                take(*m.span(), "card", digits)
    for m in _TITLED.finditer(text):
        genders = [g for t in _ONE_TITLE.findall(m[1]) for g, names in TITLES.items() if t in names]
        gender = next((g for g in genders if g != "n"), "n")
        last = 3 if m[3][0].isupper() else 2
        if not m[last] or not m[last][0].isupper():
            continue
        if last == 3 and m[2] and m[2][0].isupper():
            take(*m.span(2), f"given-{gender if gender != 'n' else GENDER.get(m[2].lower(), 'n')}-{script_of(m[2])}", m[2].lower())
        take(*m.span(last), f"surname-{script_of(m[last])}", m[last].lower())
    for m in _GIVEN.finditer(text):
        if m[2] and m[2][0].isupper():
            take(*m.span(1), f"given-{GENDER[m[1].lower()]}-{script_of(m[1])}", m[1].lower())
            take(*m.span(2), f"surname-{script_of(m[2])}", m[2].lower())
    people: dict[str, str] = {}
    for _, _, kind, norm in found:
        if kind.startswith(("given", "surname")):
            people.setdefault(norm, kind)
    if people:
        # Mentions of a person who is known by now need no title or given name; small letters are other words.
        taken = list(found)
        starts = [f[0] for f in taken]
        for m in _WORD_OF_NAME.finditer(text):
            kind = people.get(m[0].lower())
            if kind and m[0][0].isupper():
                i = bisect_right(starts, m.start())
                if (i == 0 or taken[i - 1][1] <= m.start()) and (i == len(taken) or m.end() <= starts[i]):
                    found.append((*m.span(), kind, m[0].lower()))
    return sorted(found)


def domain_of(email: str) -> str:
    return email.rpartition("@")[2]


class _Draw:
    """Numbers from a keyed stream."""

    def __init__(self, key: bytes, *parts: object) -> None:
        self.seed = hmac.new(key, "\0".join(map(str, parts)).encode(), hashlib.sha256).digest()
        self.value, self.left, self.count = 0, 0, 0

    def below(self, n: int) -> int:
        if self.left < 64:
            self.count += 1
            self.value = int.from_bytes(hashlib.sha256(self.seed + self.count.to_bytes(4, "big")).digest(), "big")
            self.left = 256
        self.value, got = divmod(self.value, n)
        self.left -= n.bit_length()
        return got

    def like(self, text: str) -> str:
        """Letters for letters, digits for digits."""
        return "".join(
            chr(97 + self.below(26)) if c.isalpha() else str(self.below(10)) if c.isdigit() else c for c in text
        )


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0, domain: str | None = None) -> str:
    """The normal form of an entity's replacement at a given attempt; ``domain`` is the replacement of an address's domain (by
    default its first one)."""
    draw = _Draw(key, kind, norm, attempt)
    more = "a" * (attempt // 4)
    if kind == "email":
        local, _, real = norm.rpartition("@")
        return f"{draw.like(local + more)}@{domain or surrogate(key, 'domain', real)}"
    if kind == "domain":
        first, *others = norm.split(".")
        return ".".join([draw.like(first + more), *(draw.like(x) for x in others[:-1]), *others[-1:]])
    if kind == "ip":
        return ".".join(str(x) for x in (1 + draw.below(223), draw.below(256), draw.below(256), 1 + draw.below(254)))
    if kind.startswith("phone"):
        code = kind[6:]
        return code + draw.like(norm[len(code):])
    if kind == "ssn":
        return draw.like(norm)
    if kind == "card":
        body = norm[0] + draw.like(norm[1:-1])
        return body + str(next(d for d in range(10) if luhn(body + str(d)) == luhn(norm)))
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in norm[4:])
        return f"{norm[:2]}{98 - _mod97(norm[:2] + '00' + body):02d}{body}"
    parts = kind.split("-")
    syllables = SYLLABLES[parts[-1]]
    stem = "".join(syllables[draw.below(len(syllables))] for _ in range(2 + draw.below(2) + attempt // 4))
    if parts[0] == "given":
        endings = ENDINGS[parts[-1]][parts[1]]
        return stem[:-1] + endings[draw.below(len(endings))]
    return stem


def in_format_of(place: str, kind: str, norm: str) -> str:
    """A replacement written the way the entity was written at this place."""
    if kind in ("email", "ip"):
        return norm.upper() if place.isupper() and kind == "email" else norm
    if kind.startswith(("given", "surname")):
        return norm.upper() if place.isupper() and len(place) > 1 else norm[:1].upper() + norm[1:]
    signs = iter(norm)
    return "".join(next(signs) if c.isalnum() else c for c in place)


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with all entities replaced, and their kinds."""
    pieces, kinds, at = [], [], 0
    for start, end, kind, norm in detect(text):
        tail = "." * (len(text[start:end]) - len(text[start:end].rstrip("."))) if kind == "email" else ""
        real = domain_of(norm) if kind == "email" else None
        domain = surrogate(key, "domain", real, attempts.get(("domain", real), 0)) if real else None
        drawn = surrogate(key, kind, norm, attempts.get((kind, norm), 0), domain)
        pieces += [text[at:start], in_format_of(text[start:end], kind, drawn), tail]
        kinds.append(re.split(r"[+-]", kind)[0])
        at = end
    return "".join([*pieces, text[at:]]), kinds


def _drawn(key: bytes):
    def run(rows: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in rows:
            yield pa.array([surrogate(key, *row) for row in zip(*(c.to_pylist() for c in columns))], pa.string())

    return arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)


def _settled(entities: DataFrame, key: bytes) -> DataFrame:
    draw = _drawn(key)
    real = entities.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("is_real"))
    now = entities.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ATTEMPTS):
        now = stored(now.withColumn("surrogate", draw("kind", "norm", "attempt", "domain")))
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("first"))
        marked = now.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        again = F.col("is_real").isNotNull() | (F.col("first.norm") != F.col("norm"))
        marked = stored(marked.select("kind", "norm", "domain", "attempt", again.alias("again")))
        if not marked.where("again").limit(1).count():
            return now.select("kind", "norm", "attempt", "surrogate")
        now = marked.select("kind", "norm", "domain", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    kinds = [r.kind for r in marked.where("again").select("kind").distinct().limit(10).collect()]
    raise ValueError(f"no surrogates left in the format of {', '.join(kinds)}")


def settled_attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, attempt, surrogate) of distinct entities (kind, norm) and of the domains of addresses: no two surrogates of a
    kind are alike, and none is an entity of its kind. Domains are settled before the addresses that hold them."""
    entities = stored(entities.select("kind", "norm").distinct())
    is_email, domain = F.col("kind") == "email", F.substring_index("norm", "@", -1)
    domains = entities.where(is_email).select(F.lit("domain").alias("kind"), domain.alias("norm"))
    others = stored(entities.where(~is_email).union(domains).distinct())
    others = _settled(others.withColumn("domain", F.lit(None).cast("string")), key)
    drawn = others.where("kind = 'domain'").select(F.col("norm").alias("real"), F.col("surrogate").alias("domain"))
    emails = entities.where(is_email).withColumn("real", domain).join(drawn, "real").select("kind", "norm", "domain")
    return others.unionByName(_settled(stored(emails), key))


def _entities(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("norm", pa.string())]))
    for batch in texts:
        rows = [[(k, n) for _, _, k, n in detect(t)] if t else [] for t in batch.to_pylist()]
        rows = [row + [("domain", domain_of(n)) for k, n in row if k == "email"] for row in rows]
        yield pa.array([[{"kind": k, "norm": n} for k, n in row] for row in rows], kind)


def with_surrogates(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their entities replaced in the whole text; adds ``kinds``, the kinds of the entities in order (a
    column of that name is replaced). Null texts stay null and have no entities; all other columns pass through.

    Texts are read twice and never shuffled while the exceptions of the collision check are few (counted); beyond that the
    exceptions of each text reach it by a join on a hash of the text.
    """
    whole = F.col(text).cast("string")
    found = arrow_udf(_entities, FOUND, ArrowUDFType.SCALAR_ITER)
    mentions = docs.select(whole.alias("t")).where(F.col("t").rlike(r"[0-9@]") | F.col("t").rlike(f"({'|'.join(sum(TITLES.values(), []) + sum(GIVEN.values(), []))})"))
    entities = mentions.select(F.explode(found("t")).alias("e")).select("e.kind", "e.norm").distinct()
    exceptions = stored(settled_attempts(entities, key).where("attempt > 0").select("kind", "norm", "attempt"))
    docs = docs.drop("kinds")
    if exceptions.count() <= BROADCAST_EXCEPTIONS:
        known = {(r.kind, r.norm): r.attempt for r in exceptions.collect()}
        own = F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int>>")
        rows = docs.withColumn("__own", own)
    else:
        known = {}
        named = docs.select(F.xxhash64(whole).alias("__same"), F.explode(found(whole)).alias("e")).select("__same", "e.*").distinct()
        own = named.join(exceptions, ["kind", "norm"]).groupBy("__same").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("__own"))
        rows = docs.withColumn("__same", F.xxhash64(whole)).join(own, "__same", "left").drop("__same")

    def rewritten(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, owns in batches:
            done = []
            for t, own in zip(texts.to_pylist(), owns.to_pylist()):
                attempts = known if own is None else {(x["kind"], x["norm"]): x["attempt"] for x in own}
                done.append(dict(zip(("text", "kinds"), rewrite(t, key, attempts))) if t is not None else {"text": None, "kinds": []})
            yield pa.array(done, pa.struct([("text", pa.string()), ("kinds", pa.list_(pa.string()))]))

    done = arrow_udf(rewritten, "struct<text:string,kinds:array<string>>", ArrowUDFType.SCALAR_ITER)(whole, F.col("__own"))
    out = rows.withColumn("__done", done)
    return out.withColumns({text: F.col("__done.text"), "kinds": F.col("__done.kinds")}).drop("__done", "__own")
