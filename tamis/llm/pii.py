"""PII surrogates: detected entities receive keyed, type-consistent replacements.

Kinds: e-mail, telephone, IPv4, IPv6, payment card, social security number, IBAN, and
personal names after a title or an introduction, with all other mentions of such a name in
the same document. Everything but names is mapped by a keyed
permutation (a Feistel network with cycle walking) over all values of the same format,
shifted so that no value stays: equal values get equal surrogates in every document
(coreference), different values different ones (distinctness), and no surrogate is its own
original. Case, separators, lengths, the e-mail's last label, the IBAN's country and valid
check digits, and whether a card number's check digit holds are kept.

Parts of names get pronounceable surrogates of the same script and case; the ending goes
with the gender of the title; a name whose title tells none takes the one that another title
in the document tells. These come from a keyed hash, so their distinctness is
checked over all documents: names are gathered, and of names that share a surrogate all but
the least, and those whose surrogate is itself a name of the corpus, are given another one,
until there are none. Such exceptions are few, as names are made a syllable longer, all
together, if there were more than ``EXCEPTIONS``; a worker holds at most so many.

The key is the session's ``spark.tamis.surrogate.key``; with it surrogates are the same in
every run. Where it is unset each call draws a key of its own, which nobody can know.

Nulls stay null; texts without entities (empty ones, too) are returned as they are. Repeated
rows and ids are rewritten alike. An empty table gives an empty result. A very long text is
held whole by one worker. Other columns are kept; columns that are added get underscores in
front if docs has their names.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, prepare, schema_of, stored, table, unused

KEY_SETTING = "spark.tamis.surrogate.key"
#: Syllables of a name's surrogate before its ending, at first.
SYLLABLES = 3
#: Turns after which names are made longer; and names whose first surrogate was taken, of all documents, at most.
TURNS = 12
EXCEPTIONS = 50_000

# ---- detection

EMAIL = re.compile(r"(?<![\w.+%-])[^\W_][\w.+%-]*@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,24}(?![\w-])")
DIGITS = re.compile(
    r"""(?<![0-9A-Za-z_.])(?:
      (?P<ipv4>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![0-9A-Za-z_]|\.\d))
    | (?P<card>(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![0-9A-Za-z_]))
    | (?P<ssn>\d{3}-\d{2}-\d{4}(?![0-9A-Za-z_-]))
    | (?P<phone>(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}
        |\+\d{1,3}[ .-]\d(?:[ .-]?\d{2,4}){2,4}|\d{3}[ ]\d{3}[ ]\d{4}|0\d{1,4}[ /-]\d{5,8}|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ ]\d{3,4}[ ]\d{3,4})(?![0-9A-Za-z_]))
    )""",
    re.X,
)
IPV6 = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:.])")
#: An IBAN and what may follow it in capitals or digits; its end is found by ibans().
IBAN = re.compile(r"(?<![0-9A-Za-z_])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z_])")
# Lengths of IBANs by country; of other countries the longest with valid check digits is taken.
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}.items() for c in cs.split()}
# Titles and introductions, with the gender that they tell (m, f or none).
TITLES = {
    "Mr.": "m", "Mr": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
    "Mme": "f", "Mademoiselle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sr.": "m", "Sra.": "f", "Dr.": "", "Prof.": "", "господин": "m", "госпожа": "f",
    "Господин": "m", "Госпожа": "f", "κύριος": "m", "κυρία": "f", "My name is": "", "my name is": "", "Mein Name ist": "", "mein Name ist": "", "Je m'appelle": "", "je m'appelle": "", "Me llamo": "", "me llamo": "",
}
PART = r"[A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я][\w’'-]*[^\W\d_]"
NAMED = re.compile(r"(?<!\w)(" + "|".join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True)) + rf")[  ]({PART}(?: {PART}){{0,2}})")
HINTS = sorted({t.rstrip(".") for t in TITLES})


def luhn(digits: str) -> int:
    """What a card number's digits sum up to, by ten; 0 if its check digit holds."""
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10


def iban_rest(iban: str) -> int:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def ibans(text: str) -> list[tuple[int, int]]:
    """(start, end) of all IBANs: of what IBAN finds, the part up to a word's end that has the country's length, or else the longest with valid check digits."""
    found, m = [], IBAN.search(text)
    while m:
        ends = [e for e in range(m.end(), m.start() + 14, -1) if e == m.end() or text[e] == " "]
        sized = [(e, e - m.start() - text.count(" ", m.start(), e)) for e in ends]
        valid = [(n != IBAN_LENGTHS.get(m[0][:2], n), -e) for e, n in sized if 15 <= n <= 34 and iban_rest(text[m.start() : e]) == 1]
        end = -min(valid)[1] if valid else m.start() + 1
        found += [(m.start(), end)] if valid else []
        m = IBAN.search(text, end)
    return found


def names(text: str) -> list[tuple[int, int, str]]:
    """(start, end, gender) of the names after titles, and of all other mentions of these names, which may overlap."""
    titled = []
    for m in NAMED.finditer(text):
        for p in re.finditer(r"\S+", m[2]):
            own = len(p[0]) - 2 if p[0].endswith(("'s", "’s")) and len(p[0]) > 3 else len(p[0])
            titled.append((m.start(2) + p.start(), m.start(2) + p.start() + own, TITLES[m[1]]))
    told: dict[str, str] = {}
    for a, e, g in titled:
        told[text[a:e].casefold()] = told.get(text[a:e].casefold()) or g
    out = [(a, e, g or told[text[a:e].casefold()]) for a, e, g in titled]
    if out:
        forms = {f for a, e, _ in titled for f in (text[a:e], text[a:e].upper())}
        bare = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(forms, key=lambda f: (-len(f), f)))) + r")(?!\w)")
        at = {a for a, _, _ in titled}
        out += [(m.start(), m.end(), told[m[0].casefold()]) for m in bare.finditer(text) if m.start() not in at and m[0].casefold() in told]
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of all entities, in order and apart; of two that overlap the earlier, then the longer stays."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", "") for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), m.lastgroup, "") for m in DIGITS.finditer(text)]
    if text.count(":") > 1:
        found += [(m.start(), m.end(), "ipv6", "") for m in IPV6.finditer(text) if sum(map(str.isdigit, m[0]))]
    found += [(a, e, "iban", "") for a, e in ibans(text)]
    if any(h in text for h in HINTS):
        found += [(a, e, "name", g) for a, e, g in names(text)]
    out: list = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


# ---- surrogates


def keyed(key: bytes, *parts) -> int:
    key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest(), "big")


def permuted(key: bytes, tweak: str, x: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse."""
    half = max(1, (max(2, size) - 1).bit_length() + 1 >> 1)
    mask, rounds = (1 << half) - 1, range(6)

    def f(r: int, v: int) -> int:
        out = 0
        for part in range(half // 128 + 1):
            out = out << 128 | keyed(key, tweak, size, r, part, v)
        return out & mask

    while True:
        a, b = x >> half, x & mask
        if back:
            for r in reversed(rounds):
                a, b = b ^ f(r, a), a
        else:
            for r in rounds:
                a, b = b, a ^ f(r, b)
        x = a << half | b
        if x < size:
            return x


def moved(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation without fixed points, as long as there are two values."""
    return permuted(key, tweak, (permuted(key, tweak, x, size) + 1) % size, size, back=True)


# Alphabets within which a character is replaced.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
CLASS = {c: a for a in ALPHABETS for c in a}


def reshaped(key: bytes, tweak: str, text: str) -> str:
    """Another text of the same format: each character from the alphabet and in the case of the old one."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    shape = "".join(CLASS[c][0] if c in CLASS else c for c in low)
    x, size = 0, 1
    for c in low:
        if c in CLASS:
            x = x * len(CLASS[c]) + CLASS[c].index(c)
            size *= len(CLASS[c])
    y, out = moved(key, f"{tweak} {shape}", x, size), []
    for c, old in zip(reversed(low), reversed(text), strict=True):
        if c in CLASS:
            y, k = divmod(y, len(CLASS[c]))
            c = CLASS[c][k]
            out.append(c.upper() if old != old.lower() else c)
        else:
            out.append(old)
    return "".join(reversed(out))


def filled(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def of_card(key: bytes, text: str) -> str:
    digits = "".join(c for c in text if c.isdigit())
    head, rest = digits[:-1], luhn(digits)
    new = f"{moved(key, f'card {len(head)} {rest}', int(head), 10 ** len(head)):0{len(head)}d}"
    return filled(text, new + next(d for d in "0123456789" if luhn(new + d) == rest))


def of_ipv4(key: bytes, text: str) -> str:
    x = 0
    for part in text.split("."):
        x = x << 8 | int(part)
    y = moved(key, "ipv4", x, 1 << 32)
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def of_ipv6(key: bytes, text: str) -> str:
    import ipaddress

    try:
        x = int(ipaddress.IPv6Address(text))
    except ValueError:
        return reshaped(key, "ipv6", text)
    y = str(ipaddress.IPv6Address(moved(key, "ipv6", x, 1 << 128)))
    return y.upper() if text != text.lower() else y


def of_phone(key: bytes, text: str) -> str:
    head = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    at = head.end() if head else 0
    digits = "".join(c for c in text[at:] if c.isdigit())
    return text[:at] + filled(text[at:], f"{moved(key, f'phone {text[:at]} {len(digits)}', int(digits), 10 ** len(digits)):0{len(digits)}d}")


def of_email(key: bytes, text: str) -> str:
    head, dot, top = text.rpartition(".")
    return reshaped(key, f"email {top.lower()}", head) + dot + top


def of_iban(key: bytes, text: str) -> str:
    body = reshaped(key, f"iban {text[:2]}", text[4:])
    return text[:2] + f"{98 - iban_rest(text[:2] + '00' + body):02d}" + body


def of_ssn(key: bytes, text: str) -> str:
    return reshaped(key, "ssn", text)


# Sounds of name surrogates by script: consonants, vowels, endings for men and women.
SOUNDS = {
    "latin": ("b d f g h j k l m n p r s t v w z br dr gr kr tr".split(), "a e i o u".split(), "n r s l".split(), ["a"]),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε η ι ο".split(), ["ς"], ["α"]),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), ["н", "р", "в"], ["а"]),
}


def script(text: str) -> str:
    c = text[:1]
    return "greek" if "Ͱ" <= c <= "Ͽ" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "latin"


def of_name(key: bytes, name: str, gender: str, syllables: int, turn: int = 0) -> str:
    """A name of the same script and case, whose ending goes with the gender; the next one for each turn."""
    consonants, vowels, men, women = SOUNDS[script(name)]
    x, out = keyed(key, "name", gender, name.casefold(), *([turn] if turn else [])), ""
    for _ in range(syllables):
        x, c = divmod(x, len(consonants))
        x, v = divmod(x, len(vowels))
        out += consonants[c] + vowels[v]
    x, c = divmod(x, len(consonants))
    end = {"m": men, "f": women}.get(gender)
    out += end[x % len(end)] if end == men else consonants[c] + (end[0] if end else vowels[x % len(vowels)])
    return out.upper() if name.isupper() and len(name) > 1 else out[:1].upper() + out[1:] if name[:1].isupper() else out


SURROGATE: dict[str, Callable[[bytes, str], str]] = {"email": of_email, "card": of_card, "ipv4": of_ipv4, "ipv6": of_ipv6, "phone": of_phone, "ssn": of_ssn, "iban": of_iban}


@dataclass(frozen=True)
class Names:
    """How names are replaced: syllables, and the turns of the names whose first surrogate was taken."""

    syllables: int = SYLLABLES
    turns: dict[tuple[str, str], int] = field(default_factory=dict)

    def surrogate(self, key: bytes, name: str, gender: str) -> str:
        return of_name(key, name, gender, self.syllables, self.turns.get((name.casefold(), gender), 0))


def replaced(text: str, key: bytes, names: Names | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced."""
    out, at, kinds, names = [], 0, [], names or Names()
    for a, b, kind, gender in entities(text):
        old = text[a:b]
        out += [text[at:a], names.surrogate(key, old, gender) if kind == "name" else SURROGATE[kind](key, old)]
        at = b
        kinds.append(kind)
    return ("".join([*out, text[at:]]) if kinds else text), kinds


def names_found(docs: DataFrame) -> DataFrame:
    """The distinct (name, gender) of the corpus, case folded."""

    def make():
        def each(b):
            found = {(t[a:e].casefold(), g) for t in b.column(0).to_pylist() if any(h in t for h in HINTS) for a, e, kind, g in entities(t) if kind == "name"}
            names, genders = zip(*found, strict=True) if found else ((), ())
            yield batch(["name", "gender"], pa.array(names, pa.string()), pa.array(genders, pa.string()))

        return each

    return map_arrow(docs.where("text is not null").select("text"), make, "name string, gender string").distinct()


def with_surrogate(names: DataFrame, key: bytes, syllables: int) -> DataFrame:
    """(name, gender, turn, surrogate) of rows (name, gender, turn)."""

    def make():
        def each(b):
            got = [of_name(key, x, g, syllables, t) for x, g, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield batch(["name", "gender", "turn", "surrogate"], *b.columns, pa.array(got, pa.string()))

        return each

    return map_arrow(names.select("name", "gender", "turn"), make, "name string, gender string, turn int, surrogate string")


def distinct_names(docs: DataFrame, key: bytes, syllables: int = SYLLABLES, most: int = EXCEPTIONS) -> Names:
    """Surrogates that differ for all names of the corpus, none of them a name of the corpus."""
    found = stored(names_found(docs), "pii-names")
    real = found.select(F.col("name").alias("surrogate")).distinct()
    while True:
        made = stored(with_surrogate(found.withColumn("turn", F.lit(0)), key, syllables), "pii-surrogates")
        for _ in range(TURNS):
            # the one that has kept its surrogate longest stays, the least name on ties
            rank = F.struct("turn", "name", "gender")
            shared = made.groupBy("surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1").select("surrogate", F.col("first.name").alias("name"), F.col("first.gender").alias("gender"))
            twice = made.join(shared.select("surrogate"), "surrogate", "left_semi").join(shared.select("name", "gender"), ["name", "gender"], "left_anti")
            taken = made.join(real, "surrogate", "left_semi")
            wrong = stored(twice.union(taken.select(twice.columns)).select("name", "gender", "turn").distinct(), "pii-wrong")
            n = wrong.count()
            if not n:
                return Names(syllables, {(r.name, r.gender): r.turn for r in made.where("turn > 0").toLocalIterator()})
            if n + made.where("turn > 0").count() > most:
                break
            again = with_surrogate(wrong.withColumn("turn", F.col("turn") + 1), key, syllables)
            made = stored(made.join(wrong, ["name", "gender"], "left_anti").unionByName(again), "pii-surrogates")
        syllables += 1


def key_of(spark: SparkSession) -> bytes:
    told = spark.conf.get(KEY_SETTING, None)
    return told.encode() if told else secrets.token_bytes(32)


def with_surrogates(docs: DataFrame, key: bytes | None = None, *, counted: bool = False, syllables: int = SYLLABLES, most: int = EXCEPTIONS) -> DataFrame:
    """docs with surrogates in text; n_chars, if there, counted anew where text changed; counted adds n_entities and kinds."""
    spark = docs.sparkSession
    prepare(spark)
    key = key_of(spark) if key is None else key
    shared, names = spark.sparkContext.broadcast(distinct_names(docs, key, syllables, most)), docs.columns
    added = [unused(docs, c) for c in ("n_entities", "kinds")] if counted else []

    def make():
        k, how = names.index("text"), shared.value

        def each(b):
            texts, kinds = b.column(k).to_pylist(), []
            counts = b.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i, t in enumerate(texts):
                new, got = replaced(t, key, how) if t else (t, [])
                if got:
                    texts[i] = new
                    if counts:
                        counts[i] = len(new)
                kinds.append(got)
            cols = list(b.columns)
            cols[k] = pa.array(texts, pa.string())
            if counts:
                cols[names.index("n_chars")] = pa.array(counts, b.schema.field("n_chars").type)
            if counted:
                cols += [pa.array([len(x) for x in kinds], pa.int64()), pa.array([",".join(sorted(set(x))) for x in kinds], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *added])

        return each

    return map_arrow(docs, make, schema_of(docs) + "".join(f", `{c}` {kind}" for c, kind in zip(added, ("long", "string"))))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents", "doc_id", "text"), counted=True)
