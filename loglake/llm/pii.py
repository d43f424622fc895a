"""Surrogates for personal data (operator 7).

Entities (e-mail addresses, phone, card, account, passport and social security numbers, IP and MAC
addresses, secrets, names after an honorific and their words where they stand alone later in the document,
capitalised and of two letters or more) are found by patterns and checks, and
replaced by keyed surrogates of the same type and format: digits by
digits, letters by letters of their script and case, a card number that passes
its checksum by another that does, a name by a name of its gender and script.

Coreference: the draw depends on the key and the entity's canonical form only
(an e-mail address without case, a phone number without punctuation, each word of a
name by itself, first name or surname), so one entity has one surrogate in all documents. A name's gender is the one
that most documents with an honorific show for it; without a majority it is neutral. Collision
check: surrogates are drawn for all distinct entities, and those that meet
another entity's surrogate, or an entity that occurs, are drawn again until none does.
A format with too little room for that (after MAX_DRAWS) goes over to a keyed permutation of all its
forms: surrogates stay distinct, but may be forms that occur. Names grow instead.

Texts are searched once; what the second pass has to change is marked in a fixed-size
filter, and documents with a redrawn entity or another gender than their own text shows are
joined with these. All others need no join.

Defined cases: null text stays null without entities, empty text stays empty; of
overlapping entities the first, then the longest counts; repeated rows get equal results; of
colliding entities the smallest canonical form keeps its draw; a form without any letter or
digit that can be replaced stays.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import flag_rows, save, table

KEY = b"surrogates-1"
MAX_DRAWS = 20
#: Draw number that stands for the permutation of a format.
PERMUTED = -1

#: Honorifics by the gender they tell.
HONORIFICS = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Mademoiselle", "Señora", "Sra", "Señorita", "Srta", "Doña", "Signora", "Госпожа"],
    "n": ["Dr", "Prof", "Professor", "Доктор"],
}
GENDER = {h.lower(): g for g, hs in HONORIFICS.items() for h in hs}
#: Letter ranges that surrogates stay inside of.
RANGES = [("0", "9"), ("a", "z"), ("A", "Z"), ("à", "ö"), ("À", "Ö"), ("а", "я"), ("А", "Я"), ("α", "ρ"), ("Α", "Ρ")]
#: Syllables and endings of made-up names, by script and gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha ka ke la le li lo ma me mi mo na ne no ra re ri ro sa se ta te ti to va ve vi".split(),
    "cyrillic": "ба бе бо ва ве да де за ка ко ла ле ли ло ма ме ми мо на не но ра ре ри ро са се та те ти то".split(),
    "greek": "βα γα δα δι θε κα κο λα λε λι μα με μι να νε νι πα πε ρα ρι σα σο τα τε τι το".split(),
}
ENDINGS = {
    ("latin", "m"): ["n", "rt", "s", "l"], ("latin", "f"): ["na", "la", "ra", "sa"], ("latin", "n"): ["n", "r", "x", "y"],
    ("cyrillic", "m"): ["н", "р", "в", "л"], ("cyrillic", "f"): ["на", "ра", "ва", "ла"], ("cyrillic", "n"): ["н", "к", "р", "ко"],
    ("greek", "m"): ["ς", "ος", "ης", "ων"], ("greek", "f"): ["α", "η", "ια", "να"], ("greek", "n"): ["ου", "ας", "ης", "ης"],
}

KINDS = ("email", "secret", "iban", "mac", "ip6", "ip", "passport", "phone", "ssn", "card")
_CAPITAL = "[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ]"
_NAME = rf"(?-i:(?={_CAPITAL}))[^\W\d_]+(?:[-'’][^\W\d_]+)?"
PATTERN = re.compile(
    r"(?P<email>[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<secret>(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|bearer)\b[\"']?\s*(?:[=:]\s*|\s)[\"']?)(?P<value>(?=[^\s\"']*\d)[A-Za-z0-9+/_.~-]{12,}=*)"
    r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|(?=[a-f]*\d)[0-9a-f]{40}|[0-9a-f]{64})\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<mac>(?<![\w:-])(?=[\w:-]*\d)[0-9a-f]{2}(?P<dash>[:-])(?:[0-9a-f]{2}(?P=dash)){4}[0-9a-f]{2}(?![\w:-]))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9a-f:]*\d)(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=[0-9a-f:]*::)(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![\w:]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|\bpassport(?: (?:no|nr|number))?\b[.:#]?[ ]*(?P<passport>[A-Z]{0,2}\d{6,9})(?!\w)"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
    r"|(?<![\w+.,/-])0\d{1,4}[ -]\d{3,4}[ -]?\d{3,4}(?![\w-])"
    r"|(?:(?<=call )|(?<=called )|(?<=phone )|(?<=phone: )|(?<=tel )|(?<=tel: )|(?<=tel. )|(?<=dial )|(?<=mobile )|(?<=fax ))\d{3}[ -]\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))"
    rf"|\b(?P<title>{'|'.join(sorted(GENDER, key=len, reverse=True))})\b\.?[ ](?P<name>{_NAME}(?: {_NAME}){{0,2}})", re.IGNORECASE)
#: What every entity without an honorific has, for a first look at a text: a digit or an @, or the
#: beginning of a secret without digits.
PLAIN = re.compile(r"[\d@]")
NO_DIGITS = ("akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
LETTERS, CAPITAL = re.compile("[a-f]{64}"), re.compile(_CAPITAL)
TITLES = [f"{h.casefold()}{end}" for h in GENDER for end in (" ", ". ")]


def likely(text: str) -> bool:
    """False only for texts in which PATTERN finds nothing."""
    if PLAIN.search(text):
        return True
    folded = text.casefold()
    same = len(folded) == len(text)  # so places agree
    for t in TITLES:
        at = folded.find(t)
        while at >= 0:
            end = at + len(t)
            if not same or CAPITAL.match(text, end) and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
                return True
            at = folded.find(t, at + 1)
    return any(x in folded for x in NO_DIGITS) or LETTERS.search(folded) is not None


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_check(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, canonical form, gender) in text order. A name has one gender in a text."""
    if not text or not likely(text):
        return []
    found = list(matched(text))
    first: dict[str, int] = {}
    shown: dict[str, int] = {}
    for _, end, kind, canon, gender in found:
        if kind == "name":
            first.setdefault(canon, end)
            shown[canon] = shown.get(canon, 0) + {"m": 1, "f": -1, "n": 0}[gender]
    bare_names = [n for n in first if len(n) > 1]
    if bare_names:
        bare = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(bare_names, key=len, reverse=True)))})(?!\w)", re.IGNORECASE)
        at = min(first[n] for n in bare_names)
        for start, end in [*(x[:2] for x in found if x[0] >= at), (len(text), len(text))]:
            for m in bare.finditer(text, at, start):
                if m.start() >= first.get(m[0].lower(), len(text)) and m[0][0].isupper():
                    found.append((*m.span(), "name", m[0].lower(), "n"))
            at = end
        found.sort()
    return [(s, e, kind, canon, gender_of(shown[canon]) if kind == "name" else "n") for s, e, kind, canon, _ in found]


def gender_of(balance: int) -> str:
    """From the mentions that show a man less those that show a woman."""
    return "m" if balance > 0 else "f" if balance < 0 else "n"


def matched(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """The entities that PATTERN finds, a name's gender by its honorific."""
    for m in PATTERN.finditer(text):
        if m["name"]:
            gender, at = GENDER.get(m["title"].casefold(), "n"), m.start("name")
            for k, word in enumerate(words := m["name"].split(" ")):
                # A surname behind a first name shows no gender in most scripts.
                yield at, at + len(word), "name", word.lower(), "n" if 0 < k == len(words) - 1 else gender
                at += len(word) + 1
            continue
        kind = next(k for k in KINDS if m[k])
        start, end = m.span("value") if m["value"] else m.span(kind)
        value = text[start:end]
        digits = re.sub(r"\D", "", value)
        if kind in ("email", "mac", "ip6"):
            canon = value.lower()
        elif kind == "ip":
            if any(int(x) > 255 for x in value.split(".")):
                continue
            canon = ".".join(str(int(x)) for x in value.split("."))
        elif kind == "iban":
            canon = value.replace(" ", "").upper()
            if iban_check(canon) != 1:
                continue
        elif kind == "phone":
            code = re.match(r"\+(\d{1,3}?)(?=\D)", value)
            canon = f"{code[1]}|{digits[len(code[1]):]}" if code else f"|{digits}"
        elif kind == "passport":
            canon = value.upper()
        else:
            canon = digits if kind in ("card", "ssn") else value
        yield start, end, kind, canon, "n"


class Draw:
    """Numbers keyed by type, canonical form and number of the draw."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.parts, self.n, self.left = key, repr(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(self.parts + self.n.to_bytes(4, "big"), key=self.key).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def one_of(self, alphabet: str) -> str:
        return alphabet[self.below(len(alphabet))]


def script_of(word: str) -> str:
    c = next((c for c in word if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def fixed_prefix(kind: str, canon: str) -> int:
    """Leading characters that a surrogate keeps: what tells the format or a private network."""
    if kind == "phone":
        return canon.index("|") + 1 + (canon[canon.index("|") + 1:].startswith("0") and canon[0] == "|")
    if kind == "ip":
        a, b = canon.split(".")[:2]
        kept = 1 if a in ("10", "127") else 2 if (a, b) in (("192", "168"), ("169", "254")) or a == "172" and 16 <= int(b) <= 31 else 0
        return sum(len(x) + 1 for x in canon.split(".")[:kept])
    if kind == "card":
        return 1
    if kind == "iban":
        return 4
    if kind == "ip6" and re.match("f[cde]|::1$", canon):
        return min(4, len(canon))
    if kind == "secret" and (prefix := re.match("AKIA|gh[pousr]_|sk-", canon)):
        return len(prefix[0])
    return 0


def slots(kind: str, canon: str) -> list[tuple[int, str]]:
    """(place, alphabet) of every character that a surrogate draws anew."""
    hexadecimal = kind in ("mac", "ip6") or kind == "secret" and re.fullmatch("[0-9a-f]+", canon)
    end = len(canon)
    if kind == "email":
        labels = canon.partition("@")[2].split(".")
        end -= len(labels[-1]) + 1 + (len(labels[-2]) if labels[-2] == "example" else 0)
    elif kind == "card" and luhn(canon):
        end -= 1
    out = []
    for i in range(fixed_prefix(kind, canon), end):
        r = next((r for r in RANGES if r[0] <= canon[i] <= r[1]), None)
        if r is not None:
            out.append((i, "0123456789abcdef" if hexadecimal else "".join(map(chr, range(ord(r[0]), ord(r[1]) + 1)))))
    return out


def shape(kind: str, canon: str) -> str:
    """What forms that are permuted among themselves have in common."""
    if kind == "ip":
        return f"{canon[:fixed_prefix(kind, canon)]}{canon.count('.')}"
    out = list(canon)
    for i, alphabet in slots(kind, canon):
        out[i] = alphabet[0]
    if kind == "iban":
        out[2:4] = "00"
    return "".join(out[:-1]) + "*" if kind == "card" and luhn(canon) else "".join(out)


def finished(kind: str, canon: str, text: str) -> str:
    """With the check digits that the form asks for."""
    if kind == "card" and luhn(canon):
        return next(text[:-1] + d for d in "0123456789" if luhn(text[:-1] + d))
    if kind == "iban":
        return f"{text[:2]}{98 - iban_check(text[:2] + '00' + text[4:]):02d}{text[4:]}"
    return text


def permuted(n: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 to size - 1: a Feistel network on the bits, walked until it is inside."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    while True:
        left, right = n >> half, n & mask
        for i in range(8):
            h = hashlib.blake2b(tweak + bytes([i]) + right.to_bytes((half + 7) // 8, "big"), key=key, digest_size=64).digest()
            while len(h) * 8 < half:
                h += hashlib.blake2b(h, key=key).digest()
            left, right = right, left ^ int.from_bytes(h, "big") & mask
        n = left << half | right
        if n < size:
            return n


def permutation(kind: str, canon: str, key: bytes = KEY) -> str:
    """The surrogate of a form by the permutation of all forms of its shape."""
    tweak = repr((kind, shape(kind, canon))).encode()
    if kind == "ip":
        kept = fixed_prefix(kind, canon)
        octets = [int(x) for x in canon[kept:].split(".")]
        n = permuted(sum(x << 8 * i for i, x in enumerate(octets)), 1 << 8 * len(octets), key, tweak)
        return canon[:kept] + ".".join(str(n >> 8 * i & 255) for i in range(len(octets)))
    places, n, size = slots(kind, canon), 0, 1
    for i, alphabet in places:
        n, size = n * len(alphabet) + alphabet.index(canon[i]), size * len(alphabet)
    n = permuted(n, size, key, tweak)
    out = list(canon)
    for i, alphabet in reversed(places):
        n, digit = divmod(n, len(alphabet))
        out[i] = alphabet[digit]
    return finished(kind, canon, "".join(out))


def surrogate(kind: str, canon: str, gender: str, draw_no: int, key: bytes = KEY) -> str:
    """Canonical form of the surrogate."""
    if draw_no == PERMUTED:
        return permutation(kind, canon, key)
    draw = Draw(key, kind, canon, draw_no)
    if kind == "name":
        script = script_of(canon)
        syllables = SYLLABLES[script]
        # Longer with every redraw, so that room for distinct names never ends.
        body = "".join(syllables[draw.below(len(syllables))] for _ in range(3 + draw_no // 4))
        return body + ENDINGS[script, gender][draw.below(4)]
    if kind == "ip":
        kept = fixed_prefix(kind, canon)
        return canon[:kept] + ".".join(str(1 + draw.below(254)) for _ in canon[kept:].split("."))
    out = list(canon)
    for i, alphabet in slots(kind, canon):
        out[i] = draw.one_of(alphabet)
    return finished(kind, canon, "".join(out))


def render(kind: str, value: str, canon: str) -> str:
    """The surrogate in the format of the mention it replaces."""
    if kind == "name":
        return canon.upper() if value.isupper() and len(value) > 1 else canon.capitalize()
    if kind in ("email", "mac", "ip6", "passport") and len(value) == len(canon):
        return "".join(c.upper() if v.isupper() else c.lower() if v.islower() else c for v, c in zip(value, canon))
    if kind in ("phone", "ssn", "card", "iban"):
        rest = iter(canon.replace("|", ""))
        return "".join(next(rest, "") if c.isalnum() else c for c in value)
    return canon


def replace(text: str | None, resolved: dict[tuple[str, str], tuple[str, int]], key: bytes = KEY) -> tuple[str | None, int]:
    """The text with surrogates, and the number of entities. ``resolved``: gender and draw of
    those entities (type, canonical form) that are not as the text alone shows."""
    if not text:
        return text, 0
    out, end, n = [], 0, 0
    for s, e, kind, canon, gender in entities(text):
        out += (text[end:s], render(kind, text[s:e], surrogate(kind, canon, *resolved.get((kind, canon), (gender, 0)), key)))
        end, n = e, n + 1
    return "".join([*out, text[end:]]), n


def find_entities(docs: DataFrame) -> DataFrame:
    """doc_id, row, kind, canon, gender of every distinct mention in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, r, *x) for d, r, t in zip(*(c.to_pylist() for c in b.columns))
                    for x in sorted({x[2:] for x in entities(t)})]
            columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *(pa.string(),) * 3))],
                                             ["doc_id", "row", "kind", "canon", "gender"])

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(
        run, "doc_id long, row long, kind string, canon string, gender string")


def draw_surrogates(known: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, gender, draw, with ``to`` and, for forms that can be permuted, ``shape``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            to = [surrogate(*x, key) for x in rows]
            shapes = [None if kind == "name" else shape(kind, canon) for kind, canon, *_ in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.string()), pa.array(shapes, pa.string())], [*b.schema.names, "to", "shape"])

    return known.select("kind", "canon", "gender", "draw").mapInArrow(
        run, "kind string, canon string, gender string, draw int, to string, shape string")


def resolve(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, canon, gender, draw, to: all distinct entities, without collisions."""
    balance = F.count_if(F.col("gender") == "m") - F.count_if(F.col("gender") == "f")
    known = found.groupBy("kind", "canon").agg(balance.alias("_b")).select(
        "kind", "canon", F.when(F.col("_b") > 0, "m").when(F.col("_b") < 0, "f").otherwise("n").alias("gender"), F.lit(0).alias("draw"))
    known = save(draw_surrogates(known, key), "pii-entities")
    taken = known.select("kind", F.col("canon").alias("to"))
    entity = ["kind", "canon"]
    for tried in itertools.count():
        # What is permuted stays distinct by itself.
        drawn = known.where(F.col("draw") != PERMUTED)
        same = (drawn.groupBy("kind", "to").agg(F.min(F.struct("draw", "canon")).alias("first"), F.count(F.lit(1)).alias("n"))
                .where("n > 1").select("kind", "to", "first"))
        meets = (drawn.join(same, ["kind", "to"]).where(F.struct("draw", "canon") != F.col("first")).select(*entity, "shape")
                 .union(drawn.join(taken, ["kind", "to"], "left_semi").select(*entity, "shape")).distinct())
        meets = save(meets, "pii-collisions")
        if meets.isEmpty():
            return known.drop("shape")
        if tried < MAX_DRAWS:
            again = known.join(meets.select(*entity), entity, "left_semi").withColumn("draw", F.col("draw") + 1)
            known = known.join(meets.select(*entity), entity, "left_anti")
        else:  # no room left: whole formats change over; names go on growing
            full = meets.where("shape IS NOT NULL").select("kind", "shape").distinct()
            again = known.join(full, ["kind", "shape"], "left_semi").withColumn("draw", F.lit(PERMUTED))
            grown = known.join(meets.where("shape IS NULL").select(*entity), entity, "left_semi").withColumn("draw", F.col("draw") * 2)
            known = (known.join(full, ["kind", "shape"], "left_anti").join(meets.where("shape IS NULL").select(*entity), entity, "left_anti"))
            again = again.unionByName(grown)
        known = save(known.unionByName(draw_surrogates(again, key)), "pii-entities")
    raise AssertionError


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, n_entities, text with surrogates: one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = save(find_entities(docs), "pii-mentions")
    known = resolve(found, key).select("kind", "canon", F.col("gender").alias("known"), "draw")
    other = found.join(known, ["kind", "canon"]).where((F.col("draw") != 0) | (F.col("known") != F.col("gender")))
    per_doc = save(other.groupBy("doc_id", "row").agg(F.collect_set(F.struct("kind", "canon", "known", "draw")).alias("resolved")), "pii-resolved")
    columns = ["doc_id", "row"]
    # Only rows with entities are searched again, and only those with something resolved are joined.
    keyed = docs.withColumn("row", F.xxhash64("text"))
    marked = flag_rows(flag_rows(keyed, found.select(columns), columns, "_found"), per_doc.select(columns), columns, "_resolve")
    none = F.lit(None).cast(per_doc.schema["resolved"].dataType)
    plain = marked.where("NOT _resolve").select("doc_id", "text", "_found", none.alias("resolved"))
    special = (marked.where("_resolve").alias("d").join(per_doc.alias("p"), F.expr("d.doc_id <=> p.doc_id AND d.row = p.row"), "left")
               .select("d.doc_id", "text", "_found", "resolved"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            touched = b.column(2).to_pylist()
            if not any(touched):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(b.num_rows, np.int64)), b.column(1)], ["doc_id", "n_entities", "text"])
                continue
            rows = [replace(t, {(x["kind"], x["canon"]): (x["known"], x["draw"]) for x in r or ()}, key) if f else (t, 0)
                    for t, f, r in zip(b.column(1).to_pylist(), touched, b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([t for t, _ in rows], pa.string())],
                ["doc_id", "n_entities", "text"])

    return plain.unionByName(special).mapInArrow(run, "doc_id long, n_entities long, text string")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
