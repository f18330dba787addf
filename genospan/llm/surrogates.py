"""Personal data replaced by keyed surrogates of the same kind.

Entities are found by patterns and brought to a canonical form, so that two spellings
of one entity share a surrogate.  The surrogate follows from a secret key and the canonical form alone and
matches the kind: digits stay digits, separators and lengths stay, card numbers keep
their check digits' validity, addresses stay addresses, names keep gender and script.  All distinct entities of
the table are then checked in the form that is printed (of persons the surname, which may stand alone): where two would get
the same surrogate, or one that is itself an entity of the table, all but the smallest are drawn again with
the next attempt number, until none collides.

Only the few entities that were drawn again need a table when texts are rewritten.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import string
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospan.llm.runtime import cut, worker_state
from genospan.session import ship_by_value

ship_by_value(__name__)

EXAMPLE_KEY = b"an example, not a secret"  # for the query and the pipeline; callers bring their own
WIDE_FROM = 4  # the attempt from which secrets and mail names are drawn from more than their own form
MOST_REDRAWN_SENT = 50_000  # redrawn entities that are sent along with the tasks; more are joined

# Titles with gender, and given names by script and gender.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
    "Mademoiselle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Oscar"],
    ("latin", "f"): ["Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Hanna", "Irene", "Julia", "Laura", "Maria", "Olivia"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Иван", "Олег"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Ольга"],
    ("greek", "m"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"],
}
GIVEN |= {(script, "n"): GIVEN[script, "m"] + GIVEN[script, "f"] for script in ("latin", "cyrillic", "greek")}
SYLLABLES = {
    "latin": ["ba", "den", "fel", "gar", "hol", "ken", "lam", "mor", "nor", "ped", "ros", "sten", "tal", "ver", "win", "zan"],
    "cyrillic": ["ба", "ве", "гор", "дан", "ков", "лен", "мар", "нов", "пет", "рос", "сал", "тов"],
    "greek": ["βα", "γρη", "δα", "κα", "λου", "μα", "νι", "πα", "ρου", "σα", "το", "φω"],
}

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<secret>(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9]))
    |(?P<keyed>(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\b["']?\s{0,3}[=:]\s{0,3}["']?)(?P<value>[^\s"']{6,}))
    |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){3,7}(?:\ ?[A-Z0-9]{1,3})?(?!\w))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))
    |(?P<card>(?<![\w-])\d(?:[\ -]?\d){12,18}(?![\w-]))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[\ .-]?)?(?:\(\d{2,4}\)[\ .-]?|\d{2,4}[\ .-])\d{3,4}[\ .-]\d{3,4}(?![\w-]|\.\d)|(?<![\w+])\+\d{1,3}(?:[\ .-]?\d){7,11}(?!\w))
    |(?P<name>(?<!\w)(?P<title>"""
    + _TITLE
    + r""")\.?\s(?P<person>[^\W\d_]+(?:[\s'-][^\W\d_]+)?))
    """,
    re.VERBOSE,
)
# Cheap signs that a text may hold an entity at all; the shortest run of digits is an address like 1.1.1.1.
_SIGN = re.compile(r"@|AKIA|gh[pousr]_|sk-|\d[\d .()/-]{5,}\d|[A-Z]{2}\d{2}\ ?[A-Z0-9]{4}|[=:]|(?:" + _TITLE + r")\b")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is valid."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_rest(moved: str) -> int:
    """Remainder by 97 of an account number whose first four characters have been moved to its end; 1 if it is valid."""
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _script(text: str) -> str:
    if re.search(r"[\u0400-\u04ff]", text):
        return "cyrillic"
    return "greek" if re.search(r"[\u0370-\u03ff\u1f00-\u1fff]", text) else "latin"


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of every entity, from left to right."""
    if not _SIGN.search(text):
        return
    found = list(_patterned(text))
    yield from _mentions(text, found) if any(e[2] == "name" for e in found) else found


def _mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` and all other mentions, whole or by surname, of the persons in it; a person has one canonical form in a text.

    Where persons share a surname, it stands for the first of the title's gender, without a title for the first of all.
    """
    whole: dict[str, dict[str, str]] = {}
    surname: dict[str, dict[str, str]] = {}
    spelled = set()
    for start, end, kind, canonical in found:
        if kind != "name":
            continue
        gender, person = canonical.split(" ", 1)
        whole.setdefault(person, {}).setdefault(gender, canonical)
        words = text[start:end].split()
        for form in (words, [w.upper() for w in words], [w.title() for w in words]):
            spelled |= {tuple(form), (form[-1],)}
        if len(words) > 1:
            surname.setdefault(person.split()[-1], {}).setdefault(gender, canonical)

    def resolved(person: str, gender: str) -> str:
        own = surname.get(person) or whole[person]
        if gender in own and gender != "n":
            return own[gender]
        known = next((c for g, c in own.items() if g != "n"), None)
        if gender == "n":
            return known or own["n"]
        return own.get("n") or whole[person][gender]

    out = [(s, e, k, resolved(c.split(" ", 1)[1], c[0]) if k == "name" else c) for s, e, k, c in found]
    starts = [e[0] for e in out]
    forms = sorted((r"\s+".join(map(re.escape, words)) for words in spelled if len(words) > 1 or len(words[0]) > 1), key=len, reverse=True)
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(forms)})(?!\w)", text) if forms else ():
        k = bisect_right(starts, m.start()) - 1
        if (k >= 0 and out[k][1] > m.start()) or (k + 1 < len(starts) and starts[k + 1] < m.end()):
            continue
        person = " ".join(m[0].split()).title()
        own = surname.get(person) or whole[person]
        out.append((*m.span(), "name", resolved(person, next(iter(own)) if person in surname or "n" not in own else "n")))
    return sorted(out)


def _patterned(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _PATTERN.finditer(text):
        kind = m.lastgroup
        for name in ("email", "secret", "keyed", "iban", "ssn", "ip", "card", "phone", "name"):
            if m[name] is not None:
                kind = name
                break
        start, end = m.span("value" if kind == "keyed" else "person" if kind == "name" else 0)
        found = text[start:end]
        if kind == "name":
            if not all(w[0].isupper() for w in re.split(r"[\s'-]", found) if w):
                first = re.split(r"[\s'-]", found)[0]
                if not first[:1].isupper():
                    continue
                end, found = start + len(first), first
            canonical = f"{TITLES[m['title']]} {' '.join(found.split()).title()}"
        elif kind == "keyed":
            kind, canonical = "secret", found
        elif kind == "email":
            canonical = found.lower()
        elif kind in ("phone", "card", "ssn"):
            canonical = re.sub(r"\D", "", found)
        elif kind == "iban":
            canonical = found.replace(" ", "")
        else:
            canonical = found
        yield start, end, kind, canonical


class Stream:
    """Numbers that follow from the key, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int) -> None:
        self.seed = hmac.new(key, f"{kind}\x1f{attempt}\x1f{canonical}".encode(), hashlib.sha256).digest()
        self.count, self.value = 0, int.from_bytes(self.seed)

    def below(self, n: int) -> int:
        if self.value < 1 << 64:
            self.count += 1
            self.value = int.from_bytes(hashlib.sha256(self.seed + self.count.to_bytes(4)).digest())
        self.value, out = divmod(self.value, n)
        return out


def _kin(c: str) -> str:
    """Letters or digits of the same case near ``c`` in its script; kept for each block of 64 and category."""
    low, kind = ord(c) & ~63, unicodedata.category(c)
    known = worker_state("kin", dict)
    if (low, kind) not in known:
        known[low, kind] = "".join(chr(k) for k in range(max(low, 128), low + 64) if unicodedata.category(chr(k)) == kind)
    return known[low, kind]


def _alike(text: str, draw: Stream) -> str:
    """Each letter and digit by one of its class; hexadecimal strings stay hexadecimal."""
    if re.fullmatch(r"(?=.*[a-f])[0-9a-f]{8,}|(?=.*[A-F])[0-9A-F]{8,}", text):
        digits = "0123456789ABCDEF" if text.upper() == text else "0123456789abcdef"
        return "".join(digits[draw.below(16)] for _ in text)
    out = []
    for c in text:
        if c.isascii() and c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isascii() and c.isupper():
            out.append(chr(65 + draw.below(26)))
        elif c.isascii() and c.islower():
            out.append(chr(97 + draw.below(26)))
        elif c.isalnum():
            out.append(_kin(c)[draw.below(len(_kin(c)))])
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of the surrogate of an entity."""
    draw = Stream(key, kind, canonical, attempt)
    if kind == "email":
        local, domain = canonical.rsplit("@", 1)
        more = "".join(string.ascii_lowercase[draw.below(26)] for _ in range(attempt // WIDE_FROM))
        return f"{_alike(local, draw)}{more}@{_alike(domain.rsplit('.', 1)[0], Stream(key, 'domain', domain, 0))}.example"
    if kind == "ip":
        return f"{240 + draw.below(15)}.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}"
    if kind == "ssn":
        return f"9{draw.below(10**8):08d}"
    if kind == "card":
        body = canonical[0] + "".join(str(draw.below(10)) for _ in canonical[2:])
        right = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (right if luhn(canonical) else str((int(right) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        head = len(canonical) - 7 if len(canonical) > 9 else 2
        return canonical[: max(0, head - 3)] + "".join(str(draw.below(10)) for _ in canonical[max(0, head - 3) :])
    if kind == "iban":
        body = _alike(canonical[4:], draw)
        right = 98 - iban_rest(f"{body}{canonical[:2]}00")
        return f"{canonical[:2]}{right if iban_rest(canonical[4:] + canonical[:4]) == 1 else 2 + (right + draw.below(96)) % 97:02d}{body}"
    if kind == "secret":
        lead = re.match(r"AKIA|gh[pousr]_|sk-", canonical)
        fixed = lead[0] if lead else ""
        made = fixed + _alike(canonical[len(fixed) :], draw)
        # A form with few or no letters and digits has too few others: then any letters and digits, more with each attempt.
        if made == canonical or attempt >= WIDE_FROM:
            drawn = string.ascii_letters + string.digits
            made = fixed + "".join(drawn[draw.below(len(drawn))] for _ in range(len(canonical) - len(fixed) + attempt // WIDE_FROM))
        return made
    gender, person = canonical.split(" ", 1)
    script = _script(person)
    parts = re.split(r"([\s'-])", person)
    syllables = SYLLABLES[script]
    made = "".join(syllables[draw.below(len(syllables))] for _ in range(3 + attempt)).capitalize()
    given = GIVEN[script, gender][draw.below(len(GIVEN[script, gender]))]
    return f"{gender} {given}{parts[1]}{made}" if len(parts) > 1 else f"{gender} {made}"


def _dressed(original: str, kind: str, made: str) -> str:
    """The surrogate in the format of the original: its separators, its letter case."""
    if kind in ("phone", "card", "ssn", "iban"):
        letters = iter(made)
        return "".join(next(letters, "") if c.isalnum() else c for c in original)
    if kind == "name":
        made = made.split(" ", 1)[1]
        if not re.search(r"[\s'-]", original):
            made = made.rsplit(" ", 1)[-1]
        return made.upper() if original.isupper() and len(original) > 1 else made
    if kind == "email" and original.isupper():
        return made.upper()
    return made


def printed(kind: str, canonical: str) -> str:
    """What two entities of a kind must not share: the shortest form in which one is printed."""
    return canonical.rsplit(" ", 1)[-1].lower() if kind == "name" else canonical


def _rewritten(text: str, key: bytes, attempt_of: Callable[[str, str], int]) -> tuple[str, list[str]]:
    out, last, kinds = [], 0, []
    for start, end, kind, canonical in entities(text):
        out += [text[last:start], _dressed(text[start:end], kind, surrogate(key, kind, canonical, attempt_of(kind, canonical)))]
        last = end
        kinds.append(kind)
    return "".join([*out, text[last:]]) if kinds else text, kinds


def entity_table(docs: DataFrame, text: str, key: bytes) -> DataFrame:
    """(kind, canonical, attempt): every distinct entity with the attempt that keeps all surrogates distinct."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, c) for lo in range(0, batch.num_rows, 256) for t in batch.column(0).slice(lo, 256).to_pylist() if t for _, _, k, c in entities(t)}
            columns = [pa.array(list(c), pa.string()) for c in zip(*sorted(found), strict=True)] if found else [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "canonical"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            made = [(printed(k, c), printed(k, surrogate(key, k, c, a))) for k, c, a in rows]
            own, new = (pa.array([m[i] for m in made], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], own, new], names=["kind", "canonical", "attempt", "own", "made"])

    schema = "kind string, canonical string, attempt int, own string, made string"
    distinct = docs.select(text).mapInArrow(find, "kind string, canonical string").distinct()
    known = cut(distinct.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema))
    real = known.select("kind", F.col("own").alias("made")).distinct().withColumn("real", F.lit(True))
    while True:
        # An earlier attempt and then the smallest form has the right to a surrogate.
        first = known.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canonical"))["canonical"].alias("first"), F.count(F.lit(1)).alias("n"))
        taken = first.join(real, ["kind", "made"], "left").where("n > 1 or real").select("kind", "made", "first", "real")
        taken = cut(taken)
        if taken.isEmpty():
            return known.select("kind", "canonical", "attempt")
        met = known.join(taken, ["kind", "made"], "left")
        again = (F.col("real") | (F.col("first") != F.col("canonical"))) & F.col("first").isNotNull()
        again = F.coalesce(again, F.lit(False))
        redrawn = met.where(again).select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        known = cut(met.where(~again).select("kind", "canonical", "attempt", "own", "made").union(redrawn.mapInArrow(draw, schema)))


def replace_entities(docs: DataFrame, text: str = "text", *, key: bytes, most_sent: int = MOST_REDRAWN_SENT) -> DataFrame:
    """``docs`` with rewritten ``text`` and the new column ``entities``, the kinds found in order.

    Null texts stay null with no entities, empty ones stay empty; other columns, nulls and
    repeated rows stay as they are; equal entities of one table get equal
    surrogates, different ones different.  A column ``entities`` of the input is replaced.
    """
    redrawn = cut(entity_table(docs, text, key).where("attempt > 0"))
    others = [c for c in docs.columns if c not in (text, "entities")]
    rows = docs.select(F.col(text).alias("text"), F.struct(F.lit(1).alias("__one"), *others).alias("rest"))
    if redrawn.count() <= most_sent:
        sent = {(r["kind"], r["canonical"]): r["attempt"] for r in redrawn.collect()}
        rows = rows.withColumn("redrawn", F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>"))
    else:
        sent = {}
        rows = _with_redrawn(rows, redrawn)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for lo in range(0, batch.num_rows, 256):
                own = batch.column(2).slice(lo, 256).to_pylist()
                for t, redo in zip(batch.column(0).slice(lo, 256).to_pylist(), own, strict=True):
                    if not t:
                        texts.append(t), kinds.append([])
                        continue
                    table = sent if redo is None else {(r["kind"], r["canonical"]): r["attempt"] for r in redo}
                    made, found = _rewritten(t, key, lambda k, c, table=table: table.get((k, c), 0))
                    texts.append(made), kinds.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1), pa.array(kinds, pa.list_(pa.string()))], names=["text", "rest", "entities"])

    rest = rows.schema["rest"].dataType.simpleString()
    made = rows.mapInArrow(rewrite, f"text string, rest {rest}, entities array<string>")
    return made.select(*[F.col("text").alias(text) if c == text else F.col("rest")[c].alias(c) for c in docs.columns if c != "entities"], "entities")


def _with_redrawn(rows: DataFrame, redrawn: DataFrame) -> DataFrame:
    """Each text with the redrawn entities it holds, by joins on the entity and on the text's digest."""

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({(d, k, c) for d, t in zip(*(x.to_pylist() for x in batch.columns), strict=True) if t for _, _, k, c in entities(t)})
            columns = [pa.array(list(c), pa.string()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "kind", "canonical"])

    rows = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    held = rows.select("digest", "text").mapInArrow(where, "digest string, kind string, canonical string").distinct()
    own = held.join(redrawn, ["kind", "canonical"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("redrawn"))
    met = rows.join(own, "digest", "left")
    return met.select("text", "rest", F.coalesce("redrawn", F.array().cast("array<struct<kind:string,canonical:string,attempt:int>>")).alias("redrawn"))
