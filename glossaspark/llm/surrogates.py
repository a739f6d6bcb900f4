"""Keyed, type-consistent surrogates for personal data."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

# Shapes of personal data and of credentials.
EMAIL = r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])*\.[A-Za-z]{2,})"
PHONE = (
    r"(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![\w+])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))"
)
ADDRESS = r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9]))"
CARD = r"(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"
NATIONAL = r"(?P<national>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
CREDENTIAL = (
    r"(?P<access>(?<![A-Za-z0-9])AKIA[A-Z0-9]{12,}(?![A-Za-z0-9]))"
    r"""|(?P<secret>(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]{8,}))"""
)
FEMALE = "Anna Maria Emma Sophie Julia Laura Claire Camille Alice Helen Margaret Susan Linda Karen Nancy Lucía Carmen Elena Paula Marta".split()
MALE = "James John Robert Michael William David Thomas Charles Peter Hans Klaus Jürgen Pierre Michel Antoine Carlos Miguel Javier Andrés Pedro".split()
FAMILY = "Smith Johnson Brown Miller Wilson Taylor Walker Wright Müller Schneider Fischer Weber Dubois Moreau Laurent Lefèvre García Fernández Martínez Romero".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split()
MALE_CYRILLIC = "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил".split()
FAMILY_CYRILLIC = "Иванов Петров Смирнов Кузнецов Попов Соколов Лебедев Новиков".split()
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr")
TITLES = ("Dr", "Prof")
#: What stands before a full name of any kind.
CUES = (
    "[Mm]y name is", "[Hh]er name is", "[Hh]is name is", "[Nn]ame:", "[Ff]rom:", "[Tt]o:", "[Aa]uthor:", "[Aa]ttn:", "[Pp]atient:", "[Cc]ustomer:", "[Cc]ontact:?",
    "[Cc]all", "[Ww]rite to", "[Aa]sk for", "[Ss]igned,?", "[Ss]igned by", "[Dd]ear", "[Rr]egards,", "[Ss]incerely,", "[Ii]ch heiße", "[Mm]ein Name ist", "[Jj]e m'appelle", "[Mm]e llamo",
    "[Мм]еня зовут",
)
VOWELS = ("aeiou", "аеиоуыэюя")
CONSONANTS = ("bcdfghjklmnpqrstvwxyz", "бвгджзйклмнпрстфхцчшщ")
#: Only for words that have no other letters.
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþё"

_title = "|".join((*FEMALE_TITLES, *MALE_TITLES, *TITLES))
_given = "|".join((*FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC))
_family = "|".join((*FAMILY, *(x + "а?" for x in FAMILY_CYRILLIC)))
_capital = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]*(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]*)?"
NAME = (
    rf"(?P<titled>\b(?P<title>{_title})\b\.?[ ](?P<name>{_capital}(?:[ ]{_capital})?))"
    rf"|(?P<full>\b(?:{_given})[ ](?:{_family})\b)"
    rf"|(?P<half>\b(?:{_given})[ ]{_capital})(?![\w-])"
)
MARKED = re.compile("[0-9@]|(?i:password|passwd|secret|token|api_?key)|AKIA")
ENTITY = re.compile("|".join((EMAIL, CREDENTIAL, ADDRESS, PHONE, NATIONAL, CARD)))
NAMED = re.compile(NAME)
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]*")
#: Words that a name of :data:`NAME` begins with.
HEADS = frozenset((*FEMALE_TITLES, *MALE_TITLES, *TITLES, *FEMALE, *MALE, *FEMALE_CYRILLIC, *MALE_CYRILLIC))
#: A whole word that begins with a capital, as all parts of names do.
WHOLE = re.compile(r"\b[A-ZÀ-ÖØ-ÞА-ЯЁ]\w*")
RUN = re.compile(rf"(?<![\w-]){_capital}[ ]{_capital}(?:[ ]{_capital})?(?![\w-])")
PAIR = re.compile(rf"(?<![\w-]){_capital}[ ]{_capital}")
CUED = re.compile(rf"\b(?:{'|'.join(CUES)})\s\Z")
ADDRESS_NEXT = re.compile(r",?[ ][(<]?[A-Za-z0-9][\w.+-]*@")
#: The longest cue, and the character before it.
CUE_SIZE = 24


def _valid(digits: str) -> bool:
    """Check digit of a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


class Surrogates:
    """Keyed permutations of the strings of one format.

    Every character class keeps its class (digit, letter of a script, vowel of a
    name), everything else stays. An alternating Feistel network over the two halves
    permutes all strings of a format, so different entities get different surrogates
    and an entity gets the same one everywhere. ``attempt`` selects another
    permutation, for an entity whose surrogate is taken or equals itself.
    """

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key, rounds
        self.of = lru_cache(1 << 16)(self._of)

    def _permuted(self, values: list[int], radices: list[int], tweak: str) -> list[int]:
        live = [i for i, r in enumerate(radices) if r > 1]
        halves = (live[: len(live) // 2], live[len(live) // 2 :])
        bounds = [prod(radices[i] for i in h) for h in halves]
        state = []
        for h in halves:
            x = 0
            for i in h:
                x = x * radices[i] + values[i]
            state.append(x)
        for r in range(self.rounds):
            side, other = r % 2, 1 - r % 2
            message = f"{tweak}|{r}|{radices}|{state[other]}".encode()
            width = min(64, bounds[side].bit_length() // 8 + 9)
            state[side] = (state[side] + int.from_bytes(blake2b(message, key=self.key, digest_size=width).digest(), "big")) % bounds[side]
        out = list(values)
        for h, x in zip(halves, state, strict=True):
            for i in reversed(h):
                x, out[i] = divmod(x, radices[i])
        return out

    def spelled(self, text: str, classes: list[str | None], tweak: str) -> str:
        """``text`` with each character exchanged inside its class (None: kept)."""
        values = [c.index(t) if c else 0 for t, c in zip(text, classes, strict=True)]
        out = self._permuted(values, [len(c) if c else 1 for c in classes], tweak)
        return "".join(c[v] if c else t for t, c, v in zip(text, classes, out, strict=True))

    def _of(self, kind: str, value: str, attempt: int = 0) -> str:
        tweak = f"{kind}|{attempt}"
        digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
        if kind == "email":
            host = value.rindex(".")
            classes = [(lower if c in lower else digits if c in digits else None) if i < host else None for i, c in enumerate(value)]
            return self.spelled(value, classes, f"{tweak}|{value[host:]}")
        if kind == "phone":
            kept = 2 if value[0] == "+" else 0  # the first digit of the country code
            return self.spelled(value, [digits if i >= kept else None for i in range(len(value))], f"{tweak}|{value[:kept]}")
        if kind == "national":
            return self.spelled(value, [digits] * len(value), tweak)
        if kind == "card":
            head = self.spelled(value[:-1], [None] + [digits] * (len(value) - 2), f"{tweak}|{value[0]}")
            return next(head + d for d in digits if _valid(head + d))
        if kind == "ip":
            public = lambda q: 0 < q[0] < 224
            parts = [int(x) for x in value.split(".")]
            now = self._permuted(parts, [256] * 4, tweak)
            while public(now) != public(parts):
                now = self._permuted(now, [256] * 4, tweak)
            return ".".join(map(str, now))
        if kind in ("female", "male", "family", "female2", "male2", "family2"):
            names = {"female": FEMALE, "male": MALE, "family": FAMILY, "female2": FEMALE_CYRILLIC, "male2": MALE_CYRILLIC, "family2": FAMILY_CYRILLIC}[kind]
            order = sorted(names, key=lambda n: blake2b(f"{tweak}|{n}".encode(), key=self.key, digest_size=8).digest())
            return order[(order.index(value) + 1) % len(order)]
        if kind == "word":  # a name of no list keeps its script and the places of its vowels
            pools = (*VOWELS, *CONSONANTS)
            classes = [next((p for p in pools if c in p), None) for c in value]
            if len(value) > 3:
                classes[-1] = None  # endings often carry the gender
            if not any(classes):
                classes = [ACCENTED if c in ACCENTED else None for c in value]
            return self.spelled(value, classes, f"{tweak}|{value[-1] if len(value) > 3 else ''}")
        pools = (digits + lower[:6],) if re.fullmatch("[0-9a-f]+", value) else (digits, lower, lower.upper())
        classes = [next((p for p in pools if c in p), None) for c in value]
        if kind == "access":
            classes[:4] = [None] * 4
        return self.spelled(value, classes, tweak)


def _cased(like: str, text: str) -> str:
    return "".join(t.upper() if s.isupper() else t for s, t in zip(like, text, strict=True)) if len(like) == len(text) else text


def _name_parts(text: str) -> list[tuple[str, str, str]]:
    """(kind, canonical value, part) of the words of a name."""
    out, parts = [], re.split(r"([ -])", text)
    for i, part in enumerate(parts):
        if part in (" ", "-", ""):
            continue
        family = part[:-1] if part[:-1] in FAMILY_CYRILLIC and part.endswith("а") else part
        if part in FAMILY or family in FAMILY_CYRILLIC:
            out.append(("family2" if family in FAMILY_CYRILLIC else "family", family, part))
        elif part in FEMALE or part in MALE:
            out.append(("female" if part in FEMALE else "male", part, part))
        elif part in FEMALE_CYRILLIC or part in MALE_CYRILLIC:
            out.append(("female2" if part in FEMALE_CYRILLIC else "male2", part, part))
        else:
            out.append(("word", part.lower(), part))
    return out


def names(text: str) -> Iterator[tuple[int, str]]:
    """(start, name) of the names of a text: after a title, of a listed given name and
    another capitalised word, of two or three capitalised words after a cue, and of two
    before an e-mail address. Only capitalised words are looked at."""
    end = 0
    for word in CAPITAL.finditer(text):
        at = word.start()
        if at < end:
            continue
        if word[0] in HEADS and (m := NAMED.match(text, at)):
            group = next(g for g in ("name", "full", "half") if m[g])
        elif text[word.end() : word.end() + 1] not in (" ", "-"):
            continue
        elif (m := RUN.match(text, at)) and CUED.search(text[max(0, at - CUE_SIZE) : at]):
            group = 0
        elif (m := PAIR.match(text, at)) and ADDRESS_NEXT.match(text, m.end()):
            group = 0
        else:
            continue
        end = m.end()
        yield m.start(group), m[group]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of each entity of a text, in order. The
    canonical value is the same for all spellings of an entity. The parts of a name
    count wherever the same text has them, also alone or, with three letters and more, in capitals."""
    found, parts, capitals = [], {}, {}
    if MARKED.search(text):
        for m in ENTITY.finditer(text):
            start, end = m.start(), m.end()
            if m["secret"]:
                start, end = m.start("value"), m.end("value")
                if re.search("[A-Za-z0-9]", m["value"]):  # a row of signs hides nothing
                    found.append((start, end, "secret", text[start:end]))
                continue
            value = m[0]
            digits = re.sub("[^0-9]", "", value)
            if m["email"]:
                found.append((start, end, "email", value.lower()))
            elif m["phone"]:
                if 7 <= len(digits) <= 15:
                    found.append((start, end, "phone", ("+" if value[0] == "+" else "") + digits))
            elif m["ip"]:
                found.append((start, end, "ip", ".".join(str(int(x)) for x in value.split("."))))
            elif m["national"]:
                found.append((start, end, "national", digits))
            elif m["card"]:
                if _valid(digits):
                    found.append((start, end, "card", digits))
            else:
                found.append((start, end, "access", value))
    for at, name in names(text):
        for kind, value, part in _name_parts(name):
            at = text.index(part, at)
            found.append((at, at + len(part), kind, value))
            at += len(part)
            if len(part) > 1:  # initials are no mention
                forms = (value, value + "а") if kind == "family2" else (part,)
                parts |= {form: (kind, value) for form in forms}
                capitals |= {form.upper(): (kind, value) for form in forms if len(form) > 2 and len(form.upper()) == len(form)}
    found.sort()
    out, end = [], 0
    for e in found:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return _with_mentions(text, out, capitals | parts) if parts else out


def _with_mentions(text: str, found: list[tuple[int, int, str, str]], parts: dict[str, tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """Entities, and between them the words that are parts of a name of the text."""
    out, k = [], 0
    for m in WHOLE.finditer(text):
        if m[0] not in parts:
            continue
        while k < len(found) and found[k][1] <= m.start():
            out.append(found[k])
            k += 1
        if k == len(found) or m.end() <= found[k][0]:
            out.append((m.start(), m.end(), *parts[m[0]]))
    return out + found[k:]


#: Kinds of names that come from closed lists.
LISTED = frozenset(("female", "male", "family", "female2", "male2", "family2"))


def _written(kind: str, original: str, surrogate: str) -> str:
    """The surrogate in the format of the occurrence."""
    if kind in ("phone", "card", "national"):
        digits = iter(surrogate.lstrip("+"))
        return "".join(next(digits) if "0" <= c <= "9" else c for c in original)
    if kind in ("email", "word"):
        return _cased(original, surrogate)
    if kind == "family2" and original[-1] in "аА":
        surrogate += "а"
    return surrogate.upper() if len(original) > 2 and original.isupper() and kind in LISTED else surrogate


def replaced(text: str | None, surrogates: Surrogates, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """A text with surrogates for its entities, and their number."""
    if not text:
        return text, 0
    out, at, found = [], 0, entities(text)
    for start, end, kind, value in found:
        original = text[start:end]
        out += [text[at:start], _written(kind, original, surrogates.of(kind, value, attempts.get((kind, value), 0)))]
        at = end
    return ("".join(out) + text[at:], len(found)) if found else (text, 0)


def _listed(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            found = {(kind, value) for t in batch.column(0) if t.is_valid for _, _, kind, value in entities(t.as_py())}
            rows = [(kind, value, surrogates.of(kind, value)) for kind, value in sorted(found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "value", "surrogate"]
            )

    return run


def _attempted(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            kinds, values, attempts = (batch.column(i).to_pylist() for i in range(3))
            new = [surrogates.of(*x) for x in zip(kinds, values, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], ["kind", "value", "attempt", "surrogate"])

    return run


def _rewritten(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                out = []
                for text, again in zip(piece.column(1), piece.column(2), strict=True):
                    attempts = {(x["kind"], x["value"]): x["attempt"] for x in again.as_py() or ()}
                    out.append(replaced(text.as_py(), surrogates, attempts))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())],
                    ["row", "text", "n_entities"],
                )

    return run


#: Kinds whose surrogates can't avoid the entities of a corpus: closed lists and words.
CLOSED = ("female", "male", "family", "female2", "male2", "family2", "word")


def _collisions(known: DataFrame) -> DataFrame:
    """Entities whose surrogate is their own value, or belongs to another entity of the
    kind with a smaller value."""
    owners = known.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count("*").alias("n"))
    return (
        known.join(owners.where("n > 1 OR surrogate = owner"), ["kind", "surrogate"])
        .where("value <> owner OR surrogate = value")
        .select("kind", "value", "attempt")
    )


def _met(known: DataFrame) -> DataFrame:
    """Entities whose surrogate is an entity of the corpus itself."""
    real = known.select("kind", F.col("value").alias("surrogate"))
    return known.where(~F.col("kind").isin(*CLOSED)).join(real, ["kind", "surrogate"], "left_semi").select("kind", "value", "attempt")


def retried(listed: DataFrame, key: bytes, rounds: int = 8) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate collides, each with
    the first attempt that doesn't; usually empty. The checks cover all entities, and
    what the corpus itself holds: a surrogate that is an entity there is tried again
    too (but for kinds of :data:`CLOSED`). An entity that after ``rounds`` further
    attempts still shares its surrogate, or keeps its value, stops the job; one whose
    surrogate only occurs in the corpus stays distinct and is accepted."""
    known = materialize(listed.withColumn("attempt", F.lit(0)).select("kind", "value", "attempt", "surrogate"), "entities")
    for _ in range(rounds):
        again = materialize(_collisions(known).unionByName(_met(known)).distinct(), "collisions")
        if again.isEmpty():
            break
        tried = again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(
            _attempted(key), "kind string, value string, attempt int, surrogate string"
        )
        known = materialize(known.join(again, ["kind", "value"], "left_anti").select("kind", "value", "attempt", "surrogate").unionByName(tried), "entities")
    else:
        left = _collisions(known).count()
        if left:
            raise RuntimeError(f"{left} entities have no surrogate of their own after {rounds} further attempts")
    return known.where("attempt > 0").select("kind", "value", "attempt")


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, k, v) for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if t.is_valid for k, v in {e[2:] for e in entities(t.as_py())}]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
            ["key", "kind", "value"],
        )


def with_surrogates(
    docs: DataFrame, *, key: bytes, text_col: str = "text", count_col: str | None = "n_entities"
) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced.

    Entities: e-mail addresses, phone numbers, IPv4 addresses, social security
    numbers, card numbers with a right check digit, names (after a title or a cue such
    as "my name is", before an e-mail address, or a listed given name and another
    capitalised word), access keys and values assigned to passwords or tokens. Surrogates are keyed and keep kind
    and format: digits stay digits, letters keep script and case, cards keep issuer and
    check digit, names keep gender (list, ending) and script. The same
    entity has the same surrogate in all documents and spellings; the distinct entities
    of the whole table are checked for collisions, and those that collide take another
    permutation, joined back by a hash of the text. Parts of a name are also replaced
    where the same text has them alone, in the same spelling.

    Keeps all rows and columns and adds ``count_col``, also in place of a column of that
    name (None: nothing). Null and empty
    texts stay as they are, so do texts without entities; repeated rows and null ids
    stay. An empty table stays empty. Entities without a surrogate of their own after
    all attempts stop the job.
    """
    listed = (
        docs.select(F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_listed(key), "kind string, value string, surrogate string")
        .distinct()
    )
    again = retried(listed, key)
    fields = [c for c in docs.columns if c != count_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"), F.xxhash64(F.col(text_col).cast("string")).alias("__key"), F.col(text_col).cast("string").alias("__text"))
    if again.isEmpty():
        rows = rows.withColumn("__again", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        per_doc = (
            rows.select("__key", "__text")
            .mapInArrow(_occurring, "key long, kind string, value string")
            .join(again, ["kind", "value"])
            .groupBy(F.col("key").alias("__key"))  # equal hashes only share attempts, which name their entity
            .agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("__again"))
        )
        rows = rows.join(per_doc, "__key", "left")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType())])
    done = rows.select("row", "__text", "__again").mapInArrow(_rewritten(key), schema)
    out = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in fields]
    return done.select(*out, *([F.col("n_entities").alias(count_col)] if count_col else []))
