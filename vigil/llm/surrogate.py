"""Surrogates for personal data.

Detected entities are replaced by made-up ones of the same type and format:
digits for digits, letters for letters of the same script and case, valid
octets, check digits that hold where they held, names that keep the gender
their title shows.  Replacements follow from a secret key, so an entity has
the same surrogate in every document, however it is written (coreference).
Names are found by a title, and further mentions of a full name or surname in
the same document without one; each part of a name has its own surrogate, so
full names and surnames agree.  Collision checks over all distinct entities keep surrogates
distinct from each other and from every entity that occurs.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, free_name, to_scratch

_TITLES = {"f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|г-жа|κυρία",
           "m": "Mr|Sir|Herr|Monsieur|Señor|Sr|г-н|κύριος", "n": "Dr|Prof"}
_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]{1,30}"
_TITLE = "|".join(_TITLES.values())
_PART = rf"(?:[^\W\d_a-zà-öø-ÿа-яα-ω]['’])?{_NAME}"
_WORD = rf"{_PART}(?:-{_PART})*"
_INITIAL = r"[^\W\d_a-zà-öø-ÿа-яα-ω]\."
_PARTICLES = "van|von|der|den|de|del|della|la|le|du|di|da|dos|zu|zur|bin|ibn|al"
_GENDER = {t.lower(): g for g, ts in _TITLES.items() for t in ts.split("|")}
# each pattern starts at a boundary, so that long runs are read once
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\w)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w])"
                         r"|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+-])\d{3}-\d{3}-\d{4}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("name", re.compile(rf"(?<!\w)(?P<title>{_TITLE})\b\.? (?:(?:{_TITLE})\b\.? )*"
                        rf"(?P<name>(?:{_INITIAL} ?)*(?:(?:{_PARTICLES}) )*{_WORD}(?!\w)"
                        rf"(?: (?:{_INITIAL} ?)*(?:(?:{_PARTICLES}) )*{_WORD}(?!\w))*)")),
]
_WORDS = re.compile(rf"(?<![\w'’-]){_WORD}(?!\w)")
_GAP = re.compile(rf" (?:(?:{_INITIAL}|{_PARTICLES}) ?)*")
_SUFFIXES = {"jr", "sr", "junior", "senior", "ii", "iii", "iv"}
_PARTS = re.compile(rf"(?<![\w'’]){_PART}(?!\w)")


def may_hold(text: str) -> Column:
    """True for every text with an entity: a digit or @, or a title that
    something follows."""
    c = F.col(text).cast("string")
    out = c.rlike("[0-9@]")
    for title in "|".join(_TITLES.values()).split("|"):
        out = out | F.contains(c, F.lit(title + " ")) | F.contains(c, F.lit(title + ". "))
    return F.coalesce(out, F.lit(False))


_SCRIPTS = {
    "latin": ("ba be bi bo da de di do ga ka ke ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te ti to va ve vi".split(),
              {"f": "a ina ella".split(), "m": "o us ert".split(), "n": "el in ar".split()}),
    "cyrillic": ("ба бе би бо ва ве ви да де до ка ко ла ле ли ма ме ми на не но ра ре ро са се со та те то".split(),
                 {"f": "ова ина".split(), "m": "ов ин".split(), "n": "ко ук".split()}),
    "greek": ("βα βε γα γε δα δε κα κε λα λε μα με να νε πα πε ρα ρε σα σε τα τε".split(),
              {"f": "ου α".split(), "m": "ος ης".split(), "n": "ακη".split()}),
}


#: attempts in a format before it gets longer
ROOM = 16


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    """Bytes that follow from the key and the parts."""
    n = 0
    while True:
        yield from hmac.new(key, "\x1f".join((*parts, str(n))).encode("utf-8", "replace"),
                            hashlib.sha256).digest()
        n += 1


def _script(s: str) -> str:
    c = next((c for c in s if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _luhn(digits: str) -> int:
    """The check sum of a card number; 0 in a valid one."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
               for i, d in enumerate(map(int, reversed(digits)))) % 10


def normal(kind: str, value: str, gender: str = "n") -> str:
    """What is common to all spellings of an entity."""
    if kind == "email":
        return value.lower()
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "name":
        return f"{gender}:{value.casefold()}"
    if kind == "ip":
        return value
    return "".join(c for c in value if c.isdigit())


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The replacement of a normal form; another one for another attempt.
    After every ``ROOM`` attempts the format gets one sign longer, so there is
    always room in the end."""
    more = attempt // ROOM
    rnd = _stream(key, kind, norm, str(attempt))

    def pick(options: str | list[str]) -> str:
        return options[(next(rnd) << 16 | next(rnd) << 8 | next(rnd)) % len(options)]
    digit, letter = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    if kind == "name":
        gender, name = norm.split(":", 1)
        out = []
        for word in name.split(" "):
            parts, ends = _SCRIPTS[_script(word)]
            out.append("".join(pick(parts) for _ in range(2 + attempt // 4 + next(rnd) % 2)) + pick(ends[gender]))
        return f"{gender}:" + " ".join(out)
    if kind == "ip":
        sizes = [min(3, len(o) + more) for o in norm.split(".")]
        ends = [pick([str(x) for x in range(10 ** (n - 1), min(255, 10 ** n))]) for n in sizes]
        return ".".join(ends + [pick(digit) + pick(digit) for _ in range(max(0, more - 2))])
    if kind == "email":
        head, tld = norm.rsplit(".", 1)
        return "".join(pick(letter) for _ in range(more)) + "".join(
            pick(digit) if c.isdigit() else pick(letter) if c.isalpha() else c for c in head) + "." + tld
    if kind == "iban":
        return norm[:2] + "".join(pick(digit) if c.isdigit() else pick(letter).upper() for c in norm[2:]) + "".join(
            pick(digit) for _ in range(more))
    out = [pick(digit[1:])] + [pick(digit) for _ in norm[1:]] + [pick(digit) for _ in range(more)]
    if kind == "phone":  # the country code stays
        out[:1] = norm[:1]
    if kind == "card" and _luhn(norm) == 0:
        out[-1] = "0"
        out[-1] = str(-_luhn("".join(out)) % 10)
    return "".join(out)


def render(kind: str, value: str, norm: str) -> str:
    """A normal form written the way ``value`` is."""
    if kind == "name":
        words = norm.split(":", 1)[1].split(" ")
        return " ".join(w.upper() if len(v) > 1 and v.isupper() else w[:1].upper() + w[1:]
                        for w, v in zip(words, value.split(" ")))
    if kind == "email":
        longer = len(norm) - len(value)
        return norm[:longer] + "".join(n.upper() if v.isupper() else n for n, v in zip(norm[longer:], value))
    if kind == "ip":
        return norm
    left = iter(norm)
    return "".join(next(left) if c.isalnum() else c for c in value) + "".join(left)


def _mentions(text: str, names: list[list[str]]) -> list[tuple[int, int]]:
    """Spans of the mentions, capitalised as names are, of the full names and
    surnames (the last word, and its parts between hyphens)."""
    given: dict[str, set[str]] = {}
    for words in names:
        for last in {words[-1], *words[-1].split("-")}:
            given.setdefault(last, set()).update(words[:-1])
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int, str]] = []
    for m in _WORDS.finditer(text):
        a, b = m.span()
        word = m.group().casefold()
        if not run or a - run[-1][1] > 40 or not _GAP.fullmatch(text, run[-1][1], a):
            run = []
        run.append((a, b, word))
        if word in given:
            start = a
            for at, _, before in reversed(run[:-1]):
                if before not in given[word]:
                    break
                start = at
            while out and out[-1][0] >= start:  # a given name that is a surname as well
                start = min(start, out.pop()[0])
            out.append((start, b))
            run = []
    return out


def find_entities(text: str) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, kind, normal form, first of its entity) in order, none
    overlapping: what an earlier pattern takes is blank to the later ones.  A
    name gives a row for each of its parts."""
    out: list[tuple[int, int, str, str, bool]] = []
    names: list[list[str]] = []

    def blank(text: str, spans: list[tuple[int, int]]) -> str:
        at, parts = 0, []
        for a, b in spans:
            parts += [text[at:a], "\0" * (b - a)]
            at = b
        return "".join(parts) + text[at:]

    def add_name(a: int, b: int, gender: str) -> None:
        for n, m in enumerate(_PARTS.finditer(text, a, b)):
            out.append((m.start(), m.end(), "name", normal("name", m.group(), gender), not n))
    for kind, pattern in PATTERNS:
        spans = []
        for m in pattern.finditer(text):
            a, b = m.span("name") if kind == "name" else m.span()
            spans.append((a, b))
            if kind == "name":
                add_name(a, b, _GENDER.get(m.group("title").lower(), "n"))
                words = [w.group().casefold() for w in _WORDS.finditer(text, a, b)]
                names.append([w for w in words if w not in _SUFFIXES] or words)
            else:
                out.append((a, b, kind, normal(kind, text[a:b]), True))
        if spans:
            text = blank(text, spans)
    if names:
        for a, b in _mentions(text, names):
            add_name(a, b, "n")
    return sorted(out)


def one_gender(entities: DataFrame) -> DataFrame:
    """(kind, norm, resolved) for every distinct (kind, norm): a part of a name
    has one gender in all documents, the one that its titles show, neuter if
    they show none or both."""
    known = to_scratch(entities.select("kind", "norm").distinct(), "entity-norms")
    name = F.col("kind") == "name"
    word = F.when(name, F.expr("substring(norm, 3)"))
    shown = F.when(~F.col("norm").startswith("n:"), F.substring("norm", 1, 1))
    genders = known.where(name).groupBy(word.alias("word")).agg(F.min(shown).alias("a"), F.max(shown).alias("b"))
    gender = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("n")
    return to_scratch(known.withColumn("word", word).join(genders, "word", "left").select(
        "kind", "norm", F.when(name, F.concat(gender, F.lit(":"), "word")).otherwise(F.col("norm")).alias("resolved")),
        "entity-genders")


def occurrences(docs: DataFrame, text: str) -> DataFrame:
    """Written table of entities in the distinct texts: text_hash, start,
    length, kind, value, norm, first (of the parts of a name)."""
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame(
                [(h, a, b - a, kind, t[a:b], norm, first) for h, t in zip(p["text_hash"], p["text"])
                 for a, b, kind, norm, first in find_entities(t)],
                columns=["text_hash", "start", "length", "kind", "value", "norm", "first"])
    rows = bounded_batches(docs).where(may_hold(text)).select(
        F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return to_scratch(rows.mapInPandas(
        find, "text_hash long, start long, length long, kind string, value string, norm string, "
        "first boolean"), "entities")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, new) for every distinct (kind, norm): all ``new`` of a kind
    differ from each other and from every norm of it.

    Each round makes the surrogates of the entities still open and checks them
    against all norms and all surrogates given before; of several that agree,
    the first by norm keeps it, the others try again.
    """
    @F.pandas_udf("string")
    def make(kind: pd.Series, norm: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, n, a) for k, n, a in zip(kind, norm, attempt)], dtype=object)
    known = to_scratch(entities.select("kind", "norm").distinct(), "entity-list")
    taken, open_, done = known, known, None
    for attempt in count():
        tried = open_.withColumn("new", make("kind", "norm", F.lit(attempt)))
        first = tried.groupBy("kind", "new").agg(F.min("norm").alias("norm"))
        free = first.join(taken.select("kind", F.col("norm").alias("new")), ["kind", "new"], "left_anti")
        given = to_scratch(free.select("kind", "norm", "new"), "surrogates")
        done = given if done is None else done.unionByName(given)
        taken = taken.unionByName(given.select("kind", F.col("new").alias("norm")))
        open_ = to_scratch(open_.join(given, ["kind", "norm"], "left_anti"), "entity-open")
        if open_.isEmpty():
            return done


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the entities of the text column replaced, and n_entities
    (replacing a column of this name).

    All rows stay, repeated ones too; null texts stay null, with 0 entities;
    texts without an entity stay as they are.  Extra columns pass.  ``key`` is
    the secret; another key gives other surrogates.  Texts that cannot hold an
    entity are neither joined nor moved.
    """
    docs = docs.drop("n_entities")
    h, s = free_name(docs, "_hash"), free_name(docs, "_spans")
    found = occurrences(docs, text)
    genders = one_gender(found)
    new = assign(genders.select("kind", F.col("resolved").alias("norm")), key.encode())
    new = genders.join(new.withColumnRenamed("norm", "resolved"), ["kind", "resolved"]).drop("resolved")
    named = found.join(new, ["kind", "norm"])
    spans = named.groupBy(F.col("text_hash").alias(h)).agg(F.sort_array(F.collect_set(
        F.struct("start", "length", "kind", "value", "new", "first"))).alias(s))

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, where in zip(texts, spans):
            if where is not None and t is not None:
                at, parts = 0, []
                for w in where:
                    parts += [t[at:w["start"]], render(w["kind"], w["value"], w["new"])]
                    at = w["start"] + w["length"]
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)
    may = may_hold(text)
    some = docs.where(may).withColumn(h, F.xxhash64(text)).join(spans, h, "left")
    n = F.greatest(F.coalesce(F.size(F.filter(s, lambda x: x["first"])), F.lit(0)), F.lit(0)).cast("long")
    some = some.withColumn("n_entities", n).withColumn(text, F.when(F.col(s).isNull(), F.col(text)).otherwise(
        rewrite(F.col(text).cast("string"), F.col(s))))
    return some.select(*docs.columns, "n_entities").unionByName(
        docs.where(~may).withColumn("n_entities", F.lit(0).cast("long")))
