"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same type and
format: e-mail addresses, telephone, card, bank and social security numbers,
IP addresses, secrets, and personal names (same script, and same gender where
a title or given name tells it).

An entity's surrogate is generated from an HMAC of its canonical form, so all
its mentions, in whatever format and document, get the same surrogate
(coreference), and a given or family name alone matches the full name's.  The
distinct entities of the whole corpus are then checked: where two have the
same surrogate, or a surrogate is itself an entity of the corpus, all but the
first draw again until none is left (distinctness).  Only the entities that
had to draw again travel back to the documents: as a broadcast table up to
``BROADCAST_ENTITIES`` rows, beyond that joined per document.

Texts are read twice and not moved (unless that join is needed).

Defined cases: null texts stay null and empty ones empty; repeated rows give
repeated results; null ids travel like any column; texts of any length are
searched whole; overlapping matches go to the earlier kind in ``PATTERNS``;
matches without a letter or digit (masked values) are no entities;
an empty table gives an empty result; other columns travel unchanged.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.llm.common import fits, free_name, scratch_path, written

BROADCAST_ENTITIES = 500_000
#: From this attempt on a surrogate is longer than its entity, by a character
#: more with each attempt: an entity with few forms of its own length (``**1***``)
#: gets a free one all the same.
LONGER_FROM = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kinds in order of precedence; group ``v`` is what is replaced, if there is one.
PATTERNS = {
    "secret": re.compile(
        r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b\s*[:=]\s*[\"']?)(?P<v>[^\s\"'<>|,;]{6,})"
        r"|(?<![0-9A-Za-z])(?P<w>(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "email": re.compile(r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "ip": re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    "ssn": re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    "phone": re.compile(
        r"(?<![\d+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)"
        r"|(?<![\d+])\+(?!1\D)\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\d)"
        r"|(?<![\d(])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)"
        r"|(?<![\d\-])\d{3}-\d{4}(?![\d\-])"),
    "card": re.compile(r"(?<!\d)(?:\d{4}[ \-]){3}\d{1,7}(?!\d)|(?<!\d)\d{13,19}(?!\d)"),
}
#: Titles that come before a name (fixed values): gender by title.
TITLES = {
    "Mr": "M", "Mister": "M", "Sir": "M", "Herr": "M", "Monsieur": "M", "Señor": "M", "Sr": "M", "Don": "M",
    "Mrs": "F", "Ms": "F", "Miss": "F", "Madam": "F", "Frau": "F", "Madame": "F", "Mme": "F", "Mlle": "F", "Señora": "F", "Sra": "F", "Doña": "F",
    "Dr": "N", "Prof": "N", "Professor": "N",
    "господин": "M", "госпожа": "F", "г-н": "M", "г-жа": "F", "κύριος": "M", "κυρία": "F",
}
#: Given names that tell a name without a title (fixed values).
GIVEN = {
    "F": ["Anna", "Maria", "Emma", "Sophie", "Julia", "Laura", "Sarah", "Emily", "Marie", "Elena", "Carmen", "Lucía", "Claire", "Hannah", "Olivia", "Анна", "Мария", "Ольга", "Елена"],
    "M": ["John", "James", "Peter", "Paul", "Thomas", "Michael", "David", "Robert", "Hans", "Pierre", "Jean", "José", "Carlos", "Antonio", "William", "Иван", "Пётр", "Сергей", "Алексей"],
}
GENDER = {n: g for g, names in GIVEN.items() for n in names}
#: Syllables and endings that surrogate names are made of, by script (fixed values).
SYLLABLES = {
    "LATIN": "ba be bi bo bu da de di do du fa fe fi fo ga ge go ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no ra re ri ro ru sa se si so ta te ti to va ve vi vo za".split(),
    "CYRILLIC": "ба бе би бо ва ве ви во га ге го да де ди до за зе зи ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то фа фе".split(),
    "GREEK": "βα βε βι βο γα γε δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φι".split(),
    "CJK": list("安白成达恩方高国海和恒华建江杰金景康立林明宁平清荣瑞山生石书松天田文武贤新信星旭学阳远云泽正志中"),
}
ENDINGS = {
    ("LATIN", "F"): ["na", "lia", "ra"], ("LATIN", "M"): ["n", "rd", "s"], ("LATIN", "N"): ["l", "n", "r"],
    ("CYRILLIC", "F"): ["на", "лия", "ра"], ("CYRILLIC", "M"): ["н", "р", "с"], ("CYRILLIC", "N"): ["ль", "н", "й"],
    ("GREEK", "F"): ["να", "ία", "η"], ("GREEK", "M"): ["νος", "ρης", "ος"], ("GREEK", "N"): ["ν", "ς", "ρ"],
    ("CJK", "F"): list("芳娟兰丽梅娜婷雪燕玉"), ("CJK", "M"): list("刚浩军强涛伟勇峰斌磊"), ("CJK", "N"): list("文宇晨"),
}
FAMILY_ENDINGS = {("LATIN", g): ["ner", "ton", "ley", "mann"] for g in "FMN"} | {
    ("CYRILLIC", "F"): ["ова", "ина"], ("CYRILLIC", "M"): ["ов", "ин"], ("CYRILLIC", "N"): ["ко", "чук"],
    **{("GREEK", g): ["δου", "κη"] if g == "F" else ["δης", "κης"] for g in "FMN"}, **{("CJK", g): [""] for g in "FMN"}}

_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_TITLED = re.compile(rf"(?<!\w)(?P<t>{'|'.join(map(re.escape, TITLES))})\.? (?P<v>{_WORD}(?: {_WORD}){{0,2}})")
_KNOWN = re.compile(rf"(?<!\w)(?P<v>(?:{'|'.join(GENDER)}) {_WORD})")
_CJK = re.compile(r"(?P<v>[一-鿿]{2,3})(?P<t>先生|女士|小姐)")


class Mention(NamedTuple):
    start: int
    end: int
    kind: str  # type, and for names script and gender
    entity: str  # canonical form


def script_of(word: str) -> str:
    for c in word:
        name = unicodedata.name(c, "").split(" ")[0]
        if name in SYLLABLES:
            return name
    return "LATIN"


_DIGIT = re.compile(r"\d")
_TITLE_WORDS = sorted(TITLES)
_GIVEN_WORDS = sorted(GENDER)


def _kinds(text: str) -> list[str]:
    """Kinds of ``PATTERNS`` whose matches the text's characters allow."""
    number = _DIGIT.search(text) is not None
    return [k for k in PATTERNS if ("@" in text if k == "email" else number or (k == "secret" and ("=" in text or ":" in text)))]


def _canonical(kind: str, text: str) -> tuple[str, str]:
    digits = re.sub(r"\D", "", text)
    if kind == "email":
        return kind, text.lower()
    if kind == "phone" and text.startswith("+"):
        code = re.match(r"\+(1|\d{1,3}?(?=[ .\-(])|\d{2})", text)
        return "phone", f"+{code[1]} {digits[len(code[1]):]}"
    if kind in ("card", "ssn", "phone"):
        return kind, digits
    if kind == "iban":
        return kind, text.replace(" ", "")
    return kind, text


def _named(text: str) -> Iterator[Mention]:
    """Given and family names, each a mention of its own."""
    def words(m: re.Match, gender: str) -> Iterator[Mention]:
        at, parts = m.start("v"), []
        for w in m["v"].split(" "):
            if not w[0].isupper():
                break
            parts.append((at, w))
            at += len(w) + 1
        for k, (a, w) in enumerate(parts):
            family = k == len(parts) - 1
            script = script_of(w)
            # a family name shows its bearer's gender in Cyrillic and Greek only
            shown = gender if not family or script in ("CYRILLIC", "GREEK") else "N"
            yield Mention(a, a + len(w), f"{'family' if family else 'given'} {script} {shown}", w.casefold())

    # the patterns are only tried on texts that hold one of their fixed words
    titled = _TITLED.finditer(text) if any(w in text for w in _TITLE_WORDS) else ()
    given = _KNOWN.finditer(text) if any(w in text for w in _GIVEN_WORDS) else ()
    for m in titled:
        known = next((GENDER[w] for w in m["v"].split(" ") if w in GENDER), "N")
        yield from words(m, TITLES[m["t"]] if TITLES[m["t"]] != "N" else known)
    for m in given:
        if len(m["v"].split(" ")) > 1 and m["v"].split(" ")[1][0].isupper():
            yield from words(m, GENDER[m["v"].split(" ")[0]])
    for m in () if text.isascii() else _CJK.finditer(text):
        gender = "M" if m["t"] == "先生" else "F"
        a, b = m.span("v")
        yield Mention(a, a + 1, "family CJK N", m["v"][0])
        yield Mention(a + 1, b, f"given CJK {gender}", m["v"][1:])


def detect(text: str) -> list[Mention]:
    """Mentions that do not overlap, in text order."""
    found: list[Mention] = []  # in text order, so only the neighbours can overlap

    def add(m: Mention) -> None:
        at = bisect.bisect_left(found, m.start, key=lambda x: x.start)
        if (at == 0 or found[at - 1].end <= m.start) and (at == len(found) or m.end <= found[at].start):
            found.insert(at, m)

    for kind in _kinds(text):
        for m in PATTERNS[kind].finditer(text):
            group = next((g for g in ("v", "w") if m.groupdict().get(g)), 0)
            if any(c.isalpha() or c.isdigit() for c in m[group]):
                add(Mention(*m.span(group), *_canonical(kind, m[group])))
    names = list(_named(text))
    for m in names:
        add(m)
    if names:  # later mentions of the same names alone
        kinds = {text[m.start:m.end]: m for m in reversed(names)}
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(kinds, key=len, reverse=True)))})(?!\w)")
        for x in again.finditer(text):
            m = kinds[x[0]]
            add(Mention(x.start(), x.end(), m.kind, m.entity))
    return found


# -- surrogates ------------------------------------------------------------

class _Stream:
    """Keyed choices for one entity."""

    def __init__(self, key: bytes, *what: str):
        self.seed = hmac.new(key, "\0".join(what).encode(), hashlib.sha256).digest()
        self.left, self.turn = 0, 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.left = int.from_bytes(hashlib.sha256(self.seed + self.turn.to_bytes(4, "big")).digest(), "big")
            self.turn += 1
        self.left, out = divmod(self.left, n)
        return out

    def pick(self, items):
        return items[self.below(len(items))]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _like(s: _Stream, text: str) -> str:
    """Each letter and digit by another of its kind and script (a hexadecimal text stays one)."""
    letters = "abcdef" if re.fullmatch(r"[0-9a-fA-F]+", text) else "abcdefghijklmnopqrstuvwxyz"
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(s.below(10)))
        elif c.isalpha():
            x = s.pick(letters if c.isascii() or script_of(c) == "LATIN" else sorted(set("".join(SYLLABLES[script_of(c)]))))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """Canonical form of the entity's surrogate."""
    s = _Stream(key, kind, entity, str(attempt))
    longer = max(0, attempt - LONGER_FROM + 1)
    more = "".join(str(s.below(10)) for _ in range(longer))
    if kind == "email":
        # addresses of one domain stay together
        local, domain = entity.rsplit("@", 1)
        labels = domain.split(".")
        d = _Stream(key, "domain", domain)
        return _like(s, local) + more + "@" + ".".join([*(_like(d, x) for x in labels[:-1]), labels[-1]])
    if kind == "phone":
        head, _, rest = entity.rpartition(" ")
        return f"{head} {_like(s, rest)}{more}".strip()
    if kind == "ip":
        # four octets at any attempt: there are billions of them
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        out = entity[0] + _like(s, entity[1:]) + more
        return next(x for x in (out[:-1] + str(d) for d in range(10)) if _luhn(x)) if _luhn(entity) else out
    if kind == "iban":
        return entity[:2] + _like(s, entity[2:]) + more
    if kind.startswith(("given", "family")):
        what, script, gender = kind.split(" ")
        n = 1 if script == "CJK" and what == "family" else 2 + s.below(2) - (script == "CJK")
        out = "".join(s.pick(SYLLABLES[script]) for _ in range(n + attempt))
        return out + s.pick((ENDINGS if what == "given" else FAMILY_ENDINGS)[script, gender])
    return _like(s, entity) + more


def render(mention: str, kind: str, new: str) -> str:
    """The surrogate in the format of the mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(new.replace("+", "").replace(" ", ""))
        return "".join(next(chars) if c.isalnum() else c for c in mention) + "".join(chars)
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind.startswith(("given", "family")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new[0].upper() + new[1:]
    return new


# -- over a table ----------------------------------------------------------

ENTITY = "kind string, entity string"


def entities(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct (kind, entity) of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = sorted({(m.kind, m.entity) for t in b.column(0).to_pylist() if t for m in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([e for _, e in seen], pa.string())], names=["kind", "entity"])
    return docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, ENTITY).distinct()


def _draw(rows: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, new) of rows (kind, entity, attempt)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, *x) for x in zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "attempt")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "entity", "attempt")), pa.array(new, pa.string())], names=["kind", "entity", "attempt", "new"])
    return rows.select("kind", "entity", "attempt").mapInArrow(run, f"{ENTITY}, attempt int, new string")


def assign(found: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(kind, entity, attempt, new) of all entities with distinct surrogates
    that are no entities, and those of them that drew more than once."""
    spark = found.sparkSession
    path = scratch_path(spark, "surrogates")
    schema = f"{ENTITY}, attempt int, new string"
    # kinds that could be taken for one another share one space
    space = F.split("kind", " ")[0]
    real = found.select(space.alias("space"), F.col("entity").alias("new")).distinct()
    waiting, turn, settled = found.withColumn("attempt", F.lit(0)), 0, None
    while True:
        drawn = written(_draw(waiting, key).withColumn("space", space), "drawn")
        # the first of those that drew the same, unless it is taken or real
        first = drawn.groupBy("space", "new").agg(F.min(F.struct("kind", "entity")).alias("first")).join(real, ["space", "new"], "left_anti")
        if settled is not None:
            first = first.join(settled.select(space.alias("space"), "new"), ["space", "new"], "left_anti")
        won = first.select(F.col("first.kind").alias("kind"), F.col("first.entity").alias("entity"))
        drawn.join(won, ["kind", "entity"], "left_semi").select("kind", "entity", "attempt", "new").write.parquet(f"{path}/turn={turn}")
        settled = spark.read.schema(schema).parquet(*[f"{path}/turn={i}" for i in range(turn + 1)])
        waiting = written(drawn.join(settled.select("kind", "entity"), ["kind", "entity"], "left_anti")
                          .select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), "drawing-again")
        if waiting.isEmpty():
            again = spark.read.schema(schema).parquet(*[f"{path}/turn={i}" for i in range(1, turn + 1)]) if turn else settled.limit(0)
            return settled, again
        turn += 1


def replace(text: str, key: bytes, drawn: dict[tuple[str, str], str]) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and the number of mentions of each type."""
    out, upto, n = [], 0, {}
    for m in detect(text):
        new = drawn.get((m.kind, m.entity)) or surrogate(key, m.kind, m.entity)
        out += [text[upto:m.start], render(text[m.start:m.end], m.kind, new)]
        upto = m.end
        kind = m.kind.split(" ")[0]
        n[kind] = n.get(kind, 0) + 1
    return "".join([*out, text[upto:]]), n


def replace_personal_data(docs: DataFrame, key: bytes, text_col: str = "text", counts: str = "n_mentions",
                          broadcast_entities: int = BROADCAST_ENTITIES) -> DataFrame:
    """``docs`` with surrogates in its text and the mentions per type in column ``counts``."""
    sc = docs.sparkSession.sparkContext
    counts = free_name(docs.columns, counts)
    extra = free_name(docs.columns, "_drawn")
    _, again = assign(written(entities(docs, text_col), "entities"), key)
    if fits(again, broadcast_entities):
        table = sc.broadcast({(r["kind"], r["entity"]): r["new"] for r in again.collect()})
        base = docs.withColumn(extra, F.lit(None).cast("array<struct<kind: string, entity: string, new: string>>"))
    else:
        table = None
        base = _with_drawn(docs, again, text_col, extra)
    at, drawn_at = docs.columns.index(text_col), len(docs.columns)
    names = [*docs.columns, counts]
    schema = T.StructType([*docs.schema.fields, T.StructField(counts, T.MapType(T.StringType(), T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = [], []
            for t, own in zip(b.column(at).to_pylist(), b.column(drawn_at).to_pylist()):
                drawn = table.value if table is not None else {(x["kind"], x["entity"]): x["new"] for x in own or ()}
                t, k = (None, {}) if t is None else replace(t, key, drawn)
                texts.append(t)
                n.append(list(k.items()))
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:drawn_at])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.map_(pa.string(), pa.int32()))], names=names)

    return base.mapInArrow(run, schema)


def _with_drawn(docs: DataFrame, again: DataFrame, text_col: str, extra: str) -> DataFrame:
    """``docs`` with the redrawn surrogates of the entities of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, m.kind, m.entity) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t
                    for m in {(m.kind, m.entity): m for m in detect(t)}.values()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string()))], names=["h", "kind", "entity"])
    text = F.col(f"`{text_col}`")
    digest = F.unhex(F.sha2(text, 256))
    held = docs.select(digest.alias("h"), text.alias("t")).mapInArrow(run, f"h binary, {ENTITY}").distinct()
    lists = held.join(again, ["kind", "entity"]).groupBy("h").agg(F.collect_list(F.struct("kind", "entity", "new")).alias(extra))
    h = free_name([*docs.columns, extra], "_h")
    return docs.withColumn(h, digest).join(lists.withColumnRenamed("h", f"{h}2"), F.col(h) == F.col(f"{h}2"), "left").select(*[F.col(f"`{c}`") for c in docs.columns], extra)
