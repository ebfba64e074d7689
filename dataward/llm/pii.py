"""Personal data in whole texts, disguised or not, with offsets into the source.

Plain detectors find e-mail addresses, IP addresses, card and phone numbers. Then transducers rewrite
disguises - homoglyphs, wide and foreign digits, invisible characters, spelled digits, "at" and "dot"
in brackets or words - into plain characters, each of which remembers the source characters it came
from. The detectors run again on the plain text; what they find there and holds a disguise is mapped
back and added, unless it lies within a plain span of its kind. Offsets count code points, ends are
exclusive. What a rewritten text stands for is kept by stretches, so a few disguises in a long text cost little.
Every transducer sees every text, so what is found in one place doesn't hang on the rest of the text.

Each detector takes leftmost matches that don't overlap; a match that fails its check is dropped and
not tried again in part. All of them are linear in the length of the text.

Defined results: a null or empty text has no spans; rows are independent, so repeated rows and ties
repeat; an empty table gives an empty result; other columns are ignored (redacted() keeps them, whatever
their names).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches, unused

KINDS = ("email", "ip", "card", "phone")
SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТХУЅІЈаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρ",
        "ABEKMHOPCTXYSIJaeopcyxijsdhqwABEZHIKMNOPTYXaovp",
        strict=True,
    )
)
# Other forms of signs.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "﹢": "+", "－": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "（": "(", "）": ")", "　": " ", "\xa0": " "}
# Characters that show nothing.
INVISIBLE = frozenset("­​‌‍‎‏⁠⁡⁢⁣⁤﻿")
# Digits as words, in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arobase", "arroba", "klammeraffe"), ("dot", "punkt", "point", "punto"), ("plus", "más")

_any = lambda words: "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w)))
AT, DOT, NUM = _any(AT_WORDS), _any(DOT_WORDS), _any(DIGIT_WORDS)
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
BRACKET_AT = re.compile(rf"\s{{0,3}}{OPEN}\s{{0,3}}(?:{AT}|@)\s{{0,3}}{CLOSE}\s{{0,3}}", re.I)
BRACKET_DOT = re.compile(rf"\s{{0,3}}{OPEN}\s{{0,3}}(?:{DOT}|\.)\s{{0,3}}{CLOSE}\s{{0,3}}", re.I)
#: name at host dot suffix, where either sign may also be plain but set apart by spaces.
WORDED = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?P<at>\s{{1,3}}(?:{AT}|@)\s{{1,3}}|@)(?P<host>[A-Za-z0-9-]{{1,63}}(?:(?:\s{{1,3}}(?:{DOT})\s{{1,3}}|\s{{1,3}}\.\s{{0,3}}|\.)[A-Za-z0-9-]{{1,63}}){{1,8}})", re.I)
WORDED_DOT = re.compile(rf"\s{{1,3}}(?:{DOT})\s{{1,3}}|\s{{1,3}}\.\s{{0,3}}", re.I)
NUMBER_DOT = re.compile(rf"(?<=[0-9])\s{{1,3}}(?:{DOT})\s{{1,3}}(?=[0-9])", re.I)
#: Runs of digits and digit words with at least three words, and a plus before them.
SPELLED = re.compile(rf"(?:(?<!\w)(?:{_any(PLUS_WORDS)})\s{{1,3}})?(?<!\w)(?:(?:{NUM})(?!\w)|[0-9]+(?!\w))(?:[\s,.()-]{{1,3}}(?:(?:{NUM})(?!\w)|[0-9]+(?!\w)))+", re.I)
SPELLED_UNIT = re.compile(rf"(?<!\w)(?P<plus>{_any(PLUS_WORDS)})\s{{1,3}}|(?<!\w)(?P<word>{NUM})(?!\w)|(?P<gap>[\s,.()-]+)", re.I)
#: Digits with letters that look like digits among them.
MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OolI]*[0-9])[0-9OolI]+(?![A-Za-z0-9])")
MIXED_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}

#: Letters that match i or s when case is ignored, though their lower case is another.
_CASES = {"İ": "i", "ı": "i", "ſ": "s"}
#: What every run with three digit words holds, in a text that has passed lowered(): far faster than SPELLED.
_three_words = re.compile(rf"(?<!\w)(?:{NUM})(?:[\s,.()-]{{1,3}}(?:[0-9]+[\s,.()-]{{1,3}})*(?:{NUM})){{2}}(?!\w)")
_bracketed = re.compile(rf"{OPEN}\s{{0,3}}(?:{AT}|{DOT}|@|\.)\s{{0,3}}{CLOSE}", re.I)
#: Decimal digits of all scripts, which stand in tens from 0 to 9.
_decimals = "".join(f"{c}-{chr(ord(c) + 9)}" for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) == 0)
_odd = re.compile("[" + "".join(map(re.escape, sorted({*LOOKALIKES, *SIGNS, *INVISIBLE}))) + _decimals + "⁰-₉①-⑳０-～\U0001d400-\U0001d7ff]")


def lowered(text: str) -> str:
    if not text.isascii():
        for c, x in _CASES.items():
            text = text.replace(c, x)
    return text.lower()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of undisguised identifiers."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Plain:
    """A text on its way to plain characters; each stretch of it knows the source characters it stands for.

    A stretch is (place in the text, source start, source end, rewritten); in a rewritten one every
    character stands for all its source characters, else each for its own.
    """

    def __init__(self, text: str):
        self.text, self.stretches, self.places = text, [(0, 0, len(text), False)], [0]

    @property
    def rewritten(self) -> bool:
        return len(self.stretches) != 1 or self.stretches[0][3]

    def source(self, start: int, end: int) -> list[tuple[int, int, bool]]:
        """(source start, source end, rewritten) of the stretches between two places."""
        out, i = [], bisect_right(self.places, start) - 1
        while i < len(self.stretches) and self.places[i] < end:
            at, a, b, new = self.stretches[i]
            last = self.places[i + 1] if i + 1 < len(self.places) else len(self.text)
            out.append((a, b, True) if new else (a + max(start, at) - at, a + min(end, last) - at, False))
            i += 1
        return out

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, end, new text) in order, none overlapping; new characters stand for all that they replace."""
        if not edits:
            return
        out, stretches, size, at = [], [], 0, 0

        def keep(start: int, end: int) -> None:
            nonlocal size
            begun = size
            for a, b, new in self.source(start, end) if start < end else ():
                stretches.append((size, a, b, new))
                size = min(size + b - a, begun + end - start) if not new else size
                if new:  # as many characters as the stretch has between the two places
                    i = bisect_right(self.places, start + size - begun) - 1
                    last = self.places[i + 1] if i + 1 < len(self.places) else len(self.text)
                    size = begun + min(last, end) - start
            out.append(self.text[start:end])

        for start, end, new in edits:
            keep(at, start)
            if new:
                held = self.source(start, end)
                stretches.append((size, held[0][0], held[-1][1], True))
                out.append(new)
                size += len(new)
            at = end
        keep(at, len(self.text))
        self.text, self.stretches = "".join(out), stretches or [(0, 0, 0, True)]
        self.places = [x[0] for x in self.stretches]


def folded(c: str) -> str:
    """A look-alike, sign, wide form or foreign digit as a plain character; invisible ones as nothing."""
    if c in INVISIBLE:
        return ""
    if (x := LOOKALIKES.get(c) or SIGNS.get(c)) is not None:
        return x
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and " " <= wide <= "~" else c


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in SPELLED.finditer(text) if _three_words.search(lowered(text)) else ():
        units = list(SPELLED_UNIT.finditer(text, *run.span()))
        if sum(u.lastgroup == "word" for u in units) < 3:
            continue
        for u in units:
            if u.lastgroup == "plus":
                edits.append((*u.span(), "+"))
            elif u.lastgroup == "word":
                edits.append((*u.span(), DIGIT_WORDS[lowered(u[0])]))
            elif len(u[0]) > 1 or u[0] not in " -":
                edits.append((*u.span(), " "))
    return edits


def worded_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in WORDED.finditer(text):
        worded_dots = [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in WORDED_DOT.finditer(m["host"])]
        set_apart = m["at"] != "@"
        if set_apart and m["at"].strip() != "@" and not worded_dots:
            continue  # "look at example.com": a word and a plain host are no disguise
        edits += [(*m.span("at"), "@")] * set_apart + worded_dots
    return edits


def disguised(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of identifiers that hold a disguise."""
    way = Plain(text)
    way.rewrite([(m.start(), m.end(), x) for m in _odd.finditer(way.text) if (x := folded(m[0])) != m[0]])
    if _bracketed.search(way.text):
        way.rewrite([(*m.span(), "@") for m in BRACKET_AT.finditer(way.text)])
        way.rewrite([(*m.span(), ".") for m in BRACKET_DOT.finditer(way.text)])
    way.rewrite(worded_edits(way.text))
    way.rewrite([(*m.span(), ".") for m in NUMBER_DOT.finditer(way.text)])
    way.rewrite(spelled_edits(way.text))
    way.rewrite([(m.start() + i, m.start() + i + 1, MIXED_DIGITS[c]) for m in MIXED.finditer(way.text) for i, c in enumerate(m[0]) if c in MIXED_DIGITS])
    if not way.rewritten:
        return []
    found = []
    for kind, start, end in plain(way.text):
        inside = way.source(start, end)
        gone = inside[-1][1] - inside[0][0] > sum(b - a for a, b, _ in dict.fromkeys(inside))  # invisible characters in between
        if gone or any(new for *_, new in inside):
            found.append((kind, inside[0][0], inside[-1][1]))
    return found


def spans(text: str | None) -> list[dict]:
    """All spans, by start and kind."""
    if not text:
        return []
    base = plain(text)
    added = [x for x in disguised(text) if not any(k == x[0] and a <= x[1] and x[2] <= b for k, a, b in base)]
    every = [(a, KINDS.index(k), b, True) for k, a, b in base] + [(a, KINDS.index(k), b, False) for k, a, b in dict.fromkeys(added)]
    return [{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in sorted(every)]


def redact(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in brackets; overlapping spans count as one."""
    if not text:
        return text
    out, at = [], 0
    for s in spans(text):
        if s["start"] >= at:
            out += (text[at : s["start"]], f"[{s['kind'].upper()}]")
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, text: str, name: str, kind: T.DataType, arrow: pa.DataType, of: Callable[[str | None], object]) -> DataFrame:
    """docs with `of` of each whole text as the column `name`, in place of one of that name."""
    names = [c for c in docs.columns if c != name]
    rows = text_batches(docs).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(unused(docs, "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                *kept, texts = batch.slice(part, 1000).columns
                yield pa.RecordBatch.from_arrays([*kept, pa.array([of(x) for x in texts.to_pylist()], arrow)], names=[*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, kind)]))


def found(docs: DataFrame, text: str = "text", spans_as: str = "spans") -> DataFrame:
    """docs with the spans of its text column: array of struct(kind, start, end, base)."""
    return _mapped(docs, text, spans_as, SPANS_TYPE, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])), spans)


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans: all spans as text."""
    rows = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(n, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each identifier of the text replaced by its kind in brackets; null and empty texts stay."""
    return _mapped(docs, "text", "text", T.StringType(), pa.string(), redact).select(*[F.col(f"`{c}`") for c in docs.columns])
