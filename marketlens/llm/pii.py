"""Personal data in plain and disguised writing, found at its place in the source text.

A text is scanned as it is; what is found there is the base. Then transducers rewrite it, each keeping where its output comes
from: letters that look like ASCII ones, other digits, dashes and spaces become ASCII, invisible characters go (``homoglyphs``);
spelled digits become digits and written-out at, dot and plus signs become the signs (``spellings``). The same detectors scan the rewritten
text, and each match is carried back through the transducers to the characters it stands for. A match adds a span if it rests on a rewritten
character and no base span of its kind overlaps it; a longer e-mail address around a base one is added beside it.

All detectors and transducers take time in proportion to the text. E-mail addresses are found from their @, going left; runs of digits are
taken whole, since a match that fails is not tried again inside its run.

A bare "at" is a word like any other, so it becomes a sign only before a domain whose dots are spelled out too, or in brackets; other languages' words for
dot only between digits or in such a domain. Look-alikes of digits (O, o, l, I, |) count only in a run of digits.

Defined results: null text counts as empty and has no spans; ties and repeated rows are judged alike, row by row; an empty
table gives an empty result; very long texts are scanned whole; further columns of the input are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, start: long, stop: long, base: boolean, value: string>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Match = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[Match]:
    done = 0
    for found in AT_DOMAIN.finditer(text):
        start = at = found.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            done = found.end()
            yield "email", start, done


def addresses(text: str) -> Iterator[Match]:
    for found in IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in found.group().split("."))):
            yield "ip", found.start(), found.end()


def cards(text: str) -> Iterator[Match]:
    for found in DIGITS.finditer(text):
        if found.end() - found.start() > 12:
            digits = found.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", found.start(), found.end()


def phones(text: str) -> Iterator[Match]:
    for found in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in found.group()) <= 15:
            yield "phone", found.start(), found.end()


def detect(text: str) -> list[Match]:
    """All matches by kind as in KINDS, then start."""
    return [*(emails(text) if "@" in text else ()), *addresses(text), *cards(text), *(phones(text) if "+" in text else ())]


@dataclass
class Rewritten:
    """A text whose pieces come from places of a source: piece i is text[at[i]:at[i + 1]], from source[left[i]:right[i]].

    A piece is either copied, character by character, or ``changed`` as a whole.
    """

    text: str
    at: list[int]
    left: list[int]
    right: list[int]
    changed: list[bool]

    def back(self, start: int, stop: int) -> tuple[int, int, bool]:
        """The source range of text[start:stop], and whether a changed piece lies in it."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, stop - 1) - 1
        begin = self.left[first] if self.changed[first] else self.left[first] + start - self.at[first]
        end = self.right[last] if self.changed[last] else self.left[last] + stop - self.at[last]
        return begin, end, any(self.changed[first : last + 1])


def rewrite(text: str, edits: Iterator[tuple[int, int, str]]) -> Rewritten | None:
    """The text with source ranges, in order and apart, replaced; None if there are none. An empty replacement is no piece."""
    out: list[str] = []
    at, left, right, changed = [], [], [], []
    done = size = 0

    def piece(new: str, start: int, stop: int, is_new: bool) -> None:
        nonlocal size
        if new:
            out.append(new)
            at.append(size)
            left.append(start)
            right.append(stop)
            changed.append(is_new)
            size += len(new)

    touched = False
    for start, stop, new in edits:
        touched = True
        piece(text[done:start], done, start, False)
        piece(new, start, stop, True)
        done = stop
    if not touched:
        return None
    piece(text[done:], done, len(text), False)
    return Rewritten("".join(out), at, left, right, changed)


# Letters of other scripts, and Latin ones, that look like an ASCII letter, each before what it looks like.
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw ӏl АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW "
    "αa οo ρp υu νv ιi κk ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ıi ɑa ɡg ɩi ʏy"
)
#: Signs beside what stands for them; marks that join the words they stand between are deleted with the invisible ones.
SIGNS = {"。": ".", "․": ".", "∙": ".", "⋅": ".", "−": "-", "⁃": "-"}


def _lookalike_table() -> dict[int, str]:
    """What stands for one ASCII character: by compatibility, digits of all scripts, dashes, spaces, look-alikes; '' for invisible ones."""
    table: dict[int, str] = {}
    for point in range(0x80, 0x20000):
        char = chr(point)
        kind = unicodedata.category(char)
        plain = unicodedata.normalize("NFKC", char)
        if kind == "Nd":
            table[point] = str(unicodedata.digit(char))
        elif kind == "Pd":
            table[point] = "-"
        elif kind == "Zs":
            table[point] = " "
        elif kind == "Cf":
            table[point] = ""
        elif len(plain) == 1 and " " < plain < "\x7f":
            table[point] = plain
    table |= {ord(pair[0]): pair[1] for pair in LOOKALIKES.split()}
    return table | {ord(sign): plain for sign, plain in SIGNS.items()}


HOMOGLYPHS = _lookalike_table()
_FOREIGN = re.compile("[" + "".join(f"\\U{p:08x}" for p in sorted(HOMOGLYPHS)) + "]")


def homoglyphs(text: str) -> Rewritten | None:
    """Single characters that stand for an ASCII one, rewritten."""
    if text.isascii():
        return None
    return rewrite(text, ((m.start(), m.end(), HOMOGLYPHS[ord(m.group())]) for m in _FOREIGN.finditer(text)))


# The ten digits in the languages of the corpus, names of signs, characters typed for a digit.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
AT_WORDS = "at arroba arobase klammeraffe"
DOT_WORDS = "dot punkt point punto"
PLUS_WORDS = "plus más"
ENTITIES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": ".", "&#43;": "+", "&plus;": "+"}
TYPED_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1"}

DIGIT_OF = {word: str(n) for words in DIGIT_WORDS.values() for n, word in enumerate(words.split())} | {"oh": "0"}
REPEATS = {"double": 2, "triple": 3}



def _any(words: str | list[str]) -> str:
    every = words.split() if isinstance(words, str) else words
    return "(?:" + "|".join(sorted(map(re.escape, every), key=len, reverse=True)) + ")"


_LETTER, _BLANK, _GAP, _LABEL = r"[^\W_]", r"[\x20\x09]{0,2}", r"[\x20\x09-\x0D]{1,3}", r"[A-Za-z0-9-]+"
_BETWEEN = re.compile(r"[\x20\x09-\x0D,;/-]{1,3}")
_DIGIT, _AT, _DOT, _PLUS = _any(list(DIGIT_OF)), _any(AT_WORDS), _any(DOT_WORDS), _any(PLUS_WORDS)
_WHOLE_DIGIT = rf"(?<!{_LETTER}){_DIGIT}(?!{_LETTER})"
_SPELLED = re.compile(
    "|".join(
        [
            rf"{_BLANK}[\[({{<]{_BLANK}(?:(?P<boxed_at>@|a|{_AT})|(?P<boxed_dot>\.|{_DOT})){_BLANK}[\])}}>]{_BLANK}",
            rf"(?<={_LETTER})(?P<bare_at>{_GAP}{_AT}{_GAP})(?={_LABEL}{_GAP}{_DOT}{_GAP}[A-Za-z])",
            rf"(?P<repeat>(?<!{_LETTER}){_any(list(REPEATS))}){_GAP}(?P<repeated>{_WHOLE_DIGIT}|[0-9](?![0-9]))",
            rf"(?P<digit>{_WHOLE_DIGIT})",
            rf"(?<={_LETTER})(?P<dot>{_GAP}{_DOT}{_GAP})(?={_LETTER})",
            rf"(?P<plus>(?<!{_LETTER}){_PLUS}{_GAP})(?={_WHOLE_DIGIT}|[0-9])",
            rf"(?P<entity>{_any(list(ENTITIES))})",
            r"(?P<typed>(?-i:(?<![A-Za-z0-9|])(?:(?=[Oo|lI]*[0-9])[0-9Oo|lI]{2,}+(?![A-Za-z0-9|])|[Oo|lI](?=\.[0-9Oo|lI])|(?<=\.)[Oo|lI](?![A-Za-z0-9|]))))",
        ]
    ),
    re.IGNORECASE,
)
#: Texts that may hold a spelling that matters: a sign, or a digit beside another one. A superset, for a linear-time engine, without case.
_HINT = "|".join(
    [
        rf"[\[({{<]{_BLANK}(?:@|a|{_AT}|\.|{_DOT}){_BLANK}[\])}}>]",
        rf"{_GAP}{_AT}{_GAP}{_LABEL}{_GAP}{_DOT}{_GAP}",
        rf"[\x20\x09-\x0D]dot[\x20\x09-\x0D]",
        rf"(?:[0-9]|{_DIGIT}){_GAP}{_DOT}{_GAP}(?:[0-9]|{_DIGIT})",
        rf"(?:\b{_DIGIT}|[0-9])[\x20\x09-\x0D,;/-]{{1,3}}{_DIGIT}\b",
        rf"\b{_DIGIT}[\x20\x09-\x0D,;/-]{{1,3}}[0-9]",
        rf"\b{_any(list(REPEATS))}{_GAP}(?:[0-9]|{_DIGIT})",
        rf"\b{_PLUS}{_GAP}(?:[0-9]|{_DIGIT})",
        _any(list(ENTITIES)),
        r"[0-9]\.?[o|li]|[o|li]\.?[0-9]",
    ]
)
_FOREIGN_HINT = "[" + "".join(f"\\x{{{p:x}}}" for p in sorted(HOMOGLYPHS)) + "]"


def _spelled_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Replacements of spelled digits and signs. Digits spelled one after another are joined."""
    digit_end = sign_end = -1  # where the last digit or plus, and the last at or dot, ended
    for m in _SPELLED.finditer(text):
        kind, start, stop = m.lastgroup, m.start(), m.end()
        if kind in ("digit", "repeated"):
            word = m.group(kind).lower()
            digit = DIGIT_OF.get(word, word if word.isdigit() else "")
            if not digit:
                continue
            if digit_end >= 0 and _BETWEEN.fullmatch(text, digit_end, start):
                yield digit_end, start, ""
            yield start, stop, digit * (REPEATS.get(m.group("repeat").lower(), 1) if kind == "repeated" else 1)
            digit_end = stop
        elif kind == "dot":
            english = text[start:stop].strip().lower() == "dot"
            in_domain = sign_end >= 0 and all(c == "-" or (c.isascii() and c.isalnum()) for c in text[sign_end:start])
            if english or in_domain or digit_end == start or text[start - 1] in "0123456789":
                yield start, stop, "."
                sign_end = stop
        elif kind == "plus":
            yield start, stop, "+"
            digit_end = stop
        elif kind == "entity":
            yield start, stop, ENTITIES[m.group().lower()]
        elif kind == "typed":
            yield start, stop, "".join(TYPED_DIGITS.get(c, c) for c in m.group())
        else:
            yield start, stop, "@" if kind.endswith("at") else "."
            sign_end = stop


def spellings(text: str) -> Rewritten | None:
    """Spelled digits and signs, rewritten."""
    return rewrite(text, _spelled_edits(text))


def _added(base: list[Match], text: str, chain: list[Rewritten]) -> Iterator[tuple[str, int, int, str]]:
    """Matches of the rewritten text that rest on a rewritten place and are no part of the base."""
    of_kind = {kind: [(start, stop) for k, start, stop in base if k == kind] for kind in KINDS}
    for kind, start, stop in detect(text):
        value = text[start:stop]
        begin, end, touched = start, stop, False
        for step in reversed(chain):
            begin, end, here = step.back(begin, end)
            touched |= here
        known = of_kind[kind]
        at = bisect_right(known, (end, -1))  # base spans of a kind lie apart, so both their ends rise
        near = at > 0 and known[at - 1][1] > begin
        wider = kind == "email" and near and begin <= known[max(bisect_right(known, (begin, -1)) - 1, 0)][0] and known[at - 1][1] <= end
        if touched and (not near or (wider and (begin, end) not in known)) and (kind != "email" or value.rpartition(".")[2].isalpha()):
            yield kind, begin, end, value


def spans(text: str, foreign: bool = True, spelled: bool = True) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, stop, base, value as detected), by kind, then start. The flags say which transducers may find work."""
    base = detect(text)
    found = [(kind, start, stop, True, text[start:stop]) for kind, start, stop in base]
    chain: list[Rewritten] = []
    if foreign and (step := homoglyphs(text)):
        chain.append(step)
    now = chain[-1].text if chain else text
    if (spelled or chain) and (step := spellings(now)):
        chain.append(step)
    if chain:
        found += [(kind, start, stop, False, value) for kind, start, stop, value in _added(base, chain[-1].text, chain)]
        found.sort(key=lambda s: (KINDS.index(s[0]), *s[1:3]))
    return found


def scan(texts: pa.Array) -> Iterator[list[tuple[str, int, int, bool, str]]]:
    """Spans of each text. Texts without a digit, an @ or a hint of a disguise are told apart for the whole array at once."""
    hint = pc.match_substring_regex(texts, _HINT, ignore_case=True)
    foreign = pc.match_substring_regex(texts, _FOREIGN_HINT)
    plain = pc.match_substring_regex(texts, "[0-9@]")
    for i, (h, f, p) in enumerate(zip(hint.to_pylist(), foreign.to_pylist(), plain.to_pylist(), strict=True)):
        yield spans(texts[i].as_py(), f, h) if h or f or p else []


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans: kind, start and stop in code points, base, and the value as it was detected."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("value", pa.string())]))
    names = ("kind", "start", "stop", "base", "value")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [[dict(zip(names, s, strict=True)) for s in each] for each in scan(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def masked(text: str, found: list[tuple[str, int, int, bool, str]]) -> str:
    """The text with each span, or spans that overlap, replaced by the kind of the first in angle brackets."""
    out, done = [], 0
    for kind, start, stop, *_ in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, stop)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced, all other columns as they came; a null text stays null."""

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        filled = pc.fill_null(texts, "")
        new = [masked(filled[i].as_py(), found) if found else filled[i].as_py() for i, found in enumerate(scan(filled))]
        return pc.if_else(texts.is_valid(), pa.array(new, pa.string()), pa.scalar(None, pa.string()))

    return docs.withColumn("text", cleaned(F.col("text").cast("string")))


def listed(found: Column) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _base_of(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, digest of the base spans, all spans, n_added."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _base_of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return find(docs).select(
        "doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
