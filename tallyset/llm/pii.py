"""Personal data with offset-preserving deobfuscation.

Base detection reads the text as it is: e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers, the
leftmost, non-overlapping matches of each kind; a match that fails its check is dropped. Then transducers rewrite a
text's disguises into a normalised text that keeps, for each character, where in the source it comes from:
homoglyphs and full-width forms become ASCII, zero-width characters go, runs of spelled digits become digits, and
at/dot signs in brackets or words become @ and a dot. A sign in brackets always counts; one in words, or between hyphens or
underscores, only before a host with a known last label, and with a plain dot in the host only after a local part in parts
("j.doe at example.com") or before a mail provider, so that "see you at example.com" and stay-at-home.com stay as they are.
The same detectors run on the result, and what they find is mapped back to source characters. A span found so is added if it
holds a rewritten character and each base span of its kind that it overlaps lies in it and is shorter; an address so found
ends in a label of letters. Base spans always stay.

Offsets are code points, the end exclusive. Null text is empty text: no spans. Rows are read one by one and whole, so
repeated rows get the same spans; of columns that clash with a new one the new one stays. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, index of the kind, end

# Homoglyphs of ASCII letters and signs, by code point.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ɡ": "g", "ɑ": "a", "ι": "i", "ο": "o", "ν": "v", "α": "a", "ρ": "p",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ι": "I", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", " ": " ", " ": " ", " ": " ", " ": " ",
}
# Characters without width.
NO_WIDTH = "​‌‍⁠﻿­"
# Spelled digits in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{_WORD}|[0-9])(?:(?:[ ,.-]|, ?| - ?)(?:{_WORD}|[0-9])(?![^\W_])){{3,}}")
_ONE_DIGIT = re.compile(rf"(?i)({_WORD}|[0-9])|[ ,.-]+")
_AT = re.compile(r"(?i)\s*(?:\[\s*(?:at|@|arroba)\s*\]|\(\s*(?:at|@|arroba)\s*\)|\{\s*(?:at|@|arroba)\s*\}|<\s*(?:at|@)\s*>)\s*")
_DOT = re.compile(r"(?i)\s*(?:\[\s*(?:dot|\.|punkt|point|punto)\s*\]|\(\s*(?:dot|\.|punkt|point|punto)\s*\)|\{\s*(?:dot|\.|punkt|point|punto)\s*\}|<\s*(?:dot|\.)\s*>)\s*")
_HYPHENED = re.compile(r"(?i)([-_]at[-_])([A-Za-z0-9]+(?:[-_]dot[-_][A-Za-z0-9]+)+)(?![A-Za-z0-9])")
_SAID = re.compile(r"(?i)( at | arroba |@)([A-Za-z0-9-]+(?:(?: dot | punkt | punto |\.)[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])")
_LOCAL_BEFORE = re.compile(r"(?i)(?<![A-Za-z0-9])([A-Za-z0-9_%+-]+(?:(?: dot | punkt | punto |\.)[A-Za-z0-9_%+-]+)*)$")
_SAID_SIGN = re.compile(r"(?i) (at|arroba|dot|punkt|punto) ")
_IN_PARTS = re.compile(r"[A-Za-z]{2}[A-Za-z0-9]*[._+%][A-Za-z]|[A-Za-z][._+%][A-Za-z]{2}")
#: Characters before a sign in which a local part is looked for; an address has 64 at most.
_LOCAL_MOST = 160
# Last labels of hosts; those of the second list are also words, and count only after a disguised dot.
LABELS = frozenset("com org net edu gov mil int info biz io co app dev ai tv xyz online site tech cloud mail eu de fr es uk us ca au nz jp cn kr br mx ar cl pt pl ru ua se dk fi nl ch cz gr hu ro ie za example test invalid local".split())
WORD_LABELS = frozenset("it in at be no me is to so my am as id name".split())
# Mail providers.
PROVIDERS = frozenset("gmail.com googlemail.com yahoo.com yahoo.de yahoo.fr yahoo.es hotmail.com hotmail.fr outlook.com live.com icloud.com aol.com gmx.de gmx.net web.de t-online.de orange.fr free.fr laposte.net proton.me protonmail.com".split())
_IP_DOTS = re.compile(r"(?i)(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot | punkt | punto )\s?[0-9]{1,3}){3}(?![0-9])")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(s: str) -> str:
    return _NOT_DIGITS.sub("", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from their @ signs, so a long word without one costs nothing."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def detect(text: str) -> list[Span]:
    """The base spans, by start and kind."""
    out: list[Span] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _HAS_DIGIT(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(only_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_HAS_DIGIT = re.compile(r"[0-9]").search
_BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:at|@|dot|\.|punkt|point|punto|arroba)\s*[\])}>]").search
_SIGNS = ("-at-", "_at_", " dot ", " punkt ", " punto ", " arroba ")
_SPOKEN = frozenset([w.encode() for w in DIGITS] + [w.upper().encode().lower() for w in DIGITS])
_TOKENS = _SPOKEN | {b"%d" % d for d in range(10)}
_PARTED = bytes(32 if chr(c) in ",.-" else c for c in range(256))


def maybe(text: str) -> bool:
    """Whether a text may hold a disguise at all; cheap, for the many that hold none."""
    if not text.isascii() and _DISGUISED.search(text):
        return True
    low = text.lower()
    if any(s in low for s in _SIGNS) or (" at " in low and _AT_HOST(low)):
        return True
    if any(c in text for c in "[({<") and _BRACKETED(text):
        return True
    words = low.encode().translate(_PARTED).split()
    return not _SPOKEN.isdisjoint(words) and b"\1\1\1\1" in bytes([w in _TOKENS for w in words])


class Tape:
    """A text under rewriting: for each character, where in the source it starts and ends, and whether it is rewritten."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.made = [False] * len(text)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts each string in the place of its span of the present text; spans are in order and disjoint."""
        if not edits:
            return
        text: list[str] = []
        start: list[int] = []
        end: list[int] = []
        made: list[bool] = []
        at = 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            made += self.made[at:a]
            if b > a:
                text.append(new)
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
                made += [True] * len(new)
                if made and not new:
                    made[-1] = True  # what stood after it is gone
            at = b
        self.text, self.start, self.end, self.made = "".join(text), start, end, made


def plain(c: str) -> str | None:
    """What a disguised character stands for; '' for one without width; None for any other."""
    if c in NO_WIDTH:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return HOMOGLYPHS.get(c)


_AT_HOST = re.compile(r"(?a) at [a-z0-9-]+\.[a-z0-9]").search
_PLUS = re.compile(r"(?i)(?<![^\W_])plus\s?(?=[0-9])")
_DISGUISED = re.compile(f"[{re.escape(''.join(HOMOGLYPHS) + NO_WIDTH)}！-～]")


def normalise(text: str) -> Tape:
    """The transducers in turn."""
    tape = Tape(text)
    tape.replace([(m.start(), m.end(), plain(m[0]) or "") for m in _DISGUISED.finditer(tape.text)])
    tape.replace([e for m in _SPELLED.finditer(tape.text) if any(map(str.isalpha, m[0])) for e in spelled(m)])
    tape.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])
    tape.replace([(m.start() + a, m.start() + b, ".") for m in _IP_DOTS.finditer(tape.text) for a, b in gaps(m[0])])
    tape.replace([(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)])
    tape.replace([(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)])
    tape.replace([e for m in _HYPHENED.finditer(tape.text) if last_label(m[2], "-_") in LABELS | WORD_LABELS for e in signs(tape.text, m.start(), m.end(), r"(?i)[-_](at|dot)[-_]")])
    said, free = [], 0
    for m in _SAID.finditer(tape.text):
        start = address(tape.text, m, free)
        if start >= 0:
            said += signs(tape.text, start, m.end(), _SAID_SIGN.pattern)
            free = m.end()
    tape.replace(said)
    return tape


def last_label(host: str, parts: str) -> str:
    return re.split(f"[{parts}]", host)[-1].lower()


def signs(text: str, start: int, end: int, sign: str) -> list[tuple[int, int, str]]:
    """The sign and dots in words of an address."""
    return [(start + s.start(), start + s.end(), "@" if s[1].lower() in ("at", "arroba") else ".") for s in re.finditer(sign, text[start:end])]


def address(text: str, m: re.Match, free: int) -> int:
    """Where the address begins that a sign and a host make of the words before them, from `free` on; -1 if they make none."""
    local = _LOCAL_BEFORE.search(text, max(free, m.start() - _LOCAL_MOST), m.start())
    if local is None:
        return -1
    label = last_label(m[2], ". ")
    if _SAID_SIGN.search(m[2]):
        good = label in LABELS or label in WORD_LABELS
    else:  # a plain sign and host are a plain address
        good = m[1] != "@" and (m[2].lower() in PROVIDERS or (label in LABELS and bool(_IN_PARTS.search(local[1]))))
    return local.start() if good else -1


def gaps(s: str) -> list[tuple[int, int]]:
    return [m.span() for m in _NOT_DIGITS.finditer(s)]


def spelled(run: re.Match) -> Iterator[tuple[int, int, str]]:
    """Each word of a run of spelled digits as its digit; what parts two of them goes."""
    for m in _ONE_DIGIT.finditer(run[0]):
        digit = "" if m[1] is None else DIGITS.get(m[1].lower(), m[1])
        if digit != m[0]:
            yield run.start() + m.start(), run.start() + m.end(), digit


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base, all) spans of a text."""
    text = text or ""
    base = detect(text)
    if not maybe(text):
        return base, base
    tape = normalise(text)
    taken = {k: [(a, b) for a, kind, b in base if kind == k] for k in range(4)}
    added = []
    for a, kind, b in detect(tape.text):
        if any(tape.made[a:b]) and (kind or tape.text[a:b].rpartition(".")[2].isalpha()):
            start, end = tape.start[a], max(tape.end[a:b])
            if not overlaps(taken[kind], start, end) or widens(taken[kind], start, end):
                added.append((start, kind, end))
    return base, sorted(base + added)


def overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    i = bisect_left(taken, (end, 0))
    return i > 0 and taken[i - 1][1] > start


def widens(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether the span contains all those that it overlaps, and is none of them."""
    met = [(a, b) for a, b in taken if a < end and b > start]
    return all(start <= a and b <= end for a, b in met) and (start, end) not in met


def told(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


def digest(texts: list[str | None]) -> list[list]:
    rows = []
    for t in texts:
        base, every = spans(t)
        counts = [0, 0, 0, 0]
        for _, k, _ in base:
            counts[k] += 1
        rows.append((*counts, hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (kept columns) with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all of them)."""
    return map_text(docs, lambda: digest, FIELDS, keep)


def mask_text(text: str | None) -> str | None:
    """The text with each span as [KIND]; of spans that overlap, the union goes under the kind of the first."""
    if text is None:
        return None
    _, every = spans(text)
    out, at = [], 0
    for a, k, b in every:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if every else text


def masked(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kind, and n_chars, where it is a column, counted anew."""
    from pyspark.sql import functions as F

    order = docs.columns
    out = map_text(docs, lambda: lambda texts: [[mask_text(t) for t in texts]], [T.StructField("text", T.StringType())])
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in order else out).select(*[F.col(f"`{c}`") for c in order])
