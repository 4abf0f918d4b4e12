"""Wikitext to plain text: templates, boxes, tables, links, markup and layout.

One pass over a page's text with a scanner for nested brackets and a table of parser functions. Templates travel to the
executors as a table of bounded size; a larger one is refused.
"""

from __future__ import annotations

import ast
import html
import operator
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_DEPTH = 30


def closing(text: str, at: int, low: str, high: str) -> int:
    """Where the bracket that opens at `at` closes (just after it), or -1."""
    depth, i = 0, at
    while i < len(text):
        if text.startswith(low, i):
            depth, i = depth + 1, i + len(low)
        elif text.startswith(high, i):
            depth, i = depth - 1, i + len(high)
            if not depth:
                return i
        else:
            i += 1
    return -1


def replace_nested(text: str, low: str, high: str, make: Callable[[str], str]) -> str:
    """Each outermost bracketed part, without its brackets, replaced by make; an unclosed one stays."""
    out, at = [], 0
    while (start := text.find(low, at)) >= 0:
        end = closing(text, start, low, high)
        if end < 0:
            out.append(text[at : start + len(low)])
            at = start + len(low)
            continue
        out += [text[at:start], make(text[start + len(low) : end - len(high)])]
        at = end
    return "".join(out) + text[at:]


def drop_nested(text: str, low: str, high: str) -> str:
    return replace_nested(text, low, high, lambda _: "")


def split_parts(body: str, sep: str = "|") -> list[str]:
    """The parts of a template's or link's inside; separators within brackets do not part."""
    parts, depth, last, i = [], 0, 0, 0
    while i < len(body):
        two = body[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = depth - 1, i + 2
        else:
            if body[i] == sep and depth == 0:
                parts.append(body[last:i])
                last = i + 1
            i += 1
    return [*parts, body[last:]]


# ---- parser functions

_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}


def arithmetic(text: str) -> str:
    """A sum, product or comparison of numbers, read as a tree of allowed nodes; anything else is an error mark."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp):
            return _ARITHMETIC[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp):
            return _ARITHMETIC[type(node.op)](value(node.operand))
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            return int(_ARITHMETIC[type(node.ops[0])](value(node.left), value(node.comparators[0])))
        raise ValueError(text)

    try:
        x = value(ast.parse(re.sub(r"\bmod\b", "%", text.replace("^", "**")).replace("<>", "!=").strip(), mode="eval").body)
        return str(int(x)) if x == int(x) else repr(round(x, 10))
    except (ValueError, SyntaxError, KeyError, ZeroDivisionError, OverflowError, RecursionError):
        return '<strong class="error">'


def switch(value: str, cases: list[str]) -> str:
    """The first case that equals the value; cases without a result fall through; #default or a last bare part else."""
    found, default = False, ""
    for i, case in enumerate(cases):
        key, sign, result = case.partition("=")
        key = key.strip()
        if key == value:
            found = True
        if sign:
            if found:
                return result.strip()
            if key == "#default":
                default = result.strip()
        elif i == len(cases) - 1:
            return default if found and default else case.strip()
    return default


def pad_left(args: list[str]) -> str:
    text, width = args[0], int(args[1]) if len(args) > 1 and args[1].strip().isdigit() else 0
    return text.rjust(width, (args[2] if len(args) > 2 and args[2] else "0")[0])


def first(args: list[str], i: int) -> str:
    return args[i].strip() if len(args) > i else ""


FUNCTIONS: dict[str, Callable[[list[str]], str]] = {
    "#if": lambda a: first(a, 1) if first(a, 0) else first(a, 2),
    "#ifeq": lambda a: first(a, 2) if first(a, 0) == first(a, 1) else first(a, 3),
    "#iferror": lambda a: first(a, 1) if 'class="error"' in first(a, 0) else (first(a, 2) if len(a) > 2 else first(a, 0)),
    "#switch": lambda a: switch(first(a, 0), a[1:]),
    "#expr": lambda a: arithmetic(first(a, 0)),
    "lc": lambda a: first(a, 0).lower(),
    "uc": lambda a: first(a, 0).upper(),
    "lcfirst": lambda a: first(a, 0)[:1].lower() + first(a, 0)[1:],
    "ucfirst": lambda a: first(a, 0)[:1].upper() + first(a, 0)[1:],
    "urlencode": lambda a: __import__("urllib.parse").parse.quote_plus(first(a, 0)),
    "int": lambda a: first(a, 0),
    "padleft": pad_left,
    **{n: (lambda a: "") for n in ("#invoke", "#ifexist", "#ifexpr", "#rel2abs", "#titleparts", "#time", "#language", "#tag")},
}


# ---- templates


class Expander:
    """Expands the templates of one wiki. now: a fixed day for date words, (year, month, day)."""

    def __init__(self, templates: dict[str, str], redirects: dict[str, str], discard: frozenset[str] = frozenset(), ignore: frozenset[str] = frozenset(), now: tuple[int, int, int] = (2025, 10, 1)) -> None:
        self.templates, self.redirects, self.discard, self.ignore = templates, redirects, discard, ignore
        self.words = {"CURRENTYEAR": f"{now[0]}", "CURRENTMONTH": f"{now[1]:02d}", "CURRENTDAY": f"{now[2]}", "CURRENTDAY2": f"{now[2]:02d}", "!": "|", "=": "="}
        self.discarded = False

    def expand(self, text: str, depth: int = 0) -> str:
        if "{{" not in text:
            return text
        if depth > MAX_DEPTH:
            return drop_nested(text, "{{", "}}")
        return replace_nested(text, "{{", "}}", lambda body: self.call(body, depth))

    def call(self, body: str, depth: int) -> str:
        parts = split_parts(body)
        head = self.expand(parts[0], depth + 1).strip()
        if head in self.words:
            return self.words[head]
        name, colon, rest = head.partition(":")
        if colon and name.strip().lower() in FUNCTIONS:
            args = [rest, *parts[1:]]
            return FUNCTIONS[name.strip().lower()]([self.expand(a, depth + 1) for a in args])
        return self.template(canonical(head), [self.expand(p, depth + 1) for p in parts[1:]], depth)

    def template(self, name: str, args: list[str], depth: int) -> str:
        name = self.redirects.get(name, name)
        if name in self.discard:
            self.discarded = True
        special = SPECIAL.get(name.lower())
        if special:
            return special(args)
        if name in self.ignore or name not in self.templates:
            return ""
        return self.expand(fill(self.templates[name], parameters(args)), depth + 1)


def canonical(title: str) -> str:
    t = " ".join(title.replace("_", " ").split())
    t = re.sub(r"^(?i:template):\s*", "", t)
    return t[:1].upper() + t[1:]


def parameters(args: list[str]) -> dict[str, str]:
    """Named arguments trimmed, others by number as they are; the last of a name wins."""
    out, n = {}, 0
    for a in args:
        name, sign, value = a.partition("=")
        if sign and re.fullmatch(r"\s*[^<>\[\]{}|]+\s*", name):
            out[name.strip()] = value.strip()
        else:
            n += 1
            out[str(n)] = a
    return out


def fill(body: str, given: dict[str, str], depth: int = 0) -> str:
    """A template's text with {{{name|default}}} filled; an unknown one without default is left out."""
    if depth > 16:
        return body

    def value(inner: str) -> str:
        name, *default = split_parts(inner)
        key = fill(name, given, depth + 1).strip()
        return given[key] if key in given else fill(default[0], given, depth + 1) if default else ""

    return replace_nested(body, "{{{", "}}}", value)


def convert(args: list[str]) -> str:
    """value unit, and a range as value to value unit."""
    plain = [a.strip() for a in args if "=" not in a]
    if len(plain) > 2 and plain[1] in ("-", "to", "–", "and", "by", "x"):
        return " ".join([plain[0], plain[1], plain[2], *plain[3:4]])
    return " ".join(plain[:2])


SPECIAL: dict[str, Callable[[list[str]], str]] = {
    "convert": convert,
    "cvt": convert,
    "lang": lambda a: a[1] if len(a) > 1 else "",
    "ipa": lambda a: "",
    "coord": lambda a: ", ".join(x.strip() for x in a if "=" not in x and ":" not in x),
    "audio": lambda a: a[1] if len(a) > 1 else "",
}


# ---- boxes, links and markup


def box_block(body: str) -> str:
    """An infobox as lines of key = value between marks; boxes within one are flattened to text."""
    lines = []
    for part in split_parts(body)[1:]:
        key, sign, value = part.partition("=")
        value = flatten(value)
        if sign and key.strip() and value:
            lines.append(f"{key.strip()} = {value}")
    return "\n--- Infobox:Start ---\n" + "\n".join(lines) + "\n--- Infobox:End ---\n" if lines else ""


def box_lines(body: str) -> str:
    """The same as key: value lines."""
    return "\n".join(x.replace(" = ", ": ", 1) for x in box_block(body).strip().split("\n")[1:-1])


def flatten(value: str) -> str:
    v = drop_nested(re.sub(r"(?s)<ref[^>/]*>.*?</ref>|<ref[^>]*/>|<!--.*?-->", "", value), "{{", "}}")
    return " ".join(re.sub(r"<[^>]+>", " ", inner_links(v).replace("'''", "").replace("''", "")).split())


def boxes(text: str, make: Callable[[str], str] = box_block) -> str:
    """Every infobox of a text in its new form; other templates are left for the expander."""

    def one(body: str) -> str:
        return make(body) if re.match(r"\s*[Ii]nfobox", body) else "{{" + body + "}}"

    return replace_nested(text, "{{", "}}", one)


_HIDDEN = re.compile(r"(?i)^:?(file|image|category|media|datei|bild|kategorie|fichier|catégorie|archivo|categoría):")


def inner_links(text: str) -> str:
    """[[target|shown]] as what it shows; files and categories go, with the links inside them."""

    def one(body: str) -> str:
        if _HIDDEN.match(body.strip()):
            return ""
        parts = split_parts(body)
        return inner_links(parts[-1] if len(parts) > 1 and parts[-1].strip() else parts[0])

    return replace_nested(text, "[[", "]]", one)


def outer_links(text: str) -> str:
    """[address shown] as what it shows; one that shows nothing goes."""
    return re.sub(r"\[(?:https?:|ftp:)?//[^\s\]]*(?:\s+([^\]]*))?\]", lambda m: m[1] or "", text)


_GONE = re.compile(r"(?is)<!--.*?-->|<(ref|gallery|timeline|math|score|source|syntaxhighlight|imagemap|code|pre|table|div\s+class=.?navbox)\b[^>]*(?<!/)>.*?</\1>|<ref\b[^>]*/>")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"__[A-Z]+__")


def clean(text: str, expander: Expander | None = None) -> str:
    """The steps in order: comments and elements with no text, templates, tables, words of magic, quotes, links, tags,
    entities, white space."""
    t = _GONE.sub("", text)
    t = expander.expand(t) if expander else drop_nested(t, "{{", "}}")
    t = drop_nested(t, "{|", "|}")
    t = _WORD.sub("", t)
    t = outer_links(inner_links(t))
    t = re.sub(r"'{2,5}", "", t)
    t = html.unescape(_TAG.sub("", t).replace("&nbsp;", " "))
    t = re.sub(r"[ \t]+", " ", t.replace(" ", " "))
    t = re.sub(r" ([,.;:])", r"\1", re.sub(r"\(\s*[,;]?\s*\)", "", t))
    return re.sub(r"\n{3,}", "\n\n", t)


_HEADING = re.compile(r"^(={2,6})\s*(.+?)\s*\1\s*$")


def compact(text: str, discard: frozenset[str] = frozenset()) -> str:
    """Headings as # marks, list items as - lines; empty sections and discarded ones (with what they hold) go."""
    out: list[tuple[int, str]] = []  # (heading level or 0, line)
    skip = 0
    for line in text.split("\n"):
        m = _HEADING.match(line.strip())
        if m:
            level = len(m[1])
            if skip and level > skip:
                continue
            skip = level if m[2] in discard else 0
            if skip:
                continue
            while out and out[-1][0] >= level:
                out.pop()
            out.append((level, "#" * level + " " + m[2]))
        elif not skip and line.strip():
            item = re.match(r"^[*#:;]+\s*(.*)$", line)
            if item is None:
                out.append((0, line.strip()))
            elif item[1].strip():
                out.append((0, f"- {item[1].strip()}"))
    while out and out[-1][0]:
        out.pop()
    return "\n".join(line for _, line in out)


def page_text(wikitext: str, expander: Expander, discard_sections: frozenset[str] = frozenset()) -> str | None:
    """A page's text; None if it uses a template that discards the page."""
    expander.discarded = False
    text = compact(clean(boxes(wikitext), expander), discard_sections)
    return None if expander.discarded else text


def extracted(pages: DataFrame, templates: DataFrame, discard: frozenset[str] = frozenset(), ignore: frozenset[str] = frozenset(), sections: frozenset[str] = frozenset({"References", "External links", "See also"}), most_chars: int = 200_000_000) -> DataFrame:
    """pages (page_id, title, wikitext) -> (page_id, title, text), with templates (name, redirect, body). Templates are
    broadcast and may hold most_chars characters; pages without text, or discarded, go."""
    from pyspark.sql import functions as F

    size = templates.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n")).first().n
    if size > most_chars:
        raise ValueError(f"templates hold {size} characters; most_chars is {most_chars}")
    rows = templates.collect()
    shared = pages.sparkSession.sparkContext.broadcast(({canonical(r.name): r.body or "" for r in rows if not r.redirect}, {canonical(r.name): canonical(r.redirect) for r in rows if r.redirect}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expander = Expander(*shared.value, discard, ignore)
        for b in batches:
            text = [page_text(w or "", expander, sections) for w in b["wikitext"]]
            out = b.assign(text=text)[["page_id", "title", "text"]]
            yield out[out["text"].map(bool)]

    return pages.select("page_id", "title", "wikitext").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, title string, text string")


def as_documents(pages: DataFrame) -> DataFrame:
    """Pages as <doc> blocks."""
    from pyspark.sql import functions as F

    return pages.select(F.concat(F.lit('<doc id="'), F.col("page_id").cast("string"), F.lit('" title="'), "title", F.lit('">\n'), "text", F.lit("\n</doc>\n")).alias("value"))
