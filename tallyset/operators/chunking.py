"""Documents into passages: fixed windows of words, and passages that follow sections, lists and boxes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import collapsed, fallback_id, passage_id

# Where a sentence ends.
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])$"


def word_chunks(docs: DataFrame, width: int = 100, least: int = 20) -> DataFrame:
    """(id, doc_id, chunk_idx, title, contents): windows of width words; those under least words are dropped and take no
    number. Documents without a title or text give none."""
    words = F.filter(F.split(collapsed(F.col("text")), " "), lambda w: w != "")
    rows = docs.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")).select(fallback_id(F.col("doc_id").cast("string"), F.col("title")).alias("doc_id"), "title", words.alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"), F.lit(width))).otherwise(F.array().cast("array<int>"))
    cut = F.filter(F.transform(starts, lambda i: F.slice("w", i, width)), lambda c: F.size(c) >= least)
    out = rows.select("doc_id", "title", F.posexplode(cut).alias("chunk_idx", "c"))
    return out.select(passage_id(F.col("doc_id"), F.col("chunk_idx")).alias("id"), "doc_id", "chunk_idx", "title", F.array_join("c", " ").alias("contents"))


def numbered(chunks: DataFrame, doc: str, pos: str) -> DataFrame:
    """chunk_idx from 0, dense, by position within a document."""
    return chunks.withColumn("chunk_idx", F.row_number().over(Window.partitionBy(doc).orderBy(pos)) - 1)


def sentences(text) -> F.Column:
    return F.filter(F.transform(F.split(text, SENTENCE), lambda s: F.trim(s)), lambda s: s != "")


# ---- sections, lists and boxes

_HEAD = re.compile(r"(?m)^(#{1,6})\s+(.+?)\s*$")
_ITEM = re.compile(r"\s*-\s+(.+)$")
_MARK = re.compile(r"--- (List|Infobox):(Start|End) ---$")
_BREAK = re.compile(SENTENCE)


@dataclass
class Part:
    """A piece of a section: its kind, and its units (sentences, items, or the pairs of a box)."""

    kind: str
    units: list[str]

    @property
    def words(self) -> int:
        return count(" ".join(self.units))


def count(text: str) -> int:
    return len(text.split())


def flat(text: str) -> str:
    return " ".join(_HEAD.sub("\n", text).split())


def sections(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, titles from level 2 on). A section runs to the next header of its level or above, so a parent holds its
    children's text; what stands before the first section has no titles; headers of level 1 open none."""
    heads = [(m.start(), len(m[1]), m[2].strip().removesuffix(".")) for m in _HEAD.finditer(text)]
    out, path = [], []
    for i, (at, level, title) in enumerate(heads):
        if level == 1:
            continue
        del path[level - 2 :]
        path.append(title)
        end = next((a for a, other, _ in heads[i + 1 :] if other <= level), len(text))
        out.append((at, end, list(path)))
    if not out:
        return [(0, len(text), [])]
    return ([(0, out[0][0], [])] if out[0][0] > 0 else []) + out


def parts(text: str) -> list[Part]:
    """The parts of a section, by a walk over its lines."""
    out: list[Part] = []
    mode, held = "text", []

    def close(next_mode: str) -> None:
        nonlocal mode, held
        if mode == "text" and (body := flat("\n".join(held))):
            out.append(Part("text", [s.strip() for s in _BREAK.split(body) if s.strip()]))
        elif mode in ("list", "items") and held:
            out.append(Part("list", held))
        elif mode == "box" and any(h.strip() for h in held):
            out.append(Part("box", [pair(h) for h in held if h.strip()]))
        mode, held = next_mode, []

    for line in text.split("\n"):
        mark, item = _MARK.match(line.strip()), _ITEM.match(line)
        if mark and mode == "box" and mark[0] != "--- Infobox:End ---" or mark and mode == "list" and mark[0] != "--- List:End ---":
            if mode == "box":
                held.append(line)  # inside a box, other marks are lines
        elif mark:
            close({"List:Start": "list", "Infobox:Start": "box"}.get(f"{mark[1]}:{mark[2]}", "text"))
        elif mode == "box":
            held.append(line)
        elif mode == "list":  # marked lists hold nothing but items
            held += [item[1].strip()] if item else []
        elif item:
            if mode == "text":
                close("items")
            held.append(item[1].strip())
        else:
            if mode == "items":
                close("text")
            held.append(line)
    close("text")
    return out


def pair(line: str) -> str:
    key, sign, value = line.partition("=")
    return f"{key.strip()}: {value.strip()}" if sign else line.strip()


@dataclass
class Packer:
    """Collects units into passages of about width words, within one section."""

    width: int
    done: list[str] = field(default_factory=list)
    units: list[str] = field(default_factory=list)
    size: int = 0

    def add(self, unit: str, words: int) -> None:
        self.units.append(unit)
        self.size += words

    def flush(self) -> None:
        if self.units:
            self.done.append(" ".join(self.units))
        self.units, self.size = [], 0

    def sentence(self, s: str) -> None:
        """On overflow the passage ends on the side that is nearer the width; the shorter one wins a tie."""
        n = count(s)
        if not self.units or self.size + n <= self.width:
            self.add(s, n)
        elif abs(self.size - self.width) <= abs(self.size + n - self.width):
            self.flush()
            self.add(s, n)
        else:
            self.add(s, n)
            self.flush()

    def block(self, text: str, n: int) -> bool:
        """A block that fits well enough joins what is held."""
        if self.units and self.size + n <= self.width * 1.2:
            self.add(text, n)
            return True
        return False

    def split(self, units: list[str], head: list[str]) -> None:
        """A large block by its units; its rest stays open for what follows."""
        self.flush()
        self.units, self.size = list(head), len(head)
        for u in units:
            n = count(u)
            if self.size + n > self.width and len(self.units) > len(head):
                self.done.append(" ".join(self.units))
                self.units, self.size = list(head), len(head)
            self.add(u, n)
        if len(self.units) == len(head):
            self.units, self.size = [], 0

    def part(self, p: Part) -> None:
        if p.kind == "text":
            for s in p.units:
                self.sentence(s)
            return
        box, n = p.kind == "box", p.words
        text = ("Infobox: " if box else "") + " ".join(p.units)
        if n < self.width // 2:
            if not self.block(text, n):
                self.flush()
                self.add(text, n)
        elif n <= self.width:
            if not (box and self.block(text, n)):
                self.flush()
                self.done.append(text)
        elif box:
            self.split(keyed(" ".join(p.units)), ["Infobox:"])
        else:
            self.split(p.units, [])


def keyed(text: str) -> list[str]:
    """A box's text by its keys, the words that end with a colon."""
    out: list[list[str]] = []
    for w in text.split():
        if w.endswith(":") or not out:
            out.append([w])
        else:
            out[-1].append(w)
    return [" ".join(p) for p in out]


def section_chunks(text: str | None, width: int) -> Iterator[tuple[str, list[str]]]:
    """The passages of a text with their section titles; none crosses a section."""
    for a, b, titles in sections(text) if text else []:
        pack = Packer(width)
        for p in parts(text[a:b]):
            pack.part(p)
        pack.flush()
        for chunk in pack.done:
            yield chunk, titles


def context_chunks(docs: DataFrame, width: int = 100, least: int = 20) -> DataFrame:
    """(id, doc_id, chunk_idx, title, section, contents) by sections; passages under least words take no number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, title, text in zip(b["doc_id"], b["title"], b["text"], strict=True):
                kept = [(c, s) for c, s in section_chunks(text, width) if count(c) >= least]
                rows += [(doc, i, title, s, c) for i, (c, s) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "title", "section", "contents"])

    ready = docs.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")).select(fallback_id(F.col("doc_id").cast("string"), F.col("title")).alias("doc_id"), "title", "text")
    out = ready.mapInPandas(run, "doc_id string, chunk_idx int, title string, section array<string>, contents string")
    return out.select(passage_id(F.col("doc_id"), F.col("chunk_idx")).alias("id"), "doc_id", "chunk_idx", "title", "section", "contents")
