"""Blocks into outlines and token-bounded chunks: a document at a time, in Arrow batches.

Sections, sentences and packing carry state from block to block, so each document is walked in order. A document's blocks are one
row's array; documents are independent.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import ABBREVIATIONS, BOUNDARY, WORD_MARKS

BLOCKS = "array<struct<kind:string,level:int,page:int,text:string>>"
CHUNKS = (
    "array<struct<chunk_index:int,body:string,embed_text:string,token_count:int,page_start:int,page_end:int,section_key:string,section_path:array<string>,"
    "heading:string,block_orders:array<int>,kinds:array<string>,has_overlap:boolean>>"
)
SECTIONS = "array<struct<position:int,key:string,parent_key:string,title:string,level:int,path:array<string>,page:int,first_block:int,n_blocks:int,chars:int,synthetic:boolean>>"
ATOMIC = ("table", "code", "caption")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in estimated tokens, held to sensible bounds."""

    target: int = 320
    overlap: int = 60
    minimum: int = 40
    maximum: int = 520
    by_section: bool = True

    def bounded(self) -> ChunkConfig:
        target = max(48, self.target)
        return ChunkConfig(target, max(0, min(self.overlap, target // 2)), max(1, min(self.minimum, target // 2)), max(self.maximum, target), self.by_section)


@lru_cache(maxsize=50_000)
def estimate(text: str) -> int:
    """As functions.text.token_estimate."""
    if not text:
        return 0
    total = text.count("\n") // 2
    for word in text.split():
        bare = word.strip(WORD_MARKS)
        total += 1 + max(0, (len(bare) or 1) - 4) // 4 + (len(word) > len(bare))
    return max(1, total)


_BOUNDARY = re.compile(BOUNDARY)
_SHORT = frozenset(ABBREVIATIONS)


def sentences(text: str) -> list[str]:
    """As functions.text.sentences."""
    out: list[str] = []
    for piece in filter(None, (p.strip() for p in _BOUNDARY.split(text.replace("\n", " ")))):
        joins = False
        if out and out[-1].endswith("."):
            last = (out[-1].rstrip(".").split() or [""])[-1].lower().strip("([")
            joins = last in _SHORT or (piece[0].isdigit() and re.search(r"\b\d+\.$", out[-1]) is not None)
        if joins:
            out[-1] += " " + piece
        else:
            out.append(piece)
    return [s for s in out if len(s) >= 2]


def _slug(title: str) -> str:
    plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:60].rstrip("-") or "section"


@dataclass
class Section:
    title: str
    level: int
    page: int
    key: str
    path: tuple[str, ...]
    parent: str | None
    synthetic: bool
    members: list[int]


def outline(blocks: list[dict], title: str) -> list[Section]:
    """Sections in reading order. Heading levels become dense; text before the first heading gets a section of the document's title.

    Keys are paths of slugs, made unique by -2, -3 and so on; paths longer than four keep the first and the last three.
    """
    levels = sorted({b["level"] or 1 for b in blocks if b["kind"] == "heading"})
    dense = {v: i + 1 for i, v in enumerate(levels)}
    sections: list[Section] = []
    stack: list[Section] = []
    used: dict[str, int] = {}

    def opened(name: str, level: int, page: int, synthetic: bool = False) -> Section:
        name = " ".join(name.split())
        name = name if len(name) <= 160 else name[:160].rstrip() + "..."
        parent = stack[-1] if stack else None
        key = f"{parent.key}/{_slug(name)}" if parent else _slug(name)
        used[key] = used.get(key, 0) + 1
        if used[key] > 1:
            key = f"{key}-{used[key]}"
        path = (parent.path if parent else ()) + (name,)
        section = Section(name, level, page, key, path if len(path) <= 4 else path[:1] + path[-3:], parent.key if parent else None, synthetic, [])
        sections.append(section)
        stack.append(section)
        return section

    for i, block in enumerate(blocks):
        if block["kind"] == "heading":
            level = dense[block["level"] or 1]
            while stack and (stack[-1].level >= level or stack[-1].synthetic) and not (stack[-1].synthetic and level > 1 and len(stack) == 1):
                stack.pop()
            opened(block["text"], level, block["page"]).members.append(i)
        else:
            if not stack:
                opened(title or "Document", 1, block["page"], True)
            stack[-1].members.append(i)
    return sections


@dataclass
class _Unit:
    text: str
    tokens: int
    block: int
    kind: str
    page: int
    repeated: bool = False

    @property
    def atomic(self) -> bool:
        return self.kind in ATOMIC


def _split_words(text: str, most: int) -> Iterator[str]:
    held: list[str] = []
    n = 0
    for word in text.split():
        cost = estimate(word)
        if held and n + cost > most:
            yield " ".join(held)
            held, n = [], 0
        held.append(word)
        n += cost
    if held:
        yield " ".join(held)


def _split_lines(text: str, most: int, repeat_header: bool) -> Iterator[str]:
    lines = text.split("\n")
    header = lines[0] if repeat_header and len(lines) > 1 else None
    held: list[str] = []
    for line in lines:
        if held and estimate("\n".join([*held, line])) > most:
            yield "\n".join(held)
            held = [header] if header and estimate(f"{header}\n{line}") <= most else []
        if estimate(line) > most:
            if held and held != [header]:
                yield "\n".join(held)
            held = []
            yield from _split_words(line, most)
            continue
        held.append(line)
    if held and held != [header]:
        yield "\n".join(held)


def units(blocks: list[dict], members: list[int], most: int) -> list[_Unit]:
    """Sentences of prose, whole tables, code and captions; what is over the maximum is cut by lines or words."""
    out: list[_Unit] = []
    for i in members:
        b = blocks[i]
        if b["kind"] in ATOMIC:
            parts = [b["text"]] if estimate(b["text"]) <= most else list(_split_lines(b["text"], most, b["kind"] == "table"))
        else:
            parts = [p for s in (sentences(b["text"]) or [b["text"].strip()]) for p in ([s] if estimate(s) <= most else _split_words(s, most))]
        out += [_Unit(p, estimate(p), i, b["kind"], b["page"]) for p in parts if p.strip()]
    return out


def pack_units(items: list[_Unit], c: ChunkConfig) -> list[list[_Unit]]:
    """Groups near the target; each next one opens with the last whole sentences of the one before, and a last runt joins its neighbour."""
    groups: list[list[_Unit]] = []
    held: list[_Unit] = []
    total = 0
    for u in items:
        if not held or total + u.tokens <= c.target or (u.tokens < c.minimum and total + u.tokens <= c.maximum):
            held.append(u)
            total += u.tokens
            continue
        groups.append(held)
        tail: list[_Unit] = []
        for prior in reversed(held):
            if prior.atomic or sum(t.tokens for t in tail) + prior.tokens > c.overlap or len(tail) + 1 >= len(held):
                break
            tail.insert(0, _Unit(prior.text, prior.tokens, prior.block, prior.kind, prior.page, True))
        held = [*tail, u]
        total = sum(x.tokens for x in held)
        if total > c.maximum:
            held, total = [u], u.tokens
    if held:
        groups.append(held)
    if len(groups) > 1:
        novel = [u for u in groups[-1] if not u.repeated]
        n = sum(u.tokens for u in novel)
        if not novel:
            groups.pop()
        elif n < c.minimum and sum(u.tokens for u in groups[-2]) + n <= c.maximum:
            groups[-2:] = [groups[-2] + novel]
    return groups


def chunks_of(blocks: list[dict], title: str, config: ChunkConfig) -> list[dict]:
    """All chunks of one document, in order."""
    c = config.bounded()
    sections = outline(blocks, title)
    plans = [(s, s.members) for s in sections] if c.by_section else [(sections[0], list(range(len(blocks))))] if sections else []
    out: list[dict] = []
    for section, members in plans:
        body_members = [i for i in members if blocks[i]["kind"] != "heading"]
        for group in pack_units(units(blocks, body_members, c.maximum), c):
            body = group[0].text
            for before, u in zip(group, group[1:]):
                body += ("\n" if before.atomic or u.atomic else " ") + u.text
            pages = [u.page for u in group]
            path = [] if section.synthetic else list(section.path)
            out.append({
                "chunk_index": len(out), "body": body, "embed_text": f"Section: {' > '.join(path)}\n{body}" if path else body, "token_count": sum(u.tokens for u in group), "page_start": min(pages), "page_end": max(pages),
                "section_key": section.key, "section_path": path, "heading": section.title, "block_orders": sorted({u.block for u in group}), "kinds": list(dict.fromkeys(u.kind for u in group)), "has_overlap": any(u.repeated for u in group),
            })
    return out


def _plain(row) -> list[dict]:
    return [{"kind": b["kind"], "level": b["level"], "page": b["page"] or 1, "text": b["text"] or ""} for b in (row if row is not None else [])]


def _per_document(docs: DataFrame, schema: str, name: str, make) -> DataFrame:
    kind = docs.schema["document_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"document_id": pdf["document_id"], name: [make(_plain(b), t) for b, t in zip(pdf["blocks"], pdf["title"])]})

    return docs.select("document_id", F.col("blocks").cast(BLOCKS).alias("blocks"), F.coalesce("title", F.lit("")).alias("title")).mapInPandas(run, f"document_id {kind}, {name} {schema}")


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:  # noqa: B008
    """(document_id, id, chunk fields...) of documents (document_id, title, blocks). Documents without text have no chunks."""
    made = _per_document(docs, CHUNKS, "c", lambda blocks, title: chunks_of(blocks, title, config))
    return made.select("document_id", F.explode("c").alias("c")).select("document_id", F.concat_ws(":", F.col("document_id").cast("string"), "c.chunk_index").alias("id"), "c.*")


def section_rows(docs: DataFrame) -> DataFrame:
    """(document_id, position, key, parent_key, title, level, path, page, first_block, n_blocks, chars, synthetic) of each section."""

    def make(blocks, title):
        return [
            {"position": i, "key": s.key, "parent_key": s.parent, "title": s.title, "level": s.level, "path": list(s.path), "page": s.page, "first_block": min(s.members, default=0), "n_blocks": len(s.members), "chars": sum(len(blocks[m]["text"]) for m in s.members), "synthetic": s.synthetic}
            for i, s in enumerate(outline(blocks, title))
        ]

    return _per_document(docs, SECTIONS, "s", make).select("document_id", F.explode("s").alias("s")).select("document_id", "s.*")


def section_rollups(sections: DataFrame) -> DataFrame:
    """(document_id, key, chars, page_start, page_end, n_sections) over each section and all below it: a key is a prefix of its descendants'."""
    up = sections.select("document_id", "chars", "page", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", "/"))), lambda n: F.array_join(F.slice(F.split("key", "/"), F.lit(1), n), "/"))).alias("key"))
    return up.groupBy("document_id", "key").agg(F.sum("chars").alias("chars"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count(F.lit(1)).alias("n_sections"))


def outline_stats(sections: DataFrame) -> DataFrame:
    """(document_id, n_sections, max_depth, flat): sections that have a heading, their deepest level, and whether there is none."""
    real = F.when(~F.col("synthetic"), F.col("level"))
    return sections.groupBy("document_id").agg(F.count(real).alias("n_sections"), F.coalesce(F.max(real), F.lit(0)).alias("max_depth"), (F.count(real) == 0).alias("flat"))


def document_stats(docs: DataFrame) -> DataFrame:
    """(document_id, pages, empty_pages, n_blocks, n_headings, n_chars, n_words) of documents (document_id, blocks)."""
    text, pages = lambda b: F.coalesce(b["text"], F.lit("")), F.coalesce(F.array_max(F.transform("blocks", lambda b: b["page"])), F.lit(0))
    total = lambda f: F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + f(text(b)))
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return docs.select(
        "document_id", pages.alias("pages"), (pages - F.size(F.array_distinct(F.transform("blocks", lambda b: b["page"])))).alias("empty_pages"), F.size("blocks").alias("n_blocks"),
        F.size(F.filter("blocks", lambda b: b["kind"] == "heading")).alias("n_headings"), total(F.length).alias("n_chars"), total(words).alias("n_words"),
    )


def plain_blocks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(document_id, title, blocks): each blank-line paragraph as a block of one page."""
    from quern.functions.text import paragraphs

    blocks = F.transform(paragraphs(text_column), lambda p: F.struct(F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(1).alias("page"), p.alias("text")))
    return docs.select(F.col(id_column).cast("string").alias("document_id"), F.lit("").alias("title"), blocks.alias("blocks"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """By document: count, tokens in all, least, most, mean (1 place), median, sections, overlaps and pages."""
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.bround(F.avg("token_count"), 1).alias("mean"),
        F.percentile("token_count", 0.5).alias("median"), F.countDistinct("section_key").alias("sections"), F.count_if("has_overlap").alias("overlaps"), F.max("page_end").alias("pages"),
    )


def renumber(blocks: DataFrame) -> DataFrame:
    """Gap-free block order by document over (page, position)."""
    return blocks.withColumn("block_order", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "position")) - 1)


def dense_levels(headings: DataFrame) -> DataFrame:
    """Heading levels without gaps, by document."""
    return headings.withColumn("dense_level", F.dense_rank().over(Window.partitionBy("document_id").orderBy("level")))
