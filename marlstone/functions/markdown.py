"""Markdown pages as columns: one Arrow pass over the text.

``parse_pages`` adds a struct per page with everything that rules and signals read. Code, comments
and sections are found by one scan from left to right, so a fence inside a comment, or a comment
inside a fence, is no more than text. Rules over pages are then filters and joins on columns.

The views of a page: its *links* come from the text without generated sections and code; its
*evidence* is the body without link sections, code and comments; its *status* view is that of the
links; its *canonical* text lacks generated sections only, for hashing.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, MapType, StringType, StructField, StructType

# Patterns that say what counts as a link, a status note, a quotation and so on.
LINK = re.compile(r"\[\[(?:[^/\]|]+/)?([^\]|]+?)(?:\|[^\]]+)?\]\]")
FILE_LINK = re.compile(r"\[[^\]]+\]\(([^)\s]+?\.md)(?:#[^)\s]*)?\)")
STATUS = re.compile(r"\*\*Status(?: note)?\s*\((\d{4}-\d{2}-\d{2})\)")
QUOTATION = re.compile(r'["“]([^"“”]{20,}?)["”]\s*\((?:own[^)]*?, )?source[sd]?:?\s*([^)]*\[\[[^)]*)\)', re.I)
WEB_ADDRESS = re.compile(r"https?://[^\s\])}>\"']+", re.I)
RAW_TOKEN = re.compile(r"(?<![-A-Za-z0-9_./:\x00\x5c])raw/[^\s,\]\"')]+")
WIKI_TOKEN = re.compile(r"(?<![-A-Za-z0-9_./:\x00\x5c])wiki/[^\s,\])]+?\.md(?=$|[\s,\])}>\"'|]|[.;:](?=$|\s))")
KEBAB = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
FREE_PROVENANCE = re.compile(r"^(experience|web|deliverable|source)[:\s]", re.I)
# Words that say nothing about a page's subject.
STOP_WORDS = (
    "the", "and", "that", "this", "with", "from", "into", "your", "you", "are", "for", "not", "but", "what", "when", "where", "which", "they", "them", "then", "than", "have", "has", "had", "was", "were", "will",
    "would", "can", "could", "should", "its", "it's", "their", "these", "those", "there", "here", "page", "pages", "wiki", "type", "tags",
)
GENERATED, CURATED = "Referenced by", "Related pages"

_STRINGS = ArrayType(StringType())
PARSED = StructType(
    [
        StructField("fm", MapType(StringType(), StringType())),
        StructField("fm_block", StringType()),
        StructField("fm_error", StringType()),
        StructField("links", _STRINGS),
        StructField("file_links", _STRINGS),
        StructField("words", LongType()),
        StructField("tokens", _STRINGS),
        StructField("body_links", BooleanType()),
        StructField("sources", _STRINGS),
        StructField("provenance", ArrayType(StructType([StructField("kind", StringType()), StructField("ref", StringType())]))),
        StructField("authority_ref_safe", BooleanType()),
        StructField("use_cases", BooleanType()),
        StructField("status_date", StringType()),
        StructField("labels", _STRINGS),
        StructField("cites_synthesis", LongType()),
        StructField("says_confidence", BooleanType()),
        StructField("has_disagreement", BooleanType()),
        StructField("sections", _STRINGS),
        StructField("canonical", StringType()),
        StructField("quotes", ArrayType(StructType([StructField("quote", StringType()), StructField("fragments", _STRINGS), StructField("cites", _STRINGS)]))),
    ]
)

_MARK = "\0"
_SCAN = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[^\r\n]*(?:\r?\n|\r?\Z)|<!--|`+", re.M)
_HEADING = re.compile(r"(#{1,6})[ \t]+(.+?)[ \t]*")
_FIELD = re.compile(r"([A-Za-z_][A-Za-z0-9_]*):(.*)")


class MalformedFrontmatter(ValueError):
    """A page opens with dashes that are no frontmatter, or never closes it."""


def frontmatter_end(text: str) -> tuple[str, int]:
    """The raw block and where the body starts; no block and 0 where a page has none."""
    lines = text.splitlines(keepends=True)
    bare = [line.rstrip("\r\n") for line in lines[:1]]
    if not bare or not bare[0].startswith("---"):
        return "", 0
    if bare[0] != "---":
        raise MalformedFrontmatter("leading frontmatter opener must be exactly '---'")
    end = len(lines[0])
    for line in lines[1:]:
        end += len(line)
        if line.rstrip("\r\n") == "---":
            block = text[len(lines[0]) : end - len(line)]
            return re.sub(r"(\r\n|\n|\r)\Z", "", block), end
    raise MalformedFrontmatter("leading frontmatter is missing an exact closing '---' line")


def split_frontmatter(text: str) -> tuple[dict[str, str] | None, str, str, str | None]:
    """Fields, raw block, body and error; a page without an opening line has no fields."""
    try:
        block, end = frontmatter_end(text)
    except MalformedFrontmatter as error:
        return None, "", text, str(error)
    if not end:
        return None, "", text, None
    return {m[1]: m[2].strip() for m in map(_FIELD.fullmatch, block.splitlines()) if m}, block, text[end:], None


def regions(text: str, start: int = 0) -> Iterator[tuple[str, int, int]]:
    """``(kind, begin, end)`` of fences, comments and code spans, each found where the one before ends."""
    hopeless: set[int] = set()  # lengths of backtick runs that nothing closes any more
    at = start
    while found := _SCAN.search(text, at):
        begin, at = found.span()
        if found[1]:
            close = re.compile(rf"^[ \t]{{0,3}}{found[1][0]}{{{len(found[1])},}}[ \t]*(?:\r?\n|\r?\Z)", re.M).search(text, at)
            at = close.end() if close else len(text)
            yield "fence", begin, at
        elif found[0] == "<!--":
            close = text.find("-->", at)
            at = close + 3 if close >= 0 else len(text)
            yield "comment", begin, at
        elif at - begin not in hopeless:
            close = re.compile(rf"(?<!`)`{{{at - begin}}}(?!`)").search(text, at)
            if close:
                at = close.end()
                yield "code", begin, at
            else:
                hopeless.add(at - begin)


def mask(text: str, start: int = 0, comments: bool = True, mark: str = _MARK) -> str:
    """The text with code, and comments if asked, overwritten by marks; line ends stay."""
    out, at = [], 0
    for kind, begin, end in regions(text, start):
        if comments or kind != "comment":
            out += (text[at:begin], re.sub(r"[^\r\n]", mark, text[begin:end]))
            at = end
    return "".join([*out, text[at:]])


def mask_code(text: str) -> str:
    """The text with fences, code spans and comments blanked, of the same length."""
    return mask(text, mark=" ")


def headings(text: str, start: int = 0) -> list[tuple[int, int, str]]:
    """``(offset, level, title)`` outside code, comments and what lies before ``start``."""
    out, at = [], start
    for line in mask(text, start)[start:].splitlines(keepends=True):
        found = _HEADING.fullmatch(line.rstrip("\r\n"))
        if found:
            out.append((at, len(found[1]), re.sub(r"[ \t]+#+[ \t]*$", "", found[2]).strip()))
        at += len(line)
    return out


def section_spans(text: str, *names: str, start: int | None = None) -> list[tuple[int, int]]:
    """Spans of level-2 sections of these names, each up to the next heading of level 1 or 2."""
    start = frontmatter_end(text)[1] if start is None else start
    tops = [(at, level, title) for at, level, title in headings(text, start) if level <= 2]
    ends = [*(at for at, _, _ in tops[1:]), len(text)][: len(tops)]
    wanted = {n.casefold() for n in names}
    return [(at, end) for (at, level, title), end in zip(tops, ends, strict=True) if level == 2 and title.casefold() in wanted]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at:begin])
        at = end
    return "".join([*out, text[at:]])


def link_view(text: str) -> str:
    """Authored links: no generated section and no code; comments and frontmatter stay."""
    kept = without(text, section_spans(text, GENERATED))
    return mask(kept, frontmatter_end(kept)[1], comments=False, mark=" ")


def evidence_view(text: str) -> str:
    body = text[frontmatter_end(text)[1] :]
    return mask_code(without(body, section_spans(body, GENERATED, CURATED, start=0)))


def canonical_text(text: str) -> str:
    """The text without generated sections; only the joins and the end are made alike."""
    for begin, end in reversed(section_spans(text, GENERATED)):
        parts = [text[:begin].rstrip("\r\n"), text[end:].lstrip("\r\n")]
        text = "\n\n".join(parts) if text[:begin] and text[end:] else "".join(parts)
    return text.rstrip("\r\n") + "\n" if text else ""


def token_words(evidence: str) -> set[str]:
    plain = re.sub(r"[`*#|>_\-\[\]()]", " ", LINK.sub(" ", evidence)).lower()
    return {w for w in re.findall(r"[a-z][a-z0-9']+", plain) if len(w) >= 4} - set(STOP_WORDS)


def list_items(value: str) -> list[str]:
    """Items of an inline list or scalar; a comma between quotation marks divides nothing."""
    value = value.strip().removeprefix("[").removesuffix("]")
    items = re.findall(r"""((?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^,"'])+)""", value)
    return [x for x in (i.strip().strip("\"'").strip() for i in items) if x]


def _block_items(lines: list[str]) -> Iterator[str]:
    for line in lines:
        item = re.match(r"\s+-\s+(.*)$", line)
        if item:
            yield item[1].strip()
        elif re.match(r"\S", line):
            return


def source_items(block: str) -> list[str]:
    """Items of the ``sources`` field, inline or as a block."""
    lines, out = block.splitlines(), []
    for i, line in enumerate(lines):
        field = re.match(r"\s*sources?:\s*(.*)$", line)
        if field and field[1].strip():
            out += list_items(field[1])
        elif field:
            out += [x for x in (y.strip("\"'").strip() for y in _block_items(lines[i + 1 :])) if x]
    return out


def has_items(block: str, key: str) -> bool:
    """Whether the first field of that name holds a value or a block item."""
    lines = block.splitlines()
    for i, line in enumerate(lines):
        if line.startswith(f"{key}:"):
            inline = line[len(key) + 1 :].strip()
            return bool(inline and inline != "[]") or any(_block_items(lines[i + 1 :]))
    return False


def scalar(value: str | None) -> str:
    value = (value or "").strip()
    quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'"
    return value[1:-1].strip() if quoted else value


def safe_path(ref: str) -> bool:
    """Whether a reference is a plain path below the repository's root."""
    return bool(ref) and "\\" not in ref and "\0" not in ref and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref) and not {"", ".", ".."} & set(ref.split("/"))


def provenance(items: list[str]) -> list[dict]:
    """What each item of ``sources`` refers to: ``raw`` and ``wiki`` paths and ``slug``s, to be looked
    up, or what is wrong with it (``bad``). Web addresses and free text refer to nothing here."""
    out = []
    for item in items:
        if FREE_PROVENANCE.match(item) or WEB_ADDRESS.fullmatch(item):
            continue
        found = [("raw", m) for m in RAW_TOKEN.finditer(item)] + [("wiki", m) for m in WIKI_TOKEN.finditer(item)]
        inside = {k for _, m in found for k in range(*m.span())}
        unseen = WEB_ADDRESS.sub(lambda m: "\0" * len(m[0]), item)
        odd = list(dict.fromkeys((m[0][:-1].lower(), _around(item, unseen, *m.span())) for m in re.finditer(r"(?i)(?:raw|wiki)[\\/]", unseen) if m.start() not in inside))
        bad = [f"unsafe {kind} repository path expression: {text!r}" for kind, text in odd if text]
        if not found and not bad and ("/" in item or "\\" in item or item.startswith((".", "~")) or re.fullmatch(r"[^\s.][^\s]*\.[^\s./]+", item)):
            bad.append(f"unsafe provenance path expression: {item!r}")
        for kind, m in found:
            ref = m[0].rstrip(".,:") if kind == "raw" else m[0]
            out.append({"kind": kind, "ref": ref} if safe_path(ref.removesuffix("/")) else {"kind": "bad", "ref": f"'{ref}' does not exist or is unsafe"})
        out += [{"kind": "bad", "ref": b} for b in bad]
        if not found and not bad:
            out.append({"kind": "slug", "ref": item} if KEBAB.fullmatch(item) else {"kind": "bad", "ref": f"unclassified provenance reference: {item!r}"})
    return out


def _around(item: str, unseen: str, begin: int, end: int) -> str:
    """The expression that holds a place, up to white space or a closing mark on either side."""
    before, after = re.search(r"[^\s,\])}|]*$", unseen[:begin]), re.match(r"[^\s,\])}|]*", unseen[end:])
    return item[before.start() : end + after.end()].strip("([{<\"'")


def plain_quote(text: str) -> str:
    """Text as quotations are compared: lower case, straight marks, no other punctuation."""
    return " ".join(re.sub(r"[^a-z0-9' ]+", " ", text.lower().replace("’", "'").replace("‘", "'")).split())


def fragments(quote: str) -> list[str]:
    """Parts between ellipses and bracketed edits, of six words or more."""
    return [p for p in map(plain_quote, re.split(r"\.\.\.|…|\[[^\]]*\]", quote)) if len(p.split()) >= 6]


def _date(value: str) -> str | None:
    try:
        return datetime.date.fromisoformat(value).isoformat()
    except ValueError:
        return None


def _quotes(body: str) -> list[dict]:
    out = []
    for m in QUOTATION.finditer(without(body, section_spans(body, GENERATED, CURATED, start=0))):
        parts = fragments(m[1])
        if parts and "own framing" not in m[0].lower() and "own interview framing" not in m[0].lower():
            out.append({"quote": m[1], "fragments": parts, "cites": LINK.findall(m[2])})
    return out


def parse(text: str | None) -> dict:
    """All of ``PARSED`` for one page; a page whose frontmatter is malformed has no views."""
    text = text or ""
    fm, block, body, error = split_frontmatter(text)
    links = evidence = status = canonical = ""
    related: list[str] = []
    if error is None:
        links, evidence, canonical = link_view(text), evidence_view(text), canonical_text(text)
        status = links
        spans = section_spans(text, CURATED)
        related = text[slice(*spans[0])].splitlines()[1:] if spans else []
    authored = without(body, section_spans(body, GENERATED, CURATED, start=0)) if error is None else ""
    return {
        "fm": fm, "fm_block": block, "fm_error": error, "links": LINK.findall(links), "file_links": FILE_LINK.findall(links), "words": len(re.findall(r"\w+", evidence)), "tokens": sorted(token_words(evidence)),
        "body_links": bool(LINK.search(evidence)), "sources": (items := source_items(block)), "provenance": provenance(items), "authority_ref_safe": safe_path(scalar((fm or {}).get("authority_ref"))), "use_cases": has_items(block, "agent_use_cases"), "status_date": max(filter(None, map(_date, STATUS.findall(status))), default=None),
        "labels": [m[1] for m in (re.match(r"-\s+([A-Za-z][A-Za-z ]*?):\s", x) for x in related if "[[" in x) if m],
        "cites_synthesis": len(re.findall(r"(?i)\(sources?:[^)]*\[\[synthesis\]\]", evidence)), "says_confidence": "confidence" in authored.lower(), "has_disagreement": "## Disagreement" in authored,
        "sections": [t for _, level, t in headings(body) if level == 2], "canonical": canonical, "quotes": _quotes(body) if error is None else [],
    }


@F.pandas_udf(PARSED)
def parsed(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in text], columns=PARSED.names)


def parse_pages(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """The pages with a column ``page`` of all that is parsed."""
    return pages.withColumn("page", parsed(F.col(text_col)))


def with_place(pages: DataFrame) -> DataFrame:
    """``folder`` (null at the root) and ``stem`` from ``path``."""
    folder = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1))
    return pages.withColumns({"folder": folder, "stem": F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")})
