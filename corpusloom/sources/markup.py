"""HTML and XML into sections by header, and sections into chunks.

A header opens a section; what stands before the first is a section under the document's title, or under its own first words. Each chunk begins
with its section's header and that header's selector. Images are asked of a loader; one that gives nothing is skipped and takes no number.

Defined results: a null, empty or blank source, and one of headers only, has no chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from corpusloom.operators.chunking import chunks
from corpusloom.schema import IMAGE, TEXT, anchor
from corpusloom.sources.dom import Node, body_of, parse, title_of

HEADERS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PARTS = frozenset(["table", "img", *HEADERS])
Loader = Callable[[str], bytes | None]


@dataclass
class Piece:
    text: str | None
    selector: str
    src: str | None = None


@dataclass
class Section:
    header: str
    selector: str
    pieces: list[Piece] = field(default_factory=list)


def table_markdown(table: Node) -> str:
    """Header cells with a rule below, data cells, and the caption last."""
    lines = []
    line = lambda cells, by: "|" + by.join(cells) + "|"
    for row in table.find_all("tr"):
        heads = [c.text() for c in row.find_all("th")]
        cells = [c.text() for c in row.find_all("td")]
        if heads:
            lines += [line(heads, " | "), line(["---"] * len(heads), "|")]
        if cells:
            lines.append(line(cells, " | "))
    caption = next(table.find_all("caption"), None)
    if caption is not None and caption.text():
        lines.append(f"*{caption.text()}*")
    return "\n".join(lines)


def _has_parts(e: Node, known: dict[int, bool]) -> bool:
    """Whether a table, image or header is below; each subtree is looked at once."""
    if id(e) not in known:
        order = [e, *e.descendants()]
        for x in reversed(order):
            if id(x) not in known:
                known[id(x)] = any(c.tag in _PARTS or known.get(id(c), False) for c in x.elements())
    return known[id(e)]


def sections(root: Node) -> list[Section]:
    found: list[Section] = []
    orphans: list[Piece] = []
    put = lambda p: (found[-1].pieces if found else orphans).append(p)
    body = body_of(root)
    known: dict[int, bool] = {}
    todo: list[tuple[Node, int]] = [(body, 0)]
    while todo:
        e, at = todo.pop()
        if at >= len(e.children):
            continue
        todo.append((e, at + 1))
        child = e.children[at]
        if isinstance(child, str):
            if child.strip() and e.tag not in ("script", "style"):
                put(Piece(" ".join(child.split()) if not child[0].isspace() else " " + " ".join(child.split()), e.selector()))
        elif child.tag in HEADERS:
            if child.text():
                found.append(Section(child.text(), child.selector()))
        elif child.tag == "table":
            if text := table_markdown(child):
                put(Piece(text, child.selector()))
        elif child.tag == "img":
            if child.attrs.get("src"):
                put(Piece(child.attrs.get("alt") or None, child.selector(), child.attrs["src"]))
        elif _has_parts(child, known):
            todo.append((child, 0))
        elif text := child.text() or child.attrs.get("text", ""):
            put(Piece(text, child.selector()))
    if orphans:
        title = title_of(root) or orphans[0].text or orphans[0].src or "No Header"
        found.insert(0, Section(title, body.selector(), orphans))
    return found


def section_contents(found: list[Section], context_size: int, load: Loader = lambda src: None) -> list[dict]:
    """Content rows in order, numbered over all sections."""
    out: list[dict] = []

    def emit(kind: int, text: str | None, data: bytes | None, selectors: list[str]) -> None:
        out.append({"content_type": kind, "text_content": text, "data_content": data, "sequence_index": len(out), "anchor": anchor("selector", selectors=selectors)})

    for s in found:
        prefix = f"{s.header}: ({s.selector})\n\n"
        texts: list[str] = []
        places: list[str] = []
        size = len(prefix)

        def flush():
            nonlocal size
            if texts:
                emit(TEXT, prefix + "".join(texts), None, places[:])
            texts.clear(), places.clear()
            size = len(prefix)

        for p in s.pieces:
            if p.src is not None:
                flush()
                if (data := load(p.src)) is not None:
                    emit(IMAGE, p.text, data, [p.selector])
            elif len(p.text) > context_size:
                flush()
                for text, _, _ in chunks(p.text, context_size, prefix):
                    emit(TEXT, text, None, [p.selector])
            else:
                if texts and size + len(p.text) > context_size:
                    flush()
                texts.append(p.text)
                places.append(p.selector)
                size += len(p.text)
        flush()
    for row in out:
        row["document_length"] = len(out)
    return out


def digest_markup(source: str | None, context_size: int, load: Loader = lambda src: None) -> list[dict]:
    if not source or source.isspace():
        return []
    return section_contents(sections(parse(source.replace("\r\n", "\n"))), context_size, load)
