"""Paged documents. What reads a file's pages is given by the caller; here pages become pieces.

A provider takes a file's bytes and returns ``Pages``. Text pieces come first, numbered over all pages, with the page and the range in it; then the
page images, numbered for themselves.

Defined results: pages without text are left out; where no page has a text at all, the whole document's text is chunked instead; a document without
either has only its images.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from corpusloom.operators.chunking import chunks
from corpusloom.schema import IMAGE, TEXT, anchor


@dataclass
class Pages:
    texts: list[tuple[int, str | None]] = field(default_factory=list)  # (page from 0, text), in any order
    images: list[tuple[int, bytes | None]] = field(default_factory=list)
    labels: dict[int, str] = field(default_factory=dict)
    whole: str | None = None


Provider = Callable[[bytes], Pages]


def digest_pages(pages: Pages, context_size: int) -> list[dict]:
    """Content rows in order."""
    rows: list[dict] = []
    texts = sorted((p, t) for p, t in pages.texts if t is not None)
    if texts:
        for page, text in texts:
            rows += [{"text_content": t, "anchor": anchor("pdf", page=page, char_range=(a, b))} for t, a, b in chunks(text, context_size)]
    elif pages.whole:
        rows = [{"text_content": t, "anchor": anchor("text", char_range=(a, b))} for t, a, b in chunks(pages.whole, context_size)]
    rows = [{"content_type": TEXT, "data_content": None, "sequence_index": i, "document_length": len(rows), **r} for i, r in enumerate(rows)]
    images = sorted((p, d) for p, d in pages.images if d is not None)
    for i, (page, data) in enumerate(images):
        caption = f"Page {pages.labels.get(page, page)} of PDF"
        rows.append({"content_type": IMAGE, "text_content": caption, "data_content": data, "sequence_index": i, "document_length": len(images), "anchor": anchor("pdf", page=page)})
    return rows
