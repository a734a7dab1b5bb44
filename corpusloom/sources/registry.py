"""File types, which type is a kind of which, and which source reads them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from corpusloom.errors import FileNotReadable, FileTypeNotValid, NoAvailableSource, NotAFile, UnknownExtension
from corpusloom.operators.chunking import chunks
from corpusloom.schema import TEXT, anchor
from corpusloom.sources.images import Fetcher, loader
from corpusloom.sources.markdown import digest_markdown
from corpusloom.sources.markup import digest_markup
from corpusloom.sources.pdf import Provider, digest_pages

#: Each type and the types that it is a kind of.
KINDS: dict[str, tuple[str, ...]] = {
    "data": (), "text": ("data",), "plain": ("text",), "utf8": ("plain",), "utf16": ("plain",), "utf16-external": ("plain",), "source": ("plain",),
    "html": ("text",), "xml": ("text",), "plist": ("xml",), "opml": ("xml",), "markdown": ("plain",), "csv": ("text",), "json": ("text",),
    "pdf": ("data",), "image": ("data",), "png": ("image",), "jpeg": ("image",), "font": ("data",),
}
EXTENSIONS = {
    "txt": "plain", "text": "plain", "log": "plain", "html": "html", "htm": "html", "xml": "xml", "plist": "plist", "opml": "opml", "md": "markdown", "markdown": "markdown", "pdf": "pdf",
    "c": "source", "h": "source", "swift": "source", "py": "source", "csv": "csv", "json": "json", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "ttf": "font", "otf": "font",
}


def ancestors(kind: str) -> set[str]:
    """The type itself and all that it is a kind of."""
    out: set[str] = set()
    todo = [kind]
    while todo:
        k = todo.pop()
        if k not in out:
            out.add(k)
            todo += KINDS.get(k, ())
    return out


def conforms(kind: str, to: str) -> bool:
    return to in ancestors(kind)


def most_specific(kinds: list[str], conforming: str) -> str | None:
    """Of the types that the given one conforms to, the first that conforms to all the others."""
    fits = [k for k in kinds if conforms(conforming, k)]
    return next((k for k in fits if all(conforms(k, other) for other in fits)), None)


@dataclass
class Options:
    context_size: int = 512
    fetch: Fetcher | None = None
    pdf: Provider | None = None
    markdown_prefix: str = "start"


@dataclass(frozen=True)
class Source:
    name: str
    kinds: tuple[str, ...]
    digest: Callable[[str, str, bytes, Options], list[dict]]  # path, type, bytes

    def reads(self, kind: str) -> bool:
        return any(conforms(kind, k) for k in self.kinds)


def decode(data: bytes, kind: str = "plain") -> str:
    """By byte order mark, else by type, else UTF-8 with what isn't valid replaced; CR LF becomes LF."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        text = data.decode("utf-16", "replace")
    elif kind == "utf16":
        text = data.decode("utf-16-le", "replace")
    elif kind == "utf16-external":
        text = data.decode("utf-16-be", "replace")
    else:
        text = data.decode("utf-8-sig", "replace")
    return text.replace("\r\n", "\n")


def text_contents(text: str, context_size: int) -> list[dict]:
    cut = chunks(text, context_size)
    return [{"content_type": TEXT, "text_content": t, "data_content": None, "sequence_index": i, "document_length": len(cut), "anchor": anchor("text", char_range=(a, b))} for i, (t, a, b) in enumerate(cut)]


def _pdf(path: str, kind: str, data: bytes, o: Options) -> list[dict]:
    if o.pdf is None:
        raise NoAvailableSource("no provider of PDF pages was given")
    return digest_pages(o.pdf(data), o.context_size)


SOURCES = (
    Source("text", ("text", "plain", "utf8", "utf16", "utf16-external"), lambda path, kind, data, o: text_contents(decode(data, kind), o.context_size)),
    Source("pdf", ("pdf",), _pdf),
    Source("markup", ("html", "xml", "plist", "opml"), lambda path, kind, data, o: digest_markup(decode(data), o.context_size, loader(path, o.fetch))),
    Source("markdown", ("markdown",), lambda path, kind, data, o: digest_markdown(decode(data), o.context_size, prefix=o.markdown_prefix)),
)


def supported_types() -> list[str]:
    return [k for s in SOURCES for k in s.kinds]


def source_for(kind: str) -> Source:
    """The source with the most specific type that the given one conforms to."""
    fits = [s for s in SOURCES if s.reads(kind)]
    best = most_specific([k for s in fits for k in s.kinds], kind)
    if best is None:
        raise NoAvailableSource(kind)
    return next(s for s in fits if best in s.kinds)


def type_of(path: str) -> str:
    extension = os.path.splitext(path)[1].lstrip(".").lower()
    if extension not in EXTENSIONS:
        raise UnknownExtension(path)
    return EXTENSIONS[extension]


def validate(path: str, kinds: tuple[str, ...] | None = None) -> str:
    """The local path, once it is known to be a readable file of a supported type."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise NotAFile(path)
    local = unquote(parts.path) if parts.scheme else path
    if not os.path.isfile(local) or not os.access(local, os.R_OK):
        raise FileNotReadable(local)
    kind = type_of(local)
    if kinds is not None and not any(conforms(kind, k) for k in kinds):
        raise FileTypeNotValid(local)
    return local
