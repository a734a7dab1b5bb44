"""Markdown into blocks, and blocks into chunks under their headings, each with the lines and columns it comes from.

Defined results: a null, empty or blank source has no chunk; a chunk begins with the headings that held where its text began (or, with
``prefix="reference"``, where it ended).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from corpusloom.schema import TEXT, anchor

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z][\w-]*(?:[\s/>]|$)|/[A-Za-z]|!--|\?|![A-Z])")
_DELIMITERS = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")


@dataclass
class Block:
    kind: str  # heading, text, break
    text: str = ""
    level: int = 0
    lower: tuple[int, int] = (1, 1)
    upper: tuple[int, int] = (1, 1)


def normal_emphasis(text: str) -> str:
    """Underscores that stand for emphasis become asterisks; code stays."""
    parts = re.split(r"(`+[^`]*`+)", text)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?<![\w\\])__(?=\S)(.+?)(?<=\S)__(?!\w)", r"**\1**", parts[i])
        parts[i] = re.sub(r"(?<![\w\\_])_(?=[^\s_])(.+?)(?<=[^\s_])_(?![\w_])", r"*\1*", parts[i])
    return "".join(parts)


def plain(text: str) -> str:
    """Inline text without its marks."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"`+([^`]*)`+", r"\1", text)
    text = re.sub(r"(?<!\\)(\*{1,3}|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<![\w\\])(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", text)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)


def blocks(source: str) -> list[Block]:
    lines = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[Block] = []
    _parse([(line, n, 1) for n, line in enumerate(lines, 1)], out)
    return out


def _lead(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _parse(rows: list[tuple[str, int, int]], out: list[Block]) -> None:
    """rows: (text, line, column of its first character); containers are taken apart and parsed in turn."""
    todo = [(rows, 0)]
    while todo:
        rows, i = todo.pop()
        n = len(rows)
        while i < n:
            line, no, col = rows[i]
            if not line.strip():
                i += 1
                continue
            end = lambda j: (rows[j - 1][1], rows[j - 1][2] + len(rows[j - 1][0]))  # noqa: B023, E731
            start = (no, col + _lead(line))
            if line.startswith("    ") or line.startswith("\t"):
                j = i + 1
                while j < n and (not rows[j][0].strip() or rows[j][0].startswith(("    ", "\t"))):
                    j += 1
                while not rows[j - 1][0].strip():
                    j -= 1
                body = "\n".join(r[0][4:] if r[0].startswith("    ") else r[0].lstrip("\t") for r in rows[i:j])
                out.append(Block("text", f"```\n{body}\n```", 0, start, end(j)))
            elif m := _FENCE.match(line):
                j = i + 1
                mark = m[1]
                while j < n and not re.fullmatch(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*", rows[j][0]):
                    j += 1
                inner = "\n".join(r[0] for r in rows[i + 1 : j])
                j = min(n, j + 1)
                out.append(Block("text", f"```{m[2].strip()}\n{inner}\n```", 0, start, end(j)))
            elif m := _ATX.match(line):
                j = i + 1
                out.append(Block("heading", "#" * len(m[1]) + " " + plain((m[2] or "").strip()), len(m[1]), start, end(j)))
            elif _RULE.match(line):
                j = i + 1
                out.append(Block("break", "", 0, start, end(j)))
            elif line.lstrip(" ").startswith(">"):
                j = i
                inner = []
                while j < n and rows[j][0].strip():
                    t = rows[j][0]
                    if _lead(t) <= 3 and t.lstrip(" ").startswith(">"):
                        cut = _lead(t) + 1
                        cut += t[cut : cut + 1] == " "
                        inner.append((t[cut:], rows[j][1], rows[j][2] + cut))
                    elif inner and inner[-1][0].strip() and not _starts_block(t):
                        inner.append(rows[j])
                    else:
                        break
                    j += 1
                todo += [(rows, j), (inner, 0)]
                break
            elif m := _ITEM.match(line):
                cut = len(m[1]) + len(m[2]) + min(len(m[3] or " "), 4)
                inner = [((m[4] or ""), no, col + len(line) - len(m[4] or ""))]
                j = i + 1
                while j < n:
                    t = rows[j][0]
                    if not t.strip():
                        k = j
                        while k < n and not rows[k][0].strip():
                            k += 1
                        if k == n or _lead(rows[k][0]) < cut:
                            break
                        inner.append(("", rows[j][1], rows[j][2]))
                    elif _lead(t) >= cut:
                        inner.append((t[cut:], rows[j][1], rows[j][2] + cut))
                    elif not _starts_block(t) and inner[-1][0].strip():
                        inner.append((t.lstrip(" "), rows[j][1], rows[j][2] + _lead(t)))
                    else:
                        break
                    j += 1
                todo += [(rows, j), (inner, 0)]
                break
            elif _HTML.match(line):
                j = i + 1
                while j < n and rows[j][0].strip():
                    j += 1
                out.append(Block("text", "\n".join(r[0] for r in rows[i:j]), 0, start, end(j)))
            elif "|" in line and i + 1 < n and "-" in rows[i + 1][0] and _DELIMITERS.match(rows[i + 1][0]) and ("|" in rows[i + 1][0]):
                j = i + 2
                while j < n and rows[j][0].strip() and not _starts_block(rows[j][0]):
                    j += 1
                out.append(Block("text", "\n".join(r[0].strip() for r in rows[i:j]), 0, start, end(j)))
            else:
                j = i + 1
                level = 0
                while j < n and rows[j][0].strip():
                    if m := _SETEXT.match(rows[j][0]):
                        level = 1 if m[1][0] == "=" else 2
                        break
                    if _starts_block(rows[j][0]):
                        break
                    j += 1
                text = "\n".join(r[0].strip() for r in rows[i:j])
                if level:
                    j += 1
                    out.append(Block("heading", "#" * level + " " + plain(text.replace("\n", " ")), level, start, end(j)))
                else:
                    out.append(Block("text", normal_emphasis(text), 0, start, end(j)))
            i = j


def _starts_block(line: str) -> bool:
    """Whether a line ends a paragraph."""
    m = _ITEM.match(line)
    return bool(_ATX.match(line) or _RULE.match(line) or _FENCE.match(line) or line.lstrip(" ").startswith(">") or (m and m[4] and (not m[2][0].isdigit() or m[2][:-1] == "1")) or _HTML.match(line))


def digest_markdown(source: str | None, context_size: int, sequence_offset: int = 0, prefix: str = "start") -> list[dict]:
    """Content rows in order."""
    if not source or source.isspace():
        return []
    if prefix not in ("start", "reference"):
        raise ValueError(f"unknown prefix {prefix!r}")
    headers: list[tuple[int, str]] = []
    done: list[tuple[str, tuple[int, int], tuple[int, int]]] = []
    texts: list[str] = []
    spans: list[tuple[tuple[int, int], tuple[int, int]]] = []
    began = ""
    size = 0
    above = lambda: " > ".join(t.replace("#", "") for _, t in headers)

    def flush():
        nonlocal size
        if texts:
            head = above() if prefix == "reference" else began
            done.append(("\n".join([head, *texts]).strip(), min(a for a, _ in spans), max(b for _, b in spans)))
        texts.clear(), spans.clear()
        size = 0

    def put(b: Block):
        nonlocal size, began
        if size + len(b.text) > context_size - len(above()):
            flush()
        if not texts:
            began = above()
        texts.append(b.text)
        spans.append((b.lower, b.upper))
        size += len(b.text)

    for b in blocks(source):
        if b.kind == "break":
            flush()
        elif b.kind == "heading":
            popped = [h for h in headers if h[0] >= b.level]
            if popped and prefix == "start":
                flush()
            while headers and headers[-1][0] >= b.level:
                headers.pop()
            if popped and prefix == "reference":
                flush()
            headers.append((b.level, b.text))
            put(b)
        else:
            put(b)
    flush()
    return [
        {"content_type": TEXT, "text_content": t, "data_content": None, "sequence_index": sequence_offset + i, "document_length": len(done), "anchor": anchor("location", text_range=(a, z))}
        for i, (t, a, z) in enumerate(done)
    ]
