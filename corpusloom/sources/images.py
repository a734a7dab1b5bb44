"""Images by their first bytes, and where an image's address points. Nothing is fetched over a network unless a fetcher is given."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from urllib.parse import unquote, unquote_to_bytes, urljoin, urlsplit

from corpusloom.errors import FileNotReadable, ImageNotValid

_SIGNS = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"), (b"II*\x00", "image/tiff"), (b"MM\x00*", "image/tiff"))
#: (status, media type, body) of an address.
Fetcher = Callable[[str], tuple[int, str, bytes]]


def sniff(data: bytes) -> str | None:
    """The media type that the first bytes tell, or None."""
    for sign, kind in _SIGNS:
        if data.startswith(sign) and len(data) > len(sign):
            return kind
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    if data[4:12] in (b"ftypheic", b"ftypheix", b"ftypavif", b"ftypmif1"):
        return "image/heif"
    return None


def load_image(address: str, fetch: Fetcher | None = None) -> bytes:
    """The bytes of a local file, a data address or, with a fetcher, a remote one (200 to 299, of an image type)."""
    parts = urlsplit(address)
    if parts.scheme in ("http", "https"):
        if fetch is None:
            raise ImageNotValid(f"{address} is remote and no fetcher was given")
        status, kind, data = fetch(address)
        if not 200 <= status <= 299:
            raise ImageNotValid(f"{address} answered {status}")
        if not kind.startswith("image/"):
            raise ImageNotValid(f"{address} is {kind}")
    elif parts.scheme == "data":
        head, _, body = parts.path.partition(",")
        data = base64.b64decode(unquote(body)) if head.endswith(";base64") else unquote_to_bytes(body)
    elif parts.scheme in ("", "file"):
        path = unquote(parts.path)
        if not os.access(path, os.R_OK) or not os.path.isfile(path):
            raise FileNotReadable(path)
        with open(path, "rb") as f:
            data = f.read()
    else:
        raise ImageNotValid(f"{address} has an unknown scheme")
    if sniff(data) is None:
        raise ImageNotValid(f"{address} is no image")
    return data


def resolve(src: str, of_file: str) -> str:
    """The address that src has in a file."""
    base = of_file if "://" in of_file or of_file.startswith("file:") else "file://" + os.path.abspath(of_file)
    return urljoin(base, src)


def loader(of_file: str, fetch: Fetcher | None = None):
    """src to bytes, or None where the image can't be had."""

    def load(src: str) -> bytes | None:
        try:
            return load_image(resolve(src, of_file), fetch)
        except (FileNotReadable, ImageNotValid, ValueError, OSError):
            return None

    return load
