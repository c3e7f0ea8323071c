"""Office containers: the streams of compound files, Outlook messages, and documents without their metadata."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OLE2 = bytes.fromhex("d0cf11e0a1b11ae1")
# Header lines of a message and the properties that hold them, the property of its body, and the kinds of text.
FIELDS = (("Date", "3007"), ("From", "0C1A"), ("To", "0E04"), ("Cc", "0E03"), ("Subject", "0037"))
BODY = "1000"
WIDE, NARROW = "001F", "001E"
_END = 0xFFFFFFFA  # chain marks begin here


def streams(body: bytes) -> dict[str, bytes]:
    """The streams of a compound file by path; one that is broken raises ValueError."""
    if len(body) < 512 or not body.startswith(OLE2):
        raise ValueError("no compound file")
    shift, small_shift = struct.unpack_from("<HH", body, 30)
    first_dir, _, limit, first_small = struct.unpack_from("<IIII", body, 48)
    size, small_size = 1 << shift, 1 << small_shift
    if not 7 <= shift <= 16 or small_shift > shift:
        raise ValueError("no compound file")
    sector = lambda n: body[(n + 1) * size : (n + 2) * size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    tables = list(struct.unpack_from("<109I", body, 76))
    more, seen = struct.unpack_from("<I", body, 68)[0], set()
    while more < _END and more not in seen:
        seen.add(more)
        *own, more = numbers(sector(more)) or [_END]
        tables += own
    follow = [n for t in tables if t < _END for n in numbers(sector(t))]

    def chain(start: int, follow: list[int], piece, most: int) -> bytes:
        out, at, steps = [], start, 0
        while at < len(follow) and steps <= len(follow) and steps * 64 <= most + size:
            out.append(piece(at))
            at, steps = follow[at], steps + 1
        return b"".join(out)[:most]

    directory = chain(first_dir, follow, sector, len(body))
    entries = []
    for k in range(0, len(directory) - 127, 128):
        raw = directory[k : k + 128]
        name = raw[: max(0, struct.unpack_from("<H", raw, 64)[0] - 2)].decode("utf-16-le", "replace")
        kind = raw[66]
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, length = struct.unpack_from("<II", raw, 116)
        entries.append((name, kind, left, right, child, start, length))
    if not entries:
        raise ValueError("no directory")
    small_follow = numbers(chain(first_small, follow, sector, len(body)))
    small = chain(entries[0][5], follow, sector, entries[0][6])
    piece = lambda n: small[n * small_size : (n + 1) * small_size]
    out: dict[str, bytes] = {}
    todo, done = [(entries[0][4], "")], set()
    while todo:
        k, path = todo.pop()
        if k >= len(entries) or k in done:
            continue
        done.add(k)
        name, kind, left, right, child, start, length = entries[k]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            out[path + name] = chain(start, small_follow, piece, length) if length < limit else chain(start, follow, sector, length)
    return out


def message_text(body: bytes, decode) -> tuple[str, str, list[str]]:
    """(header lines, body, names of attachments) of an Outlook message; decode reads narrow text from bytes."""
    own = streams(body)

    def text(field: str) -> str:
        if (raw := own.get(f"__substg1.0_{field}{WIDE}")) is not None:
            return raw.decode("utf-16-le", "replace").rstrip("\0")
        if (raw := own.get(f"__substg1.0_{field}{NARROW}")) is not None:
            return decode(raw).rstrip("\0")
        return ""

    if not any(name.startswith("__substg1.0_") for name in own):
        raise ValueError("no message")
    head = [f"{name}: {value}" for name, field in FIELDS if (value := text(field).strip())]
    attached = sorted({name.split("/", 1)[0] for name in own if name.startswith("__attach")})
    names = []
    for a in attached:
        raw = own.get(f"{a}/__substg1.0_3707{WIDE}", own.get(f"{a}/__substg1.0_3704{WIDE}", b""))
        names.append(raw.decode("utf-16-le", "replace").rstrip("\0") or a)
    return ("\n".join(head), text(BODY), names)


# Parts of an office document that tell who wrote it and when; those that end in / are folders.
TRACES = ("docProps/", "word/comments.xml", "word/commentsExtended.xml", "word/commentsIds.xml", "word/people.xml", "meta.xml", "customXml/")
_LINK = re.compile(rb'<(?:Relationship|Override)\b[^>]*"/?(?:docProps/|word/comments|comments|word/people\.xml|people\.xml|(?:\.\./)?customXml/)[^>]*/>')


def _tells(name: str) -> bool:
    return any(name.startswith(t) if t.endswith("/") else name == t for t in TRACES)


def without_traces(body: bytes) -> tuple[bytes, list[str]]:
    """(document without the parts that tell of its writers, names of those parts); links to them are taken out, too."""
    out, gone = io.BytesIO(), []
    with zipfile.ZipFile(io.BytesIO(body)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
        for part in src.infolist():
            if _tells(part.filename):
                gone.append(part.filename)
                continue
            raw = src.read(part)
            if part.filename.endswith(".rels") or part.filename == "[Content_Types].xml":
                raw = _LINK.sub(b"", raw)
            dst.writestr(zipfile.ZipInfo(part.filename, (1980, 1, 1, 0, 0, 0)), raw, zipfile.ZIP_DEFLATED)
    return out.getvalue(), sorted(gone)


def scrub(files: DataFrame) -> DataFrame:
    """(path, content, removed, error) of office files (path, content); a file that can't be read keeps a null content."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, body in part[["path", "content"]].itertuples(index=False):
                try:
                    rows.append((path, *without_traces(bytes(body)), None))
                except Exception as e:  # one broken file must not end the scan
                    rows.append((path, None, [], f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "content", "removed", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, removed array<string>, error string")
