from __future__ import annotations

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark import packs
from veilspark.operators import evaluate as E
from veilspark.operators import generate as G
from veilspark.operators import rules as U
from veilspark.sources import office as O
from veilspark.sources import readers


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with sectors of 512: small streams in the small chain, others in sectors of their own."""
    names = list(streams)
    small, small_follow, places = b"", [], {}
    for n in names:
        if len(streams[n]) < 4096:
            places[n] = len(small) // 64
            count = max(1, -(-len(streams[n]) // 64))
            small_follow += [len(small_follow) + i + 1 for i in range(count - 1)] + [0xFFFFFFFE]
            small += streams[n].ljust(count * 64, b"\0")
    sectors: list[bytes] = []
    follow: list[int] = []

    def put(data: bytes) -> int:
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, max(1, len(data)), 512)]
        for i, p in enumerate(parts):
            sectors.append(p)
            follow.append(first + i + 1 if i + 1 < len(parts) else 0xFFFFFFFE)
        return first

    big = {n: put(streams[n]) for n in names if n not in places}
    small_at = put(small)
    table_at = put(struct.pack(f"<{len(small_follow)}I", *small_follow).ljust(512, b"\xff"))

    def entry(name: str, kind: int, right: int, child: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<III", 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<IIxxxx", start, size)

    root = entry("Root Entry", 5, 0xFFFFFFFF, 1, small_at, len(small))
    body = b"".join(entry(n, 2, i + 2 if i + 1 < len(names) else 0xFFFFFFFF, 0xFFFFFFFF, places.get(n, big.get(n)), len(streams[n])) for i, n in enumerate(names))
    dir_at = put(root + body)
    fat_at = len(sectors)
    follow.append(0xFFFFFFFD)
    fat = struct.pack(f"<{len(follow)}I", *follow).ljust(512, b"\xff")
    assert len(fat) == 512
    head = O.OLE2 + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<I", 1) + struct.pack("<IIIIIII", dir_at, 0, 4096, table_at, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108)
    return head.ljust(512, b"\0") + b"".join(sectors) + fat


def test_outlook_messages(spark, tmp_path):
    wide = lambda s: s.encode("utf-16-le")
    long = "Grüezi, hier der Text. " * 300
    message = compound({"__substg1.0_0C1A001F": wide("Ida Waldner"), "__substg1.0_0E04001E": "Köniz".encode("cp1252"), "__substg1.0_0037001F": wide("Gesuch\0"), "__substg1.0_1000001F": wide(long)})
    (tmp_path / "a.msg").write_bytes(message)
    (tmp_path / "b.msg").write_bytes(message[:700])
    (tmp_path / "c.msg").write_bytes(compound({"x": b"y"}))
    rows = {r["kennung"]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.msg"]["text"] == f"From: Ida Waldner\nTo: Köniz\nSubject: Gesuch\n\n{long}".strip()
    assert rows["b.msg"]["text"] is None and rows["c.msg"]["text"] is None and rows["b.msg"]["hinweise"][0]["schluessel"] == "nicht_gelesen"


def test_documents_without_traces(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", "<x/>")
        z.writestr("docProps/core.xml", "Ida")
        z.writestr("word/comments.xml", "Ida")
        z.writestr("_rels/.rels", '<R><Relationship Id="1" Target="docProps/core.xml"/><Relationship Id="2" Target="word/document.xml"/></R>')
    df = spark.createDataFrame([("a", raw.getvalue()), ("b", b"no zip")], "path string, content binary").withColumn("error", F.lit("clash"))
    rows = {r["path"]: r for r in O.scrub(df).collect()}
    with zipfile.ZipFile(io.BytesIO(rows["a"]["content"])) as z:
        assert z.namelist() == ["word/document.xml", "_rels/.rels"] and z.read("_rels/.rels") == b'<R><Relationship Id="2" Target="word/document.xml"/></R>'
    assert rows["a"]["removed"] == ["docProps/core.xml", "word/comments.xml"] and rows["b"]["content"] is None and rows["b"]["error"]


def test_packs_rules_and_cases(spark, tmp_path):
    pack = packs.load_pack()
    assert not pack.findings() and len(pack.tags) == 45 and packs.state()["detectors"] == ["IBAN"] and pack.placeholders["CITY"] == "CITY"
    with pytest.raises(ValueError):
        packs.load_pack("xx")
    packs.register("bad", lambda: packs.Pack("bad", tags=pack.tags[:3]))
    with pytest.raises(ValueError, match="unknown tag"):
        packs.load_pack("bad")
    assert packs.readable({"CITY"}, {"ORG"}) == {"CITY", "ORG"} and packs.tags(spark, {"CITY": "Ort"}).where("tag = 'CITY'").first()["display"] == "Ort"
    (tmp_path / "r.json").write_text('{"rules": [{"id": "ab", "type": "wordlist", "words": ["Akte"]}]}')
    assert set(U.load_file(str(tmp_path / "r.json"))) == {"X_ab"} and U.load_file(str(tmp_path / "none")) == {}
    docs = spark.createDataFrame([("a", "Bern x", [("CITY", 0, 4)]), ("b", None, [("CITY", 0, 1)])], "doc_id string, text string, spans array<struct<tag:string,start:int,end:int>>")
    gold, pred = E.cases(docs, docs)
    assert [r["value"] for r in gold.collect()] == ["Bern"] and pred.count() == 1
    judged = E.containment(gold, pred).withColumn("block", F.lit("latin"))
    assert tuple(E.verdict_table(judged, "block").first()) == ("latin", "CITY", 1, 0, 0)
    shown = spark.range(1).select(G.number_spellings(F.lit("CHE-116.281.710"), (3, 3, 3, 3))).first()[0]
    assert shown["compact"] == "CHE116281710" and shown["blank"] == "CHE 116 281 710" and len(shown) == 5
