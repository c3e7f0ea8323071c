"""Files as documents: plain text, mail, mailboxes, DOCX and HTML from binary files; labelled data sets; name lists.

Files are listed and read by Spark; each is decoded in Arrow batches on the executors. A file that cannot be read gives
a row without text and with a notice, never an error for the whole scan.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contract import label_hash
from ..functions.text import html_text, readable_part
from .office import OLE2, message_text

# Extensions that are read, those that have no reader, encodings in order of trial.
REJECTED = ("doc", "dot", "xls", "ppt", "pdf")
READABLE = ("msg", "txt", "md", "log", "text", "csv", "json", "eml", "mbox", "docx", "html", "htm", "")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "iso-8859-1")
DOCX_LIMIT = 64 * 1024 * 1024
DOCUMENT = "path string, doc_no int, kennung string, format string, text string, hinweise array<struct<schluessel:string,werte:map<string,string>,text:string>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def notice(key: str, text: str, **values: object) -> dict:
    return {"schluessel": key, "werte": {k: str(v) for k, v in values.items()}, "text": text}


def decode(body: bytes) -> tuple[str, list[dict]]:
    for name in ENCODINGS:
        try:
            text = body.decode(name)
        except UnicodeDecodeError:
            continue
        found = [notice("bom", "byte order mark")] if body.startswith(b"\xef\xbb\xbf") else []
        return text, found + ([notice("kodierung", f"read as {name}", kodierung=name)] if name not in ENCODINGS[:2] else [])
    return body.decode("utf-8", "replace"), [notice("kodierung", "read with replacements")]


def mail_text(message: email.message.EmailMessage) -> tuple[str, list[dict]]:
    """Headers that name people and the matter, then the first plain part, else the HTML one; attachments are named."""
    head = "\n".join(f"{h}: {message[h]}" for h in ("Date", "From", "To", "Cc", "Subject") if message[h])
    found, body = [], None
    for kind in ("plain", "html"):
        part = message.get_body((kind,))
        if part is not None and body is None:
            body = part.get_content() if kind == "plain" else html_text(part.get_content())
            if kind == "html":
                found.append(notice("nur_html", "HTML only"))
            body, left = readable_part(body)
            if left:
                found.append(notice("binaerrest", "binary tail left out", zeichen=left))
    for part in message.iter_attachments():
        found.append(notice("anhang_uebersprungen", "attachment left out", name=part.get_filename() or "?"))
    if body is None:
        found.append(notice("nicht_gelesen", "no text part"))
    return f"{head}\n\n{body or ''}".strip(), found


def docx_text(body: bytes) -> tuple[str, list[dict]]:
    """Paragraphs by line, table rows by tabs; other parts with text are reported."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        if sum(i.file_size for i in z.infolist()) > DOCX_LIMIT:
            raise ValueError("too large")
        raw = z.read("word/document.xml")
        if re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", raw, re.I):
            raise ValueError("document type declarations are not read")
        names = z.namelist()

    def words(node: ElementTree.Element) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in node.iter())

    out = []
    for node in ElementTree.fromstring(raw).find(f"{_W}body") or ():
        if node.tag == f"{_W}p":
            out.append(words(node))
        elif node.tag == f"{_W}tbl":
            out += ["\t".join(" ".join(words(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
    left = [n for n in names if re.fullmatch(r"word/(?:header|footer|footnotes|endnotes|comments)\d*\.xml", n)]
    return "\n".join(out).strip(), [notice("nicht_gelesen", "parts left out", teile=", ".join(left))] if left else []


def documents_of(path: str, body: bytes) -> list[tuple]:
    """Rows of one file: (doc_no, kennung, format, text, notices)."""
    name = path.rsplit("/", 1)[-1]
    stem, _, ext = name.rpartition(".") if "." in name else (name, "", "")
    ext = ext.lower()
    try:
        if ext == "msg":
            head, text, names = message_text(body, lambda raw: decode(raw)[0])
            found = [notice("anhang_uebersprungen", "attachment left out", name=n) for n in names]
            found += [] if text.strip() else [notice("msg_ohne_textrumpf", "no plain body")]
            text, left = readable_part(text)
            found += [notice("binaerrest", "binary tail left out", zeichen=left)] if left else []
            return [(0, name, "msg", f"{head}\n\n{text}".strip(), found)]
        if ext in REJECTED or body.startswith(OLE2) or body.startswith(b"%PDF-"):
            return [(0, name, ext or "msg", None, [notice("nicht_gelesen", "no reader for this format", endung=ext)])]
        if ext == "eml":
            text, found = mail_text(email.message_from_bytes(body, policy=email.policy.default))
            return [(0, name, "eml", text, found)]
        if ext == "mbox":
            rows = []
            for k, part in enumerate(re.split(rb"(?m)^From [^\n]*\n", body)[1:], 1):
                message = email.message_from_bytes(part, policy=email.policy.default)
                text, found = mail_text(message)
                rows.append((k, f"{stem}#{k:03d} {str(message['Subject'] or '')[:40]}".strip(), "mbox", text, found))
            return rows or [(0, name, "mbox", None, [notice("nicht_gelesen", "no message")])]
        if ext == "docx":
            text, found = docx_text(body)
            return [(0, name, "docx", text, found)]
        text, found = decode(body)
        return [(0, name, "html" if ext in ("html", "htm") else "text", html_text(text) if ext in ("html", "htm") else text, found)]
    except Exception as e:  # one broken file must not end the scan
        return [(0, name, ext or "text", None, [notice("nicht_gelesen", f"{type(e).__name__}: {e}"[:200])])]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All readable files below a path, hidden ones left out; a mailbox gives one row for each message."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, "[.]"), -1))).otherwise("")
    chosen = files.where(ext.isin(*READABLE, *REJECTED) & ~name.startswith(".")).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(path, *row) for path, body in part.itertuples(index=False) for row in documents_of(path, bytes(body))]
            yield pd.DataFrame(rows, columns=["path", "doc_no", "kennung", "format", "text", "hinweise"])

    return chosen.mapInPandas(run, DOCUMENT)


def read_dataset(spark: SparkSession, path: str, check_labels: bool = True) -> DataFrame:
    """Labelled texts as JSON lines; the first line holds the label hash, which must be the contract's."""
    schema = "_meta struct<pack:string,label_hash:string,seed:bigint>, text string, lang string, template string, spans array<struct<tag:string,start:int,end:int>>"
    rows = spark.read.schema(schema).json(path)
    meta = rows.where("_meta is not null").select("_meta.label_hash").first()
    if check_labels and (meta is None or meta["label_hash"] != label_hash()):
        raise ValueError("the data set was made for other labels")
    return rows.where("_meta is null").drop("_meta")


def write_dataset(df: DataFrame, path: str, seed: int = 0) -> None:
    """Rows and a header with the label hash, in one folder of JSON lines."""
    head = df.sparkSession.range(1).select(F.struct(F.lit("ch").alias("pack"), F.lit(label_hash()).alias("label_hash"), F.lit(seed).cast("bigint").alias("seed")).alias("_meta"))
    head.unionByName(df, allowMissingColumns=True).write.mode("errorifexists").json(path)


def read_gold(spark: SparkSession, path: str, unchecked: bool = False) -> DataFrame:
    """Gold documents; only checked ones unless asked otherwise, and none at all is an error."""
    schema = "id string, lang string, doctype string, herkunft string, geprueft boolean, text string, spans array<struct<tag:string,start:int,end:int,wert:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    kept = rows if unchecked else rows.where("geprueft")
    if kept.isEmpty():
        raise ValueError("no gold documents")
    return kept


def skipped_gold(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the gold documents that read_gold leaves out as unchecked."""
    rows = spark.read.schema("id string, geprueft boolean").option("multiLine", True).json(path)
    return rows.where(~F.coalesce("geprueft", F.lit(False))).select("id")


def write_gold(df: DataFrame, path: str, replace: bool = False) -> None:
    """Gold documents as JSON; an existing folder is only replaced if asked for."""
    df.write.mode("overwrite" if replace else "errorifexists").json(path)


def read_places_of_origin(spark: SparkSession, path: str) -> DataFrame:
    """(name, canton, written, historical) of the placeOfOrigin elements of an XML register; names that are no longer valid
    are kept, as they stand in old documents. No element at all is an error."""
    schema = "placeOfOriginName string, cantonAbbreviation string, validTo string"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "placeOfOrigin").option("ignoreNamespace", True).load(path).where("placeOfOriginName <> ''")
    if rows.isEmpty():
        raise ValueError("no place of origin")
    written = F.trim(F.concat_ws(" ", "placeOfOriginName", "cantonAbbreviation"))
    return rows.select(F.col("placeOfOriginName").alias("name"), F.col("cantonAbbreviation").alias("canton"), written.alias("written"), F.col("validTo").isNotNull().alias("historical"))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(tag, name) of lists as JSON files; the tag is that of the meta part, and names TAG|language|value give TAG@language."""
    rows = spark.read.schema("meta struct<tag:string>, entries array<string>").option("multiLine", True).json(path)
    own = rows.select("meta.tag", F.explode("entries").alias("name")).withColumn("p", F.split("name", "[|]", 3))
    three = F.size("p") == 3
    return own.select(F.when(three, F.concat(F.col("p")[0], F.lit("@"), F.col("p")[1])).otherwise(F.col("tag")).alias("tag"), F.when(three, F.col("p")[2]).otherwise(F.col("name")).alias("name"))


def read_column(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The first of the named columns, whatever its case, of a CSV whose separator is the most frequent of ; , and tab."""
    head = "".join(r["value"] + "\n" for r in spark.read.text(path).limit(20).collect())[:4096]
    sep = max(";,\t", key=head.count)
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    by = {c.lower().strip(): c for c in df.columns}
    own = next((by[n.lower()] for n in names if n.lower() in by), None)
    if own is None:
        raise ValueError(f"none of {names} among {df.columns}")
    return df.select(F.trim(F.col(own)).alias("value")).where("value <> ''")


def read_weighted_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, weight) of the newest period, summed; Swiss thousands marks are dropped."""
    df = spark.read.option("header", True).option("sep", ";").csv(path)
    newest = df.agg(F.max("period")).first()[0]
    number = F.regexp_replace("weight", "['’\\u00a0 ]", "").try_cast("bigint")
    return df.where(F.col("period") == newest).groupBy(F.trim("name").alias("name")).agg(F.sum(F.coalesce(number, F.lit(0))).alias("weight"))
