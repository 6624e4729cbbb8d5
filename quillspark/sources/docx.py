"""Word documents as DataFrames.

One Python task a file unzips and walks the XML tree (nothing in Spark reads OOXML) and returns the document as one
row of arrays; everything after that is DataFrame work on the exploded arrays. Nested structures are flattened at the
source: a paragraph carries the table, row and column of its outermost cell.

A file that is not a valid archive, or breaks a limit, becomes a row with an error instead of failing the job.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

MAX_ENTRY, MAX_TOTAL = 50 << 20, 200 << 20
INLINES = "array<struct<kind:string,text:string,media_id:string,rel_id:string>>"
SCHEMA = (
    "doc_id string, error string,"
    f"blocks array<struct<source_id:string,source_order:int,kind:string,table_id:string,row:int,col:int,num_id:string,level:int,rows:int,inlines:{INLINES}>>,"
    "media array<struct<media_id:string,rel_id:string,file_name:string,content_type:string,content:binary>>,"
    "levels array<struct<num_id:string,abstract_id:string,level:int,num_fmt:string,lvl_text:string,start:int>>,"
    "warnings array<struct<level:string,message:string>>"
)
CONTENT_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "emf": "image/emf", "wmf": "image/wmf"}
#: Structures that are reported instead of read: local name, whether it has content, what is said.
UNSUPPORTED = (("txbxContent", True, "文本框内容暂不支持"), ("object", True, "Word 嵌入对象暂不支持"), ("altChunk", False, "altChunk 外部内容暂不支持"), ("imagedata", False, "VML 图片对象暂不支持，请转换为 PNG/JPEG"))
NO_TEXT = "（无法提取可见文字；原结构位于 word/document.xml）"
_NS = r"(?:[A-Za-z_][\w.-]*:)?"


def entries(data: bytes) -> dict[str, bytes]:
    """The archive's files; absolute or climbing paths, repeated names and oversized contents are refused."""
    out: dict[str, bytes] = {}
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            raw = info.orig_filename
            if info.is_dir():
                continue
            if raw.startswith(("/", "\\")) or re.match(r"[A-Za-z]:[/\\]", raw):
                raise ValueError(f"Absolute path: {raw}")
            name = raw.replace("\\", "/")
            if ".." in name.split("/"):
                raise ValueError(f"Path traversal: {name}")
            if not name.strip():
                continue
            if name in out:
                raise ValueError(f"Duplicate ZIP entry: {name}")
            with archive.open(info) as part:
                content = part.read(MAX_ENTRY + 1)
            if len(content) > MAX_ENTRY:
                raise ValueError(f"Entry too large: {name}")
            total += len(content)
            if total > MAX_TOTAL:
                raise ValueError("Total size exceeds limit")
            out[name] = content
    if "word/document.xml" not in out:
        raise ValueError("缺少 word/document.xml")
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def _attr(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _whole(value: str | None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def numbering_levels(xml: bytes) -> list[dict]:
    """A row for each list and level: the abstract list's levels with the list's own starts."""
    if not xml.strip():
        return []
    root, abstract = ElementTree.fromstring(xml), {}
    for node in root.iter():
        if _local(node.tag) == "abstractNum":
            levels = abstract.setdefault(_attr(node, "abstractNumId"), {})
            for lvl in (x for x in node.iter() if _local(x.tag) == "lvl"):
                of = {_local(x.tag): _attr(x, "val") for x in lvl}
                at = _whole(_attr(lvl, "ilvl")) or 0
                levels[at] = {"level": at, "num_fmt": of.get("numFmt"), "lvl_text": of.get("lvlText"), "start": _whole(of.get("start"))}
    out = []
    for node in (x for x in root.iter() if _local(x.tag) == "num"):
        num_id = _attr(node, "numId")
        abstract_id = next((_attr(x, "val") for x in node if _local(x.tag) == "abstractNumId"), None)
        starts = {_whole(_attr(o, "ilvl")) or 0: _whole(_attr(x, "val")) for o in node if _local(o.tag) == "lvlOverride" for x in o if _local(x.tag) == "startOverride"}
        for at, level in sorted(abstract.get(abstract_id, {}).items()):
            own = starts.get(at)
            out.append({"num_id": num_id, "abstract_id": abstract_id} | level | ({"start": own} if own is not None else {}))
    return out


def relationships(xml: bytes) -> tuple[set[str], dict[str, str], list[str]]:
    """Declared image relationships, those with a target, and warnings."""
    declared, targets, warnings = set(), {}, []
    if xml.strip():
        for node in ElementTree.fromstring(xml).iter():
            if _local(node.tag) == "Relationship" and "/image" in (_attr(node, "Type") or "") and (rel := _attr(node, "Id") or "").strip():
                declared.add(rel)
                if target := (_attr(node, "Target") or "").strip():
                    targets[rel] = target
                else:
                    warnings.append(f"Image relationship {rel} 缺少 Target")
    return declared, targets, warnings


def unsupported(xml: str) -> list[str]:
    """A message for every occurrence of a structure that cannot be read, with the text that is visible in it."""
    out = []
    for name, content, reason in UNSUPPORTED:
        pattern = rf"<{_NS}{name}\b[^>]*>.*?</{_NS}{name}\s*>" if content else rf"<{_NS}{name}\b[^>]*?/?>"
        for found in re.finditer(pattern, xml, re.IGNORECASE | re.DOTALL):
            seen = "".join(re.findall(rf"<{_NS}(?:t|instrText)\b[^>]*>(.*?)</{_NS}(?:t|instrText)\s*>", found[0], re.IGNORECASE | re.DOTALL))
            for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
                seen = seen.replace(entity, char)
            out.append(f"[UNSUPPORTED] {reason}\n[RAW] {seen.strip() or NO_TEXT}")
    return out


class _Walk:
    """Blocks of a document body in document order, numbered as they open."""

    def __init__(self, declared: set[str], media: dict[str, str], warn):
        self.declared, self.media, self.warn, self.n, self.blocks = declared, media, warn, 0, []

    def body(self, node: ElementTree.Element, place: tuple) -> None:
        for child in node:
            name = _local(child.tag)
            if name == "p":
                self.paragraph(child, place)
            elif name == "tbl":
                self.table(child, place)
            else:
                self.body(child, place)

    def opened(self, prefix: str, kind: str, place: tuple, **more) -> dict:
        block = {"source_id": f"{prefix}{self.n}", "source_order": self.n, "kind": kind, "table_id": place[0], "row": place[1], "col": place[2], "num_id": None, "level": None, "rows": None, "inlines": []} | more
        self.n += 1
        self.blocks.append(block)
        return block

    def paragraph(self, node: ElementTree.Element, place: tuple) -> None:
        block = self.opened("p", "paragraph", place)
        num_id = level = None
        for props in (x for x in node.iter() if _local(x.tag) == "pPr"):
            for x in props.iter():
                if _local(x.tag) == "numId":
                    num_id = _attr(x, "val")
                elif _local(x.tag) == "ilvl":
                    level = _whole(_attr(x, "val"))
        if num_id is not None and level is not None:
            block["num_id"], block["level"] = num_id, level
        for kind, value in self.inline(node):
            last = block["inlines"][-1] if block["inlines"] else None
            if kind == "text" and last and last["kind"] == "text":
                last["text"] += value
            elif kind != "text" or value:
                block["inlines"].append({"kind": kind, "text": value if kind == "text" else None, "media_id": self.media.get(value) if kind == "image" else None, "rel_id": value if kind == "image" else None})

    def inline(self, node: ElementTree.Element) -> Iterator[tuple[str, str | None]]:
        for x in node:
            name = _local(x.tag)
            if name in ("pPr", "txbxContent", "object"):
                continue
            if name == "t":
                yield "text", x.text or ""
            elif name in ("br", "cr"):
                yield "lineBreak", None
            elif name == "tab":
                yield "text", "\t"
            else:
                if name == "blip":
                    rel = _attr(x, "embed") if _attr(x, "embed") is not None else _attr(x, "link")
                    yield "image", rel
                    if rel is None:
                        self.warn("blip 缺少 r:embed / r:link 属性")
                    elif rel not in self.declared:
                        self.warn(f"Image rId={rel} 未在 document.xml.rels 中声明")
                yield from self.inline(x)

    def table(self, node: ElementTree.Element, place: tuple) -> None:
        block = self.opened("t", "table", place)
        rows = [x for x in node if _local(x.tag) == "tr"]
        block["rows"] = len(rows)
        for r, row in enumerate(rows):
            for c, cell in enumerate(x for x in row if _local(x.tag) == "tc"):
                inner = place if place[0] else (block["source_id"], r, c)
                if not place[0]:
                    self.blocks.append(block | {"kind": "cell", "row": r, "col": c, "table_id": block["source_id"], "inlines": []})
                self.body(cell, inner)


def parse(data: bytes) -> dict:
    """blocks, media, levels and warnings of one archive."""
    files = entries(data)
    warnings: list[str] = []
    declared, targets, said = relationships(files.get("word/_rels/document.xml.rels", b""))
    warnings += said
    xml = files["word/document.xml"]
    warnings += unsupported(xml.decode("utf-8", "replace"))
    media, ids = [], {}
    for rel, target in targets.items():
        name = target.replace("\\", "/")
        bare = name.lstrip("/")
        path = name if name.startswith("word/media/") else f"word/{name}" if name.startswith("media/") else bare if bare.startswith("word/") else f"word/{bare}"
        content = next((files[p] for p in (path, f"word/{path}", path.removeprefix("word/")) if p in files), None)
        if content is None:
            warnings.append(f"图片 rId={rel} 目标 {target} 在 ZIP 中未找到")
            continue
        sha, ext = hashlib.sha256(content).hexdigest(), (target.rpartition(".")[2] if "." in target else "png").lower()
        if sha not in ids.values():
            media.append({"media_id": sha, "rel_id": rel, "file_name": f"{sha}.{ext}", "content_type": CONTENT_TYPES.get(ext, "application/octet-stream"), "content": content})
        ids[rel] = sha
    walk = _Walk(declared, ids, warnings.append)
    for node in ElementTree.fromstring(xml).iter():
        if _local(node.tag) == "body":
            walk.body(node, (None, None, None))
    return {"blocks": walk.blocks, "media": media, "levels": numbering_levels(files.get("word/numbering.xml", b"")), "warnings": [{"level": "WARN", "message": m} for m in warnings]}


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            row = {"doc_id": path, "error": None, "blocks": [], "media": [], "levels": [], "warnings": []}
            try:
                row |= parse(bytes(content))
            except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError) as why:
                row["error"] = str(why)
            yield pd.DataFrame([row])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: doc_id, error, blocks, media, levels and warnings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(_parsed, SCHEMA)


def _rows(docs: DataFrame, column: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(column).alias("ordinal", "x")).select("doc_id", "ordinal", "x.*")


def blocks(docs: DataFrame) -> DataFrame:
    return _rows(docs, "blocks")


def media(docs: DataFrame) -> DataFrame:
    """Images, one row for each content of a document."""
    return _rows(docs, "media").withColumn("displayable", T.displayable(F.col("file_name")))


def numbering(docs: DataFrame) -> DataFrame:
    return _rows(docs, "levels").drop("ordinal")


def warnings(docs: DataFrame) -> DataFrame:
    return _rows(docs, "warnings")


def flat_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): paragraphs as lines, with a marker 图片N in place of the N-th image."""
    inline = blocks(docs).where("kind = 'paragraph'").select("doc_id", "ordinal", F.posexplode_outer("inlines").alias("i", "x")).select("doc_id", "ordinal", "i", "x.*")
    numbered = inline.withColumn("n", F.count_if(F.col("kind") == "image").over(_document_order()))
    piece = F.when(F.col("kind") == "image", F.concat(F.lit("[图片"), F.col("n").cast("string"), F.lit("]"))).when(F.col("kind") == "lineBreak", F.lit("\n")).otherwise(F.coalesce("text", F.lit("")))
    lines = numbered.groupBy("doc_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("i", piece.alias("s")))).alias("p"))
    joined = lines.select("doc_id", "ordinal", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("line"))
    return joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def _document_order():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("ordinal", "i").rowsBetween(Window.unboundedPreceding, 0)
