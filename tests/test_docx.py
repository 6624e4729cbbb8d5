"""Word files, written here as zip archives, through the source into blocks and questions."""

import io
import zipfile

import pytest

from quillspark.operators import blocks as B
from quillspark.operators import standard as S
from quillspark.sources import docx

W = 'xmlns:w="urn:w" xmlns:r="urn:r" xmlns:a="urn:a" xmlns:v="urn:v"'


def p(*runs, num=None):
    props = f'<w:pPr><w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr></w:pPr>' if num else ""
    return f"<w:p>{props}{''.join(f'<w:r>{r if r.startswith("<") else f"<w:t>{r}</w:t>"}</w:r>' for r in runs)}</w:p>"


def image(rel):
    return f'<w:drawing><a:blip r:embed="{rel}"/></w:drawing>'


def table(*rows):
    return f"<w:tbl>{''.join(f'<w:tr>{"".join(f"<w:tc>{c}</w:tc>" for c in r)}</w:tr>' for r in rows)}</w:tbl>"


NUMBERING = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="upperLetter"/><w:lvlText w:val="%2."/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride></w:num></w:numbering>'
RELS = '<Relationships><Relationship Id="r1" Type="x/image" Target="media/a.png"/><Relationship Id="r2" Type="x/image" Target="media/b.EMF"/><Relationship Id="r3" Type="x/image" Target="media/none.png"/><Relationship Id="r4" Type="x/image"/></Relationships>'


def archive(body, extra=()):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", NUMBERING)
        z.writestr("word/_rels/document.xml.rels", RELS)
        z.writestr("word/media/a.png", b"same")
        z.writestr("word/media/b.EMF", b"other")
        for name, content in extra:
            z.writestr(name, content)
    return data.getvalue()


BODY = p("Title") + p("Which?", image("r1"), num=(5, 0)) + p("one", num=(5, 1)) + p("two", "<w:br/>", "more", image("r1"), num=(5, 1)) + p("答案：B") + table([p("c1") + p("2nd"), p("x", image("r2"))], [p("c3"), table([p("deep")])]) + p("<w:object><w:t>inside &amp;lt;</w:t></w:object>") + p(image("r9"))


def test_a_document_becomes_blocks_and_questions(spark, tmp_path):
    (tmp_path / "one.docx").write_bytes(archive(BODY))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    docs = docx.read(spark, str(tmp_path)).cache()
    assert [r.error is None for r in docs.orderBy("doc_id").collect()] == [False, True]
    assert {r.file_name.split(".")[1]: (r.content_type, r.displayable) for r in docx.media(docs).collect()} == {"png": ("image/png", True), "emf": ("image/emf", False)}
    said = {r.message.split("\n")[0] for r in docx.warnings(docs).collect()}
    assert said >= {"Image relationship r4 缺少 Target", "Image rId=r9 未在 document.xml.rels 中声明", "[UNSUPPORTED] Word 嵌入对象暂不支持"}, said
    assert [(r.level, r.start) for r in docx.numbering(docs).orderBy("level").collect()] == [(0, 7), (1, None)]
    blocks = B.extract(docs).orderBy("source_order").collect()
    assert [(r.source_id, r.raw_text, r.numbering and r.numbering.display_text) for r in blocks] == [("p0", "Title", None), ("p1", "Which?", "7."), ("p2", "one", "A."), ("p3", "two\nmore", "B."), ("p4", "答案：B", None), ("t5:r0c0", "c1\n2nd", None), ("t5:r0c1", "x", None), ("t5:r1c0", "c3", None), ("t5:r1c1", "deep", None), ("p12", "", None), ("p13", "", None), ("unsupported0", "inside &lt;", None)]
    assert [(i.char_offset, i.supported_for_display) for i in blocks[3].images] == [(8, True)] and [(r.order_start, r.order_end) for r in blocks][5] == (6, 7)
    assert S.recognize(B.extract(docs))["records"].where("status = 'REJECTED_QUESTION'").count() == 1  # text behind the answer
    text = docx.flat_text(docs).first().text
    assert text.startswith("Title\nWhich?[图片1]\none\ntwo\nmore[图片2]")


def test_numbered_paragraphs_become_a_question(spark, tmp_path):
    (tmp_path / "q.docx").write_bytes(archive(BODY[: BODY.index("<w:tbl>")]))
    # a second line of a numbered option is a second option of that letter
    assert S.recognize(B.extract(docx.read(spark, str(tmp_path))))["records"].where("reason_code = 'DUPLICATE_OPTION'").count() == 1
    (tmp_path / "q.docx").write_bytes(archive(BODY[: BODY.index("<w:tbl>")].replace("<w:br/>", "<w:tab/>")))
    q = S.recognize(B.extract(docx.read(spark, str(tmp_path))))["questions"].first()
    assert (q.original_id, q.question, [(o.key, o.text) for o in q.options], q.answer, len(q.images)) == (7, "Which?", [("A", "one"), ("B", "two\tmore")], ["B"], 1)


@pytest.mark.parametrize("name", ["../x", "/x", "C:/x", "word/../../x", "a\\..\\b"])
def test_unsafe_paths_are_refused(name):
    with pytest.raises(ValueError, match="path|Path"):
        docx.entries(archive("", [(name, "x")]))


def test_limits(monkeypatch):
    with pytest.raises(ValueError, match="缺少"):
        data = io.BytesIO()
        zipfile.ZipFile(data, "w").close()
        docx.entries(data.getvalue())
    monkeypatch.setattr(docx, "MAX_ENTRY", 10)
    with pytest.raises(ValueError, match="too large"):
        docx.entries(archive(""))
    monkeypatch.setattr(docx, "MAX_ENTRY", 10**6)
    monkeypatch.setattr(docx, "MAX_TOTAL", 100)
    with pytest.raises(ValueError, match="Total"):
        docx.entries(archive(""))


def test_repeated_entries_are_refused():
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="Duplicate"):
        docx.entries(archive("", [("x", "1"), ("x", "2")]))
