"""The recogniser against a plain loop over blocks, and the cases of the standard format."""

import random
import re

from quillspark.functions import text as T
from quillspark.operators import blocks as B
from quillspark.operators import standard as S

FIELDS = {"answer": T.ANSWER_LINE, "explanation": T.EXPLANATION_LINE, "knowledge": T.KNOWLEDGE_LINE}


def source(order, text, kind="paragraph", numbering=None, images=(), reason=None, doc="d", table=None):
    return (doc, f"s{order}", order, kind, text, numbering, table, [tuple(i) for i in images], order, order, reason)


def frame(spark, rows):
    return spark.createDataFrame(rows, B.SCHEMA)


def result(spark, rows):
    found = S.recognize(frame(spark, rows))
    return ([r.asDict(True) for r in found["questions"].orderBy("doc_id", "index").collect()], [r.asDict(True) for r in found["records"].orderBy("doc_id", "order").collect()], {(r.doc_id, r.source_id): r.status for r in found["ledger"].collect()}, {r.doc_id: r for r in found["report"].collect()})


def paragraphs(*texts, doc="d"):
    return [source(i, t, doc=doc) for i, t in enumerate(texts)]


def split_inline(line):
    marks, out, expected = [(m[1].upper(), m.start(), m.end()) for m in re.finditer(r"([A-Ha-h])\s*[.．、:：)）]\s*", line)], [], None
    for key, start, end in marks:
        if expected is None:
            if key == "A" and (start == 0 or re.match(r"[\s。；;，,、：:（）()\[\]【】]", line[start - 1])):
                out, expected = [(key, start, end)], "B"
        elif key == expected:
            out.append((key, start, end))
            expected = chr(ord(expected) + 1)
        elif key > expected:
            break
    texts = [(k, line[e : out[i + 1][1] if i + 1 < len(out) else len(line)].strip()) for i, (k, _, e) in enumerate(out)]
    texts = [x for x in texts if x[1]]
    return (line[: out[0][1]].strip(), texts) if len(out) > 1 and len(texts) > 1 else None


def normalize(raw):
    raw = raw.strip()
    if raw in T.TRUE_WORDS + T.FALSE_WORDS:
        return ["A"] if raw in T.TRUE_WORDS else ["B"]
    out = set()
    for token in raw.replace("，", ",").replace("、", ",").replace(" ", "").split(","):
        token = token.strip().upper()
        out |= set(token) if re.fullmatch("[A-H]{2,}", token) else set(token[:1])
    return sorted(x for x in out if re.fullmatch("[A-H]", x))


def plain(rows):
    """Status of each block, and (number, stem, options, answer, explanation) of each question, by one loop."""
    status, questions, now = {}, [], None

    def close():
        nonlocal now
        if now is None:
            return
        q, now = now, None
        stem, answer = "\n".join(q["stem"]).strip(), normalize(q["answer"]) if q["answer"] is not None else []
        options = [(k, "\n".join(v).strip()) for k, v in q["options"].items()]
        judged = q["type"] == "truefalse" or (not options and (q["answer"] or "").strip() in T.TRUE_WORDS + T.FALSE_WORDS)
        if judged and not options:
            options = [("A", "对"), ("B", "错")]
        bad = q["errors"] or not stem or not answer or not options or (not judged and len(options) < 2) or set(answer) - {k for k, _ in options}
        bad = bad or (q["type"] == "single" and len(answer) > 1) or (q["type"] == "multiple" and len(answer) < 2)
        for s in q["sources"]:
            status[s] = "REJECTED_QUESTION" if bad else "ACCEPTED_QUESTION"
        if not bad:
            questions.append((q["number"], stem, options, answer, "\n".join(x for x in [q["explanation"], *q["more"]] if x) or None))

    def line(q, text, auto):
        if m := re.fullmatch(T.TYPE_LINE[1:-1], text):
            q["type"] = T.TYPE_LABELS.get(m[1])
            q["errors"] |= q["type"] is None
            q["last"], q["key"] = "type", None
            return
        for name, pattern in FIELDS.items():
            if m := re.fullmatch(pattern[1:-1], text):
                q[name], q["last"], q["key"] = m[1].strip(), name, None
                if name == "explanation":
                    q["more"] = []
                return
        if q["tagged"] and (m := re.fullmatch(T.TRAILING_ANSWER[1:-1], text)) and (not q["options"] or not m[1].strip()):
            if m[1].strip():
                q["stem"].append(m[1].strip())
            q["last"], q["key"] = "answer", None
            if q["answer"] is not None:
                q["errors"] = True
            else:
                q["answer"] = m[2].strip()
            return
        if inline := split_inline(text):
            if inline[0] and q["options"]:
                q["errors"] = True
            elif inline[0]:
                q["stem"].append(inline[0])
            added = inline[1]
        elif auto or (m := re.fullmatch(T.OPTION_LINE[1:-1], text)):
            added = [(auto, text)] if auto else [(m[1].upper(), m[2].strip())]
        else:
            if q["last"] == "explanation":
                q["more"].append(text)
            elif q["last"] == "knowledge":
                pass
            elif q["key"] and q["answer"] is None:
                q["options"][q["key"]].append(text)
            elif not q["options"] and q["answer"] is None:
                q["stem"].append(text)
            else:
                q["errors"] = True
            return
        for key, value in added:
            q["errors"] |= key in q["options"]
            q["options"].setdefault(key, []).append(value)
        q["last"], q["key"] = "option", added[-1][0]

    def new(number=None, tagged=False, kind=None):
        return {"number": number, "tagged": tagged, "type": kind, "sources": [], "stem": [], "options": {}, "answer": None, "explanation": None, "knowledge": None, "more": [], "errors": False, "last": "type" if tagged else "stem", "key": None}

    for r in rows:
        text, numbering = r[4], r[5]
        if not (text.strip() or r[7] or r[10]):
            continue
        if r[3] == "unsupported":
            close()
            status[r[1]] = "UNSUPPORTED_CONTENT"
            continue
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        head = lines[0] if lines else ""
        display = (numbering[2] or "").strip() if numbering else ""
        if m := re.fullmatch(T.TAGGED_HEADER[1:-1], head):
            close()
            now, rest = new(tagged=True, kind=T.TYPE_LABELS[m[1]]), lines[1:]
        elif (m := re.match(T.QUESTION_PREFIX, head)) or (numbering and numbering[1] == 0 and (m := re.match(T.NUMBERED_DISPLAY, display))):
            close()
            manual = re.match(T.QUESTION_PREFIX, head)
            now, rest = new(int(next(x for x in m.groups() if x))), lines[1:]
            stem = head[manual.end() :].strip() if manual else head
            now["stem"] += [stem] if stem else []
        elif numbering and numbering[2] is None:
            now = now or new()
            now["errors"] = True
            now["sources"].append(r[1])
            continue
        elif now is None:
            status[r[1]] = "NON_QUESTION_CONTENT"
            continue
        else:
            m = re.match(T.LETTERED_DISPLAY, display)
            now["sources"].append(r[1])
            for x in lines:
                line(now, x, m[1].upper() if m else None)
            continue
        now["sources"].append(r[1])
        for x in rest:
            line(now, x, None)
    close()
    return status, questions


PIECES = ["1. Q", "（2）Q2", "第3题 Q3", "A. x", "B、y", "C) z", "A. x B. y C. z", "lead A. x B. y", "A. x\nB. y", "答案：A", "答案: AB", "正确答案 对", "解析：e", "more", "知识点：k", "题型：单选题", "题型：其他", "[单选题][难度2]", "[判断题]", "[多选题]\nStem（AB）。", "Stem（A）。", "（B）", "text", " ", "A. one（B）"]
WHOLE = ["1. Q\nA. x B. y\n答案：A", "2、Q\nA. x\nB. y\n答案：AB\n解析：e\nmore", "[单选题]\nStem（A）。\nA. x\nB. y", "3. Q\n答案：对", "[判断题]\nStem（错）"]


def test_random_documents_match_a_plain_loop(spark):
    rng, rows, want = random.Random(4), [], {}
    for d in range(150):
        own = []
        for i in range(rng.randrange(1, 14)):
            roll = rng.random()
            numbering = ("n", rng.randrange(2), rng.choice(["7.", "A.", None])) if roll < 0.15 else None
            if roll > 0.96:
                own.append(source(i, "raw", "unsupported", reason="文本框内容暂不支持", doc=f"d{d}"))
            elif roll > 0.75:
                own.append(source(i, rng.choice(WHOLE), doc=f"d{d}"))
            else:
                own.append(source(i, "\n".join(rng.choice(PIECES) for _ in range(rng.choice([1, 1, 1, 2, 3]))), numbering=numbering, doc=f"d{d}"))
        rows += own
        want[f"d{d}"] = plain(own)
    questions, _, ledger, report = result(spark, rows)
    for doc, (status, found) in want.items():
        assert {s: v for (d, s), v in ledger.items() if d == doc} == status, (doc, [r[4] for r in rows if r[0] == doc])
        got = [(q["original_id"], q["question"], [(o["key"], o["text"]) for o in q["options"]], q["answer"], q["explanation"]) for q in questions if q["doc_id"] == doc]
        assert got == found, (doc, [r[4] for r in rows if r[0] == doc])
        if doc in report:
            assert report[doc].accepted == len(found) and report[doc].ledger_complete
    assert sum(len(f) for _, f in want.values()) > 20


def test_tagged_export_of_314_questions(spark):
    texts = []
    for i in range(314):
        kind = "判断题" if i < 84 else "单选题" if i < 216 else "多选题"
        texts += [f"[{kind}][难度2][作业;考试]", f"Question {i % 313}（{'对' if i < 84 else 'A' if i < 216 else 'AB'}）。"]
        texts += [] if i < 84 else ["A. one", "B. two"]
    found = S.recognize_tagged(frame(spark, paragraphs(*texts)))
    report = found["report"].first()
    assert (report.accepted, report.rejected, report.non_question, report.unsupported, report.ledger_complete) == (314, 0, 0, 0, True)
    assert {r.kind: r["count"] for r in found["questions"].groupBy("kind").count().collect()} == {"truefalse": 84, "single": 132, "multiple": 98}


def test_incomplete_tagged_group_closes_the_gate(spark):
    assert S.recognize_tagged(frame(spark, paragraphs("[单选题]", "[单选题]", "Q（A）", "A. x", "B. y")))["report"].count() == 0


def reasons(spark, *texts):
    return [r["reason_code"] for r in result(spark, paragraphs(*texts))[1]]


def test_reasons(spark):
    assert reasons(spark, "[单选题]", "Q（A）", "R（B）") == ["MULTIPLE_QUESTIONS_MERGED"]
    assert reasons(spark, "1. Q", "答案：A") == ["MISSING_OPTIONS"]
    assert reasons(spark, "1. Q", "A. x", "B. y") == ["MISSING_ANSWER"]
    assert reasons(spark, "1. Q", "A. x", "A. y", "答案：A") == ["DUPLICATE_OPTION"]
    assert reasons(spark, "1. Q", "A. x", "B. y", "答案：C") == ["ANSWER_NOT_IN_OPTIONS"]
    assert reasons(spark, "1. Q", "题型：单选", "A. x", "B. y", "答案：A") == ["INVALID_QUESTION_TYPE"]
    assert reasons(spark, "1. Q", "题型：判断题", "答案：AB") == [None]


def test_numbering_images_and_offsets(spark):
    image = lambda at, path="p.png", ok=True: ("m", "r", path, "image/png", ok, at)
    rows = [source(0, "Stem", numbering=("n", 0, "7."), images=[image(0)]), source(1, "one", numbering=("n", 1, "A.")), source(2, "two", numbering=("n", 1, "B."), images=[image(None)]), source(3, "答案：B")]
    question = result(spark, rows)[0][0]
    assert (question["original_id"], [o["key"] for o in question["options"]], question["answer"]) == (7, ["A", "B"], ["B"])
    assert question["images"] == ["p.png"] and [o["image_uris"] for o in question["options"]] == [[], ["p.png"]]
    rows = [source(0, "  1. Q\nA. x"), source(1, "B. y"), source(2, "答案：A", images=[image(4)])]
    assert result(spark, rows)[1][0]["reason_code"] == "IMAGE_OWNER_UNKNOWN"


def test_no_blocks(spark):
    found = S.recognize(frame(spark, []))
    assert all(df.count() == 0 for df in found.values())
