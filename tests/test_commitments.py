"""Placement of commitments against a plain search, line by line."""

import random
import re

from pyspark.sql import functions as F

from attestra.operators import commitments as C
from attestra.functions import scalars as S

WORDS = "alpha beta covenant breach 40% $1,500 $2M quick total margin Section replace | #".split()


def prose(line):
    return not re.match(r"\s*#{1,6}\s+", line) and not (re.match(r"\s*\d+\.\s+\S", line) and len(line.strip()) <= 80)


def amount(raw):
    s = re.sub(r"[$, ]", "", raw).lower()
    f = {"k": 10**3, "m": 10**6, "b": 10**9}.get(s[-1:], None)
    try:
        return int(float(s[:-1] if f else s) * (f or 1))
    except ValueError:
        return None


def survives(value, text, context):
    low, v = text.lower(), value.lower()
    line = lambda p: text[text.rfind("\n", 0, p) + 1 :].split("\n")[0]
    at = low.find(v)
    while v and at >= 0:
        near = low[max(0, at - 300) : at + len(v) + 300]
        if prose(line(at)) and (not context or any(w in near for w in context)):
            return True
        at = low.find(v, at + len(v))
    return bool(v) and amount(value) is not None and v.strip() not in low and any(amount(m.group()) == amount(value) and prose(line(m.start())) for m in re.finditer(S.DOLLARS, low))


def test_placed_equals_a_plain_search(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    forms = ["workbook_row", "slide_bullet", "drafting_clause", "memo_statement"]
    names = ["model.xlsx", "t.csv", "deck.pptx", "deal redline.docx", "memo.docx"]
    files, made = [], []
    for board in "abcdef":
        for name in rng.sample(names, 3):
            files.append((board, name, "\n".join(rng.choice(["# Sheet: one", "# slide 2", "12. " + say(2), "## " + say(3), say(6), say(9) + " | " + say(3), "x" * 350]) for _ in range(rng.randint(0, 8)))))
        files.append((board, "none.txt", None))
        for seq in range(30):
            terms = [rng.choice([say(1), say(2), " " + say(2) + " ", "", "$1.5K", "$2,000,000", "absent words"]) for _ in range(rng.randint(0, 4))]
            made.append((board, seq, rng.choice(names + ["", "lost.xlsx"]), rng.choice(forms), terms, rng.choice([say(4), "1 2 3", "nowhere found"])))
    got = C.placed(spark.createDataFrame(made, "board_id string, seq int, target_file string, native_form string, terms array<string>, content string"), spark.createDataFrame(files, "board_id string, file string, text string"))
    seen = {(r.board_id, r.seq): r for r in got.collect()}
    assert len(seen) == len(made)
    causes = set()
    for board, seq, target, form, terms, content in made:
        terms = list(dict.fromkeys(t.strip() for t in terms if t.strip()))
        context = []
        for w in content.lower().split():
            w = "".join(ch for ch in w if ch.isalpha())
            if len(w) >= 4 and w not in context:
                context.append(w)
        hits = {}
        for b, name, text in files:
            if b == board:
                for t in terms:
                    if survives(t, text or "", context):
                        lines = [i for i, x in enumerate(text.split("\n")) if survives(t, x, context)]
                        hits[name] = (t, lines[0] if lines else None, text)
                        break
        there = {n: h for n, h in hits.items() if target in ("", n)}

        def in_form(name, h):
            low, line = h[2].lower(), h[2].split("\n")[h[1]] if h[1] is not None else ""
            if form == "workbook_row":
                sheet = name.endswith(".csv") or any(x.strip().startswith("# sheet:") for x in low.split("\n"))
                return sheet and not line.strip().lower().startswith("# sheet:") and ("|" in line or name.endswith(".csv") and "," in line)
            if form == "slide_bullet":
                return any(x.strip().startswith("# slide") for x in low.split("\n"))
            return form != "drafting_clause" or any(m in low for m in C.CLAUSE_MARKS)

        good = any(in_form(n, h) for n, h in there.items())
        wrong = target != "" and (form == "workbook_row" and not target.endswith((".xlsx", ".csv")) or form == "slide_bullet" and not target.endswith(".pptx") or form == "drafting_clause" and not any(w in target for w in ("redline", "markup", "rider", ".docx")))
        cause = "wrong_format" if wrong else "artifact_ambiguous" if not terms else None if there and good else "native_form_missing" if there else "wrong_file" if hits else "artifact_missing"
        causes.add(cause)
        first = min(there or hits, default=None)
        want = (bool(terms), bool(there), bool(there) and good, bool(hits) and not there, *((hits[first][:2]) if first else (None, None)), cause)
        r = seen[board, seq]
        assert (r.traceable, r.found_in_target, r.native_form_satisfied, r.found_elsewhere, r.evidence, r.line_no, r.cause) == want, (board, seq, terms)
    assert len(causes) == 6


def test_a_board_without_files_or_entries(spark):
    entries = spark.createDataFrame([("a", 0, "analysis", "The 40% cap fails.", 1.0, ["debt_sensor"], "d", None, None, "active")], "board_id string, seq int, type string, content string, confidence double, tags array<string>, source_doc string, section string, evidence string, status string")
    none = spark.createDataFrame([], "board_id string, pos int, file string")
    row = C.commitments(entries, none).first()
    assert (row.target_file, row.native_form, row.terms, row.source_ref) == ("", "memo_statement", ["40%"], "d")
    assert C.commitments(entries.limit(0), none).count() == 0
    assert C.placed(C.commitments(entries, none), none.selectExpr("board_id", "file", "'' as text")).first().cause == "artifact_missing"
