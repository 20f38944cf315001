"""Layout goldens, text assembly, and hot groups against brute force."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyscan.operators import layout
from tallyscan.operators import text_assembly as ta

WORDS = "doc_id long, page int, word_idx int, text string, top double, x0 double"
ROWS = "doc_id long, page int, table_idx int, row_idx int, cells array<string>"


def words(*lines, doc=1, page=0):
    out, n = [], 0
    for top, text in lines:
        for w in text.split(" "):
            out.append((doc, page, n, w, float(top), 0.0))
            n += 1
    return out


@pytest.fixture(scope="module")
def inputs(spark):
    w = words((100, "Subtotal $100.00"), (120, "Total $110.00"))
    w += words((12.5, "Alpha"), (7.5, "beta"), doc=2) + words((0, "Total 5.00"), doc=3, page=1) + words((0, "Total 5.00"), doc=4)
    w += words((0, "INVOICE"), (20, "ACME LTD"), (40, "Acme Trading"), doc=5)
    cells = [["Invoice #", None, "INV-9"], ["Total Due", "USD", "$1,879.32"], ["Tax total", "5.00"], ["alone"], ["Total", " "]]
    r = [(1, 0, 0, i, c) for i, c in enumerate(cells)] + [(3, 1, 0, 0, ["Total", "9"])]
    docs = spark.createDataFrame([(1, "pdf"), (2, "pdf"), (3, "pdf"), (4, "image"), (5, None)], "doc_id long, kind string")
    return docs, spark.createDataFrame(w, WORDS), spark.createDataFrame(r, ROWS)


def test_layout_goldens(inputs):
    docs, w, r = inputs
    lines = {x.doc_id: x for x in layout.fields_from_lines(layout.layout_scope(w, docs)).collect()}
    assert (lines[1].total, lines[1].subtotal) == (Decimal("100.00"), Decimal("100.00"))
    assert lines[5].vendor_name == "Acme Trading" and 3 not in lines and 4 not in lines
    assert {x.y for x in layout.lines_from_words(w.where("doc_id = 2")).collect()} == {10}
    merged = {x.doc_id: x for x in layout.layout_fields(docs, w, r).collect()}
    assert (merged[1].invoice_number, merged[1].total, merged[1].tax) == ("INV-9", Decimal("1879.32"), Decimal("5.00"))
    assert merged[1].subtotal == Decimal("100.00") and 3 not in merged
    only = {x.doc_id: x for x in layout.layout_fields(docs, None, r).collect()}
    assert only[1].vendor_name is None and only[1].subtotal is None


def test_pages_engines_segments(spark):
    pages = spark.createDataFrame(
        [(1, 0, 1, 1, " "), (1, 0, 1, 2, " b "), (1, 0, 1, 3, "c"), (1, 1, 1, 1, None), (1, 0, 2, 1, "other"),
         (2, 0, 1, 1, ""), (2, 1, 2, 2, "z"), (2, 0, 2, 1, "y "), (3, 0, 1, 1, "\n")],
        "doc_id long, page int, engine_rank int, method_rank int, text string",
    )
    done = ta.pages_to_document(ta.choose_engine(ta.choose_page_text(pages)))
    assert {r.doc_id: r.text for r in done.collect()} == {1: "b", 2: "y\n\nz"}
    segments = spark.createDataFrame([(1, 1, 1, " b"), (1, 1, 0, " a"), (2, 1, 0, " "), (2, 2, 0, "q")],
                                     "doc_id long, engine_rank int, seg_idx int, text string")
    got = ta.choose_engine(ta.segments_to_document(segments))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a\n b", 2: "q"}
    table = spark.createDataFrame([(1, 0, 0, 1, ["c"]), (1, 0, 0, 0, ["a", None, "b"]), (1, 0, 1, 0, [])], ROWS)
    assert ta.table_to_text(table).first().text == "a |  | b\nc"


def test_hot_document_is_whole_and_in_order(spark):
    rng = random.Random(3)
    rows = [(1, 0, i, rng.choice(["total", "9.50", "x"]), 0.0, 0.0) for i in range(20000)]
    rows += [(d, 0, i, f"w{i}", 20.0 * (i % 3), 0.0) for d in range(2, 40) for i in range(50)]
    rng.shuffle(rows)
    got = {(r.doc_id, r.y): r for r in layout.lines_from_words(spark.createDataFrame(rows, WORDS)).collect()}
    want = {}
    for doc, _, idx, text, top, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        want.setdefault((doc, int(round(top / 5) * 5)), []).append(text)
    assert {k: r.line for k, r in got.items()} == {k: " ".join(v) for k, v in want.items()}
    assert got[1, 0].amount == Decimal("9.50")
    glyphs = [(1, 0, i, rng.choice("ab "), rng.choice([2.0, 12.4]), float(rng.randint(0, 9))) for i in range(9000)]
    df = spark.createDataFrame(glyphs, "doc_id long, page int, seq int, text string, top double, x0 double")
    lines = {}
    for g in sorted(glyphs, key=lambda g: (g[5], g[2])):
        lines.setdefault(round(g[4] / 5) * 5, []).append(g[3])
    brute = "\n".join("".join(lines[y]) for y in sorted(lines, reverse=True))
    assert ta.lines_from_glyphs(df).first().text == brute


def test_filter_does_not_repeat_patterns(spark):
    """A filter above the queue must not drag the patterns below it a second time."""
    from tallyscan.operators.responses import escalation_queue
    from tallyscan.plans.extract import plain_fields

    docs = spark.createDataFrame([(1, "Total: 5", "pdf")], "doc_id long, text string, kind string")
    queue = escalation_queue(plain_fields(docs)).where(F.col("escalation_reason").isNotNull())
    plan = queue._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("grand\\s+total") <= 2  # the two grand-total patterns, once each


def test_hot_document_is_dealt_behind_a_join(spark):
    """An exchange on line and chunk stands above a sort-merge semi join that lies by document."""
    from tallyscan.operators.layout import layout_scope, lines_from_words

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = spark.createDataFrame([(i % 3, 0, 0.0, i, "w") for i in range(50)], "doc_id long, page int, top double, word_idx int, text string")
        docs = spark.createDataFrame([(i, "pdf") for i in range(3)], "doc_id long, kind string")
        plan = lines_from_words(layout_scope(words, docs))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    chunk = plan.index("REPARTITION_BY_COL")
    assert "chunk" in plan[plan.rindex("Exchange", 0, chunk) : chunk] and plan.index("SortMergeJoin") > chunk


def test_text_of_a_file_from_all_its_parts(spark):
    from tallyscan.operators import text_assembly as ta

    page_text = spark.createDataFrame([(1, 0, 1, 1, " "), (1, 1, 1, 1, "second"), (4, 0, 2, 1, "other engine")], "doc_id long, page int, engine_rank int, method_rank int, text string")
    rows = spark.createDataFrame([(1, 0, 0, 0, ["a", None, "b"]), (2, 0, 0, 0, [])], "doc_id long, page int, table_idx int, row_idx int, cells array<string>")
    glyphs = spark.createDataFrame(
        [(1, 0, i, c, 0.0, float(i)) for i, c in enumerate("no")] + [(2, 0, i, c, 0.0, 100.0 - i) for i, c in enumerate("yes")],
        "doc_id long, page int, seq int, text string, top double, x0 double",
    )
    segments = spark.createDataFrame([(3, 1, 0, " one "), (3, 1, 1, "two"), (1, 1, 0, "not a picture")], "doc_id long, engine_rank int, seg_idx int, text string")
    files = spark.createDataFrame([(1, "pdf"), (2, "pdf"), (3, "image"), (4, "pdf"), (5, "pdf"), (6, None)], "doc_id long, kind string")
    done = ta.documents_from_parts(files, ta.page_tries(page_text, rows, glyphs), segments)
    got = {r.doc_id: r.text for r in done.collect()}
    assert got == {1: "a |  | b\n\nsecond", 2: "sey", 3: "one \ntwo", 4: "other engine", 5: None, 6: None}
