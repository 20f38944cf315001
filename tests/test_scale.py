"""What keeps large inputs within their limits: rows move once, costly steps run only where they can decide."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from tallyscan.fixed_values import ANSWER_REPAIRS
from tallyscan.functions import clean_amount
from tallyscan.functions.sqltext import AMOUNT_STEPS, MONEY, PLAIN_AMOUNT, amount
from tallyscan.operators import responses
from tallyscan.operators import text_assembly as ta
from tallyscan.operators.layout import MAY_BE_AMOUNT, lines_from_words
from tallyscan.plans.derived import NOW, Tables
from tallyscan.streaming import stream
from tallyscan.streaming.state import StateTable

SMALL = "/root/testdata/sf0.001"
AMOUNTS = [
    None, "", " ", "0", "00", "007.5", "1.", ".5", "12.345", "12.355", "-3.10", "-0.00", "+4.20", "1,234.50", "$9.99", "5 10.00", "1e5", "1E3", "9" * 26,
    "9" * 27, "12.30\n", "\n1.00", "12.3 ", "١٢", "1.2.3", "--1", "NaN", "1.23456789012345", "EUR 5.00", "INV-12", "1996-01-02", "5e", "e5",
]


def test_amounts_as_by_all_steps(spark):
    rng = random.Random(7)
    texts = AMOUNTS + ["".join(rng.choice("0159.,-+eE $a\n") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    steps = F.col("raw")
    for pattern, by in AMOUNT_STEPS:
        steps = F.regexp_replace(steps, pattern, by)
    whole = F.bround(steps.try_cast("decimal(38,10)"), 2).try_cast(MONEY)
    rows = df.select(
        "raw", clean_amount(F.col("raw")).alias("a"), F.expr(amount("raw")).alias("b"), whole.alias("c"),
        F.col("raw").rlike(MAY_BE_AMOUNT).alias("may"), F.col("raw").rlike(PLAIN_AMOUNT).alias("plain"),
    ).collect()
    assert [r for r in rows if not r.a == r.b == r.c] == []
    assert [r for r in rows if r.c is not None and not r.may] == []
    assert any(r.plain for r in rows)


def test_repairs_are_tried_where_they_can_match(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(['"', '""', ":", ",", "}", "{", "'", "\n", "\\n", "\\", "a", " ", "\x01"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t")
    for pattern, repl in ANSWER_REPAIRS:
        plain = F.regexp_replace(plain, pattern, repl)
    rows = df.select("t", responses._common_slips(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == []
    assert [responses._mark(p) for p, _ in ANSWER_REPAIRS] == ['""'] * 6 + ["", "'", "\n", ""]


def test_line_items_move_once(spark):
    """The key deals them; a deal round-robin before that moved all of them twice."""
    for name in ("docs", "words", "table_rows"):
        plan = getattr(Tables(spark, SMALL), name)._jdf.queryExecution().toString()
        assert "roundrobin" not in plan.lower() and "REPARTITION_BY_NUM" not in plan


def test_words_are_ordered_without_a_lambda(spark):
    rows = [(1, 0, 5000 - i, f"w{i % 7}", 3.0) for i in range(4999)] + [(1, 0, None, "last", 3.0), (1, 0, 1, "a", 3.0)]
    lines = lines_from_words(spark.createDataFrame(rows, "doc_id long, page int, word_idx int, text string, top double"))
    assert "lambdafunction(if" not in lines._jdf.queryExecution().optimizedPlan().toString().lower().replace(" ", "")
    key = lambda r: (r[2] is not None and r[2] // 4096 or 0, r[2] or 0, r[3])
    told = [r[3] for r in sorted((r for r in rows if r[2] is not None), key=key)]
    assert [r.line for r in lines.collect()] == [" ".join(["last", *told])]  # a null chunk comes first


def test_rows_that_are_not_due_get_no_version(spark, tmp_path: Path):
    t = Tables(spark, SMALL)
    invoices = t.invoices.drop("o_orderkey")
    results = stream.text_results_from_orders(stream.table_stream(spark, SMALL, "orders"))
    stream.stream_retry(invoices, results, str(tmp_path), NOW)
    versions = StateTable(spark, f"{tmp_path}/table", invoices.schema).versions()
    due = invoices.where(F.col("status").isin("RECEIVED", "FAILED_RETRYABLE") & (F.col("next_attempt_at") <= F.lit(NOW).cast("timestamp")))
    asked = versions.where("_version >= 0")
    assert 0 < asked.count() <= due.count() < invoices.count()
    assert asked.join(due, "id", "left_anti").isEmpty()


def test_incremental_report_runs_rules_and_layout_once(spark, monkeypatch):
    """Both jobs of j6 take the stored result of rules and layout, and stored results change nothing."""
    from tallyscan.plans import extract, queries

    t, calls, real = Tables(spark, SMALL), [], extract.plain_fields

    def counted(*given, **named):
        calls.append(1)
        return real(*given, **named)

    for module in (extract, queries):
        monkeypatch.setattr(module, "plain_fields", counted)
    queries.QUERIES["j6_incremental_report"](spark, SMALL)
    assert len(calls) == 1
    given = (t.docs, t.words, t.table_rows, t.model_responses, t.entities, queries.FULL)
    once, again = extract.extract_documents(*given), extract.extract_documents(*given, real(*given[:3]))
    text = lambda df: sorted(tuple(map(str, r)) for r in df.select("doc_id", "validation_error", "confidence_status", F.to_json("fields")).collect())
    assert text(once) == text(again)


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]


def test_parts_that_lie_by_document_are_not_moved(spark):
    """Words, cells, pages and lines of an image beside their document: no exchange up to the fields, or to the text."""
    from tallyscan.operators import layout, text_assembly

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        part = lambda columns, kinds: spark.createDataFrame([(d, *columns(i)) for d in range(3) for i in range(40)], f"doc_id long, {kinds}").repartition("doc_id")
        words = part(lambda i: (0, i, "Total" if i % 2 else "5.00", 7.0 * (i // 2)), "page int, word_idx int, text string, top double")
        pages = part(lambda i: (i, 1, 1, f"page {i}"), "page int, engine_rank int, method_rank int, text string")
        rows = part(lambda i: (0, 0, i, ["a", str(i)]), "page int, table_idx int, row_idx int, cells array<string>")
        lines = part(lambda i: (1, i, f"line {i}"), "engine_rank int, seg_idx int, text string")
        for done in (layout.fields_from_lines(words), text_assembly.page_tries(pages, rows).where("method_rank = 4"),
                     text_assembly.pages_to_document(pages, deal=False), text_assembly.segments_to_document(lines, deal=False)):
            assert len(exchanges(done)) == done._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text_assembly.page_tries(pages, rows).where("method_rank = 4").first().text == "\n".join(f"a | {i}" for i in range(40))


def test_amounts_and_vendor_in_one_pass(spark):
    """The same as of the two operators, also where one finds nothing, on lines with ties, blanks and null places."""
    from tallyscan.operators import layout

    rng, rows = random.Random(12), []
    for doc in [*range(150), None]:
        for i in range(rng.randint(1, 30)):
            text = rng.choice(["Total", "total", "Sub", "subtotal", "VAT", "Tax", "due", "amount", "5.00", "9.50", "7", "Acme", "Trading Co", "INVOICE", "date", "", None, "x"])
            rows.append((doc, rng.choice([0, 0, 1]), rng.choice([i, i, None]), text, rng.choice([None, 2.5, 7.5, 20.0 * rng.randint(0, 8)])))
    words = spark.createDataFrame(rows, "doc_id long, page int, word_idx int, text string, top double")
    first = layout.first_page(words)
    lines = lines_from_words(first)
    two = layout.amounts_from_lines(lines).join(layout.vendor_from_lines(lines), "doc_id", "full_outer").where("doc_id is not null")
    one = layout.fields_from_lines(first)
    told = lambda df: sorted(map(tuple, df.select("doc_id", "subtotal", "tax", "vat", "total", "vendor_name").where("doc_id is not null").collect()), key=str)
    assert told(one) == told(two) and len(told(one)) > 100


def test_line_items_of_entities_move_once(spark):
    plan = Tables(spark, SMALL).entities._jdf.queryExecution().toString()
    assert "roundrobin" not in plan.lower() and "REPARTITION_BY_NUM" not in plan


def test_thin_rows_of_pages_come_out_of_the_exchange_of_texts(spark):
    """So what lies below it, as tries that are put together, runs fewer times."""
    pages = spark.createDataFrame([(1, 0, 1, 1, " "), (1, 0, 2, 1, "b"), (2, 1, 1, 2, "c"), (2, 1, 1, 1, "d"), (2, 2, 2, 1, "e"), (3, 0, 1, 1, None)],
                                  "doc_id long, page int, engine_rank int, method_rank int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = ta.choose_pages(pages)
        rows = done.collect()
        plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.doc_id, r.engine_rank, r.page, r.text) for r in rows) == [(1, 2, 0, "b"), (2, 1, 1, "d")]
    assert plan.count("ReusedExchange") >= 1 and plan.count("Scan ") <= 2  # without: three scans, none reused
