"""Input tables of the operators, derived from the given tables.

The given tables hold no invoices, so documents, words, cells, answers and
lifecycle rows are derived from orders, line items, texts and events by SQL. One
text serves both engines; a dialect fills in the few functions that differ. Every
table covers all rows of what it is derived from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "1997-06-01 00:00:00"
# The given tables are one file each, which a scan reads in one task. Rendering documents from them
# is dealt round-robin to this many tasks, whatever the size of a table; operators never do that.
SPREAD = 32


class SparkDialect:
    name = "spark"

    def __init__(self, folder: str):
        self.folder = folder

    def table(self, name: str, spread: bool = True) -> str:
        """``spread`` is for rows that are rendered as they are read; where they are dealt by a key next, it would move them twice."""
        hint = f"/*+ REPARTITION({SPREAD}) */ " if spread else ""
        return f"(select {hint}* from parquet.`{self.folder}/{name}.parquet`)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def day(self, ts: str, form: str) -> str:
        return f"date_format({ts}, '{form}')"

    def text_ts(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')"

    def ts(self, col: str) -> str:
        return f"cast({col} as timestamp)"

    def plus_hours(self, ts: str, n: str) -> str:
        return f"timestampadd(HOUR, {n}, {ts})"

    def rx_replace(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, '{p}', '{r}')"

    def pieces(self, source: str, keep: str, s: str, sep: str, idx: str, piece: str) -> str:
        """One row per piece of ``s`` between separators, with its position."""
        return f"select {keep}, {idx}, {piece} from {source} lateral view posexplode(split({s}, {sep})) p as {idx}, {piece}"

    def numbers(self, source: str, keep: str, n: str, idx: str) -> str:
        """One row per number from 0 to n - 1."""
        return f"select {keep}, cast({idx} as int) as {idx} from {source} lateral view explode(sequence(0, {n} - 1)) p as {idx}"

    def cells(self, s: str) -> str:
        return f"transform(split({s}, '[:|]'), c -> nullif(trim(c), ''))"

    def sha(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def bytes(self, s: str) -> str:
        return f"cast({s} as binary)"


class DuckDialect:
    name = "duckdb"

    def table(self, name: str, spread: bool = True) -> str:
        return name

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def day(self, ts: str, form: str) -> str:
        return f"strftime({ts}, '{form.replace('yyyy', '%Y').replace('MM', '%m').replace('dd', '%d')}')"

    def text_ts(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"

    def ts(self, col: str) -> str:
        return f"cast({col} as timestamp)"

    def plus_hours(self, ts: str, n: str) -> str:
        return f"({ts} + to_hours(cast({n} as bigint)))"

    def rx_replace(self, s: str, p: str, r: str) -> str:
        return f"regexp_replace({s}, '{p}', '{r}', 'g')"

    def pieces(self, source: str, keep: str, s: str, sep: str, idx: str, piece: str) -> str:
        return (
            f"select {keep}, unnest(range(len(string_split({s}, {sep})))) as {idx}, "
            f"unnest(string_split({s}, {sep})) as {piece} from {source}"
        )

    def numbers(self, source: str, keep: str, n: str, idx: str) -> str:
        return f"select {keep}, unnest(range(cast({n} as bigint))) as {idx} from {source}"

    def cells(self, s: str) -> str:
        return f"[nullif(trim(c), '') for c in regexp_split_to_array({s}, '[:|]')]"

    def sha(self, s: str) -> str:
        return f"sha256({s})"

    def bytes(self, s: str) -> str:
        return f"encode({s})"


def _uuid(d, s: str) -> str:
    h = d.sha(s)
    parts = ", '-', ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat({parts})"


def _money(d, n: str) -> str:
    return f"concat(cast({d.div(n, '100')} as string), '.', lpad(cast(({n}) % 100 as string), 2, '0'))"


# --- derived tables: name -> SQL for a dialect -----------------------------------------


def _cents(d) -> str:
    return f"""
      select doc_id, cast(sum(c) as bigint) as sub, cast(sum({d.div('c * p', '100')}) as bigint) as dis,
             cast(sum({d.div('c * x', '100')}) as bigint) as tax
      from (select l_orderkey as doc_id, cast(round(l_extendedprice * 100) as bigint) as c,
                   cast(round(l_discount * 100) as bigint) as p, cast(round(l_tax * 100) as bigint) as x
            from {d.table('lineitem', spread=False)}) l
      group by doc_id"""


def _truth(d) -> str:
    """True values of every invoice, and its variant."""
    return f"""
      select a.doc_id, a.doc_id % 10 as v, a.sub, a.dis, a.tax,
             case when a.doc_id % 10 in (1, 4) then a.sub + a.tax - a.dis else a.sub + a.tax end as tot,
             o.o_orderdate as day, {d.rx_replace('o.o_orderpriority', '[0-9]-', '')} as word,
             case when a.doc_id % 11 = 0 then 'image' else 'pdf' end as kind
      from cents a join {d.table('orders', spread=False)} o on o.o_orderkey = a.doc_id"""


def _docs(d) -> str:
    m = {n: _money(d, n) for n in ("sub", "dis", "tax", "tot")}
    high = _money(d, "tot + 5000")
    return f"""
      select doc_id, kind, concat('INVOICE', chr(10),
        case v when 8 then concat('Acme ', word, ' Goods') when 9 then concat('  Acme ', word, ' Goods ')
               when 2 then concat('Vendor: NORTHWIND ', word, ' Co') when 3 then concat('From: northwind-sons & ', word)
               when 5 then concat('Bill from:  Northwind   ', word, ' Total') else 'From: Northwind Trading Co' end, chr(10),
        case v when 8 then 'Invoice Number: AMOUNT' when 7 then concat('Inv. No: ', lpad(cast(doc_id as string), 8, '0'))
               when 6 then concat('Invoice # inv-', cast(doc_id as string))
               else concat('Invoice No: INV-', cast(doc_id as string)) end, chr(10),
        'Invoice Date: ',
        case v when 9 then 'pending' when 2 then {d.day('day', 'dd.MM.yyyy')} when 6 then {d.day('day', 'dd.MM.yyyy')}
               when 5 then {d.day('day', 'MM/dd/yyyy')} else {d.day('day', 'yyyy-MM-dd')} end, chr(10),
        case v when 0 then concat('Subtotal: $', {m['sub']}, chr(10), 'Tax (5%): $', {m['tax']})
               when 1 then concat('Subtotal: $', {m['sub']}, chr(10), 'Discount: -$', {m['dis']}, chr(10), 'Tax: $', {m['tax']})
               when 2 then concat('Sub total: ', {m['sub']}, chr(10), 'VAT: ', {m['tax']}, chr(10), 'Currency: EUR')
               when 3 then concat('Subtotal: $', {m['sub']})
               when 4 then concat('Subtotal: $', {m['sub']}, chr(10), 'Tax: $', {m['tax']})
               when 5 then concat('| Subtotal | | $', {m['sub']}, ' |', chr(10), '| Tax | | +$', {m['tax']}, ' |')
               when 6 then concat('| Subtotal | | 5 ', {m['sub']}, ' |', chr(10), 'Tax: 5 ', {m['tax']})
               else concat('Subtotal: $', {m['sub']}, chr(10), 'Tax: $', {m['tax']}) end, chr(10),
        'Total Due: $', case v when 7 then {high} else {m['tot']} end) as text
      from truth"""


def _doc_lines(d) -> str:
    return d.pieces("docs", "doc_id", "text", "chr(10)", "ln", "line")


def _table_rows(d) -> str:
    inner = d.rx_replace("line", "^[|] *| *[|]$", "")
    return f"""
      select doc_id, case when doc_id % 3 = 2 then 1 else 0 end as page, cast({d.div('ln', '4')} as int) as table_idx,
             cast(ln % 4 as int) as row_idx, {d.cells(inner)} as cells
      from doc_lines"""


def _words(d) -> str:
    return f"""
      select doc_id, case when doc_id % 4 = 3 then 1 else 0 end as page, cast(ln * 100 + pos as int) as word_idx, text,
             cast(20.0 * ln + (pos % 3) * 0.5 as double) as top, cast(pos * 40.0 as double) as x0
      from ({d.pieces('doc_lines', 'doc_id, ln', 'line', "' '", 'pos', 'text')}) w"""


def _glyphs(d) -> str:
    label = f"concat({d.rx_replace('o_orderpriority', '[0-9]-', '')}, ' ', o_orderstatus, ' ', cast(o_orderkey as string))"
    return f"""
      select doc_id, 0 as page, cast(seq as int) as seq, substr(label, cast(seq as int) + 1, 1) as text,
             cast(2.5 * (seq % 7) + doc_id % 5 as double) as top, cast((seq * 37) % 11 as double) as x0
      from ({d.numbers(f"(select o_orderkey as doc_id, {label} as label from {d.table('orders')}) o", 'doc_id, label', 'length(label)', 'seq')}) g"""


def _page_text(d) -> str:
    """Texts cut into pages of 2000 characters, as five methods of one engine and two of another saw them."""
    pages = d.numbers(
        f"(select doc_id as did, text as whole, cast({d.div('length(text) + 1999', '2000')} as int) as n "
        f"from {d.table('documents')} where length(text) > 0) t", "did, whole", "n", "page",
    )
    tries = d.numbers(f"({pages}) pg", "did, whole, page", "7", "k")
    return f"""
      select did as doc_id, cast(page as int) as page, case when k < 5 then 1 else 2 end as engine_rank,
             cast(case when k < 5 then k + 1 else k - 4 end as int) as method_rank,
             case when k < 5 and did % 7 = 0 then ' ' when k < 5 and k < (did + page) % 5 then concat(' ', chr(10))
                  else concat(' ', substr(whole, cast(page as int) * 2000 + 1, 2000), ' [', cast(k as string), ']', chr(10)) end as text
      from ({tries}) x"""


def _ocr_segments(d) -> str:
    return f"""
      select conv_id as doc_id, cast(1 + turn % 2 as int) as engine_rank, cast(turn as int) as seg_idx,
             case when turn % 5 = 4 then '  ' else concat('  ', text) end as text
      from {d.table('conversations')}"""


def _answers(d) -> str:
    """Clean answers of a model, one JSON object per invoice."""
    m = {n: _money(d, n) for n in ("sub", "dis", "tax", "tot")}
    return f"""
      select doc_id, concat('{{"invoice_number": "INV-', cast(doc_id as string), '", "date": "', {d.day('day', 'yyyy-MM-dd')},
        '", "vendor_name": "Northwind ', word, '", "subtotal": "', {m['sub']}, '", "discount": ',
        case when v in (1, 4) then {m['dis']} else 'null' end, ', "tax": ',
        case when v = 2 then concat('{{"amount": "', {m['tax']}, '", "type": "vat"}}') else concat('"', {m['tax']}, '"') end,
        ', "total": "', {m['tot']}, '", "currency": "USD"}}') as answer
      from truth"""


def _model_responses(d) -> str:
    bt = "'```'"
    return f"""
      select doc_id, cast(1 as int) as provider_rank,
        case when doc_id % 7 = 0 then 'no answer today'
             when doc_id % 6 = 1 then concat({bt}, 'json', chr(10), answer, chr(10), {bt})
             when doc_id % 6 = 2 then concat(substr(answer, 1, length(answer) - 1), ', }}')
             when doc_id % 6 = 3 then replace(answer, '"USD"', concat(chr(39), 'USD', chr(39)))
             when doc_id % 6 = 4 then substr(answer, 1, length(answer) - 1)
             when doc_id % 6 = 5 then concat('Here it is: ', replace(answer, ', "', concat(',', chr(92), 'n "')), ' Anything else?')
             else answer end as raw_response
      from answers
      union all
      select doc_id, cast(2 as int), case when doc_id % 3 = 0 then '' when doc_id % 3 = 1
        then concat({bt}, 'json', chr(10), replace(answer, '"date"', '"invoice_date"'), chr(10), {bt})
        else replace(answer, '"date"', '"invoice_date"') end
      from answers where doc_id % 5 = 0
      union all
      select doc_id, cast(3 as int), replace(replace(answer, '"date"', '"invoice_date"'), 'USD', 'EUR')
      from answers where doc_id % 4 = 1"""


ENTITY_TYPES = [
    "invoice_id", "invoice_number", "invoice_date", "supplier_name", "vendor_name", "subtotal",
    "tax_amount", "vat_amount", "total_amount", "invoice_total", "currency", "line_item",
]


def _entities(d) -> str:
    names = " ".join(f"when {i} then '{t}'" for i, t in enumerate(ENTITY_TYPES))
    return f"""
      select l_orderkey as doc_id, l_linenumber as entity_idx,
             case (l_orderkey * 5 + l_linenumber * 7) % 12 {names} end as type,
             case when l_suppkey % 10 = 0 then null else concat('E', cast(l_partkey as string)) end as content
      from {d.table('lineitem', spread=False)}"""


def _attachments(d) -> str:
    def part(copy: int, condition: str) -> str:
        return f"""
          select concat('msg-', cast(o_orderkey as string)) as email_message_id,
                 case when o_orderkey % 3 = 0 then null else concat('user', cast(o_custkey as string), '@example.org') end as sender,
                 'Invoice' as subject,
                 case o_orderkey % 4 when 0 then 'a.b.PDF' when 1 then 'noext' when 2 then '.png' else 'scan.JPEG' end as filename,
                 case when o_orderkey % 8 = 1 then 'image/png; q=1' when o_orderkey % 8 = 2 then 'application/pdf' end as content_type,
                 {d.bytes("concat(case when o_orderkey % 2 = 0 then '%PDF-' else 'raw-' end, cast(o_custkey % 50 as string))")} as content,
                 {d.plus_hours(d.ts('o_orderdate'), str(copy))} as received_at
          from {d.table('orders')} {condition}"""

    return part(2, "") + " union all " + part(0, "where o_orderkey % 5 = 0") + " union all " + part(3, "where o_orderkey % 10 = 0")


def _invoices(d) -> str:
    created = d.ts("o_orderdate")
    return f"""
      select {_uuid(d, "concat('inv-', cast(o_orderkey as string))")} as id, concat('msg-', cast(o_orderkey as string)) as email_message_id,
             'a@example.org' as sender, 'Invoice' as subject, {created} as received_at,
             concat('f', cast(o_orderkey as string), '.pdf') as filename,
             case when o_orderkey % 5 = 0 then '' else 'application/pdf' end as content_type,
             {d.sha("cast(o_orderkey as string)")} as sha256,
             case when o_orderkey % 23 = 0 then '' else concat('storage/', cast(o_orderkey as string), '.pdf') end as storage_path,
             case o_orderkey % 9 when 0 then 'RECEIVED' when 1 then 'FAILED_RETRYABLE' when 2 then 'OCR_PENDING' when 3 then 'OCR_DONE'
               when 4 then 'EXTRACTED' when 5 then 'EXTRACTION_FAILED' when 6 then 'FAILED_FINAL' when 7 then 'RECEIVED'
               else 'OCR_DONE' end as status,
             cast(o_orderkey % 9 % 2 * (o_orderkey % 5) as int) as attempt_count,
             {d.plus_hours(created, 'o_orderkey % 48')} as next_attempt_at,
             case o_orderkey % 9 when 5 then 'PDF looks Image-Based' when 6 then 'PDF text extraction failed' when 1 then 'disk' else '' end as last_error,
             case when o_orderkey % 9 in (3, 4, 5) then o_orderpriority end as ocr_text,
             case when o_orderkey % 9 = 4 and o_orderkey % 4 <> 0 then concat('{{"total": "', cast(o_orderkey as string), '.00"}}') end as extracted_fields,
             case o_orderkey % 3 when 0 then 'ERROR' when 1 then 'VERIFIED' else 'REVIEW' end as confidence_status,
             {created} as created_at, {created} as updated_at, o_orderkey
      from {d.table('orders')}"""


def _text_results(d) -> str:
    return """
      select id, o_orderkey % 13 <> 0 as file_found, o_orderkey % 17 <> 0 as supported,
             case when o_orderkey % 19 = 0 then '' when o_orderkey % 19 = 1 then null else concat('text ', filename) end as text
      from invoices where o_orderkey % 11 <> 10"""


def _extraction_results(d) -> str:
    return """
      select id, concat('{"invoice_number": "INV-', cast(o_orderkey as string), '"}') as fields,
             case o_orderkey % 3 when 0 then 'VERIFIED' when 1 then 'REVIEW' end as confidence_status,
             case when o_orderkey % 6 = 5 then concat('code ', cast(o_orderkey % 4 as string)) end as error
      from invoices where status = 'OCR_DONE' and ocr_text is not null and extracted_fields is null"""


def _failures(d) -> str:
    return "select id, concat('boom ', cast(o_orderkey % 7 as string)) as error from invoices where status in ('RECEIVED', 'FAILED_RETRYABLE')"


def _status_updates(d) -> str:
    return """
      select id, case when o_orderkey % 2 = 0 then 'FAILED_FINAL' else 'RECEIVED' end as status,
             case when o_orderkey % 4 = 0 then 'closed by hand' end as error
      from invoices where confidence_status = 'REVIEW'"""


def _status_events(d) -> str:
    """Every event is a status change of the user's document; repeats come twice."""
    names = {"view": "RECEIVED", "signup": "OCR_PENDING", "click": "OCR_DONE", "purchase": "EXTRACTED"}
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in names.items())
    one = f"""select user_id as doc_id, event_id as seq, {d.ts('ts')} as event_ts,
             case event_type {cases} else 'FAILED_RETRYABLE' end as event,
             case when event_type = 'error' then props end as error from {d.table('events')}"""
    return one + " union all " + one + " where event_id % 4 = 0"


def _lookup_ids(d) -> str:
    return f"""
      select case o_orderkey % 4 when 0 then upper(id) when 1 then concat('inv-', cast(o_orderkey as string)) else id end as id
      from invoices union all select {_uuid(d, "concat('gone-', cast(c_custkey as string))")} from {d.table('customer')}"""


def _amount_texts(d) -> str:
    """Amounts as people write them, good and bad, one per line item."""
    n = "cast(round(l_extendedprice * 100) as bigint)"
    return f"""
      select l_orderkey as doc_id, l_linenumber as line,
        case (l_orderkey + l_linenumber) % 9
          when 0 then concat('$', {_money(d, n)}) when 1 then concat(' ', {_money(d, n)}, '5 ')
          when 2 then concat('EUR ', {_money(d, n)}) when 3 then concat('1,', lpad(cast(l_partkey as string), 3, '0'), '.')
          when 4 then concat('-', {_money(d, n)}, '15') when 5 then concat('.', cast(l_suppkey as string))
          when 6 then concat(cast(l_partkey as string), 'e2') when 7 then concat('1', lpad(cast(l_partkey as string), 25, '9'), '.005')
          else concat('12', lpad(cast(l_partkey as string), 26, '0')) end as raw
      from {d.table('lineitem')}"""


def _date_texts(d) -> str:
    day = {f: d.day("o_orderdate", f) for f in ("yyyy", "MM", "dd")}
    y, m, t = day["yyyy"], day["MM"], day["dd"]
    return f"""
      select o_orderkey as doc_id,
        case o_orderkey % 8 when 0 then concat('on ', {y}, '/', {m}, '/', {t}) when 1 then concat({t}, '.', {m}, '.', {y})
          when 2 then concat({m}, '-', {t}, '-', {y}, ' noon') when 3 then concat({y}, '-13-', {t}, ' or ', {t}, '/1/', {y})
          when 4 then concat('0000-', {m}, '-', {t}) when 5 then concat({y}, '.', {m}, '.', {t})
          when 6 then concat({y}, '-', cast(o_custkey % 14 as string), '-', cast(o_custkey % 33 as string))
          else concat(cast(o_custkey % 33 as string), '/', cast(o_custkey % 14 as string), '/', {y}) end as raw
      from {d.table('orders')}"""


def _currency_texts(d) -> str:
    return f"""
      select o_orderkey as doc_id,
        concat(cast(o_custkey as string), case o_orderkey % 7 when 0 then ' usd' when 1 then ' Euros' when 2 then ' £' when 3 then ' ₹ or $'
          when 4 then ' INR / cad' when 5 then ' ¥' else ' kr' end) as raw
      from {d.table('orders')}"""


def _misread_docs(d) -> str:
    """Texts whose dollar signs were read as 5 or S, or lost."""
    return """
      select doc_id, case doc_id % 5 when 0 then replace(text, '$', '5 ') when 1 then replace(text, '$', 'S') when 2 then replace(text, '$', '5')
        when 3 then concat(replace(text, '$', ''), chr(10), 'Currencyeur') else replace(text, '$', '') end as text
      from docs"""


def _padded_documents(d) -> str:
    return f"""
      select doc_id, concat('\u00a0 ', chr(10), text, '\u2003End\u3000 ', chr(10)) as text
      from {d.table('documents')}"""


def _corpus(d) -> str:
    """Every given text, none of them an invoice."""
    return f"""
      select doc_id, 'pdf' as kind, text from {d.table('documents')}
      union all select 1000000000 + page_id, 'pdf', html from {d.table('pages')}
      union all select 2000000000 + conv_id * 1000 + turn, 'pdf', text from {d.table('conversations')}"""


def _amount_fields(d) -> str:
    m = {n: _money(d, n) for n in ("sub", "dis", "tax")}
    off = _money(d, "dis * (1 + doc_id % 40)")
    return f"""
      select doc_id, case when doc_id % 13 <> 5 then cast({m['sub']} as decimal(28,2)) end as subtotal,
        case when doc_id % 4 <> 0 then cast(concat('-', {off}) as decimal(28,2)) end as discount,
        case when doc_id % 5 = 1 then cast(concat('-', {m['tax']}) as decimal(28,2)) when doc_id % 5 > 1 then cast({m['tax']} as decimal(28,2)) end as tax_amount,
        case when doc_id % 5 > 0 then 'vat' end as tax_type, cast(null as boolean) as tax_inferred
      from cents"""


def _manifest(d) -> str:
    """What was received, and what lies in the store: some files short, some gone."""
    return f"""
      select id, storage_path, o_orderkey, cast(100 + o_orderkey % 900 as bigint) as expected_length from invoices where storage_path <> ''"""


def _stored_files(d) -> str:
    return """
      select storage_path as path, case when o_orderkey % 29 = 3 then expected_length - 1 else expected_length end as length
      from manifest where o_orderkey % 31 <> 4"""


def _part_files(d) -> str:
    """A file for each document that any parts were read from; every third one an image, every tenth of no known kind."""
    return """
      select doc_id, case when doc_id % 10 = 9 then null when doc_id % 3 = 0 then 'image' else 'pdf' end as kind
      from (select doc_id from page_text union select doc_id from glyphs union select doc_id from ocr_segments) f"""


def _file_lines(d) -> str:
    """Orders as lines of one file a month; every second month is marked as a PDF, every third file comes twice."""
    month = d.day(d.ts("o_orderdate"), "yyyy-MM")
    return f"""
      select month, no, concat(case when cast(substr(month, 6, 2) as int) % 2 = 0 then '%PDF ' else 'text ' end,
             cast(no as string), ' ', o_orderstatus) as line, case when cast(substr(month, 6, 2) as int) % 3 = 0 then 2 else 1 end as copies
      from (select {month} as month, o_orderkey as no, o_orderstatus from {d.table('orders')}) o"""


def _arrived_pages(d) -> str:
    """The one page of each document as two methods saw it; every eleventh is blank to both."""
    return """
      select doc_id, 0 as page, 1 as engine_rank, m as method_rank,
             case when doc_id % 11 = 0 or (m = 1 and doc_id % 3 = 0) then ' ' when m = 1 then text else concat(' ', text, chr(10)) end as text
      from docs cross join (select 1 as m union all select 2) methods"""


def _arrived_segments(d) -> str:
    """The lines of each document as read from an image; every thirteenth image is blank."""
    return """
      select doc_id, 1 as engine_rank, cast(ln as int) as seg_idx, case when doc_id % 13 = 0 then '  ' else line end as text from doc_lines"""


TABLES = {
    "cents": _cents, "truth": _truth, "docs": _docs, "doc_lines": _doc_lines, "table_rows": _table_rows,
    "words": _words, "glyphs": _glyphs, "page_text": _page_text, "ocr_segments": _ocr_segments,
    "answers": _answers, "model_responses": _model_responses, "entities": _entities,
    "attachments": _attachments, "invoices": _invoices, "text_results": _text_results,
    "extraction_results": _extraction_results, "failures": _failures, "status_updates": _status_updates,
    "status_events": _status_events, "lookup_ids": _lookup_ids,
    "amount_texts": _amount_texts, "date_texts": _date_texts, "currency_texts": _currency_texts,
    "misread_docs": _misread_docs, "padded_documents": _padded_documents, "corpus": _corpus,
    "amount_fields": _amount_fields, "manifest": _manifest, "stored_files": _stored_files,
    "part_files": _part_files, "file_lines": _file_lines,
    "arrived_pages": _arrived_pages, "arrived_segments": _arrived_segments,
}


def with_clause(query: str, definitions: dict[str, str], materialized: tuple[str, ...] = ()) -> str:
    """Puts the definitions a query needs in front of it, in their own order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in definitions:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(definitions[name])

    visit(query)
    parts = [
        f"{n} as {'materialized ' if n in materialized else ''}({definitions[n]})" for n in definitions if n in needed
    ]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + query


class Tables:
    """Derived tables as DataFrames, one attribute each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        dialect = SparkDialect(folder)
        self.definitions = {n: make(dialect) for n, make in TABLES.items()}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return self.sql(f"select * from {name}")

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(with_clause(query, self.definitions))
