"""The registered queries as DuckDB SQL.

Written from the fixed patterns and the same derived tables, but by another way than
the Spark jobs: plain patterns without gates or atomic groups, windows and ordered
string aggregation, answers taken from the true values they were made of.
"""

from __future__ import annotations

from tallyscan import fixed_values as fv
from tallyscan.plans.derived import NOW, TABLES, DuckDialect, _uuid, with_clause

_D = DuckDialect()
WS = fv.WHITESPACE
MONEY = "decimal(28,2)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(s: str) -> str:
    return f"trim({s}, {q(WS)})"


def blank(s: str) -> str:
    return f"coalesce({strip(s)}, '') = ''"


def amount(s: str) -> str:
    clean = f"regexp_replace(regexp_replace({s}, {q('[$€£¥₹,_' + WS + ']')}, '', 'g'), '^([+-]?[0-9]*[.][0-9]{{9}})[0-9]*[1-9][0-9]*$', '\\11')".replace("{{", "{").replace("}}", "}")
    return f"try_cast(round_even(try_cast({clean} as decimal(38,10)), 2) as {MONEY})"


def amounts(lower: str, patterns: list[str], flags: str = "") -> str:
    inline = f"(?{flags})" if flags else ""
    return ", ".join(amount(f"regexp_extract({lower}, {q(inline + p)}, 1)") for p in patterns)


def day(s: str) -> str:
    first = [f"regexp_extract({s}, {q(fv.DATE_YEAR_FIRST)}, {i})" for i in (1, 2, 3)]
    last = [f"regexp_extract({s}, {q(fv.DATE_YEAR_LAST)}, {i})" for i in (1, 2, 3)]

    def real(y: str, m: str, d: str) -> str:
        return f"try_cast(concat(nullif({y}, '0000'), '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) as date)"

    def known(y: str, m: str, d: str) -> str:
        return f"case when {y} <> '0000' then {real(y, m, d)} end"

    a, b, y = last
    return (
        f"coalesce({known(*first)}, case when try_cast({a} as int) > 12 then {known(y, b, a)} else {known(y, a, b)} end)"
    )


def title(s: str) -> str:
    return (
        f"array_to_string([upper(r[1]) || lower(r[2:]) for r in regexp_extract_all({s}, '[A-Za-z]+|[^A-Za-z]+')], '')"
    )


def norm(source: str) -> str:
    text = strip("text")
    wide = q("[" + fv.WIDE_WHITESPACE + "]")
    return f"select *, regexp_replace(btext, {wide}, ' ', 'g') as ptext, lower(regexp_replace(btext, {wide}, ' ', 'g')) as lower from (select * exclude (text), {text} as btext from {source}) n"


def number_sql() -> str:
    def accepted(p: str) -> str:
        c = f"upper(regexp_extract(lower, {q('(?i)' + p)}, 1))"
        ok = f"length({c}) >= 3 and regexp_matches({c}, '[0-9]') and (regexp_matches({c}, '[A-Z]') or regexp_matches({c}, '^[0-9]{{4,}}$'))"
        return f"case when {ok} then {c} end".replace("{{", "{").replace("}}", "}")

    return "coalesce(" + ", ".join(accepted(p) for p in fv.NUMBER_PATTERNS) + ")"


def date_sql() -> str:
    parts = []
    for k in fv.DATE_KEYWORDS:
        context = f"substr(btext, strpos(lower, {q(k)}), 100)"
        parts.append(f"case when strpos(lower, {q(k)}) > 0 then {day(context)} end")
    return "coalesce(" + ", ".join(parts) + ")"


def labelled_sql() -> str:
    raw = strip(f"regexp_extract(substr(regexp_replace(btext, {q('[' + fv.WIDE_WHITESPACE + ']')}, ' ', 'g'), 1, 500), {q('(?im)' + fv.VENDOR_PATTERN)}, 1)")
    cut = f"regexp_replace(regexp_replace({raw}, '\\s+', ' ', 'g'), {q('(?i)' + fv.VENDOR_TAIL)}, '', 'g')"
    return f"case when length({cut}) between 2 and 100 then {title(cut)} end"


def fallback_sql() -> str:
    skip = " and ".join(f"not regexp_matches(l, {q('(?i)' + p)})" for p in fv.VENDOR_SKIP)
    upper = "(({0}) = upper({0}) and ({0}) <> lower({0}))"
    keep = f"{skip} and length(l) > 3 and length(l) < 50 and ({upper.format('l')} or {upper.format('l[1]')}) and not regexp_matches(l, '[0-9]{{4,}}')".replace("{{", "{").replace("}}", "}")
    lines = f"[{strip('x')} for x in string_split(substr(btext, 1, 500), chr(10))[2:10]]"
    return f"[l for l in {lines} if {keep}][1]"


def currency_explicit_sql() -> str:
    parts = [f"when regexp_matches(lower, '\\b{c.lower()}\\b') then '{c}'" for c in fv.CURRENCY_CODES]
    parts += [f"when contains(lower, '{s}') then '{c}'" for s, c in fv.CURRENCY_SYMBOLS.items()]
    return "case " + " ".join(parts) + " end"


def currency_inferred_sql() -> str:
    """All steps one after the other, with every overlapping pattern."""
    before = "(total|subtotal|amount|price|cost|due|fee)"
    after = "(total|subtotal|amount|due)"
    has = lambda col, p: f"regexp_matches({col}, {q(p)})"
    steps = []
    for p in (r"\b5\s+[\d,]+\.[\d]{2}\b", fv.MISREAD_FIVE_AMOUNT, r"\b5\d{3,}\.\d{2}\b"):
        near = f"({has('lower', before + '.*?' + p)} or {has('lower', p + '.*?' + after)})"
        steps.append(f"when {has('btext', p)} and {near} then 'USD'")
    for p in fv.CURRENCY_LABEL_PATTERNS:
        steps.append(f"when {has('lower', p)} then upper(regexp_extract(lower, {q(p)}, 1))")
    indicator = "contains(btext, '$') or " + " or ".join(has("ptext", p) for p in fv.DOLLAR_INDICATORS)
    words = " or ".join(f"contains(lower, '{w}')" for w in fv.INVOICE_KEYWORDS)
    for p in (r"[\d,]+\.\d{2}", r"\d+\.\d{2}"):
        near = f"{has('lower', before + '.*?' + p)} or {has('lower', p + '.*?' + after)} or {words}"
        steps.append(f"when ({indicator}) and {has('btext', p)} and ({near}) then 'USD'")
    long_five = r"5\s*\d{4,}\.\d{2}"
    both = has("btext", r"\b" + long_five + r"\b") + " and " + has("lower", before + ".*?" + long_five)
    steps.append(f"when {both} then 'USD'")
    return "case " + " ".join(steps) + " end"


EXTRACTORS = {
    "invoice_number": number_sql(),
    "invoice_date": date_sql(),
    "vendor_labelled": labelled_sql(),
    "vendor_fallback": fallback_sql(),
    "subtotal": f"coalesce({amounts('lower', fv.SUBTOTAL_TABLE_PATTERNS, 'i')}, {amounts('lower', fv.SUBTOTAL_PATTERNS)})",
    "discount": f"cast(-abs(coalesce({amounts('lower', fv.DISCOUNT_TABLE_PATTERNS, 'i')}, {amounts('lower', fv.DISCOUNT_PATTERNS)})) as {MONEY})",
    "tax": f"coalesce({amounts('lower', fv.TAX_TABLE_PATTERNS, 'i')}, {amounts('lower', fv.TAX_PATTERNS)})",
    "vat": f"coalesce({amounts('lower', fv.VAT_PATTERNS)})",
    "total": f"coalesce({amounts('lower', fv.TOTAL_PATTERNS, 'm')})",
    "explicit": currency_explicit_sql(),
    "inferred": currency_inferred_sql(),
}


def raw_rules(source: str) -> str:
    e = EXTRACTORS
    cols = ", ".join(f"{e[k]} as r_{k}" for k in e)
    return f"""
      select doc_id, kind, r_invoice_number as invoice_number, r_invoice_date as invoice_date,
        coalesce(r_vendor_labelled, r_vendor_fallback) as vendor_name, r_subtotal as subtotal, r_discount as discount,
        coalesce(r_vat, r_tax) as tax_amount, case when r_vat is not null then 'vat' when r_tax is not null then 'sales_tax' end as tax_type,
        cast(null as boolean) as tax_inferred, r_total as total, coalesce(r_explicit, r_inferred) as currency
      from (select doc_id, kind, {cols} from ({norm(source)}) t) r"""


def reconciled(source: str) -> str:
    return f"""
      select * replace (
          case when branch = 'tax' then cast(total - subtotal + d as {MONEY}) else tax_amount end as tax_amount,
          case when branch = 'tax' then 'sales_tax' else tax_type end as tax_type,
          case when branch = 'tax' then true else tax_inferred end as tax_inferred,
          case when branch = 'discount' then cast(-(subtotal + x - total) as {MONEY}) else discount end as discount),
        case when branch = 'bad' then 'inconsistent' end as reconciliation_status,
        case when branch = 'bad' then concat('Expected total: ', cast(cast(subtotal - d + x as {MONEY}) as varchar), ', Found: ', cast(total as varchar),
          ', Difference: ', cast(cast(abs(subtotal - d + x - total) as {MONEY}) as varchar)) end as reconciliation_error
      from (
        select *, case when subtotal is null or total is null then 'skip' when abs(subtotal - d + x - total) <= 0.01 then 'ok'
          when tax_amount is null and total - subtotal + d >= 0 then 'tax'
          when discount is null and subtotal + x - total > 0 then 'discount' else 'bad' end as branch
        from (select *, coalesce(discount, cast(0 as {MONEY})) as d, coalesce(tax_amount, cast(0 as {MONEY})) as x from {source}) a) b"""


def exclusive(source: str) -> str:
    return f"""
      select * replace (
        case when abs(discount) > subtotal then null else discount end as discount,
        case when tax_amount < 0 then null else tax_amount end as tax_amount,
        case when tax_amount < 0 then null else tax_type end as tax_type,
        case when tax_amount < 0 then null else tax_inferred end as tax_inferred)
      from {source}"""


def validated(source: str) -> str:
    words = ", ".join(q(w) for w in fv.HEADER_WORDS)
    text = lambda c: f"coalesce(cast({c} as varchar), '0')"
    total = f"cast(coalesce(subtotal, 0.00) + coalesce(tax_amount, 0.00) + coalesce(discount, 0.00) as {MONEY})"
    expected = f"case when coalesce(subtotal, tax_amount, discount) is null then '0' else cast({total} as varchar) end"
    return f"""
      select *, validation_error is null as is_valid from (
        select *, case when {blank('invoice_number')} then {q(fv.MISSING_NUMBER)} when total is null then {q(fv.MISSING_TOTAL)}
          when invoice_date is null then {q(fv.MISSING_DATE)}
          when {strip('upper(invoice_number)')} in ({words}) then concat('Invoice number ''', invoice_number, ''' is a table header, not a valid invoice number')
          when abs({total} - total) > 0.02 then concat('Math validation failed: total (', cast(total as varchar), ') ≠ subtotal (', {text('subtotal')},
            ') + tax (', {text('tax_amount')}, ') + discount (', {text('discount')}, '). Expected: ', {expected}, ', Difference: ',
            cast(cast(abs({total} - total) as {MONEY}) as varchar)) end as validation_error
        from {source}) v"""


def code_sql(s: str) -> str:
    parts = [f"when contains(upper({s}), '{c}') then '{c}'" for c in fv.CURRENCY_CODES]
    parts += [f"when contains({s}, '{k}') then '{c}'" for k, c in fv.CURRENCY_SYMBOLS.items()]
    return "case " + " ".join(parts) + " end"


LABEL = """case when contains(label, 'invoice') and (contains(label, 'number') or contains(label, '#') or contains(label, 'no')) then 'invoice_number'
  when contains(label, 'date') and (contains(label, 'invoice') or contains(label, 'billing')) then 'invoice_date'
  when contains(label, 'subtotal') or contains(label, 'sub total') then 'subtotal'
  when contains(label, 'tax') and not contains(label, 'vat') then 'tax' when contains(label, 'vat') then 'vat'
  when contains(label, 'total') and (contains(label, 'due') or contains(label, 'amount') or label = 'total') then 'total'
  when contains(label, 'currency') or contains(label, 'curr') then 'currency' end"""

SCOPE = "page = 0 and doc_id in (select doc_id from docs where kind is distinct from 'image')"
LAYOUT = ["invoice_number", "invoice_date", "vendor_name", "subtotal", "tax", "vat", "total", "currency"]
ANSWER = ["invoice_number", "invoice_date", "vendor_name", "subtotal", "discount", "tax_amount", "tax_type", "total", "currency", "vat"]


def _first(field: str, value: str) -> str:
    return f"arg_min({value}, (table_idx, row_idx)) filter (where field = '{field}' and {value} is not null) as {field}"


def lines(where: str) -> str:
    return f"""
      select doc_id, page, y, string_agg(text, ' ' order by word_idx) as line,
             arg_min(amt, word_idx) filter (where amt is not null) as amt
      from (select doc_id, page, word_idx, text, cast(round_even(top / 5, 0) as bigint) * 5 as y, {amount('text')} as amt
            from words where text <> '' and {where}) w
      group by doc_id, page, y"""


_TOPMOST = {
    "subtotal": "contains(lower(line), 'subtotal') or contains(lower(line), 'sub total')",
    "tax": "contains(lower(line), 'tax') and not contains(lower(line), 'vat')",
    "vat": "contains(lower(line), 'vat')",
    "total": "contains(lower(line), 'total') or contains(lower(line), 'amount due')",
}


def _answer_rows() -> str:
    """What parsing must give, from the true values; one row per parseable answer."""
    m = {n: f"concat(cast({n} // 100 as varchar), '.', lpad(cast({n} % 100 as varchar), 2, '0'))" for n in ("sub", "dis", "tax", "tot")}
    number = f"regexp_replace(regexp_replace({m['dis']}, '0$', ''), '[.]0$', '.0')"
    common = (
        f"doc_id, cast({{rank}} as bigint) as provider_rank, concat('INV-', cast(doc_id as varchar)) as invoice_number, "
        f"strftime(day, '%Y-%m-%d') as invoice_date, concat('Northwind ', word) as vendor_name, {m['sub']} as subtotal, "
        f"case when v in (1, 4) then {{dis}} end as discount, {m['tax']} as tax_amount, {{type}} as tax_type, {m['tot']} as total, "
        "{cur} as currency, cast(null as varchar) as vat"
    )
    negative = f"case when dis > 0 then concat('-', {number}) else '0.0' end"
    one = common.format(rank=1, dis=negative, type="case when v = 2 then 'vat' else 'sales_tax' end", cur="'USD'")
    two = common.format(rank=2, dis=number, type="case when v = 2 then 'vat' end", cur="'USD'")
    three = common.format(rank=3, dis=number, type="case when v = 2 then 'vat' end", cur="'EUR'")
    return (
        f"select {one} from truth where doc_id % 7 <> 0 and not (doc_id % 6 = 4 and v = 2) union all "
        f"select {two} from truth where doc_id % 5 = 0 and doc_id % 3 <> 0 union all select {three} from truth where doc_id % 4 = 1"
    )


def _entity_fields() -> str:
    names = {}
    for t, f in fv.ENTITY_FIELDS.items():
        names.setdefault(f, []).append(t)
    cols = []
    for c in ANSWER:
        f = "tax" if c == "tax_amount" else c
        if f not in names:
            cols.append(f"cast(null as varchar) as {c}")
            continue
        types = ", ".join(q(t) for t in names[f])
        cols.append(f"(list(content order by entity_idx desc, content desc nulls last) filter (where type in ({types})))[1] as {c}")
    return f"select doc_id, cast(4 as bigint) as provider_rank, {', '.join(cols)} from entities group by doc_id"


def _wrapped(source: str) -> str:
    """value, confidence and note of merged fields without a model."""
    cols = []
    for f in [*fv.FIELDS, "vat"]:
        c = "tax_amount" if f == "tax" else f
        cols.append(f"cast({c} as varchar) as {f}")
        if f == "tax":
            cols += ["tax_type", "tax_inferred"]
        cols += [f"case when {c} is not null then cast(0.9 as double) end as {f}_conf", f"cast(null as varchar) as {f}_note"]
    return f"select doc_id, {', '.join(cols)}, reconciliation_status, reconciliation_error {{more}} from {source}"


def _overlaid(queue: str) -> str:
    cols = []
    for f in [*fv.FIELDS, "vat"]:
        c = "tax_amount" if f == "tax" else f
        note = q(fv.NOTE_MISREAD) if f in ("total", "subtotal", "currency") else f"concat({q(fv.NOTE_CORRECTION)}, q.validation_error)"
        hit = f"m.{c} is not null"
        cols.append(f"coalesce(m.{c}, cast(q.{c} as varchar)) as {f}")
        if f == "tax":
            cols.append(f"case when {hit} then m.tax_type else q.tax_type end as tax_type")
            cols.append(f"case when {hit} then null else q.tax_inferred end as tax_inferred")
        cols.append(f"case when {hit} then case when q.is_valid then 0.7::double else 0.5::double end when q.{c} is not null then 0.9::double end as {f}_conf")
        cols.append(f"case when {hit} then case when q.is_valid then {q(fv.NOTE_MODEL)} else {note} end end as {f}_note")
    any_value = " or ".join(f"m.{c} is not null" for c in ANSWER)
    return f"""
      select q.doc_id, {', '.join(cols)}, q.reconciliation_status, q.reconciliation_error, q.is_valid, q.validation_error,
        q.escalation_reason, not q.is_valid and ({any_value}) as corrected
      from {queue} q left join chosen m on m.doc_id = q.doc_id and q.escalation_reason is not null"""


def queue(source: str) -> str:
    names = ["tax_amount" if f == "tax" else f for f in fv.FIELDS]
    found = " + ".join(f"({n} is not null)::int" for n in [*names, "vat", "reconciliation_status", "reconciliation_error"])
    keys = "8 + (vat is not null)::int + (reconciliation_status is not null)::int + (reconciliation_error is not null)::int"
    return f"""select *, case when not is_valid then 'validation_failed' when currency is null or total is null then 'critical_missing'
      when ({found}) / ({keys}) < 0.5 then 'low_rate' end as escalation_reason from {source}"""


def flat(source: str, *more: str, vat: bool = False) -> str:
    cols = ["invoice_number", "invoice_date", "vendor_name", "subtotal", "discount", "tax_amount", "tax_type", "total", "currency"]
    if vat:
        cols.append("vat")
    cast = ", ".join(f"cast({c} as varchar) as {c}" for c in cols)
    tail = "".join(f", {m}" for m in more)
    return f"select doc_id, {cast}, tax_inferred, reconciliation_status, reconciliation_error{tail} from {source}"


_TS = {c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" for c in ("received_at", "next_attempt_at", "created_at", "updated_at", "event_ts")}
_STATE = (
    f"select id, status, cast(attempt_count as bigint) as attempt_count, {_TS['next_attempt_at']}, {_TS['updated_at']}, "
    "last_error, ocr_text, extracted_fields, confidence_status from"
)
_NOW = f"timestamp '{NOW}'"
_DUE = f"(status in ('RECEIVED', 'FAILED_RETRYABLE') and next_attempt_at <= {_NOW})"
_UUID_KEY = "sha256(concat_ws('|', email_message_id, sha256))"
_ID = "concat(" + ", '-', ".join(f"substr({_UUID_KEY}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"
_WAIT = f"{_NOW} + to_minutes(cast(least(pow(2, greatest(attempt_count, 0)), 60) as bigint))"


def failed(source: str, hit: str, error: str) -> str:
    """State after a failed attempt, with attempt_count as it was before."""
    final = "attempt_count + 1 >= 5"
    return f"""select * replace (
      case when {hit} then case when {final} then 'FAILED_FINAL' else 'FAILED_RETRYABLE' end else status end as status,
      case when {hit} then case when {final} then {_NOW} else {_WAIT} end else next_attempt_at end as next_attempt_at,
      case when {hit} then attempt_count + 1 else attempt_count end as attempt_count,
      case when {hit} then {error} else last_error end as last_error,
      case when {hit} then {_NOW} else updated_at end as updated_at) from {source}"""


def _definitions() -> dict[str, str]:
    d = {n: make(_D) for n, make in TABLES.items()}
    d["digested"] = "select * exclude (content), sha256(content) as sha256, octet_length(content) as length, substr(hex(content), 1, 8) as head from attachments"
    d["ingested"] = """
      select * exclude (rn) from (select *, row_number() over (partition by email_message_id, sha256 order by received_at, filename) as rn from digested) x where rn = 1"""
    d["keyed"] = f"""
      select *, {_ID} as id, concat('storage/', {_ID}, case when contains(filename, '.') then '.' || lower(string_split(filename, '.')[-1]) else '' end) as storage_path
      from ingested"""
    d["page_choice"] = f"""
      select doc_id, engine_rank, page, arg_min(text, method_rank) as text from page_text where not ({blank('text')}) group by all"""
    d["engine_choice"] = "select * from page_choice qualify engine_rank = min(engine_rank) over (partition by doc_id)"
    d["raw_fields"] = raw_rules("docs")
    d["rec_fields"] = reconciled("raw_fields")
    d["rule_out"] = exclusive("rec_fields")
    d["table_pairs"] = f"""
      select doc_id, table_idx, row_idx, {LABEL} as field, val,
        {amount('val')} as amt, {day('val')} as day_value, {code_sql('val')} as code
      from (select *, lower({strip("coalesce(cells[1], '')")}) as label, nullif({strip("coalesce(cells[-1], '')")}, '') as val
            from table_rows where len(cells) >= 2 and {SCOPE}) r"""
    d["table_fields"] = f"""
      select doc_id, {_first('invoice_number', 'val')}, {_first('invoice_date', 'day_value')}, {_first('subtotal', 'amt')}, {_first('tax', 'amt')},
        {_first('vat', 'amt')}, {_first('total', 'amt')}, {_first('currency', 'code')}
      from table_pairs where field is not null and val is not null group by doc_id"""
    d["scoped_lines"] = lines(SCOPE)
    picks = ", ".join(f"arg_min(amt, y) filter (where {c}) as {n}" for n, c in _TOPMOST.items())
    d["line_amounts"] = f"select doc_id, {picks} from scoped_lines where amt is not null and ({' or '.join(f'({c})' for c in _TOPMOST.values())}) group by doc_id"
    skip = " and ".join(f"not contains(lower(line), '{w}')" for w in fv.LAYOUT_VENDOR_SKIP)
    d["line_vendor"] = f"""
      select doc_id, {strip('arg_min(line, y)')} as vendor_name
      from (select *, dense_rank() over (partition by doc_id order by y) as r from scoped_lines) t
      where r <= 5 and {skip} and length(line) > 3 and length(line) < 50 and line[1] = upper(line[1]) and line[1] <> lower(line[1])
        and not (line = upper(line) and line <> lower(line))
      group by doc_id"""
    both = ", ".join(f"coalesce(t.{f}, w.{f}) as {f}" for f in ("subtotal", "tax", "vat", "total"))
    d["layout_out"] = f"""
      select doc_id, t.invoice_number, t.invoice_date, v.vendor_name, {both}, t.currency
      from table_fields t full join line_amounts w using (doc_id) full join line_vendor v using (doc_id)"""
    over = ", ".join(f"coalesce(y.{f}, r.{f}) as {f}" for f in ("invoice_number", "invoice_date", "vendor_name", "subtotal"))
    d["merged"] = f"""
      select r.doc_id, r.kind, {over}, r.discount, coalesce(y.tax, r.tax_amount) as tax_amount, case when y.tax is null then r.tax_type end as tax_type,
        case when y.tax is null then r.tax_inferred end as tax_inferred, coalesce(y.total, r.total) as total, coalesce(y.currency, r.currency) as currency,
        y.vat, r.reconciliation_status, r.reconciliation_error
      from rule_out r left join layout_out y on y.doc_id = r.doc_id"""
    d["merged_valid"] = validated("merged")
    d["merged_queue"] = queue("merged_valid")
    d["rule_valid"] = validated(f"(select *, cast(null as {MONEY}) as vat from rule_out)")
    d["rule_queue"] = queue("rule_valid")
    d["answer_rows"] = _answer_rows()
    d["entity_fields"] = _entity_fields()
    d["asked"] = "select doc_id, min(provider_rank) as rank from (select doc_id, provider_rank from model_responses where provider_rank > 1 union all select doc_id, 4 from entities) a group by doc_id"
    d["all_answers"] = f"select doc_id, provider_rank, {', '.join(ANSWER)} from answer_rows union all select doc_id, provider_rank, {', '.join(ANSWER)} from entity_fields"
    d["chosen"] = """
      select a.* from all_answers a left join asked k on k.doc_id = a.doc_id
      where a.provider_rank = 1 or (a.provider_rank = k.rank and a.doc_id not in (select doc_id from answer_rows where provider_rank = 1))"""
    d["rule_overlaid"] = _overlaid("rule_queue")
    d["overlaid"] = _overlaid("merged_queue")
    d["finished"] = """
      select *, case when is_valid and escalation_reason is null then 'VERIFIED' when not is_valid and corrected then 'REVIEW' else 'ERROR' end as confidence_status
      from overlaid"""
    d["plain_done"] = "select *, case when is_valid then 'VERIFIED' else 'ERROR' end as confidence_status from merged_valid"
    d["text_state"] = f"""
      select i.*, {_DUE} as due, r.id is not null as hit, r.text as new_text,
        case when r.id is null then null when storage_path = '' then 'File not found: '
          when file_found and not supported then concat('Unsupported file type: ', case when content_type <> '' then content_type else 'unknown' end, '. Supported: PDF, PNG, JPEG, TIFF')
          when not file_found or coalesce(r.text, '') = '' then {q(fv.ERROR_NO_TEXT)} end as failure
      from invoices i left join text_results r on r.id = i.id"""
    return d


def _build() -> dict[str, str]:
    d = _definitions()
    single = lambda k, src="docs": f"select doc_id, cast({EXTRACTORS[k]} as varchar) as value from ({norm(src)}) t"
    answer = ", ".join(ANSWER)
    wrapped_cols = []
    for f in [*fv.FIELDS, "vat"]:
        wrapped_cols.append(f)
        if f == "tax":
            wrapped_cols += ["tax_type", "tax_inferred"]
        wrapped_cols += [f"{f}_conf", f"{f}_note"]
    wrapped_cols += ["reconciliation_status", "reconciliation_error"]
    wrapped = ", ".join(wrapped_cols)
    image_ext = ", ".join(q(e) for e in fv.IMAGE_EXTENSIONS)
    image_mime = ", ".join(q(e) for e in fv.IMAGE_MIME_TYPES)
    stored_ext = "case when contains(filename, '.') then lower(string_split(filename, '.')[-1]) else '' end"
    kind = (
        f"case when {stored_ext} in ({image_ext}) or trim(split_part(lower(coalesce(content_type, '')), ';', 1)) in ({image_mime}) then 'image' "
        "when head = '25504446' then 'pdf' end"
    )
    display = []
    for f in [*fv.FIELDS, "vat"]:
        label = fv.FIELD_LABELS.get(f, f)
        shown = "case when tax_type is null then tax when tax_type = 'vat' then 'VAT: ' || tax else 'Tax: ' || tax end" if f == "tax" else f
        extra = "where vat is not null" if f == "vat" else ""
        display.append(
            f"select doc_id, {q(f)} as field, {q(label)} as label, coalesce({shown}, 'Not found') as shown, "
            f"case when {f}_conf is not null then concat('(', cast(cast(round({f}_conf * 100) as int) as varchar), '%)') end as percent, "
            f"case when {f}_conf >= 0.9 then 'high' when {f}_conf >= 0.5 then 'middle' when {f}_conf is not null then 'low' end as band, "
            f"{f}_note as notes from finished {extra}"
        )
    names = ["tax_amount" if f == "tax" else f for f in fv.FIELDS]
    extras = "(vat is not null)::bigint + (reconciliation_status is not null)::bigint + (reconciliation_error is not null)::bigint"
    found = " + ".join(f"({n} is not null)::bigint" for n in names) + " + " + extras
    reason = (
        "case when validation_error is null then 'none' when starts_with(validation_error, 'Math validation failed') then 'Math validation failed' "
        "when contains(validation_error, 'is a table header') then 'Invoice number is a table header' else validation_error end"
    )
    counts = ", ".join(f"cast(count({f}) as bigint) as n_{f}" for f in fv.FIELDS)
    total = amount("total")
    month = "coalesce(substr(invoice_date, 1, 7), 'none')"
    report = " union all ".join(
        f"select '{section}' as section, {key} as key, {month} as month, count(*) as documents, cast(cast(sum({total}) as decimal(38,2)) as varchar) as total_amount, "
        f"count(total) - count({total}) as n_unparsed_totals, {counts} from finished {group}"
        for section, key, month, group in (
            ("all", "'all'", "cast(null as varchar)", ""),
            ("status", "confidence_status", "cast(null as varchar)", "group by confidence_status"),
            ("reason", reason, "cast(null as varchar)", f"group by {reason}"),
            ("currency", "coalesce(currency, 'none')", "cast(null as varchar)", "group by coalesce(currency, 'none')"),
            ("vendor_month", "coalesce(vendor_name, 'none')", month, f"group by coalesce(vendor_name, 'none'), {month}"),
        )
    )
    image_based = "(contains(last_error, 'PDF text extraction failed') or contains(lower(last_error), 'image-based'))"
    message = f"case when {image_based} then {q(fv.ERROR_IMAGE_BASED)} when last_error <> '' then last_error end"
    success = "(status = 'EXTRACTED' and coalesce(extracted_fields, '{}') <> '{}')"
    bare_id = r"replace(regexp_replace(regexp_replace(i.id, 'urn:|uuid:', '', 'g'), '^[{}]+|[{}]+$', '', 'g'), '-', '')"
    bt = "'```'"
    text_done = f"""select * replace (case when due and hit and failure is null then 'OCR_DONE' when due then 'OCR_PENDING' else status end as status,
        case when due and hit and failure is null then new_text else ocr_text end as ocr_text,
        case when due then {_NOW} else updated_at end as updated_at) from text_state"""
    corpus_rules = validated("(" + exclusive("(" + reconciled("(" + raw_rules("corpus") + ") c") + ") c") + ")")
    documents_rules = validated(
        "(" + exclusive("(" + reconciled("(" + raw_rules("(select doc_id, 'pdf' as kind, text from documents)") + ") c") + ") c") + ")"
    )
    latest = f"""select doc_id, seq, {_TS['event_ts']}, event, error from status_events
      qualify row_number() over (partition by doc_id order by event_ts desc, seq desc) = 1"""

    q_ = {
        "a1_scan_files": "select sum(octet_length(encode(concat_ws(',', email_message_id, filename))) + 1)::bigint as bytes, true as whole from attachments",
        "a1_scan_each_file": "select month, octet_length(encode(body))::bigint as length, sha256(body) as sha256 from (select month, string_agg(line, chr(10) order by no) || chr(10) as body from file_lines group by month) f",
        "a2_classify_files": f"select email_message_id, filename, {_TS['received_at']}, {kind} as kind, {kind} is not null as supported from digested",
        "a3_content_digest": f"select email_message_id, {_TS['received_at']}, sha256, length::bigint as length from digested",
        "a4_dedupe_ingest": f"select email_message_id, sha256, filename, {_TS['received_at']}, sender from ingested where email_message_id not like '%7'",
        "a5_assign_storage_key": "select email_message_id, filename, id, storage_path from keyed",
        "a6_check_sizes": """select m.id, m.expected_length, coalesce(f.length, 0) as stored_length from manifest m left join stored_files f on f.path = m.storage_path
            where coalesce(f.length, 0) <> m.expected_length""",
        "a7_initial_state": f"""select id, email_message_id, coalesce(sender, '') as sender, subject, filename, coalesce(content_type, 'application/octet-stream') as content_type,
            'RECEIVED' as status, 0::bigint as attempt_count, {_TS['received_at']}, '{NOW}' as next_attempt_at, '{NOW}' as created_at, '' as last_error,
            cast(null as varchar) as ocr_text, cast(null as varchar) as extracted_fields, 'ERROR' as confidence_status from keyed""",
        "a8_evolve_schema": "select id, status, case when created_at >= '1996-01-01' and confidence_status <> 'REVIEW' then confidence_status else 'ERROR' end as confidence_status from invoices",
        "a9_write_invoices": f"select id, email_message_id, 'RECEIVED' as status, 'ERROR' as confidence_status, {_TS['received_at']} from keyed",
        "b1_choose_page_text": "select doc_id, engine_rank::bigint as engine_rank, page::bigint as page, text from page_choice",
        "b2_choose_engine": "select doc_id, engine_rank::bigint as engine_rank, page::bigint as page, text from engine_choice",
        "b3_lines_from_glyphs": f"""select doc_id, page::bigint as page, string_agg(line, chr(10) order by y desc) as text from (
            select doc_id, page, cast(round_even(top / 5, 0) as bigint) * 5 as y, string_agg(text, '' order by x0, seq) as line from glyphs where text <> '' group by all) g
            where not ({blank('line')}) group by doc_id, page""",
        "b4_table_to_text": """select doc_id, page::bigint as page, string_agg(array_to_string([coalesce(c, '') for c in cells], ' | '), chr(10) order by table_idx, row_idx) as text
            from table_rows where len(cells) > 0 group by doc_id, page""",
        "b5_pages_to_document": f"""select doc_id, string_agg({strip('text')}, chr(10) || chr(10) order by page) as text from engine_choice where not ({blank('text')}) group by doc_id""",
        "b6_segments_to_document": f"""select doc_id, engine_rank::bigint as engine_rank, text from (
            select doc_id, engine_rank, {strip("string_agg(text, chr(10) order by seg_idx)")} as text from ocr_segments group by all) s
            where text <> '' qualify engine_rank = min(engine_rank) over (partition by doc_id)""",
        "b7_normalise_text": f"select doc_id, btext as text, lower as text_lower from ({norm('padded_documents')}) t",
        "c1_clean_amounts": f"select doc_id, line::bigint as line, cast({amount('raw')} as varchar) as value from amount_texts",
        "c2_clean_dates": f"select doc_id, cast({day('raw')} as varchar) as value from date_texts",
        "c3_clean_currency": f"select doc_id, {code_sql('raw')} as value from currency_texts",
        "d1_invoice_number": single("invoice_number"),
        "d2_invoice_date": single("invoice_date"),
        "d3a_vendor_labelled": single("vendor_labelled"),
        "d3b_vendor_fallback": single("vendor_fallback"),
        "d4_subtotal": single("subtotal"),
        "d5_tax_amount": single("tax"),
        "d6_vat_amount": single("vat"),
        "d7_tax_normalised": "select doc_id, cast(tax_amount as varchar) as tax_amount, tax_type from raw_fields",
        "d8_discount": single("discount"),
        "d9_total": single("total"),
        "d10a_currency_explicit": single("explicit"),
        "d10b_currency_inferred": single("inferred", "misread_docs"),
        "d11_rule_fields": flat("rule_out"),
        "d11_rule_fields_corpus": flat(f"({corpus_rules}) c", "is_valid", "validation_error"),
        "e1_reconcile_amounts": flat("rec_fields"),
        "e2_field_exclusivity": f"select doc_id, cast(subtotal as varchar) as subtotal, cast(discount as varchar) as discount, cast(tax_amount as varchar) as tax_amount, tax_type from ({exclusive('amount_fields')}) e",
        "e3_validate_accounting": "select doc_id, is_valid, validation_error from rule_valid",
        "f1_layout_scope": f"select doc_id, table_idx::bigint as table_idx, row_idx::bigint as row_idx, len(cells)::bigint as n_cells from table_rows where {SCOPE}",
        "f2_fields_from_tables": "select doc_id, " + ", ".join(f"cast({f} as varchar) as {f}" for f in LAYOUT if f != "vendor_name") + " from table_fields",
        "f3_lines_from_words": f"select doc_id, page::bigint as page, y, line from ({lines('true')}) l",
        "f4_amounts_from_lines": "select doc_id, " + ", ".join(f"cast({f} as varchar) as {f}" for f in _TOPMOST) + " from line_amounts",
        "f5_vendor_from_lines": "select doc_id, vendor_name from line_vendor",
        "f6_merge_layout": "select doc_id, " + ", ".join(f"cast({f} as varchar) as {f}" for f in LAYOUT) + " from layout_out",
        "g1_escalation_queue": "select doc_id, is_valid, escalation_reason from merged_queue",
        "g2_build_requests": """select q.doc_id, substr(d.text, 1, 4000) as text, case when not is_valid then validation_error end as validation_error,
            not is_valid and coalesce(starts_with(cast(total as varchar), '5'), false) as misread_hint, cast(total as varchar) as prior_total
            from merged_queue q join docs d on d.doc_id = q.doc_id where escalation_reason is not null""",
        "g3_repair_responses": f"""select doc_id, 1::bigint as provider_rank,
              case when doc_id % 7 = 0 then 'no answer today' when doc_id % 6 = 2 then concat(substr(answer, 1, length(answer) - 1), ' }}')
                when doc_id % 6 = 4 and doc_id % 10 = 2 then regexp_extract(answer, '^.*?"type": "vat"}}')
                when doc_id % 6 = 5 then replace(answer, ', "', concat(',', chr(10), ' "')) else answer end as repaired from answers
            union all select doc_id, 2, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then concat(chr(10), replace(answer, '"date"', '"invoice_date"'), chr(10))
              else replace(answer, '"date"', '"invoice_date"') end from answers where doc_id % 5 = 0
            union all select doc_id, 3, replace(replace(answer, '"date"', '"invoice_date"'), 'USD', 'EUR') from answers where doc_id % 4 = 1""",
        "g4_parse_responses": f"select doc_id, provider_rank, {answer} from answer_rows",
        "g5_entities_to_fields": f"select doc_id, {answer} from entity_fields",
        "g6_choose_provider": f"select doc_id, provider_rank, {answer} from chosen",
        "g7_overlay_semantic": f"select doc_id, {wrapped}, corrected from rule_overlaid",
        "h1_merge_levels": flat("merged", vat=True),
        "h2_with_confidence": _wrapped("merged_valid").format(more=""),
        "h3_unwrap": flat("merged_valid", vat=True),
        "h4_confidence_status": "select p.doc_id, p.confidence_status as without_model, f.confidence_status as with_model from plain_done p join finished f on f.doc_id = p.doc_id",
        "h5_extract_documents": f"select doc_id, {wrapped}, is_valid, validation_error, confidence_status from finished",
        "i1_due_for_text": f"select id, status, {_TS['created_at']}, {_TS['next_attempt_at']} from invoices where {_DUE}",
        "i1_next_for_text": f"select id, status, {_TS['created_at']} from (select * from invoices where {_DUE} order by created_at, id limit 25) x",
        "i2_due_for_extraction": f"select id, status, {_TS['created_at']} from invoices where status = 'OCR_DONE' and ocr_text is not null and extracted_fields is null",
        "i3_apply_failures": f"{_STATE} ({failed('(select i.*, f.id is not null as hit, f.error from invoices i left join failures f on f.id = i.id)', 'hit', 'error')}) x",
        "i4_apply_text": f"{_STATE} ({failed(f'({text_done})', '(due and failure is not null)', 'failure')}) x",
        "i5_apply_extraction": f"""{_STATE} (select i.* replace (
              case when r.error is not null then 'EXTRACTION_FAILED' when r.id is not null then 'EXTRACTED' else i.status end as status,
              case when r.id is not null and r.error is null then r.fields else i.extracted_fields end as extracted_fields,
              case when r.id is not null and r.error is null then coalesce(r.confidence_status, 'ERROR') else i.confidence_status end as confidence_status,
              case when r.error is not null then 'Extraction failed: ' || r.error else i.last_error end as last_error,
              case when r.id is not null then {_NOW} else i.updated_at end as updated_at)
            from invoices i left join extraction_results r on r.id = i.id) x""",
        "i6_set_status": f"""{_STATE} (select i.* replace (coalesce(u.status, i.status) as status, case when u.id is not null then coalesce(u.error, '') else i.last_error end as last_error,
              case when u.id is not null then {_NOW} else i.updated_at end as updated_at) from invoices i left join status_updates u on u.id = i.id) x""",
        "j1_invoice_lookup": f"""select i.id as asked_id, case when not regexp_matches({bare_id}, '^[0-9a-fA-F]{{32}}$') then 'invalid' when v.id is null then 'not_found' else 'found' end as lookup,
              v.email_message_id, v.status from lookup_ids i left join invoices v on v.id = i.id""".replace("{{32}}", "{32}"),
        "j2_invoice_out": f"""select id, email_message_id, sender, subject, filename, sha256, storage_path, status, confidence_status, last_error,
              attempt_count::bigint as attempt_count, {_TS['next_attempt_at']}, {_TS['created_at']}, {_TS['updated_at']} from invoices""",
        "j3_client_result": f"""select id, case when {success} then 'success' when status = 'EXTRACTION_FAILED' then 'extraction_failed'
                when status in ('FAILED_RETRYABLE', 'FAILED_FINAL') then 'error' else 'timeout' end as result,
              case when {success} then null when status = 'EXTRACTION_FAILED' then coalesce({message}, 'Field extraction failed')
                when status in ('FAILED_RETRYABLE', 'FAILED_FINAL') then coalesce({message}, 'Processing failed') else {q(fv.ERROR_TIMEOUT)} end as error,
              case when ({success} or status = 'EXTRACTION_FAILED') and coalesce(extracted_fields, '{{}}') <> '{{}}' then extracted_fields else '{{}}' end as extracted_fields,
              case when {success} then confidence_status end as confidence_status from invoices""".replace("{{}}", "{}"),
        "j4_display_fields": " union all ".join(display),
        "j5_scorecard": f"select doc_id, {found} as n_found, 8 + {extras} as n_keys, cast({found} as double) / cast(8 + {extras} as double) as rate, confidence_status, is_valid from plain_done",
        "j6_corpus_report": report,
        "k1_stream_ingest": f"select id, email_message_id, sha256, filename, 'RECEIVED' as status, {_TS['received_at']} from keyed",
        "k2_stream_extract": flat(f"({documents_rules}) c", "is_valid", "validation_error"),
        "k3_latest_status": latest,
        "k3_stream_latest_status": latest,
    }
    q_["l1_text_stage"] = f"""
        select f.doc_id, f.kind, p.text from part_files f left join (
            select doc_id, 'pdf' as kind, string_agg({strip('text')}, chr(10) || chr(10) order by page) as text from (
              select * from (
                select doc_id, page, engine_rank, text from (
                  select doc_id, page::bigint as page, engine_rank, method_rank, text from page_text where engine_rank = 2 or method_rank < 4
                  union all select doc_id, page, 1, 4, text from ({q_['b4_table_to_text']}) b4
                  union all select doc_id, page, 1, 5, text from ({q_['b3_lines_from_glyphs']}) b3) tries
                where not ({blank('text')}) qualify row_number() over (partition by doc_id, engine_rank, page order by method_rank, text) = 1) c
              qualify engine_rank = min(engine_rank) over (partition by doc_id)) e
            group by doc_id
          union all select doc_id, 'image', text from ({q_['b6_segments_to_document']}) b6) p on p.doc_id = f.doc_id and p.kind = f.kind"""
    q_["l2_stored_fields"] = """
        select i.id, 'success' as result, f.confidence_status, f.total, f.currency, f.vendor_name_note as vendor_note, f.tax_type
        from invoices i join finished f on f.doc_id = i.o_orderkey
        where i.status = 'OCR_DONE' and i.ocr_text is not null and i.extracted_fields is null"""
    # a stream touches only rows a result names, so nothing is left claimed without one
    named = text_done.replace("from text_state", "from (select * replace (due and hit as due) from text_state)")
    q_["k4_stream_retry"] = f"{_STATE} ({failed(f'({named})', '(due and failure is not null)', 'failure')}) x"
    for state, same in (("i3_state_failures", "i3_apply_failures"), ("i4_state_text", "i4_apply_text"),
                        ("i5_state_extraction", "i5_apply_extraction"), ("i6_state_status", "i6_set_status")):
        q_[state] = q_[same]
    q_["j1_state_lookup"] = q_["j1_invoice_lookup"]
    q_["j6_incremental_report"] = q_["j6_corpus_report"]
    q_["k2_stream_documents"] = q_["h5_extract_documents"]
    q_["k1_stream_files"] = f"""
        select {_uuid(DuckDialect(), "concat(month, '|', sha256)")} as id, month as email_message_id, sha256,
          case when pdf then 'application/pdf' else {q(fv.DEFAULT_CONTENT_TYPE)} end as content_type, 'RECEIVED' as status, 0::bigint as attempt_count
        from (select month, sha256(string_agg(line, chr(10) order by no) || chr(10)) as sha256, starts_with(min(line), '%PDF') as pdf
              from file_lines group by month) f"""
    # DuckDB 2.0 fails inside when the cells are aggregated straight from the unnested lines
    sqls = {name: with_clause(sql, d, ("docs", "table_rows")) for name, sql in q_.items()}

    # the same levels over documents with the kind and the text that their files gave
    first = ("attachments", "digested", "ingested", "keyed")
    usable = "(a.kind = 'pdf' and doc_id % 11 <> 0 or a.kind = 'image' and doc_id % 13 <> 0)"
    files = {n: d[n] for n in first} | {"arrived": f"select *, substr(email_message_id, 5)::bigint as doc_id, {kind} as kind from keyed"}
    for name, sql in d.items():
        if name == "docs":
            files |= {"rendered": sql, "docs": f"select r.doc_id, a.kind, r.text from rendered r join arrived a using (doc_id) where {usable}"}
        elif name not in first:
            files[name] = sql
    content_type = f"coalesce(nullif(content_type, ''), {q(fv.DEFAULT_CONTENT_TYPE)})"
    end_to_end = f"""
        select id, case when there then 'success' else 'error' end as result, case when not there then {message} end as error,
          case when there then confidence_status end as confidence_status, invoice_number, total, currency, vendor_note, tax_type
        from (select a.id, f.doc_id is not null as there, f.confidence_status, f.invoice_number, f.total, f.currency,
                f.vendor_name_note as vendor_note, f.tax_type,
                case when a.kind is null then 'Unsupported file type: ' || {content_type} || '. Supported: PDF, PNG, JPEG, TIFF' else {q(fv.ERROR_NO_TEXT)} end as last_error
              from arrived a left join finished f on f.doc_id = a.doc_id) x"""
    sqls["l3_end_to_end"] = with_clause(end_to_end, files, ("docs", "table_rows"))
    return sqls


ORACLES = _build()
