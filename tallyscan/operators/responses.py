"""Model answers as data: who needs one, what is asked, what came back.

No service is called. Requests leave as a table, raw answers come in as a table.
Everything is an expression over that table, so an answer is repaired, parsed and
merged where its partition lies.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscan import fixed_values as fv
from tallyscan.functions import computed, let, strip
from tallyscan.operators.merge import PLAIN_FIELDS, WRAPPED_FIELDS, plain_value, wrap

ANSWER_FIELDS = [*fv.FIELDS, "vat"]
ANSWER_COLUMNS = [
    "invoice_number", "invoice_date", "vendor_name", "subtotal", "discount", "tax_amount", "tax_type",
    "total", "currency", "vat",
]
PRIMARY_RANK = 1
ENTITY_RANK = 4
_COMPLETE_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def escalation_queue(
    extracted: DataFrame, use_fallback: bool = True, min_rate: float = fv.MIN_EXTRACTION_RATE
) -> DataFrame:
    """Adds ``escalation_reason``, null for documents that need no model.

    The share counts what was found over the keys of the record: eight, one more
    for a layout VAT, two more for an inconsistent reconciliation.
    """
    present = lambda c: F.col(c).isNotNull().cast("int")
    extra = present("vat") + present("reconciliation_status") + present("reconciliation_error")
    names = ["tax_amount" if f == "tax" else f for f in fv.FIELDS]
    found = sum((present(n) for n in names[1:]), present(names[0])) + extra
    rate = found / (F.lit(len(fv.FIELDS)) + extra)
    reason = F.when(~F.col("is_valid"), "validation_failed")
    if use_fallback:
        reason = reason.when(F.col("currency").isNull() | F.col("total").isNull(), "critical_missing")
        reason = reason.when(rate < min_rate, "low_rate")
    return computed(extracted, extracted.columns, reason.alias("escalation_reason"))


def prior_fields() -> Column:
    """What lower levels found, as JSON text."""
    return F.to_json(F.struct(*[plain_value(f).alias(f) for f in WRAPPED_FIELDS]))


def build_requests(queue: DataFrame, docs: DataFrame, text_chars: int | None = fv.MODEL_TEXT_CHARS) -> DataFrame:
    """(doc_id, text, text_cut, prior_fields, validation_error, misread_hint) per escalated document.

    Only escalated ids meet the texts, and a text is cut to ``text_chars`` before it
    travels (None: whole); ``text_cut`` tells that something is missing.
    """
    asked = queue.where(F.col("escalation_reason").isNotNull()).select(
        "doc_id",
        prior_fields().alias("prior_fields"),
        F.when(~F.col("is_valid"), F.col("validation_error")).alias("validation_error"),
        (~F.col("is_valid") & F.coalesce(F.col("total").cast("string").startswith("5"), F.lit(False))).alias(
            "misread_hint"
        ),
    )
    if text_chars is None:
        sent = docs.select("doc_id", "text", F.lit(False).alias("text_cut"))
    else:
        too_long = (F.length("text") > text_chars).alias("text_cut")
        sent = docs.select("doc_id", F.substring("text", 1, text_chars).alias("text"), too_long)
    return asked.join(sent, "doc_id")


def _real_breaks(raw: Column) -> Column:
    """Literal \\n, \\r, \\t become real ones, except inside complete strings. A text without a backslash stays as it is."""
    parts = F.regexp_extract_all(raw, F.lit(rf'(?d)({_COMPLETE_STRING}|[^"]++|")'), F.lit(1))

    def outside(part: Column) -> Column:
        for literal, real in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
            part = F.replace(part, F.lit(literal), F.lit(real))
        return part

    real = F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(outside(p))), "")
    return F.when(raw.contains("\\"), real).otherwise(raw)


def _without_fence(text: Column) -> Column:
    """Content of the first code fence; marks dropped when the fence is never closed."""
    parts = F.split(text, "```")
    inner = F.get(parts, F.lit(1))
    closed = F.when(inner.startswith("json"), strip(F.substr(inner, F.lit(5)))).otherwise(inner)
    unclosed = strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    return F.when(~text.startswith("```"), text).when(F.size(parts) >= 3, closed).otherwise(unclosed)


def _outer_object(text: Column) -> Column:
    """From the first opening to the last closing brace; closed when there is none behind it."""
    first = F.locate("{", text)
    last = F.length(text) - F.locate("}", F.reverse(text)) + 1
    whole = F.substring(text, first, last - first + 1)
    rest = F.regexp_replace(strip(F.substr(text, first)), r",\s*$", "")
    has_last = text.contains("}") & (last > first)
    return F.when(first == 0, text).when(has_last, whole).otherwise(F.concat(F.rtrim(rest, F.lit(fv.WHITESPACE)), F.lit("\n}")))


def _common_slips(text: Column) -> Column:
    """Empty keys, trailing commas, single quotes, broken lines, control characters.

    A repair that needs a mark is tried only on a text that has it.
    """

    def repaired(text: Column, repairs: list[tuple[str, str]]) -> Column:
        for pattern, repl in repairs:
            text = F.regexp_replace(text, pattern, repl)
        return text

    for mark, group in groupby(fv.ANSWER_REPAIRS, lambda r: _mark(r[0])):
        repairs = list(group)
        if mark:
            text = let(text, lambda t: F.when(t.contains(mark), repaired(t, repairs)).otherwise(t))  # noqa: B023
        else:
            text = repaired(text, repairs)
    return text


def _mark(pattern: str) -> str:
    """What every match of a repair's pattern holds, empty if no one thing."""
    return next((mark for mark, form in (('""', '""'), ("'", "'"), ("\n", r"\n")) if form in pattern), "")


def _even_quotes(text: Column) -> Column:
    """An odd number of quotes after a colon: the last quote is doubled."""
    odd = F.length(F.regexp_replace(text, '[^"]', "")) % 2 == 1
    from_end = F.locate('"', F.reverse(text))
    at = F.length(text) - from_end + 1
    head = F.substring(text, F.lit(1), at)
    fits = odd & (at > 1) & F.substring(text, F.lit(1), at - 1).contains(":")
    return F.when(fits, F.concat(head, F.lit('"'), F.substr(text, at + 1))).otherwise(text)


def repair_responses(model_responses: DataFrame) -> DataFrame:
    """Adds ``repaired``: the primary model's answer made parseable where the rules can.

    Answers of other providers only lose a code fence. The last step runs the first
    again; it changes nothing in a text that parses already.
    """
    raw = strip(F.col("raw_response"))
    text = raw
    for step in (_real_breaks, _without_fence, _outer_object, _common_slips, _even_quotes, _real_breaks):
        text = let(text, step)
    inner = F.get(F.split(raw, "```"), F.lit(1))
    unfenced = (
        F.when(~raw.startswith("```"), raw)
        .when(inner.startswith("json"), F.substr(inner, F.lit(5)))
        .otherwise(inner)
    )
    primary = F.col("provider_rank") == PRIMARY_RANK
    return computed(model_responses, model_responses.columns, F.when(primary, text).otherwise(unfenced).alias("repaired"))


def _amount_or_text(value: Column, negative: bool = False) -> Column:
    """A plain number in canonical form, negated when positive; other text unchanged."""
    text = strip(value)
    number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    bare = F.regexp_replace(F.regexp_replace(text, r"^[+-]", ""), r"\.$", "")
    canonical = F.regexp_replace(F.regexp_replace(bare, r"^0+(?=\d)", ""), r"^\.", "0.")
    zero = canonical.rlike(r"^[0.]*$")
    minus = text.startswith("-") | (F.lit(negative) & ~zero)
    return F.when(~number, value).when(minus, F.concat(F.lit("-"), canonical)).otherwise(canonical)


def parse_responses(repaired: DataFrame, unusable: bool = False) -> DataFrame:
    """(doc_id, provider_rank, is_empty, answer columns as text), one row per parseable answer.

    With ``unusable`` all others come too, without values and with a null ``is_empty``.

    The primary model says "date" for the invoice date, gives tax as a bare amount
    (taken as sales tax) and discounts of either sign. The text must be exactly one
    JSON object. An answer that names none of the known fields counts as empty. What
    other providers than the primary one say beyond the known fields is ``extra``, values as they were sent.
    """
    keys = [*fv.FIELDS, "date", "vat"]
    schema = "array<struct<" + ",".join(f"{k}:string" for k in keys) + ">>"
    strict = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    one = F.concat(F.lit("["), F.col("repaired"), F.lit("]"))
    whole = let(F.from_json(one, schema, strict), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))
    parsed = computed(
        repaired, ["doc_id", "provider_rank", "repaired"],
        whole.alias("_answer"), F.json_object_keys("repaired").alias("_keys"),
    )
    usable = F.col("_answer").isNotNull() & F.col("_keys").isNotNull()
    if unusable:
        parsed = parsed.withColumns({c: F.when(usable, F.col(c)) for c in ("_answer", "repaired")})
    else:
        parsed = parsed.where(usable)
    a = lambda k: F.col("_answer")[k]
    primary = F.col("provider_rank") == PRIMARY_RANK
    tax = a("tax")
    tax_parts = F.from_json(F.when(tax.startswith("{"), tax), "amount string, type string")
    falsy_tax = (tax == "") | F.col("repaired").rlike(r'"tax"\s*:\s*(?:-?0+(?:\.0*)?|false)\s*[,}]')
    every = F.from_json("repaired", "map<string,variant>", strict)
    other = F.map_filter(every, lambda k, v: ~k.isin(*fv.FIELDS, "vat") & v.isNotNull() & ~F.is_variant_null(v))
    known = F.when(primary, F.array(*[F.lit(k) for k in [*[f for f in fv.FIELDS if f != "invoice_date"], "date"]]))
    return parsed.select(
        "doc_id", "provider_rank",
        F.when(usable, F.when(primary, ~F.arrays_overlap(F.col("_keys"), known)).otherwise(F.size("_keys") == 0)).alias("is_empty"),
        a("invoice_number").alias("invoice_number"),
        F.when(primary, a("date")).otherwise(a("invoice_date")).alias("invoice_date"),
        a("vendor_name").alias("vendor_name"),
        a("subtotal").alias("subtotal"),
        F.when(primary & (a("discount") != ""), _amount_or_text(a("discount"), negative=True))
        .otherwise(a("discount")).alias("discount"),
        F.when(tax.startswith("{"), tax_parts["amount"]).otherwise(tax).alias("tax_amount"),
        F.when(tax.startswith("{"), tax_parts["type"])
        .when(primary & tax.isNotNull() & ~falsy_tax, "sales_tax").alias("tax_type"),
        a("total").alias("total"),
        a("currency").alias("currency"),
        F.when(~primary, a("vat")).alias("vat"),
        F.when(~primary & (F.size(other) > 0), other).alias("extra"),
    )


def entities_to_fields(entities: DataFrame) -> DataFrame:
    """Typed entities of a document service to one answer row; the last of a type name wins."""
    field = F.coalesce(*[F.when(F.col("type") == t, f) for t, f in fv.ENTITY_FIELDS.items()])
    named = entities.select("doc_id", "entity_idx", field.alias("field"), "content")

    def last(name: str) -> Column:
        mine = F.col("field") == name
        # the content goes in a struct: a null content still replaces an earlier one
        return F.max_by(F.struct("content"), F.when(mine, F.struct("entity_idx", "content")))["content"]

    wanted = {c: ("tax" if c == "tax_amount" else c) for c in ANSWER_COLUMNS if c not in ("discount", "tax_type")}
    found = named.groupBy("doc_id").agg(*[last(f).alias(c) for c, f in wanted.items()])
    null = F.lit(None).cast("string")
    full = found.withColumns({"discount": null, "tax_type": null, "extra": F.lit(None).cast("map<string,variant>")})
    return full.select("doc_id", F.lit(ENTITY_RANK).alias("provider_rank"), F.lit(False).alias("is_empty"), *ANSWER_COLUMNS, "extra")


def choose_provider(parsed: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One answer per document, out of ``parse_responses(..., unusable=True)``.

    The primary model counts when its answer is not empty. Otherwise the next
    provider that was asked decides, even if its answer cannot be used; a row
    (or an entity) means it was asked. The answers are read once.
    """
    answers = parsed if entities is None else parsed.unionByName(entities_to_fields(entities))
    candidate = answers.where((F.col("provider_rank") != PRIMARY_RANK) | ~F.col("is_empty")).select(
        "doc_id", "provider_rank", F.when(F.col("is_empty").isNotNull(), F.struct(*ANSWER_COLUMNS, "extra")).alias("answer")
    )
    # an answer comes before the bare "asked" row of the same provider, the least by its text before others
    ranked = candidate.groupBy("doc_id").agg(
        F.min_by(
            F.struct("provider_rank", "answer"),
            F.struct("provider_rank", F.col("answer").isNull(), F.to_json("answer")),
        ).alias("best")
    )
    return ranked.where(F.col("best.answer").isNotNull()).select("doc_id", "best.provider_rank", "best.answer.*")


def overlay_semantic(queue: DataFrame, chosen: DataFrame) -> DataFrame:
    """Wrapped ``fields`` with model values over lower ones, for escalated documents only.

    ``fields.extra`` holds what a model said beyond the known fields. Adds ``corrected``: a model value was applied to an invalid document. The record
    is not validated again.
    """
    keep = [c for c in queue.columns if c not in PLAIN_FIELDS]
    q, m = queue.alias("q"), chosen.withColumn("_answered", F.lit(True)).alias("m")
    needed = F.col("q.escalation_reason").isNotNull()
    joined = q.join(m, (F.col("q.doc_id") == F.col("m.doc_id")) & needed, "left")
    level = joined.select(
        *[F.col(f"q.{c}") for c in keep],
        *[F.col(f"q.{c}") for c in PLAIN_FIELDS],
        *[F.col(f"m.{c}").alias(f"m_{c}") for c in [*ANSWER_COLUMNS, "extra"]],
    )
    valid = F.col("is_valid")

    def note(field: str) -> Column:
        if field in ("total", "subtotal", "currency"):
            fixed = F.lit(fv.NOTE_MISREAD)
        else:
            fixed = F.concat(F.lit(fv.NOTE_CORRECTION), F.col("validation_error"))
        return F.when(valid, fv.NOTE_MODEL).otherwise(fixed)

    confidence = F.when(valid, fv.MODEL_CONFIDENCE).otherwise(fv.MODEL_FIX_CONFIDENCE)

    def overlaid(field: str) -> Column:
        lower = wrap(plain_value(field))
        if field == "tax":
            answer = F.when(
                F.col("m_tax_amount").isNotNull() | F.col("m_tax_type").isNotNull(),
                F.struct(
                    F.col("m_tax_amount").alias("amount"), F.col("m_tax_type").alias("type"),
                    F.lit(None).cast("boolean").alias("inferred"),
                ),
            )
        elif field in ANSWER_FIELDS:
            answer = F.col(f"m_{field}")
        else:
            return lower.alias(field)
        return F.coalesce(wrap(answer, confidence, note(field)), lower).alias(field)

    extra = F.transform_values("m_extra", lambda k, v: wrap(v, confidence, note("extra")))
    any_value = F.coalesce(*[F.col(f"m_{c}") for c in ANSWER_COLUMNS]).isNotNull() | F.col("m_extra").isNotNull()
    return level.select(
        *keep,
        F.struct(*[overlaid(f) for f in WRAPPED_FIELDS], extra.alias("extra")).alias("fields"),
        (~valid & any_value).alias("corrected"),
    )
