"""Fixed values.

Word lists, patterns, labels and message texts that decide results. They are
data, not logic: a user moving to this package must get the same answers, so
they are stated here plainly and in the order in which they are tried.
"""

# --- fixed values: status names ------------------------------------------
RECEIVED = "RECEIVED"
OCR_PENDING = "OCR_PENDING"
OCR_DONE = "OCR_DONE"
EXTRACTED = "EXTRACTED"
EXTRACTION_FAILED = "EXTRACTION_FAILED"
FAILED_RETRYABLE = "FAILED_RETRYABLE"
FAILED_FINAL = "FAILED_FINAL"
INVOICE_STATUSES = [RECEIVED, OCR_PENDING, OCR_DONE, EXTRACTED, EXTRACTION_FAILED, FAILED_RETRYABLE, FAILED_FINAL]

VERIFIED = "VERIFIED"
REVIEW = "REVIEW"
ERROR = "ERROR"
CONFIDENCE_STATUSES = [VERIFIED, REVIEW, ERROR]

# --- fixed values: files ---------------------------------------------------
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp"]
IMAGE_MIME_TYPES = [
    "image/png", "image/jpeg", "image/jpg", "image/tiff", "image/bmp", "image/gif", "image/webp",
]
PDF_MAGIC = "%PDF"
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# --- fixed values: field names and labels ------------------------------------
FIELDS = ["invoice_number", "invoice_date", "vendor_name", "subtotal", "discount", "tax", "total", "currency"]
FIELD_LABELS = {
    "invoice_number": "Invoice Number",
    "invoice_date": "Invoice Date",
    "vendor_name": "Vendor Name",
    "subtotal": "Subtotal",
    "discount": "Discount",
    "tax": "Tax/VAT",
    "total": "Total",
    "currency": "Currency",
}

# --- fixed values: currency ----------------------------------------------------
CURRENCY_CODES = ["USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CNY", "INR"]
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
INVOICE_KEYWORDS = ["invoice", "bill", "payment", "subtotal", "total", "amount", "due", "tax", "vat"]

# --- fixed values: label words that are no invoice number --------------------------
HEADER_WORDS = [
    "AMOUNT", "DESCRIPTION", "QTY", "QUANTITY", "TOTAL", "SUBTOTAL",
    "PRICE", "ITEM", "UNIT", "RATE", "BALANCE", "DUE",
]

# --- fixed values: patterns (group 1 is the value), tried in this order ---------------
NUMBER_PATTERNS = [
    r"invoice\s*(?:no|number|#)\s*:?\s*([A-Z0-9\-]+)",
    r"inv\.?\s*(?:no|number|#)\s*:?\s*([A-Z0-9\-]+)",
    r"invoice\s+([A-Z0-9\-]{3,})",
]
DATE_KEYWORDS = ["date", "issued", "invoice date", "billing date"]
DATE_YEAR_FIRST = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
DATE_YEAR_LAST = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
DATE_CONTEXT_CHARS = 100

VENDOR_PATTERN = r"(?:from|vendor|supplier|bill\s+from)\s*:?\s*([A-Z][A-Za-z\s&.,-]{2,30}?)(?:\n|$)"
VENDOR_TAIL = r"\s+(subtotal|total|date|invoice).*$"
VENDOR_SKIP = [
    r"click\s+to\s+edit",
    r"invoice",
    r"^[|]",
    r"^\s*$",
    r"^\d+",
    r"\d{4}[-/]\d",
    r"(billed\s+to|from|date|invoice|total|subtotal|tax|amount)",
]
HEADER_CHARS = 500
HEADER_LINES = 10
LAYOUT_VENDOR_SKIP = ["invoice", "click to edit", "date", "number"]

SUBTOTAL_TABLE_PATTERNS = [
    r"[|]\s*subtotal\s*[|][^|]*[|]\s*\$?\s*([\d,]+\.?\d*)\s*[|]",
    r"[|]\s*subtotal\s*[|][^|]*[|]\s*5\s+([\d,]+\.?\d*)\s*[|]",
    r"[|]\s*subtotal\s*[|][^|]*[|]\s*S([\d,]+\.?\d*)\s*[|]",
    r"[|]\s*sub\s+total\s*[|][^|]*[|]\s*\$?\s*([\d,]+\.?\d*)\s*[|]",
]
SUBTOTAL_PATTERNS = [
    r"subtotal\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"subtotal\s*:?\s*5\s+([\d,]+\.?\d*)",
    r"sub\s+total\s*:?\s*\$?\s*\$?\s*([\d,]+\.?\d*)",
    r"sub\s+total\s*:?\s*5\s+([\d,]+\.?\d*)",
    r"total\s+before\s+tax\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"total\s+before\s+tax\s*:?\s*5\s+([\d,]+\.?\d*)",
]
TAX_TABLE_PATTERNS = [
    r"[|]\s*tax\s*[|][^|]*[|]\s*\+?\$?\s*([\d,]+\.?\d*)\s*[|]",
    r"[|]\s*tax\s*[|][^|]*[|]\s*\+?5\s+([\d,]+\.?\d*)\s*[|]",
    r"[|]\s*tax\s+amount\s*[|][^|]*[|]\s*\$?\s*([\d,]+\.?\d*)\s*[|]",
]
TAX_PATTERNS = [
    r"tax\s*(?:\([^)]+\))?\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"tax\s*(?:\([^)]+\))?\s*:?\s*5\s+([\d,]+\.?\d*)",
    r"tax\s+amount\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"tax\s+amount\s*:?\s*5\s+([\d,]+\.?\d*)",
    r"sales\s+tax\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"sales\s+tax\s*:?\s*5\s+([\d,]+\.?\d*)",
]
VAT_PATTERNS = [
    r"vat\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"vat\s*:?\s*5\s+([\d,]+\.?\d*)",
    r"vat\s+amount\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"value\s+added\s+tax\s*:?\s*\$?\s*([\d,]+\.?\d*)",
]
DISCOUNT_TABLE_PATTERNS = [
    r"[|]\s*discount\s*[|][^|]*[|]\s*-?\$?\s*([\d,]+\.?\d*)\s*[|]",
    r"[|]\s*discount\s*[|][^|]*[|]\s*-?5\s+([\d,]+\.?\d*)\s*[|]",
]
DISCOUNT_PATTERNS = [
    r"discount\s*:?\s*-?\$?\s*([\d,]+\.?\d*)",
    r"discount\s+amount\s*:?\s*-?\$?\s*([\d,]+\.?\d*)",
    r"discount\s*:?\s*5\s+([\d,]+\.?\d*)",
]
TOTAL_PATTERNS = [
    r"total\s+due\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"total\s+due\s*:?\s*5\s+([\d,]+\.?\d*)",
    r"amount\s+due\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"amount\s+due\s*:?\s*5\s+([\d,]+\.?\d*)",
    r"grand\s+total\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"grand\s+total\s*:?\s*5\s+([\d,]+\.?\d*)",
    r"^total\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"^total\s*:?\s*5\s+([\d,]+\.?\d*)",
    r"\btotal\s*:?\s*\$?\s*([\d,]+\.?\d*)",
    r"\btotal\s*:?\s*5\s+([\d,]+\.?\d*)",
]
CURRENCY_LABEL_PATTERNS = [
    r"currency\s*:?\s*(usd|eur|gbp|cad|aud|jpy|cny|inr)",
    r"(usd|eur|gbp|cad|aud|jpy|cny|inr)\s+currency",
]
MISREAD_FIVE_AMOUNT = r"\b5\s*[\d,]+\.[\d]{2}\b"
DOLLAR_INDICATORS = [r"\b5\s+[\d,]+\.[\d]{2}\b", r"\bS[\d,]+\.[\d]{2}\b", r"\b5\d{3,}\.\d{2}\b"]

# --- fixed values: tolerances, limits ----------------------------------------------------
RECONCILE_TOLERANCE = "0.01"
VALIDATE_TOLERANCE = "0.02"
RULE_CONFIDENCE = 0.9
MODEL_FIX_CONFIDENCE = 0.5
MODEL_CONFIDENCE = 0.7
MIN_EXTRACTION_RATE = 0.5
MODEL_TEXT_CHARS = 4000
MAX_ATTEMPTS = 5
BACKOFF_CAP_MINUTES = 60

# --- fixed values: message texts --------------------------------------------------------------
MISSING_NUMBER = "Invoice number is missing or empty"
MISSING_TOTAL = "Total amount is missing or empty"
MISSING_DATE = "Invoice date is missing or empty"
NOTE_CORRECTION = "Level 3 (Gemini) correction applied: "
NOTE_MISREAD = "Level 3 (Gemini) correction: OCR error fixed (e.g., '5' -> '$')"
NOTE_MODEL = "Level 3 (Gemini) extraction"
ERROR_NO_TEXT = "Text extraction failed - file may be corrupted or unsupported format"
ERROR_IMAGE_BASED = (
    "PDF appears to be image-based (scanned). This app requires text-based PDFs. "
    "Please use a PDF with selectable text."
)
ERROR_TIMEOUT = (
    "Processing timed out. The PDF may be too large or complex. Please try again with a simpler PDF."
)

# --- fixed values: entity types of a document service -> field -----------------------------------
ENTITY_FIELDS = {
    "invoice_id": "invoice_number",
    "invoice_number": "invoice_number",
    "invoice_date": "invoice_date",
    "supplier_name": "vendor_name",
    "vendor_name": "vendor_name",
    "subtotal": "subtotal",
    "tax_amount": "tax",
    "vat_amount": "vat",
    "total_amount": "total",
    "invoice_total": "total",
    "currency": "currency",
}

# --- fixed values: characters that str.strip() and \s treat as white space ------------------------
WHITESPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# the part of it that \s of a Java pattern does not match
WIDE_WHITESPACE = "".join(c for c in WHITESPACE if c not in "\t\n\x0b\x0c\r ")

# --- fixed values: repairs of a model answer, in the order they are made: pattern, replacement ---
ANSWER_REPAIRS = [
    (r',?\s*""\s*:\s*"[^"]*"', ""),
    (r',?\s*""\s*:\s*[^,}\]]+', ""),
    (r',\s*""\s*}', "}"),
    (r'\s*""\s*}', "}"),
    (r',\s*""\s*,', ","),
    (r',\s*""\s*([,}])', "$1"),
    (r",(\s*[}\]])", "$1"),
    (r":\s*'([^']*)'", ': "$1"'),
    (r'"([^"]*)\n([^"]*)"', r'"$1\\n$2"'),
    (r"[\x00-\x1f\x7f-\x9f]", ""),
]
