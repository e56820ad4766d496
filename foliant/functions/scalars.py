"""Column functions: boxes, confidences, labels, messages, hashes, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types by file extension, labels by part of a path, markers by region type.
DOCUMENT_TYPES = {"image": (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp"), "pdf": (".pdf",), "docx": (".doc", ".docx"), "text": (".txt", ".rtf", ".odt", ".html", ".md")}
WORD_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MIME_BY_EXTENSION = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".html": "text/html", ".txt": "text/plain", ".docx": WORD_MIME}
MAGIC = (("25504446", "application/pdf"), ("FFD8FF", "image/jpeg"), ("89504E47", "image/png"), ("504B", WORD_MIME))
MARKERS = {"heading": "## ", "subheading": "### "}
PROGRESS_BANDS = ((0.1, "Analyzing document structure..."), (0.3, "Performing OCR extraction..."), (0.7, "Detecting and extracting tables..."), (0.9, "Post-processing and validation..."))
ENDPOINTS = (("/jobs/", "/jobs/{job_id}"), ("/status/", "/status/{job_id}"), ("/result/", "/result/{job_id}"), ("/review/", "/review/{job_id}"))
ALLOWED_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/tiff", WORD_MIME)
# The answer to each kind of error; texts of their own are told, the others' are details of a general one.
ERRORS = {
    "ProcessingException": (422, None), "StorageException": (500, None), "ValidationException": (400, None), "AuthenticationException": (401, "Authentication failed"), "AuthorizationException": (403, "Access denied"),
    "RateLimitException": (429, "Rate limit exceeded"), "ValidationError": (422, "Request validation failed"), "DatabaseError": (500, "Database operation failed"), "RedisError": (503, "Cache service unavailable"),
    "InternalServerError": (500, "An unexpected error occurred"),
}
HIGH, LOW, REVIEW = 0.9, 0.7, 0.8
MAX_BYTES, MAX_NAME = 50 * 1024 * 1024, 255


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def document_type(path: Column) -> Column:
    out, ext = F, extension(path)
    for kind, endings in DOCUMENT_TYPES.items():
        out = out.when(ext.isin(*endings), kind)
    return out.otherwise("unknown")


def mime_type(path: Column, content: Column | None = None) -> Column:
    """By the extension; else by the first bytes of the content."""
    out, ext = F, extension(path)
    for ending, mime in MIME_BY_EXTENSION.items():
        out = out.when(ext == ending, mime)
    if content is not None:
        start = F.hex(F.substring(content, 1, 4))
        for magic, mime in MAGIC:
            out = out.when(F.startswith(start, F.lit(magic)), mime)
    return out.otherwise("application/octet-stream")


def quality(confidence: Column) -> Column:
    """High above 0.9, Low below 0.7, Medium from one to the other, both included."""
    return F.when(confidence > HIGH, "High").when(confidence >= LOW, "Medium").when(confidence < LOW, "Low")


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def colour(confidence: Column) -> Column:
    """From red to green."""
    return F.struct((1 - clamped(confidence)).alias("r"), clamped(confidence).alias("g"), F.lit(0.0).alias("b"))


def raw_confidence(value: Column) -> Column:
    """An engine's 0 to 100; -1 (no text) counts as 0."""
    return F.greatest(value, F.lit(0)) / 100


def centre(a: Column, b: Column) -> Column:
    return (a + b) / F.lit(2.0)


def polygon(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))


def box_of(points: Column) -> Column:
    """[x1, y1, x2, y2] around a polygon's points."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0), x2 - x1) * F.greatest(F.lit(0), y2 - y1)


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes; 0 if both have no area."""
    shared = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    return F.coalesce(F.try_divide(shared.cast("double"), (area(*a) + area(*b) - shared).cast("double")), F.lit(0.0))


def inside(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def shortened(name: Column, most: int = 30) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most), F.lit("..."))).otherwise(name)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def throughput(amount: Column, seconds: Column) -> Column:
    """0 without time."""
    return F.when(seconds > 0, amount / seconds).otherwise(0.0)


def eta_seconds(status: Column, progress: Column, started: Column, now: Column) -> Column:
    """What is left at the pace so far; null unless a job is under way."""
    elapsed = (F.unix_timestamp(now) - F.unix_timestamp(started)).cast("double")
    return F.when((status == "processing") & (progress > 0), F.greatest(F.lit(0.0), elapsed / progress - elapsed))


def status_message(status: Column, progress: Column, error: Column | None = None) -> Column:
    out = F.when(status == "pending", "Job is queued for processing")
    for below, message in PROGRESS_BANDS:
        out = out.when((status == "processing") & (progress < below), message)
    out = out.when(status == "processing", "Finalizing results...").when(status == "completed", "Processing completed successfully")
    failed = F.lit("Processing failed") if error is None else F.coalesce(F.nullif(error, F.lit("")), F.lit("Processing failed"))
    return out.when(status == "failed", failed).otherwise("Unknown status")


def endpoint_label(path: Column) -> Column:
    """Paths with an identifier share a label; the first that fits names it."""
    out = F
    for part, label in ENDPOINTS:
        out = out.when(F.contains(path, F.lit(part)), label)
    return out.when(F.contains(path, F.lit("/webhooks/")) & (path != "/webhooks/register"), "/webhooks/{webhook_id}").otherwise(path)


def render_type(mime: Column, has_text: Column) -> Column:
    """struct<render_type, confidence>, where no classifier is at hand."""
    kind = F.when((mime == "application/pdf") & has_text, "digital_pdf").when(mime == "application/pdf", "scanned_image").when(F.startswith(mime, F.lit("image/")), "photograph")
    kind = kind.when(F.contains(mime, F.lit("word")), "docx").otherwise("scanned_image")
    return F.struct(kind.alias("render_type"), F.lit(0.5).alias("confidence"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def shard_path(digest: Column) -> Column:
    """ab/cd/abcd..."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def mode(name: Column) -> Column:
    known = F.upper(F.trim(name))
    return F.when(known.isin("BASIC", "STANDARD", "ADVANCED"), known).otherwise("STANDARD")


def mode_settings(name: Column, max_pages: Column, tables: Column) -> Column:
    """What a mode turns on: basic is fast, of three pages unless told otherwise, and without tables; advanced has tables."""
    known = mode(name)
    return F.struct(
        (known == "BASIC").alias("fast"), F.when(known == "BASIC", F.coalesce(max_pages, F.lit(3))).otherwise(max_pages).alias("max_pages"),
        F.when(known == "BASIC", F.lit(False)).when(known == "ADVANCED", F.coalesce(tables, F.lit(True))).otherwise(F.coalesce(tables, F.lit(False))).alias("extract_tables"),
    )


def mode_flags(name: Column, fast: Column, max_pages: Column, tables: Column, classify: Column, forms: Column, layout: Column) -> Column:
    """What a mode makes of the parameters asked for, null for those not given: basic overrides all; advanced has tables unless told
    otherwise and none of the rest; any other takes them as they are, off by default."""
    known, off = mode(name), lambda c: F.coalesce(c, F.lit(False))
    basic, plain = known == "BASIC", known == "STANDARD"
    return F.struct(
        known.alias("mode"), (basic | off(fast)).alias("fast"), F.when(basic, F.coalesce(max_pages, F.lit(3))).otherwise(max_pages).alias("max_pages"),
        F.when(basic, F.lit(False)).when(plain, off(tables)).otherwise(F.coalesce(tables, F.lit(True))).alias("extract_tables"),
        *((plain & off(c)).alias(n) for c, n in ((classify, "classify_document"), (forms, "extract_forms"), (layout, "analyze_layout"))),
    )


def error_response(kind: Column, message: Column, request_id: Column) -> Column:
    """struct<status_code, body>: the JSON that an error is answered with. Unknown kinds are an internal error; general texts keep the message as a detail."""
    known = F.when(kind.isin(*ERRORS), kind).otherwise("InternalServerError")
    status, text, detail = F, F, F
    for name, (code, told) in ERRORS.items():
        status = status.when(known == name, code)
        own = name.endswith("Exception")
        text = text.when(known == name, F.coalesce(message, F.lit(told)) if own else F.lit(told))
        detail = detail.when(known == name, F.lit(None).cast("string") if own else message)
    error = F.struct(known.alias("type"), text.alias("message"), F.when(detail.isNotNull(), F.struct(detail.alias("error"))).alias("details"))
    return F.struct(status.alias("status_code"), F.to_json(F.struct(error.alias("error"), request_id.alias("request_id"))).alias("body"))


def rejection(name: Column, size: Column, mime: Column, allowed: Sequence[str] = ALLOWED_TYPES) -> Column:
    """Why an upload is refused; null if it isn't."""
    return (
        F.when(size > MAX_BYTES, "too large").when(~mime.isin(*allowed) | mime.isNull(), "type not allowed").when(name.isNull() | (F.trim(name) == ""), "no name").when(F.length(name) > MAX_NAME, "name too long")
        .when(F.contains(name, F.lit("..")) | name.rlike(r'[/\\<>:"|?*]'), "name not allowed")
    )


def marked(text: Column, region_type: Column) -> Column:
    """The lines of a text export: headings are marked, each line of a list is."""
    out = F
    for kind, marker in MARKERS.items():
        out = out.when(region_type == kind, F.concat(F.lit(marker), text))
    listed = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("* "), F.trim(x))), "\n")
    return out.when(region_type == "list", listed).otherwise(text)


# Text clean-up: extensions with semantics of our own.


def normalized(text: Column) -> Column:
    """Hyphens at line ends joined, white space made one space, curly quotes and dashes made plain."""
    joined = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    return F.trim(F.regexp_replace(F.translate(joined, "‘’“”–—", "''\"\"--"), r"\s+", " "))


def masked(text: Column) -> Column:
    """Mail addresses, card numbers and long telephone numbers are replaced by their kind."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[card]")
    return F.regexp_replace(out, r"\+[0-9][0-9 -]{7,14}[0-9]", "[phone]")


def valid_date(value: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(value, F.lit(pattern)).isNotNull()


def valid_amount(value: Column) -> Column:
    return F.regexp_replace(value, r"[$€£, ]", "").try_cast("decimal(18,2)").isNotNull()
