"""Request options: parsing, prompts, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
FORMATS = ("text", "json", "markdown", "table", "key_value", "structured")
REGION_PROMPTS = {
    "text": "Text Recognition:",
    "table": "Table Recognition:",
    "formula": "Formula Recognition:",
    "title": "Text Recognition:",
    "figure": "Text Recognition:",
    "caption": "Text Recognition:",
    "header": "Text Recognition:",
    "footer": "Text Recognition:",
}
REGION_TYPES = {
    "text": "text",
    "title": "title",
    "table": "table",
    "figure": "figure",
    "formula": "formula",
    "list": "list_item",
    "header": "header",
    "footer": "footer",
    "caption": "caption",
    "reference": "reference",
    "abstract": "abstract",
    "code": "code",
    "seal": "seal",
    "handwriting": "handwriting",
    "paragraph": "text",
    "heading": "title",
    "table_caption": "caption",
    "figure_caption": "caption",
    "footnote": "text",
    "page_number": "text",
}
LABEL_TASKS = {"table": "table", "formula": "formula"}
TASK_PROMPTS = {
    "text": "Text Recognition:",
    "table": "Table Recognition:",
    "formula": "Formula Recognition:",
    "markdown": "Text Recognition: Convert this document region to well-structured Markdown. Use proper heading levels (#, ##, ###), bold for field labels, pipe-syntax tables, and bullet lists where appropriate.",
    "key_value": "Text Recognition: Extract all key-value pairs from this document region. Return a flat JSON object with label names as keys.",
    "structured": "Text Recognition: Perform comprehensive extraction on this document region. Return JSON with keys: document_type, raw_text, fields, tables, handwritten_sections.",
    "json": "Text Recognition: Extract all information from this document region as structured JSON. Include document_type, fields as key-value pairs, line_items as arrays, and any tables. Return valid JSON only.",
}


def _trim(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def valid_formats(formats: Column, custom_prompt: Column) -> Column:
    """Whether each of a comma list is known; a custom prompt needs none."""
    known = F.forall(F.transform(F.split(formats, ","), _trim), lambda f: f.isin(*FORMATS))
    return F.coalesce(custom_prompt != "", F.lit(False)) | known


def parse_bool(x: Column) -> Column:
    return F.coalesce(F.lower(x) == "true", F.lit(False))


def bounded_int(x: Column, default: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(whole_number(x), F.lit(default))))


def whole_number(x: Column) -> Column:
    """Digits with an optional sign, trimmed; else null."""
    t = _trim(x)
    return F.when(t.rlike(r"^[+-]?[0-9]{1,9}$"), t).try_cast("int")


def number(x: Column) -> Column:
    return _trim(x).try_cast("double")


def field_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), _trim), lambda f: f != "")


#: The sentence that asks for named fields.
FIELDS_PROMPT = ("Text Recognition: Extract only the following fields from this document: ", ". Return a flat JSON object where each key is one of the requested field names.")


def prompt(custom: Column, fields: Column, formats: Column) -> Column:
    """A custom prompt first, then a list of fields, then the first format's."""
    first = F.lower(_trim(F.element_at(F.split(formats, ","), 1)))
    named = F.concat(F.lit(FIELDS_PROMPT[0]), F.array_join(fields, ", "), F.lit(FIELDS_PROMPT[1]))
    return F.when(F.coalesce(custom, F.lit("")) != "", custom).when(F.size(F.coalesce(fields, F.array().cast("array<string>"))) > 0, named).when(first == "table", REGION_PROMPTS["table"]).when(first == "formula", REGION_PROMPTS["formula"]).otherwise(REGION_PROMPTS["text"])


def region_prompt(region_type: Column, custom: Column | None = None) -> Column:
    own = F.coalesce(_lookup(REGION_PROMPTS, F.lower(region_type)), F.lit(REGION_PROMPTS["text"]))
    return own if custom is None else F.coalesce(F.nullif(custom, F.lit("")), own)


def region_type(raw: Column) -> Column:
    """Known names first, then the first known name that the raw one contains, else text."""
    low = F.lower(raw)
    out = _lookup(REGION_TYPES, low)
    part = F.when(low.contains("text"), "text")
    for key, value in list(REGION_TYPES.items())[1:]:
        part = part.when(low.contains(key), value)
    return F.coalesce(out, part, F.lit("text"))


def label_task(label: Column) -> Column:
    return F.coalesce(_lookup(LABEL_TASKS, label), F.lit("text"))


def task_prompt(task: Column) -> Column:
    return F.coalesce(_lookup(TASK_PROMPTS, task), F.lit(TASK_PROMPTS["text"]))


def line_label(line: Column) -> Column:
    t = _trim(line)
    formula = t.contains("$$") | t.contains("\\frac") | t.contains("\\int")
    return F.when(t.startswith("#"), "title").when(t.startswith("|") & t.endswith("|"), "table").when(formula, "formula").otherwise("text")


def token_budget(wanted: Column, default: int = 2048, most: int = 8192, low_vram: bool = False, fast: bool = False) -> Column:
    """Tokens for a region: the wish or the default, under the caps in force."""
    caps = [most, *([2048] if low_vram else []), *([512] if fast else [])]
    return F.least(F.coalesce(wanted, F.lit(default)), *(F.lit(c) for c in caps)) if len(caps) else wanted


def page_token_budget(wanted: Column) -> Column:
    return F.greatest(F.lit(64), F.least(F.lit(8192), wanted))


def repetition_penalty(precision: Column) -> Column:
    return F.when(precision.isin("high", "precision"), 1.15).otherwise(1.05)


def request_error(image_ref: Column, prompt_text: Column, max_tokens: Column) -> Column:
    """The first reason to refuse a request, or null."""
    return (
        F.when(image_ref.isNull() | (image_ref == ""), "image_ref is required")
        .when(F.char_length(image_ref) > 4096, "image_ref is too long")
        .when(F.char_length(prompt_text) > 2048, "prompt is too long")
        .when(max_tokens.isNotNull() & ~max_tokens.between(64, 8192), "max_tokens is out of range")
    )


#: Options that are truth values.
SWITCHES = ("include_coordinates", "include_word_confidence", "include_page_layout")
_INT = r"^[ \t\n\x0b\f\r]*[+-]?[0-9]{1,18}[ \t\n\x0b\f\r]*$"


def _kind(v: Column) -> Column:
    """The kind of a variant: VOID for a JSON null, null for nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _shown(v: Column) -> Column:
    """A list's item as text, truth values and nulls written with a capital."""
    kind = _kind(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(v.isNull() | (kind == "VOID"), "None").when(kind == "BOOLEAN", F.initcap(F.to_json(v))).otherwise(F.to_json(v))


def _listed(v: Column) -> Column:
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), _shown)
    return F.filter(items, lambda x: x.rlike(r"\S"))


def checked_options(image_ref: Column, prompt_text: Column, options: Column) -> Column:
    """(reason, output_format, max_tokens, extract_fields) of a request, options being the text of a JSON object.

    reason is the first ground for refusing it, or null.  Each option is read by its own type: switches have to be
    truth values; a format may be of any case; a number may be written as text, and decimals are cut off;
    fields may be a list, an object (its names), the text of a JSON list, or names with commas between.  An image is a
    data address or a rooted path: whether a relative one exists is not for an expression to say, so it is refused.
    """
    v = F.try_parse_json(options)
    at = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    # an option that is null is there: an object's entry, which getting a path does not tell from none
    given = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))
    there = lambda name: F.array_contains(given, name)
    kind = lambda name: F.coalesce(_kind(at(name)), F.lit("VOID"))
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))

    fmt = F.lower(F.coalesce(text("output_format"), F.to_json(at("output_format")), F.lit("none")))
    number = (
        F.when(kind("max_tokens").isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, "$.max_tokens", "double").try_cast("long"))
        .when(kind("max_tokens") == "BOOLEAN", F.lit(0).cast("long"))
        .when(text("max_tokens").rlike(_INT), F.trim(F.translate(text("max_tokens"), "\t\n\x0b\f\r", "     ")).try_cast("long"))
    )
    said = F.regexp_replace(text("extract_fields"), r"^\s+|\s+$", "")
    inner = F.try_parse_json(said)
    commas = F.filter(F.transform(F.split(said, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    which = kind("extract_fields")
    names = F.filter(F.map_keys(F.try_variant_get(v, "$.extract_fields", "map<string,variant>")), lambda x: x.rlike(r"\S"))
    fields = (
        F.when(~there("extract_fields"), None)
        .when(which == "VOID", F.array().cast("array<string>"))
        .when(which == "ARRAY", _listed(at("extract_fields")))
        .when(which == "OBJECT", names)
        .when(which == "STRING", F.when(F.coalesce(_kind(inner) == "ARRAY", F.lit(False)), _listed(inner)).otherwise(commas))
    )
    reason = F.when(F.coalesce(image_ref, F.lit("")) == "", "image_ref is required").when(F.char_length(image_ref) > 4096, "image_ref is too long")
    reason = reason.when(~(image_ref.startswith("data:") | image_ref.startswith("/")), "image_ref must be a path or a data address").when(F.char_length(prompt_text) > 2048, "prompt is too long")
    for name in SWITCHES:
        reason = reason.when(there(name) & (kind(name) != "BOOLEAN"), f"{name} must be a boolean")
    reason = reason.when(there("output_format") & ~fmt.isin(*FORMATS), "output_format is unknown")
    reason = reason.when(there("max_tokens") & ~F.coalesce(number.between(64, 8192), F.lit(False)), "max_tokens must be an integer between 64 and 8192")
    reason = reason.when(there("extract_fields") & fields.isNull(), "extract_fields must be a list")
    return F.struct(reason.alias("reason"), F.when(there("output_format"), fmt).alias("output_format"), number.alias("max_tokens"), fields.alias("extract_fields"))


def clean_prompt(x: Column) -> Column:
    """Without control characters other than tab, LF and CR."""
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def field_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[ -]", "_")


def field_match(key: Column, field: Column) -> Column:
    """Either name contains the other, apart from case, blanks and hyphens."""
    k, f = field_key(key), field_key(field)
    return (F.instr(k, f) > 0) | (F.instr(f, k) > 0)


def size_allowed(size: Column, limit: int = 10 << 20) -> Column:
    return size <= limit


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576.0, 2)


def storage_path(path: Column, root: str) -> Column:
    """Rooted paths stay, paths that start with the root's own name are rooted, others go below it."""
    bare = root.lstrip("/")
    return F.when(path.startswith("/"), path).when(path.startswith(bare), F.concat(F.lit("/"), path)).otherwise(F.concat(F.lit(root + "/"), path))


def backoff_seconds(attempt: Column, cap: float | None = None) -> Column:
    wait = F.pow(F.lit(2.0), attempt - 1)
    return wait if cap is None else F.least(wait, F.lit(cap))


def image_score(low_res: Column, noise: Column, contrast: Column, skew: Column, shadow: Column) -> Column:
    off = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = F.lit(1.0) - off(low_res, 0.2) - F.least(noise / 100, F.lit(0.3)) - off(contrast < 30, 0.2) - off(F.abs(skew) > 1.0, 0.1) - off(shadow, 0.1)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def image_too_large(w: Column, h: Column, channels: Column, limit_mb: int) -> Column:
    return w.cast("long") * h * channels > limit_mb * 1048576


def bounded_edge(edge: Column, longest: Column, most: int) -> Column:
    """An edge after the longest is brought down to `most`; smaller images stay."""
    return F.when(longest <= most, edge).otherwise(F.greatest(F.lit(1), F.floor(edge * (F.lit(float(most)) / longest)))).cast("int")


def percent_used(used: Column, total: Column) -> Column:
    return F.round(used / total * 100, 2)
