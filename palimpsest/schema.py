"""Fixed values and row types: what the tables hold, and the vocabularies of plans."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: must be exactly these for results to agree -----------------

#: Characters that match as another one; one character for one, so offsets survive.
FOLD_QUOTES = {c: "'" for c in "‘’‚‛′´ʼ"} | {c: '"' for c in "“”„‟″"}
FOLD_DASHES = {c: "-" for c in "‐‑‒–—―−⁃"}
FOLD_SPACES = {c: " " for c in "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u200b\ufeff\t"}
FOLD = FOLD_QUOTES | FOLD_DASHES | FOLD_SPACES

CLAUSE_PATTERN = "^[ \t]*(\\d+(?:\\.\\d+)+)\\.?(?=[ \t\u00a0])"
SECTION_PATTERN = "^[ \t]*(\\d+)\\.(?=[ \t\u00a0])"
REFERENCE_WORDS = ("section", "sections", "article", "articles", "clause", "clauses", "paragraph", "paragraphs", "subsection", "subsections")
REFERENCE_NUMBER = "[ \t\u00a0]*(\\d+(?:\\.\\d+)*)"
REFERENCE_JOINER = "[ \t\u00a0]*(?:,|;|and|or|through|to|-|–|—|&)"
TOKEN_PATTERN = r"\w+|\s+|[^\w\s]"

CHARS_PER_TOKEN, SEGMENT_TOKENS, INDEX_TOKENS = 4, 25_000, 12_000
MIN_HEADINGS, MIN_NUMBERED_SHARE, MIN_SECTIONS = 8, 0.25, 3
TITLE_CHARS, TITLE_FALLBACK, OUTLINE_CHARS, RENDER_CHARS = 80, 60, 240, 400
AMBIGUITY_CHARS, SIMILARITY_FLOOR, DIFF_GAP = 25, 0.45, 3

#: Searched in lower-cased text, case-sensitively.
RISKS = {
    "liability": "liabilit|limitation of liability|consequential",
    "indemnity": "indemnif|indemnit|hold harmless",
    "termination": "terminat|expir",
    "renewal": "renew|auto-renew",
    "warranty": "warrant|disclaim",
    "confidentiality": "confidential|non-disclosure",
    "data": "personal data|privacy|data protection|breach|GDPR",
    "governing-law": "governing law|jurisdiction|venue|arbitrat",
    "assignment": "assign|change of control",
    "audit": "audit|inspect",
    "insurance": "insur",
    "ip": "intellectual property|copyright|patent|trademark",
    "payment": "fees|payment|invoic|price|charge",
}

SEVERITIES = ("low", "medium", "high", "critical")
REJECTIONS = ("empty_target", "paragraph_not_found", "target_already_struck", "target_not_found", "target_ambiguous", "span_conflict")
#: Action types: required fields, optional fields, phase.
ACTIONS = {
    "replace_text": (("find", "replace"), ("clause", "all", "regex"), "content"),
    "insert_text": (("text",), ("clause", "anchor", "position"), "content"),
    "delete_text": (("find",), ("clause", "all", "regex"), "content"),
    "rewrite_clause": (("clause", "text"), (), "content"),
    "insert_clause": (("text",), ("title", "after_clause", "before_clause", "into_section"), "structural"),
    "delete_clause": (("clause",), (), "structural"),
    "move_clause": (("clause",), ("after_clause", "before_clause", "into_section", "position"), "structural"),
    "reorder_clauses": (("section", "order"), (), "structural"),
    "insert_section": (("title",), ("after_section", "text"), "structural"),
    "delete_section": (("section",), (), "structural"),
    "move_section": (("section",), ("after_section", "before_section", "position"), "structural"),
    "insert_row": (("table", "values"), ("row",), "content"),
    "delete_row": (("table", "row"), (), "content"),
    "update_cell": (("table", "row", "col", "text"), (), "content"),
    "format_text": (("find",), ("clause", "bold", "italic", "underline", "color", "highlight"), "content"),
    "format_clause": (("clause",), ("alignment", "space_after", "space_before", "style"), "content"),
    "comment": (("text",), ("clause", "find"), "annotation"),
}
ACTION_COMMON = ("id", "type", "rationale", "severity", "note")
DERIVED_ACTIONS = ("renumber_clause", "update_cross_reference")
#: One of these must be given where a type places something.
PLACEMENTS = {"insert_clause": ("after_clause", "before_clause", "into_section"), "move_clause": ("after_clause", "before_clause", "into_section"), "move_section": ("after_section", "before_section", "position")}
STRUCTURAL_ORDER = ("delete_section", "delete_clause", "move_section", "move_clause", "reorder_clauses", "insert_section", "insert_clause")
#: Op plans: required and optional keys.
OPS = {
    "insert_text": (("match", "text"), ("where", "count")),
    "delete_text": (("match",), ("regex", "count")),
    "replace_text": (("old", "new"), ("regex", "ignore_case", "count")),
    "update_paragraph": (("match", "text"), ()),
    "insert_paragraph": (("match", "text"), ("where", "style")),
    "delete_paragraph": (("match",), ("all",)),
    "move_paragraph": (("match", "after"), ()),
    "insert_row": (("table",), ("row", "values")),
    "delete_row": (("table", "row"), ()),
    "update_cell": (("table", "row", "col", "text"), ()),
    "format_text": (("match",), ("regex", "count", "props")),
    "format_paragraph": (("match",), ("props",)),
    "comment": (("match", "text"), ()),
}

# --- row types ---------------------------------------------------------------

REV = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "id", "author", "date", "move_name")])
PIECE = T.StructType([
    T.StructField("seq", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("rev_stack", T.ArrayType(REV)),
    *(T.StructField(n, T.BooleanType()) for n in ("bold", "italic", "underline")),
    *(T.StructField(n, T.StringType()) for n in ("color", "highlight", "fmt_old")),
])
PARAGRAPHS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("para_id", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("style", T.StringType()), T.StructField("level", T.IntegerType()),
    T.StructField("table_index", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
    T.StructField("mark", T.StringType()), T.StructField("pieces", T.ArrayType(PIECE)),
])
_STRINGS = ("id", "type", "rationale", "severity", "note", "clause", "find", "replace", "text", "anchor", "position", "title", "after_clause", "before_clause", "into_section", "section", "after_section", "before_section", "color", "highlight", "alignment", "style")
#: An action item: every field may be null, which means that it isn't given.
ACTION = T.StructType([
    *(T.StructField(n, T.StringType()) for n in _STRINGS),
    *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("order", "values")),
    *(T.StructField(n, T.BooleanType()) for n in ("all", "regex", "bold", "italic", "underline")),
    *(T.StructField(n, T.IntegerType()) for n in ("table", "row", "col")),
    *(T.StructField(n, T.DoubleType()) for n in ("space_after", "space_before")),
])


def action_json_schema(nullable: str = "inline") -> dict:
    """JSON Schema of a plan for engines: all fields required, those that may be missing nullable.

    nullable: "inline" puts null among a field's types, "anyOf" beside the field.
    """
    if nullable not in ("inline", "anyOf"):
        raise ValueError(f"nullable must be 'inline' or 'anyOf', not {nullable!r}")
    kinds = {"string": "string", "boolean": "boolean", "integer": "integer", "double": "number", "array": "array"}
    choices = {"type": sorted(ACTIONS), "severity": list(SEVERITIES), "position": ["before", "after", "start", "end", "first", "last"], "alignment": ["LEFT", "CENTER", "RIGHT", "JUSTIFY"]}
    given = ("id", "type", "rationale", "severity")
    fields: dict = {}
    for f in ACTION:
        if f.name == "note":
            continue
        kind = kinds[f.dataType.typeName()]
        one: dict = {"type": kind} | ({"items": {"type": "string"}} if kind == "array" else {}) | ({"enum": choices[f.name]} if f.name in choices else {})
        if f.name not in given:
            if nullable == "anyOf":
                one = {"anyOf": [one, {"type": "null"}]}
            else:
                one |= {"type": [kind, "null"]} | ({"enum": [*one["enum"], None]} if "enum" in one else {})
        fields[f.name] = one
    item = {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    return {"type": "object", "properties": {"summary": {"type": "string"}, "action_items": {"type": "array", "items": item}}, "required": ["summary", "action_items"], "additionalProperties": False}


def triage_json_schema() -> dict:
    """JSON Schema of an engine's choice among a document's segments."""
    words = {"type": "array", "items": {"type": "string"}}
    one = {"segment": {"type": "string"}, "priority": {"type": "string", "enum": ["deep", "scan", "skip"]}, "reason": {"type": "string"}, "focus": words}
    item = {"type": "object", "properties": one, "required": list(one), "additionalProperties": False}
    return {"type": "object", "properties": {"notes": {"type": "string"}, "selections": {"type": "array", "items": item}}, "required": ["selections", "notes"], "additionalProperties": False}


def output_form(name: str, description: str, schema: dict, style: str = "tool") -> dict:
    """A schema as engines want it: "tool" is a forced tool's description, "text" a format of the reply's text."""
    if style == "tool":
        return {"name": name, "description": description, "strict": True, "input_schema": schema}
    if style == "text":
        return {"format": {"type": "json_schema", "name": name, "description": description, "strict": True, "schema": schema}}
    raise ValueError(f"style must be 'tool' or 'text', not {style!r}")
