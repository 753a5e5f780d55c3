"""Scalar text functions as Column expressions: no Python in the hot path."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
MONTHS_IT = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


def token_estimate(text: Column, factor: float = 1.8) -> Column:
    """`factor` times the words and punctuation marks, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))) * factor).cast("int"), F.lit(0))


def pair_token_estimate(query: Column, text: Column) -> Column:
    """A query and a text in one model input, with 8 tokens around them."""
    return token_estimate(query) + token_estimate(text) + 8


def normalised(text: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))


def accents_off(text: Column) -> Column:
    """The common Latin accents removed; other letters stay."""
    return F.translate(text, "àáâãäåèéêëìíîïòóôõöùúûüñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC")


def collapsed(text: Column) -> Column:
    """Lower case, no accents, punctuation and white space as single blanks."""
    return F.trim(F.regexp_replace(F.lower(accents_off(text)), r"[^a-z0-9]+", " "))


def decomposed(text: Column) -> Column:
    """Compatibility decomposition without marks, lower case, punctuation and white space as single blanks: any script."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        out = texts.str.normalize("NFKD").str.lower()
        return out.map(lambda t: None if t is None else re.sub(r"[\W_]+", " ", "".join(c for c in t if not unicodedata.combining(c))).strip())

    return plain(text)


def as_list(text: Column) -> Column:
    """A list from a cell: a JSON array, or parts between commas; trimmed, without empties, each once in its order; [] for null."""
    parsed = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
    parts = F.transform(F.coalesce(parsed, F.split(text, ",")), lambda x: F.trim(x))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: F.length(x) > 0)), F.array().cast("array<string>"))


def cache_key(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def cleaned(text: Column) -> Column:
    """Without control characters and surrounding quotes; the common HTML entities resolved."""
    s = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.trim(s), r"""^["']+|["']+$""", ""))


def split_on(text: Column, *markers: str) -> Column:
    """Trimmed parts between any of the literal markers; empty parts stay."""
    pattern = "|".join(r"\Q" + m + r"\E" for m in sorted(markers, key=len, reverse=True))
    return F.transform(F.split(text, pattern, -1), lambda x: F.trim(x))


def keywords(text: Column, stopwords: list[str], least: int = 4) -> Column:
    """Distinct lower-case words of `least` letters or more that are no stop words, in order."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    stop = F.array(*(F.lit(w) for w in stopwords)) if stopwords else F.array().cast("array<string>")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w)))


def sentences_as_phrases(text: Column, least: int = 20, most: int = 10) -> Column:
    """The first `most` sentences longer than `least` characters."""
    parts = F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: F.length(s) > least), 1, most)


def truncated(text: Column, tokens: int, chars_per_token: int = 4) -> Column:
    """Head and tail with an ellipsis where the text is over the budget."""
    budget = tokens * chars_per_token
    half = budget // 2
    return F.when(F.length(text) > budget, F.concat(F.substring(text, 1, half), F.lit("..."), F.right(text, F.lit(half)))).otherwise(text)


def file_name(url: Column) -> Column:
    """Last part of a path or address, without query and fragment; null for none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"/+$", "")
    return F.nullif(F.element_at(F.split(F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", ""), "/"), -1), F.lit(""))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


#: File types by extension.
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "xlsx": "xlsx", "xls": "xls", "csv": "csv", "txt": "txt", "md": "md", "markdown": "md", "html": "url", "htm": "url"}


def source_type(source: Column, content: Column, name: Column, payload: Column | None = None) -> Column:
    """Type of a source: magic bytes of a base64 payload, extension of the file name, of the
    address, web address, text content, null."""
    lookup = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    ext = lambda c: F.try_element_at(lookup, F.lower(F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1)))
    magic = F.lit(None).cast("string")
    if payload is not None:
        head = F.hex(F.try_to_binary(F.substring(payload, 1, 16), F.lit("base64")))
        magic = F.when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0"), "xls")
    web = F.when(F.lower(F.trim(source)).rlike(r"^https?://|^www\."), "url")
    text = F.when(F.length(F.trim(content)) > 0, "txt")
    return F.coalesce(magic, ext(name), ext(F.trim(source)), web, text)


def resolved_type(explicit: Column, detected: Column) -> Column:
    """The explicit type unless it is null, empty or auto."""
    own = F.lower(F.trim(explicit))
    return F.coalesce(F.when(~own.isin("auto", ""), own), detected)


def calendar_date(text: Column) -> Column:
    """DATE of ISO dates and timestamps, DD/MM/YYYY, and a day with a month name in Italian, English or Spanish; else null."""
    s = F.lower(F.trim(text))
    iso = F.try_to_timestamp(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")
    slash = F.try_to_timestamp(F.regexp_extract(s, r"^(\d{2}/\d{2}/\d{4})$", 1), F.lit("dd/MM/yyyy")).cast("date")
    months = F.create_map(*(F.lit(x) for names in (MONTHS_IT, MONTHS_EN, MONTHS_ES) for i, m in enumerate(names, 1) if names is MONTHS_IT or m not in MONTHS_IT for x in (m, i)))
    month = F.try_element_at(months, F.regexp_extract(s, r"^\d{1,2} (\p{L}+) \d{4}$", 1))
    day, year = F.regexp_extract(s, r"^(\d{1,2}) ", 1), F.regexp_extract(s, r" (\d{4})$", 1)
    named = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(iso, slash, F.when(month.isNotNull(), named))


def amount(text: Column) -> Column:
    """Number of a money text with Italian or English separators, as DECIMAL(18,2); null if there is none."""
    raw = F.regexp_extract(text, r"(-?\d[\d.,]*)", 1)
    dot, comma = F.length(raw) - F.locate(".", F.reverse(raw)), F.length(raw) - F.locate(",", F.reverse(raw))
    has_dot, has_comma = F.contains(raw, F.lit(".")), F.contains(raw, F.lit(","))
    both = F.when(comma > dot, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    one_comma = F.when(raw.rlike(r"^-?\d{1,3}(,\d{3})+$"), F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    one_dot = F.when(raw.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.replace(raw, F.lit("."), F.lit(""))).otherwise(raw)
    plain = F.when(has_dot & has_comma, both).when(has_comma, one_comma).when(has_dot, one_dot).otherwise(raw)
    return F.regexp_replace(plain, r"\.$", "").try_cast("decimal(18,2)")


#: Entity patterns of Italian administrative text, with the group that holds the value.
ENTITY_PATTERNS = {
    "CIG": (r"(?i)\bCIG\s*[:\.]?\s*([A-Z0-9]{10})\b", 1),
    "CUP": (r"(?i)\bCUP\s*[:\.]?\s*([A-Z0-9]{15})\b", 1),
    "CF": (r"(?i)\b[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]\b", 0),
    "DATE_IT": (r"\b(\d{1,2}[/\-\.]\d{2}[/\-\.]\d{4})\b", 1),
    "MONEY": (r"(?i)€\s*\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d{1,3}(?:\.\d{3})*,\d{2}\s*(?:euro|€)", 0),
    "QUANTITY": (r"(?i)\b(?:n\.?°?|nr\.?|pz\.?)\s*(\d+)\b", 1),
}


def entities(text: Column) -> Column:
    """Distinct (type, name) structs of the pattern entities, names in lower case, by type and position."""

    def of(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("type"), F.lower(F.trim(x)).alias("name")))

    return F.array_distinct(F.concat(*(of(k, p, g) for k, (p, g) in ENTITY_PATTERNS.items())))


def dates_of_months(text: Column) -> Column:
    """Every day, as dd/MM/yyyy, of each Italian month with a year that the text names, in order."""
    months = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS_IT, 1) for x in (m, i)))
    named = F.regexp_extract_all(F.lower(text), F.lit(r"\b((?:" + "|".join(MONTHS_IT) + r")\s+\d{4})\b"), F.lit(1))

    def days(x: Column) -> Column:
        parts = F.split(x, r"\s+")
        first = F.make_date(parts[1].cast("int"), F.element_at(months, parts[0]), F.lit(1))
        return F.transform(F.sequence(first, F.last_day(first)), lambda day: F.date_format(day, "dd/MM/yyyy"))

    return F.flatten(F.transform(named, days))


def citation_ids(text: Column) -> Column:
    """Distinct numbers of [n] markers, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\[\d+\]", ""))


REFERENCE = r"(?i)(?:\b(?:figure|figura|table|tabella|tabla|section|sezione|sección|equation|equazione|appendix|appendice|articolo|article|artículo)\s+|\b(?:fig|tab|sez|sec|eq|app|art)\.\s*|§\s*)(?:[0-9]+(?:\.[0-9]+)*|[A-Z]\b)"


def cross_references(text: Column) -> Column:
    """Distinct `kind number` references in lower case, in order."""
    whole = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    return F.array_distinct(F.transform(whole, lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))))


def heading_level(line: Column) -> Column:
    """Level of a heading by markdown marks, numbering depth, roman numeral or capital letter; 0 for none."""
    t = F.trim(line)
    return (
        F.when(t.rlike(r"^#{1,6} "), F.length(F.regexp_extract(t, r"^(#{1,6}) ", 1)))
        .when(t.rlike(r"^\d+(\.\d+)+\.? \p{Lu}"), F.size(F.split(F.regexp_extract(t, r"^([\d.]*\d)", 1), r"\.")))
        .when(t.rlike(r"^\d{1,2}\. \p{Lu}[^.]{0,80}$"), 1)
        .when(t.rlike(r"^[IVX]{1,5}\. \p{Lu}"), 1)
        .when(t.rlike(r"^[A-Z]\. \p{Lu}"), 2)
        .otherwise(0)
    )


#: Patterns that make a question temporal, in the order in which they are tried.
TEMPORAL = [
    r"\boggi\b", r"\bieri\b", r"\bdomani\b",
    r"\bstamattina\b", r"\bstasera\b",
    r"\bquesta\s+(?:settimana|giornata|mattina|sera)\b",
    r"\bquesto\s+(?:mese|anno|trimestre|semestre)\b",
    r"\bl[']?\s*(?:anno|mese|settimana)\s+scorso\b",
    r"\bnell[ae]?\s+giornata\b", r"\bnel\s+corso\b",
    r"\bnel\s+periodo\b", r"\bnel\s+mese\b",
    r"\bultim[ioe]\s+\d+\s+(?:giorni|settimane|mesi)\b",
    r"\bdal\b.{0,40}\b(?:al|fino|a)\b",
    r"\bdal\s+\d", r"\bdal\s+\w+\s+\d{4}\b",
    r"\bdal\s+(?:primo|1°?)\b",
    r"\bfino\s+a\b", r"\bentro\s+il\b",
    r"\b(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\b",
    r"\btoday\b", r"\byesterday\b", r"\bthis\s+(?:week|month|year)\b",
    r"\blast\s+(?:week|month|year)\b", r"\bsince\b.{0,20}\d{4}",
    r"\briassunto\b", r"\briepilogo\b", r"\bsommario\b", r"\bsintesi\b",
    r"\bcosa\s+hanno\s+(?:fatto|deliberato|deciso|acquistato|assunto)\b",
    r"\bcosa\s+[èe]\s+stato\b", r"\bcosa\s+[èe]\s+successo\b",
    r"\btipo\s+di\s+attivit[àa]", r"\bche\s+attivit[àa]",
    r"\bquante?\s+(?:determine|delibere|atti|acquisti|assunzioni)\b",
    r"\bn[°º]?\s*(?:determine|delibere)\b",
    r"\bquanti\s+(?:medici|infermieri|dipendenti)\b",
    r"\bsummary\b", r"\bsummarize\b", r"\bwhat\s+(?:happened|did\s+they\s+do)\b",
    r"\bhow\s+many\b",
]
#: Phrases of each kind of question, tried in this order.
QUERY_KINDS = {
    "exploratory": [
        "tell me about", "what is", "what are", "explain", "describe", "overview", "introduction", "summarize", "give me", "show me",
        "parlami di", "cos'è", "spiega", "descrivi",
    ],
    "technical": [
        "error", "code", "bug", "issue", "fix", "problem", "how to", "tutorial", "step by step", "configure", "install", "setup", "syntax",
        "command", "function", "errore", "codice", "problema", "come fare", "configurare",
    ],
    "relational": [
        "relation", "relationship", "connect", "connection", "influence", "impact", "affect", "correlate", "between", "vs", "versus",
        "compare", "comparison", "difference", "similar", "relazione", "connessione", "influenza", "impatto", "confronto",
        "how does", "why does", "what causes",
    ],
}


def temporal_route(text: Column) -> Column:
    """`temporal` with the number of the first pattern that matches, or `semantic` with -1."""
    first = reduce(lambda rest, ip: F.when(F.lower(text).rlike(ip[1]), ip[0]).otherwise(rest), reversed(list(enumerate(TEMPORAL))), F.lit(-1))
    return F.struct(F.when(first >= 0, "temporal").otherwise("semantic").alias("route"), first.alias("pattern"))


def query_kind(text: Column) -> Column:
    """The first kind one of whose words is in the question; exploratory by default."""
    low = F.lower(text)
    hit = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    first, *rest = QUERY_KINDS.items()
    out = F.when(hit(first[1]), first[0])
    for kind, words in rest:
        out = out.when(hit(words), kind)
    return out.otherwise("exploratory")


def is_noise_line(line: Column) -> Column:
    """Lines that no record is read from: empty, markdown marks, rules, bullets without text."""
    t = F.trim(line)
    return (t == "") | t.rlike(r"^```|^#{1,6}\s|^[-=*_]{3,}$|^[-*•]$")


#: What marks a line of generated records that holds no data.
SKIP_STARTS = ["```", "***", "---", "===", "###", "## ", "# ", "**", "* ", "- ", "_ ", "> ", "|", "//", "/*", "<!--", "-->"]
SKIP_WORDS = [
    "output:", "example:", "note:", "important:", "warning:", "format:", "entity_types:", "text:", "goal:", "steps:", "here is", "following",
    "please note", "remember that", "make sure", "ensure that", "do not", "don't", "real data:", "examples:", "example 1:", "example 2:", "completed",
]


def skipped_line(line: Column) -> Column:
    """Lines of generated records without data: markup, bare rules, numbered points, disclaimers, prose without quotes."""
    low, bare = F.lower(line), F.trim(line)
    starts = reduce(lambda a, b: a | b, (line.startswith(s) for s in SKIP_STARTS))
    words = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in SKIP_WORDS))
    prose = ~F.contains(line, F.lit('"')) & ~F.contains(line, F.lit("'")) & (F.size(F.split(bare, r"\s+")) > 2)
    return starts | bare.isin("**", "*", "-", "_", "---", "***", "____", "----------", "==========") | line.rlike(r"^\d+\.\s") | words | prose


def text_format(text: Column) -> Column:
    """markdown, tabular or plain by the first ten lines."""
    head = F.slice(F.split(text, "\n"), 1, 10)
    piped = F.size(F.filter(head, lambda x: F.size(F.split(x, r"\|")) >= 3))
    rule = F.exists(head, lambda x: x.rlike(r"^\s*\|?\s*:?-{3,}"))
    marked = F.exists(head, lambda x: x.rlike(r"^\s*(#{1,6}\s|[-*]\s|\d+\.\s|```)"))
    return F.when(rule & (piped >= 2), "markdown").when(marked, "markdown").when(piped >= 2, "tabular").otherwise("plain")
