"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravine.functions import fixed

#: White space as an explicit class, so that other engines agree.
_SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def token_estimate(text: Column) -> Column:
    """A token for every four characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed, trimmed, in lower case."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, _SPACE, " "))), 256)


def raw_hash(text: Column) -> Column:
    """The first 32 hexadecimal digits of the raw text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def terms(text: Column) -> Column:
    """L1: lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def stemmed(text: Column) -> Column:
    """L1: plurals at their stems, by a light stemmer (Harman 1991): ies becomes y, es e, and s goes, but for endings that are no plurals."""
    end = "(?![\\p{L}\\p{N}])"
    for plural, single in (("(?<![ea])ies", "y"), ("(?<![aeo])es", "e"), ("(?<![us])(?<![aeo]e)s", "")):
        text = F.regexp_replace(text, plural + end, single)
    return text


def stemmed_terms(text: Column) -> Column:
    """L1: terms without stop words, by their stems, joined by blanks."""
    return stemmed(F.array_join(F.filter(terms(text), lambda t: ~t.isin(fixed.STOP_WORDS)), " "))


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), _SPACE), lambda x: x != "")


def keywords(question: Column) -> Column:
    """Q2: words without stop words and words of one or two characters, stripped of punctuation, first of each.

    Stop words and lengths are judged before stripping.
    """
    kept = F.filter(words(question), lambda w: ~w.isin(fixed.STOP_WORDS) & (F.length(w) > 2))
    return F.array_distinct(F.transform(kept, lambda w: F.btrim(w, F.lit(fixed.KEYWORD_EDGES))))


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in phrases])


def _starts(text: Column, phrases: list[str]) -> Column:
    return reduce(Column.__or__, [F.startswith(text, F.lit(p)) for p in phrases])


def requires_graph(question: Column) -> Column:
    """Q1: whether the question hints at relations; by substring, so `who` is found in `whole`."""
    return _any(F.lower(question), fixed.GRAPH_HINTS)


def intent(question: Column) -> Column:
    """Q1: factual, procedural, comparative, relational or general, the first that fits."""
    q = F.lower(question)
    return (
        F.when(_starts(q, fixed.FACTUAL_STARTS), "factual")
        .when(_starts(q, fixed.PROCEDURAL_STARTS), "procedural")
        .when(_any(q, fixed.COMPARATIVE_HINTS), "comparative")
        .when(requires_graph(question), "relational")
        .otherwise("general")
    )


def section_heading(text: Column) -> Column:
    """C11: the heading in the first line: Markdown, letters only, numbered, chapter or section; else null."""
    first = F.trim(F.element_at(F.split(text, "\n", 2), 1))
    found = [F.nullif(F.trim(F.regexp_extract(first, p, 1)), F.lit("")) for p in fixed.HEADING_PATTERNS]
    return F.coalesce(*found)


def is_table(text: Column) -> Column:
    """Whether a line runs from bar to bar; at the end of the text too."""
    return F.regexp_like(text, F.lit("\\|[^\\n]+\\|(\\n|$)"))


def markdown_tables(text: Column) -> Column:
    """Runs of at least two lines from bar to bar."""
    return F.regexp_extract_all(text, F.lit("(?m)((?:^[ \\t]*\\|.*\\|[ \\t]*(?:\\n|\\z)){2,})"), 1)


def table_context(table: Column) -> Column:
    """C14: what a Markdown table is about: its first five columns and its number of rows."""
    lines = F.split(F.trim(table), "\n")
    heads = F.filter(F.transform(F.split(lines[0], "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.size(F.filter(F.slice(lines, 3, F.size(lines)), lambda x: F.trim(x) != "")).cast("string")
    more = F.when(F.size(heads) > 5, F.concat(F.lit(", ... ("), F.size(heads).cast("string"), F.lit(" columns)"))).otherwise("")
    named = F.concat(F.lit("Table with columns: "), F.array_join(F.slice(heads, 1, 5), ", "), more, F.lit(". "), rows, F.lit(" rows."))
    return F.when(F.size(lines) < 2, "Table data").when(F.size(heads) > 0, named).otherwise(
        F.concat(F.lit("Table with "), rows, F.lit(" rows"))
    )


def rows_to_markdown(rows: Column) -> Column:
    """Ragged rows (array of arrays of strings) as a Markdown table; the first row is the head."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.size(rows)), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n")).otherwise("")


def ocr_confidence(text: Column) -> Column:
    """C20: how much of a text is letters, digits and common punctuation; short texts count for less."""
    total = F.length(text)
    good = F.length(F.regexp_replace(text, "[^\\p{L}\\p{N} .,;:!?\\n\\t-]", ""))
    share = good / total * 0.8 + (1 - (total - good) / total) * 0.2
    short = F.when(total < 50, 0.7).when(total < 100, 0.85).otherwise(1.0)
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share * short))
    return F.when(text.isNull() | (F.length(F.trim(text)) < 10), 0.1).otherwise(value)


def outcome(transcript: Column) -> Column:
    """The first outcome with a phrase in the transcript, else completed."""
    text, ladder = F.lower(transcript), None
    for name, phrases in fixed.OUTCOMES.items():
        ladder = (F if ladder is None else ladder).when(_any(text, phrases), name)
    return ladder.otherwise("completed")


def sentiment(transcript: Column) -> Column:
    """Positive needs two phrases more than negative ones; negative needs one more."""
    text = F.lower(transcript)
    count = lambda phrases: sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0))
    good, bad = count(fixed.POSITIVE), count(fixed.NEGATIVE)
    return F.when(good > bad + 1, "positive").when(bad > good, "negative").otherwise("neutral")


def phone_clean(phone: Column) -> Column:
    """Without spaces, hyphens and brackets."""
    return F.translate(phone, " -()", "")


def e164(phone: Column) -> Column:
    """Digits only, behind a plus sign."""
    return F.concat(F.lit("+"), F.regexp_replace(phone, "[^0-9]", ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def _mapped(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def file_kind(path: Column, mime: Column | None = None) -> Column:
    """By extension; otherwise by what the MIME type holds, if there is one; otherwise unknown."""
    told = [F.when(F.contains(mime, F.lit(part)), kind) for part, kind in fixed.MIME_KINDS.items()] if mime is not None else []
    return F.coalesce(_mapped(extension(path), fixed.FILE_KINDS), *told, F.lit("unknown"))


def mime_type(path: Column) -> Column:
    """By extension; otherwise a stream of bytes."""
    return F.coalesce(_mapped(extension(path), fixed.MIME_TYPES), F.lit("application/octet-stream"))


def call_state(name: Column) -> Column:
    """The provider's state in our names; an unknown one stays as it is."""
    return F.coalesce(_mapped(F.lower(name), fixed.CALL_STATES), name)


def yes_no_score(answer: Column) -> Column:
    """a relevance score from a yes-or-no answer in words."""
    text = F.lower(F.trim(answer))
    first = F.rtrim(F.element_at(F.split(text, _SPACE), 1), F.lit(".,!?;:"))
    yes, no = F.contains(text, F.lit("yes")), F.contains(text, F.lit("no"))
    return (
        F.when(F.startswith(first, F.lit("yes")) | first.isin(fixed.YES_WORDS), fixed.YES_SCORE)
        .when(F.startswith(first, F.lit("no")) | first.isin(fixed.NO_WORDS), F.when(yes, fixed.NO_BUT_YES_SCORE).otherwise(fixed.NO_SCORE))
        .when(yes, fixed.HOLDS_YES_SCORE)
        .when(no, fixed.HOLDS_NO_SCORE)
        .otherwise(fixed.UNCLEAR_SCORE)
    )


def sentence_boundary(text: Column, position: Column, window: int = 100) -> Column:
    """The end of the sentence nearest to a place, within window characters of it; the place itself if there is none.

    Places count from 0; of two equally near ends the earlier one counts.
    """
    start = F.greatest(position - window, F.lit(0))
    region = F.substr(text, start + 1, F.least(F.length(text), position + window) - start)
    ends = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(2 * window)), lambda i: F.regexp_like(F.substr(region, i), F.lit("^[.!?]\\s"))),
        lambda i: start + i - 1 + F.length(F.regexp_extract(F.substr(region, i), "^[.!?]\\s+", 0)),
    )
    near = F.array_min(F.transform(ends, lambda e: F.struct(F.abs(e - position).alias("far"), e.alias("end"))))
    return F.coalesce(near["end"], position)


def extractable(text: Column, least: int = 50) -> Column:
    """Whether a text is long enough for extraction, blanks at its ends apart."""
    return F.coalesce(F.length(F.trim(text)) >= least, F.lit(False))


def yes_probability(yes_log: Column, no_log: Column) -> Column:
    """softmax of two log-probabilities; a missing one is impossible, none at all gives null."""
    gap = F.coalesce(no_log, F.lit(float("-inf"))) - F.coalesce(yes_log, F.lit(float("-inf")))
    return F.when(yes_log.isNotNull() | no_log.isNotNull(), 1 / (1 + F.exp(gap)))


def labelled(*parts: tuple[str, Column]) -> Column:
    """`Label: value` lines of the values that are there; an empty label gives the bare value."""
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: " if label else ""), c))
    return F.concat_ws("\n", *(line(label, c) for label, c in parts))
