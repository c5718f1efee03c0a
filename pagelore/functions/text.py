"""Column expressions over text and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore import fixed_values as fx

LINE_BREAK = r"\r\n|\r|\n"
# What counts as white space at the ends of a text (Unicode, not only ASCII).
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]"
WORD_BREAK = r"[^\p{L}\p{N}]+"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def lines(col: Column) -> Column:
    return F.split(col, LINE_BREAK)


def content_hash(col: Column) -> Column:
    """SHA-256 hex of the UTF-8 text."""
    return F.sha2(F.encode(col, "UTF-8"), 256)


def row_hash(*cols: str) -> Column:
    """Change key over the named columns, NULL-safe.

    Every value is written with its length in front, so no two different rows
    can spell the same key.
    """
    parts = []
    for name in cols:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text),
                                F.lit("~")))
    return F.sha2(F.encode(F.concat_ws(";", *parts), "UTF-8"), 256)


def url_host(col: Column) -> Column:
    return F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(col: Column) -> Column:
    return F.regexp_extract(col, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(col: Column) -> Column:
    return F.regexp_extract(col, r"^[^?#]*\?([^#]*)", 1)


def offsite_redirect(requested: Column, final: Column) -> Column:
    return url_host(requested) != url_host(final)


def snapshot_path(url: Column) -> Column:
    """Where the raw copy of a page is kept: its path, with the query folded in."""
    relative = F.regexp_replace(url_path(url), "^/+", "")
    query = url_query(url)
    folded = F.concat(
        F.regexp_replace(relative, r"\.md$", ""),
        F.lit("__"),
        F.regexp_replace(query, "[^A-Za-z0-9=_-]", "_"),
        F.lit(".md"),
    )
    return F.concat(F.lit("pages/"), F.when(query != "", folded).otherwise(relative))


def simple_tokens(col: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(col), WORD_BREAK), lambda t: t != "")


def plain_query(col: Column) -> Column:
    """A text as a search query for its words alone: quoted one by one, none of them is an operator."""
    return F.concat_ws(" ", F.transform(simple_tokens(col), lambda t: F.concat(F.lit('"'), t, F.lit('"'))))


def redact_secrets(col: Column, pattern: str = fx.SECRET_PATTERN,
                   mark: str = fx.SECRET_MARK) -> Column:
    return strip(F.regexp_replace(col, pattern, mark))


def brace_span(col: Column) -> Column:
    """From the first opening to the last closing brace; empty without such."""
    start = F.instr(col, "{")
    stop = F.length(col) - F.instr(F.reverse(col), "}") + 1
    return F.when((start > 0) & F.contains(col, F.lit("}")) & (stop > start), F.substring(col, start, stop - start + 1)).otherwise("")


def has_citation(col: Column) -> Column:
    return col.rlike(fx.CITATION_PATTERN)


def extract_citations(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(fx.CITATION_PATTERN), F.lit(0))


def has_code(col: Column) -> Column:
    """A fenced block is present; inline backticks are not code."""
    return F.coalesce(col, F.lit("")).rlike(fx.CODE_FENCE_PATTERN)


def retitle_without_code(col: Column, title: str = "**Code sample**",
                         steps: str = "**Steps**") -> Column:
    return F.when(has_code(col), col).otherwise(F.replace(col, F.lit(title), F.lit(steps)))


def search_text(title: Column, heading: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "),
                    F.coalesce(heading, F.lit("")), F.lit(" "), content)


def embed_input(title: Column, heading: Column, content: Column) -> Column:
    """Chunk text with its ``title — heading`` line in front, where there is one."""
    empty = F.lit("")
    header = F.concat_ws(" — ", F.nullif(title, empty), F.nullif(heading, empty))
    return F.when(header != "", F.concat(header, F.lit("\n\n"), content)).otherwise(content)
