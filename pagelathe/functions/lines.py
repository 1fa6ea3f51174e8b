"""Predicates and rewrites of single lines of text. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes, bullets and limits on which results depend.
CAPTION_PREFIXES = ["Figura ", "Fig. ", "Fig ", "Tabela ", "Source:", "Fonte:", "Source ", "Fonte ", "Note:", "Nota:", "Chart ", "Gráfico ", "Graph ", "Diagram ", "Image ", "Imagem ", "Photo ", "Foto "]
CODE_PREFIXES = ["import ", "export ", "from ", "const ", "let ", "var ", "function ", "class ", "def ", "pub fn ", "fn ", "async fn ", "impl ", "=> ", "-> ", ":: ", ":= "]
BULLETS = "•○●◦"
MATHS_SIGNS = "=<>≤≥≪≫≈≠±∑∫√∝"
MONOSPACE_FONTS = ["courier", "consolas", "monaco", "menlo", "mono", "fixed", "terminal", "typewriter", "source code", "fira code", "jetbrains", "inconsolata"]
MOST_CODE_BYTES, LEAST_CODE_MARKS = 200, 3

# Patterns that Java and RE2 read alike.
TRIM = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
TRIM_START = r"^[\s\p{Z}]+"
PAGE_NUMBER = r"^(?:[0-9]{1,4}|-\s*[0-9]+\s*-|[0-9]+\s+of\s+[0-9]+|page(?:\s*|\s*[0-9]+|\s*of|\s*of\s+[0-9]+(?:\s.*)?|\s*[0-9]+\s+of\s+[0-9]+(?:\s.*)?))$"
LIST_ITEM = rf"^(?:[•\-*○●◦] |[0-9]{{0,4}}[.)]|[A-Za-z][.)]|\(.\))"
LIST_ITEM_DIGITS = r"[0-9]"
CAPTION = "^(?:" + "|".join(p.replace(".", r"\.") for p in CAPTION_PREFIXES) + r"|(?i:figure|table) \s*[0-9(#]|(?i:source):)"
CODE_PREFIX = "^(?:" + "|".join(CODE_PREFIXES) + ")"
CODE_MARKS = r"[{}()\[\];=<>]"
CODE_END = r"[;{}]$"
EQUATION_NUMBER = r"^\([0-9]{1,3}\)$"
DOT_LEADERS = r"\.{4}|\.{3}[^.](?:.*[^.])?\.{3}"
TOC_ENTRY = r"\.{3,}\s*[0-9]{1,4}\s*$"
STRUCTURAL = r"^(?:#|[-*•] |[0-9].*[.)] )"
MONOSPACE = "|".join(MONOSPACE_FONTS)


def utrim(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, TRIM, "")


def is_page_number(line: Column) -> Column:
    """At most four digits, -N-, "N of M", or "page" with either, both or neither."""
    return F.lower(utrim(line)).rlike(PAGE_NUMBER)


def is_caption(line: Column) -> Column:
    return utrim(line).rlike(CAPTION)


def is_list_item(line: Column) -> Column:
    """A bullet and a blank; digits and . or ) within five characters of which one is a digit; a letter and . or ); (x)."""
    start = F.regexp_replace(line, TRIM_START, "")
    head = F.substring(start, 1, 5)
    numbered = head.rlike(r"^[0-9]{0,4}[.)]") & head.rlike(LIST_ITEM_DIGITS)
    return start.rlike(r"^[•\-*○●◦] ") | numbered | start.rlike(r"^(?:[A-Za-z][.)]|\(.\))")


def format_list_item(line: Column) -> Column:
    """The bullet, also one inside an opening ** or * or <u>, becomes "- "."""
    start = F.regexp_replace(line, TRIM_START, "")
    return F.regexp_replace(start, rf"^(\*\*|\*|<u>|)[{BULLETS}][\s\p{{Z}}]*", "- $1")


def is_code_like(line: Column) -> Column:
    t = utrim(line)
    marks = F.regexp_count(t, F.lit(CODE_MARKS))
    return t.rlike(CODE_PREFIX) | ((marks >= LEAST_CODE_MARKS) & (F.octet_length(t) < MOST_CODE_BYTES)) | t.rlike(CODE_END)


def has_dot_leaders(line: Column) -> Column:
    """Four dots in a row, or two groups of three or more."""
    return line.rlike(DOT_LEADERS)


def is_toc_entry(line: Column) -> Column:
    return line.rlike(TOC_ENTRY)


def is_structural(line: Column) -> Column:
    return F.regexp_replace(line, TRIM_START, "").rlike(STRUCTURAL)


def is_decorative(line: Column) -> Column:
    """One character, repeated."""
    first = F.substring(line, 1, 1)
    return (F.length(line) > 0) & (F.length(F.replace(line, first, F.lit(""))) == 0)


def is_monospace_font(font: Column) -> Column:
    return F.lower(font).rlike(MONOSPACE)


def is_bold_font(font: Column) -> Column:
    f = F.lower(font)
    return f.rlike("bold|[-_]bd|black|heavy") | (f.rlike("medium") & ~f.rlike("mediumitalic")) | (f.rlike("-medi") & ~f.rlike("mediumital"))


def is_italic_font(font: Column) -> Column:
    return F.lower(font).rlike("italic|oblique|[-_]it|slant|inclined|kursiv")


def compare_key(line: Column) -> Column:
    """White space collapsed, leading and trailing digits gone: how running headers are compared."""
    squeezed = F.regexp_replace(utrim(line), r"[\s\p{Z}]+", " ")
    return utrim(F.regexp_replace(squeezed, "^[0-9]+|[0-9]+$", ""))


def is_number(text: Column) -> Column:
    """Only digits and . , - + with a digit among them."""
    t = utrim(text)
    return t.rlike(r"^[0-9.,+-]+$") & t.rlike("[0-9]")


def is_title_like(line: Column) -> Column:
    """1 to 12 words, 4 to 140 characters, a letter, no closing . , ; and neither bullet, caption nor contents entry."""
    t = utrim(line)
    words = F.size(F.split(t, r"[\s\p{Z}]+"))
    return (
        words.between(1, 12) & F.length(t).between(4, 140) & t.rlike(r"\p{L}") & ~t.rlike("[.,;]$") & ~is_list_item(t) & ~is_caption(t) & ~has_dot_leaders(t)
    )


def is_heading_fragment(line: Column) -> Column:
    """One or two words that begin in lower case, a page of a total, or an equation's number with maths or a lead-in."""
    t = F.regexp_replace(line, r"[\s\p{Z}]+$", "")
    words = F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: w != "")
    small = (F.size(words) <= 2) & F.regexp_extract(t, r"(\p{L})", 1).rlike(r"^\p{Ll}$")
    pieces = F.split(t, " ")
    last, before = F.element_at(pieces, -1), F.coalesce(F.try_element_at(pieces, F.lit(-2)), F.lit(""))
    total = F.regexp_extract(last, "([0-9]+)", 1).try_cast("long")
    page_of = F.coalesce(F.when(before.rlike("^[0-9]{1,9}$"), before.try_cast("long") <= total), F.lit(False))
    numbered = last.rlike(EQUATION_NUMBER) & (page_of | before.rlike("[,:]$") | t.rlike(f"[{MATHS_SIGNS}]"))
    lead_in = t.endswith(":") & F.exists(words, lambda w: w.rlike(EQUATION_NUMBER))
    return small | numbered | lead_in
