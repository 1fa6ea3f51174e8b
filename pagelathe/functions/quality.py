"""Signs of broken text. Every function takes and returns Columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GARBAGE_LEAST = 50
CIPHER_LEAST_LETTERS, CIPHER_VOWELS = 200, 0.30
SHIFT_LEAST_PAIRS, SHIFT_SHARE = 100, 0.10
DOLLARS_LEAST, DOLLARS_BETWEEN = 10, 20
#: Share of each letter, a to z, in English text, in per cent.
ENGLISH = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.15, 2.0, 0.07]
COSINE_OWN, COSINE_SORTED = 0.60, 0.90

# Patterns that Java and RE2 read alike. Visible: no white space of any script; the next line control is white space.
VISIBLE = r"[^\s\x0B\p{Z}\x{85}]"
LEADERS = r"\.{3,}|_{3,}|·{3,}"
MARKUP = r"[\s\x0B\p{Z}\x{85}#*|-]"
CONTROLS = r"[\x{80}-\x{84}\x{86}-\x{9F}]"
HIGH_LATIN = r"[\x{A1}-\x{B6}\x{B8}-\x{FF}]"
MORE_LATIN = r"[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1E00}-\x{1EFF}]"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
SPACES = r"[\s\x0B\p{Z}\x{85}]+"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def once(value: Column, then) -> Column:
    """then(value), with value worked out once a row however often then mentions it."""
    return F.transform(F.array(value), then)[0]


def replacement_runs(text: Column) -> Column:
    """(chars, replacements, spans, longest) of U+FFFD."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(�+)"), F.lit(1)), lambda x: F.length(x))
    return F.struct(
        F.length(text).alias("chars"), count(text, "�").alias("replacements"), F.size(runs).alias("spans"), F.coalesce(F.array_max(runs), F.lit(0)).alias("longest")
    )


def letter_counts(text: Column) -> Column:
    """Counts of a to z, either case."""
    return once(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), lambda low: F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("int") for c in string.ascii_lowercase]))


def vowel_share(text: Column) -> Column:
    letters = count(text, "[A-Za-z]")
    return F.when(letters > 0, count(text, "[AEIOUaeiou]") / letters)


def cipher_evidence(text: Column) -> Column:
    """What looks_garbled() weighs; the fields of several texts add up, counts letter by letter."""
    pairs = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z](?=[A-Za-z])", ""))
    shifts = F.length(text) - F.length(F.regexp_replace(text, "[a-z](?=[A-Z])", ""))
    ascii_letters, more = count(text, "[A-Za-z]"), count(text, MORE_LATIN)
    return F.struct(
        letter_counts(text).alias("counts"), ascii_letters.alias("letters"), count(text, "[AEIOUaeiou]").alias("vowels"), more.alias("more_latin"), (count(text, r"\p{L}") - ascii_letters - more).alias("other"),
        pairs.cast("int").alias("pairs"), shifts.cast("int").alias("shifts"),
    )


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def letter_shape(counts: Column) -> Column:
    """(own, sorted): cosines of letter counts with English, letter by letter and rank by rank."""
    english = F.array(*map(F.lit, ENGLISH))
    return F.struct(_cosine(counts, english).alias("own"), _cosine(F.sort_array(counts), F.sort_array(english)).alias("sorted"))


def looks_garbled(evidence: Column) -> Column:
    """Of cipher_evidence(): enough mostly Latin letters, too few vowels, and either case that shifts within words or
    letters as unevenly spread as in English, but not the same ones."""

    def judge(e: Column) -> Column:
        latin = (e["letters"] >= CIPHER_LEAST_LETTERS) & (e["other"] <= e["letters"] + e["more_latin"])
        shifting = (e["pairs"] >= SHIFT_LEAST_PAIRS) & (e["shifts"] >= e["pairs"] * SHIFT_SHARE)
        permuted = once(letter_shape(e["counts"]), lambda s: (s["own"] < COSINE_OWN) & (s["sorted"] >= COSINE_SORTED))
        return F.when(latin & (e["vowels"] <= e["letters"] * CIPHER_VOWELS), shifting | F.coalesce(permuted, F.lit(False))).otherwise(F.lit(False))

    return once(evidence, judge)


def is_garbage(text: Column) -> Column:
    """Fifty visible characters or more, under half of them letters or digits; markup and leaders do not count."""
    plain = F.regexp_replace(F.regexp_replace(text, LEADERS, ""), MARKUP, "")
    return once(plain, lambda x: (F.length(x) >= GARBAGE_LEAST) & (count(x, r"[\p{L}\p{N}]") * 2 < F.length(x)))


def is_cid_garbage(text: Column) -> Column:
    """Garbage, or too many control characters, or mostly accented letters among few plain ones."""
    total, controls = count(text, VISIBLE), count(text, CONTROLS)
    foreign = (total >= 20) & (count(text, HIGH_LATIN) * 5 >= total * 2) & (count(text, "[A-Za-z]") * 3 < total)
    return is_garbage(text) | ((total >= 5) & (((controls >= 2) & (controls * 20 >= total)) | foreign))


def has_dollar_spaces(text: Column) -> Column:
    """Dollar signs that stand for blanks: many, most of them between letters."""
    pieces = F.split(text, r"\$")
    between = F.size(F.filter(F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.slice(pieces, F.lit(2), F.size(pieces)), lambda a, b: a.rlike(r"[A-Za-z]\z") & b.rlike("^[A-Za-z]")), lambda x: x))
    dollars = F.size(pieces) - 1
    return F.when(dollars > DOLLARS_LEAST, (between > DOLLARS_BETWEEN) | (between * 2 > dollars)).otherwise(F.lit(False))


def has_private_use_run(text: Column) -> Column:
    """Three private-use characters in a row, or two that make half of a text."""
    total, own = count(text, VISIBLE), count(text, PRIVATE_USE)
    return text.rlike(PRIVATE_USE + "{3}") | ((total >= 5) & (own >= 2) & (own * 2 >= total))


def has_cid_control_token(text: Column) -> Column:
    """A word of five characters or more with two control characters or more, at least a twentieth of it."""
    return F.exists(F.split(text, SPACES), lambda w: (F.length(w) >= 5) & (count(w, CONTROLS) >= 2) & (count(w, CONTROLS) * 20 >= F.length(w)))


def has_replacement_run(text: Column) -> Column:
    return text.contains("��") | (count(text, "�") >= 3)


def span_issue(text: Column) -> Column:
    """strong, replacement or null: what is wrong with the letters of one run of text."""
    t = F.regexp_replace(text, r"^[\s\x0B\p{Z}]+|[\s\x0B\p{Z}]+$", "")
    strong = has_dollar_spaces(t) | has_private_use_run(t) | is_cid_garbage(t) | has_cid_control_token(t)
    return once(t, lambda _: F.when(t == "", None).when(strong, "strong").when(has_replacement_run(t), "replacement"))


def has_encoding_issues(text: Column) -> Column:
    """A replacement character, dollars for blanks, or letters as a cipher leaves them."""
    return text.contains("�") | has_dollar_spaces(text) | looks_garbled(cipher_evidence(text))


def private_use_runs(text: Column) -> Column:
    return count(text, r"[\x{E000}-\x{F8FF}]{2,}")
