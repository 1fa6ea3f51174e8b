"""Rewrites of whole texts. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HAN_SHARE = 0.2
WIDE_FROM, WIDE_TO = ",;:?!", "，；：？！"
SUBSCRIPTS, SUPERSCRIPTS = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹"
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]
ROMANS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]

COMMON_WORDS = ["the", "and", "of", "to", "in", "a", "is", "that", "for", "with", "on", "as", "by", "from", "this", "be", "are", "at", "or", "not", "it", "our"]
DASHES = "—–‒-"
REMAP_LEAD = 3

# Patterns that Java and RE2 read alike.
URL = r"https?://[^\s<>)\]]+[^\s<>)\].,;]"
RTL = r"[\x{590}-\x{5FF}\x{600}-\x{6FF}\x{700}-\x{74F}\x{750}-\x{77F}\x{780}-\x{7BF}\x{7C0}-\x{7FF}\x{800}-\x{83F}\x{840}-\x{85F}\x{8A0}-\x{8FF}\x{FB1D}-\x{FB4F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
CJK = r"[\x{1100}-\x{11FF}\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3130}-\x{318F}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
HAN_KANA = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
ROMAN = "^(c*)(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
NUMERIC = r"^[0-9,.()+%-]*[0-9][0-9,.()+%-]*$"

HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"


def count_of(text: Column, piece: str) -> Column:
    """How often a literal piece occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def is_cjk_dominant(text: Column) -> Column:
    seen = F.regexp_count(text, F.lit(r"\S"))
    return (seen > 0) & (F.regexp_count(text, F.lit(HAN)) / seen >= HAN_SHARE)


def normalize_punctuation(text: Column) -> Column:
    """Full-width punctuation where Han characters dominate; a point between digits stays."""
    wide = F.regexp_replace(F.translate(text, WIDE_FROM, WIDE_TO), r"(?<![0-9])\.|\.(?![0-9])", "。")
    return F.when(is_cjk_dominant(text), wide).otherwise(text)


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{2,}", "\n")


def category_key(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(raw, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), "[-_ ]", "")


def balance_brackets(latex: Column) -> Column:
    """As many } as {, as many \\right as \\left: what lacks is put at the end or the beginning."""
    opens, closes = count_of(latex, "{"), count_of(latex, "}")
    even = F.concat(F.repeat(F.lit("{"), F.greatest(F.lit(0), closes - opens)), latex, F.repeat(F.lit("}"), F.greatest(F.lit(0), opens - closes)))
    left, right = count_of(latex, r"\left"), count_of(latex, r"\right")
    return F.concat(F.repeat(F.lit(r"\left. "), F.greatest(F.lit(0), right - left)), even, F.repeat(F.lit(r" \right."), F.greatest(F.lit(0), left - right)))


def collapse_quads(latex: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(latex, r"(?:\\quad\s*){2,}", r"\\quad "), r"\s+$", "")


def eqno_to_tag(latex: Column) -> Column:
    return F.regexp_replace(latex, r"\\eqno\s*\(([^)]*)\)", r"\\tag{$1}")


def close_environments(latex: Column) -> Column:
    """\\end{} for every environment still open at the end, innermost first."""
    marks = F.regexp_extract_all(latex, F.lit(r"(\\(?:begin|end)\{[^}]*\})"), F.lit(1))
    none = F.array().cast("array<string>")

    def step(stack: Column, mark: Column) -> Column:
        name = F.regexp_extract(mark, r"\{([^}]*)\}", 1)
        # an end closes the innermost environment of its name and leaves those around it
        at = F.size(stack) - F.array_position(F.reverse(stack), name) + 1
        shut = F.when(
            F.array_contains(stack, name), F.concat(F.slice(stack, F.lit(1), at.cast("int") - 1), F.slice(stack, at.cast("int") + 1, F.size(stack)))
        ).otherwise(stack)
        return F.when(mark.startswith(r"\begin"), F.concat(stack, F.array(name))).otherwise(shut)

    still = F.aggregate(marks, none, step)
    return F.concat(latex, F.array_join(F.transform(F.reverse(still), lambda n: F.concat(F.lit(r"\end{"), n, F.lit("}"))), ""))


def repair_latex(latex: Column) -> Column:
    return close_environments(eqno_to_tag(collapse_quads(balance_brackets(latex))))


def display_math(latex: Column) -> Column:
    t = F.regexp_replace(latex, r"^\s+|\s+$", "")
    return F.when(t.startswith(r"\[") & t.endswith(r"\]"), t).otherwise(F.concat(F.lit("\\[\n"), t, F.lit("\n\\]")))


def expand_ligatures(text: Column) -> Column:
    for old, new in LIGATURES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def script_digits(text: Column, raised: bool) -> Column:
    return F.translate(text, "0123456789", SUPERSCRIPTS if raised else SUBSCRIPTS)


def clean_markdown(text: Column) -> Column:
    """Dot leaders to " ... ", words broken at a line's end joined, blanks and empty lines squeezed, one line feed at the end."""
    out = F.regexp_replace(text, r"\.{4,}", " ... ")
    out = F.regexp_replace(out, r"([a-z])-\n([a-z])", "$1$2")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(out, r"^\s+|\s+$", ""), F.lit("\n"))


def roman(n: Column) -> Column:
    """Upper-case Roman numeral of a number from 1 on."""
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMANS])
    start = F.struct(n.cast("int").alias("left"), F.lit("").alias("out"))
    step = lambda a, r: F.struct((a["left"] % r["v"]).alias("left"), F.concat(a["out"], F.repeat(r["s"], F.floor(a["left"] / r["v"]).cast("int"))).alias("out"))
    return F.aggregate(table, start, step)["out"]


def alphabetic(n: Column) -> Column:
    """A, B, ..., Z, AA, ...: base 26 without a zero, of a number from 1 on."""
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))

    def step(a: Column, _: Column) -> Column:
        letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ((a["left"] - 1) % 26 + 1).cast("int"), F.lit(1))
        more = F.struct(F.floor((a["left"] - 1) / 26).cast("long").alias("left"), F.concat(letter, a["out"]).alias("out"))
        return F.when(a["left"] > 0, more).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["out"]


def numbering(text: Column) -> Column:
    """Parts of a leading decimal number like 1.2.3 that ends in . ) or :, else null. Parts have at most 3 digits."""
    token = F.regexp_extract(text, r"^\s*((?:[0-9]{1,3}\.)*[0-9]{1,3})[.):](?:\s|$)", 1)
    return F.when(token != "", F.transform(F.split(token, r"\."), lambda x: x.cast("int")))


def escape_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_inline(text: Column) -> Column:
    """Markdown's \\ ` * [ ] always, _ at a word's edge, & and < as references."""
    out = F.regexp_replace(text, r"([\\`*\[\]])", r"\\$1")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])_|_(?![\p{L}\p{N}])", r"\\_")
    return F.replace(F.replace(out, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def code_fence(text: Column) -> Column:
    """Back quotes enough to fence a text: one more than its longest run of two or more, else three."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(F.array_max(runs), F.lit(0)), F.lit(2)) + 1)


def cell_kind(value: Column) -> Column:
    """empty, number, boolean or text. Numbers are what a floating-point literal may look like, inf and nan included."""
    t = F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    number = t.rlike(r"^[+-]?(?i:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$")
    return F.when(t.isNull(), None).when(t == "", "empty").when(number, "number").when(F.lower(t).isin("true", "false"), "boolean").otherwise("text")


def cell_number(value: Column) -> Column:
    """A double as a sheet shows it: whole numbers below 1e15 without a point, others with up to 10 decimals."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    other = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", value), "0+$", ""), r"\.$", "")
    return F.when(whole, value.cast("long").cast("string")).otherwise(other)


def is_rtl(text: Column) -> Column:
    """More letters that are written from right to left than others; Chinese, Japanese and Korean ones count as neither."""
    rtl = F.regexp_count(text, F.lit(RTL))
    letters = F.regexp_count(F.regexp_replace(F.regexp_replace(text, RTL, ""), CJK, ""), F.lit(r"\p{L}"))
    return (rtl > 0) & (rtl > letters)


def preview(text: Column, most: int) -> Column:
    """The first characters of a text."""
    return F.left(text, F.lit(most))


def link_urls(text: Column) -> Column:
    """Bare web addresses as Markdown links; not those that follow "](" or stand within an open bracket."""
    gaps, urls = F.split(text, URL), F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1))
    depth = lambda x: F.length(F.regexp_replace(x, r"[^\[]", "")) - F.length(F.regexp_replace(x, r"[^\]]", ""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("open"))

    def step(state: Column, pair: Column) -> Column:
        inside = state["open"] + depth(pair["gap"])
        linked = pair["gap"].endswith("](") | (inside > 0)
        shown = F.when(linked, pair["url"]).otherwise(F.concat(F.lit("["), pair["url"], F.lit("]("), pair["url"], F.lit(")")))
        return F.struct(F.concat(state["out"], pair["gap"], shown).alias("out"), (inside + depth(pair["url"])).alias("open"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(urls)), urls, lambda g, u: F.struct(g.alias("gap"), u.alias("url")))
    return F.concat(F.aggregate(pairs, start, step)["out"], F.element_at(gaps, -1))


def financial_values(text: Column) -> Column:
    """The values of a run of amounts: numbers, dashes, and dollar signs with their number; null if anything else is there."""
    words = F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != "")
    plain = F.array_join(words, " ")
    values = F.regexp_extract_all(plain, F.lit(r"(\$ [^ ]+|[^ ]+)"), F.lit(1))
    fine = F.forall(values, lambda v: F.regexp_replace(v, r"^\$ ", "").rlike(NUMERIC) | v.rlike(f"^[{DASHES}]$"))
    return F.when((F.size(values) > 0) & fine, values)


def roman_value(token: Column) -> Column:
    """The value of a Roman numeral of up to 8 letters i, v, x, l, c in its usual form, either case; else null."""
    t = F.lower(F.trim(token))
    part = lambda k: F.regexp_extract(t, ROMAN, k)
    tens = F.when(part(2) == "xc", 90).when(part(2) == "xl", 40).otherwise(F.when(part(2).startswith("l"), 50).otherwise(0) + F.length(F.replace(part(2), F.lit("l"), F.lit(""))) * 10)
    ones = F.when(part(3) == "ix", 9).when(part(3) == "iv", 4).otherwise(F.when(part(3).startswith("v"), 5).otherwise(0) + F.length(F.replace(part(3), F.lit("v"), F.lit(""))))
    return F.when(F.length(t).between(1, 8) & t.rlike(ROMAN), F.length(part(1)) * 100 + tens + ones)


def roman_lower(n: Column) -> Column:
    """Lower-case Roman numeral with letters up to c."""
    return F.lower(F.concat(F.repeat(F.lit("C"), F.floor(n / 100).cast("int")), roman(n % 100)))


def word_score(text: Column) -> Column:
    """How much a text looks like words: common words, letters, blanks and digits for it, signs and controls against."""
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    hits = F.size(F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.lower(w).isin(COMMON_WORDS)))
    letters, blanks, digits, broken = n("[A-Za-z]") + n(HAN_KANA), n(" "), n("[0-9]"), n(r"[\p{Cc}\x{FFFD}]")
    other = F.length(text) - letters - blanks - digits - broken
    score = hits * 10 + letters + blanks * 2 + digits - (other + broken * 3) * 2
    return score - F.when((letters > 15) & (hits == 0), 15).otherwise(0)


def better_decode(primary: Column, remapped: Column) -> Column:
    """Of two readings of one string, the second if the first is empty or scores clearly less."""
    return F.when(primary == "", remapped).when(remapped == "", primary).when(word_score(remapped) > word_score(primary) + REMAP_LEAD, remapped).otherwise(primary)
