"""Registered queries over texts and lines, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import lines as L
from pagelathe.functions import quality as Q
from pagelathe.functions import text as X
from pagelathe.operators import documents as D
from pagelathe.operators import render as R
from pagelathe.plans.inputs import INPUT_SQL, read


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, {q(L.TRIM)}, '', 'g')"


def _page_number(c: str) -> str:
    return f"regexp_matches(lower({_trim(c)}), {q(L.PAGE_NUMBER)})"


def _start(c: str) -> str:
    return f"regexp_replace({c}, {q(L.TRIM_START)}, '')"


def _list_item(c: str) -> str:
    s = _start(c)
    return f"(regexp_matches({s}, '^[•\\-*○●◦] ') OR (regexp_matches(left({s}, 5), '^[0-9]{{0,4}}[.)]') AND regexp_matches(left({s}, 5), '[0-9]')) OR regexp_matches({s}, '^(?:[A-Za-z][.)]|\\(.\\))'))"


def _code(c: str) -> str:
    t = _trim(c)
    return f"(regexp_matches({t}, {q(L.CODE_PREFIX)}) OR (len(regexp_extract_all({t}, {q(L.CODE_MARKS)})) >= {L.LEAST_CODE_MARKS} AND strlen({t}) < {L.MOST_CODE_BYTES}) OR regexp_matches({t}, {q(L.CODE_END)}))"


def _compare_key(c: str) -> str:
    squeezed = f"regexp_replace({_trim(c)}, '[\\s\\p{{Z}}]+', ' ', 'g')"
    return _trim(f"regexp_replace({squeezed}, '^[0-9]+|[0-9]+$', '', 'g')")


_DECORATIVE = "(length(line) > 0 AND length(replace(line, left(line, 1), '')) = 0)"
_SPLIT = r"unnest(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)))"


def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.line_profile(read(spark, sf_dir, "documents"))


LINE_PROFILE_SQL = f"""
WITH l AS (SELECT doc_id, {_SPLIT} AS line FROM documents), f AS (SELECT * FROM l WHERE {_trim('line')} <> ''),
c AS (
  SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER ({_page_number('line')}) AS BIGINT) AS page_numbers, count(*) FILTER ({_list_item('line')}) AS list_items,
    count(*) FILTER (regexp_matches({_trim('line')}, {q(L.CAPTION)})) AS captions, count(*) FILTER ({_code('line')}) AS code_lines, count(*) FILTER (regexp_matches(line, {q(L.DOT_LEADERS)})) AS leader_lines,
    count(*) FILTER ({_DECORATIVE}) AS decorative_lines, count(*) FILTER (contains(line, '|')) AS table_lines
  FROM f GROUP BY doc_id)
SELECT *, CASE WHEN table_lines * 2 > n_lines THEN 'table_dense' WHEN code_lines * 10 < n_lines * 3 THEN 'text_dominant' ELSE 'mixed' END AS mix,
  CASE WHEN table_lines * 2 > n_lines THEN 'pipeline' WHEN code_lines * 10 < n_lines * 3 THEN 'native' ELSE 'mineru-vlm' END AS route FROM c
"""


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return read(spark, sf_dir, "text_lines").select(
        "doc_id", "line_no", L.is_page_number(line).alias("page_number"), L.is_list_item(line).alias("list_item"), L.is_caption(line).alias("caption"), L.is_code_like(line).alias("code"),
        L.has_dot_leaders(line).alias("leaders"), L.is_toc_entry(line).alias("toc"), L.is_structural(line).alias("structural"), L.is_decorative(line).alias("decorative"),
        L.format_list_item(line).alias("formatted"), L.compare_key(line).alias("compare_key"), L.is_number(line).alias("number"),
    )


LINE_KINDS_SQL = f"""
SELECT doc_id, line_no, {_page_number('line')} AS page_number, {_list_item('line')} AS list_item, regexp_matches({_trim('line')}, {q(L.CAPTION)}) AS caption, {_code('line')} AS code,
  regexp_matches(line, {q(L.DOT_LEADERS)}) AS leaders, regexp_matches(line, {q(L.TOC_ENTRY)}) AS toc, regexp_matches({_start('line')}, {q(L.STRUCTURAL)}) AS structural, {_DECORATIVE} AS decorative,
  regexp_replace({_start('line')}, '^(\\*\\*|\\*|<u>|)[{L.BULLETS}][\\s\\p{{Z}}]*', '- \\1') AS formatted,
  {_compare_key('line')} AS compare_key,
  regexp_matches({_trim('line')}, '^[0-9.,+-]+$') AND regexp_matches({_trim('line')}, '[0-9]') AS number
FROM {INPUT_SQL['text_lines']}
"""


def page_numbers_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.drop_page_number_lines(read(spark, sf_dir, "text_lines"))


_FREE = "({0} IS NULL OR {1} = '' OR {1} = '---')"
PAGE_NUMBERS_DROPPED_SQL = f"""
WITH a AS (SELECT *, lag(line) OVER w AS b, lead(line) OVER w AS n FROM {INPUT_SQL['text_lines']} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, line FROM a WHERE NOT ({_page_number('line')} AND {_trim('line')} <> '' AND (({_FREE.format('b', _trim('b'))} AND {_FREE.format('n', _trim('n'))}) OR coalesce({_trim('n')} = '---', false)))
"""


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.code_blocks(read(spark, sf_dir, "text_lines"))


CODE_BLOCKS_SQL = f"""
WITH f AS (SELECT *, {_code('line')} AS c FROM {INPUT_SQL['text_lines']}),
n AS (SELECT *, CASE WHEN c AND NOT coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY line_no), false) THEN 1 ELSE 0 END AS new FROM f),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM n)
SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines FROM r WHERE c GROUP BY ALL
"""


def markdown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.markdown_text(read(spark, sf_dir, "documents"))


MARKDOWN_TEXT_SQL = f"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM t),
c AS (SELECT *, {_code('line')} AND {_trim('line')} <> '' AS c FROM l),
m AS (SELECT *, coalesce(lag(c) OVER w, false) AS was, coalesce(lead(c) OVER w, false) AS nxt FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, string_agg(CASE WHEN c AND NOT was THEN '```' || chr(10) ELSE '' END || CASE WHEN c THEN line WHEN {_list_item('line')} THEN regexp_replace({_start('line')}, '^(\\*\\*|\\*|<u>|)[{L.BULLETS}][\\s\\p{{Z}}]*', '- \\1') ELSE {_trim('line')} END
  || CASE WHEN c AND NOT nxt THEN chr(10) || '```' ELSE '' END, chr(10) ORDER BY k) AS markdown FROM m GROUP BY 1
"""


def running_lines_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.strip_running_lines(read(spark, sf_dir, "page_lines")).select("doc_id", "page", "line_no", "text")


RUNNING_LINES_STRIPPED_SQL = f"""
WITH l AS (SELECT * FROM {INPUT_SQL['page_lines']}),
r AS (SELECT *, {_compare_key('text')} AS k, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y) AS up, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS down FROM l),
e AS (SELECT *, up <= {D.EDGE_ROWS} OR down <= {D.EDGE_ROWS} AS edge FROM r),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1),
s AS (SELECT doc_id, avg(s) AS span FROM (SELECT doc_id, page, max(y) - min(y) AS s FROM l GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT doc_id, k, count(DISTINCT page) AS on_pages, stddev_pop(y) AS dev, min(page) AS first_page FROM e WHERE edge AND strlen(k) >= {D.LEAST_KEY_BYTES} AND NOT regexp_matches({_start('text')}, {q(L.STRUCTURAL)}) GROUP BY 1, 2),
f AS (SELECT g.* FROM g JOIN p USING (doc_id) JOIN s USING (doc_id) WHERE pages >= {D.LEAST_PAGES} AND on_pages >= greatest({D.LEAST_PAGES}, ceil(pages * {D.PAGE_SHARE})) AND dev < span * {D.MOST_SPREAD})
SELECT doc_id, page, line_no, text FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = e.doc_id AND f.k = e.k AND e.edge AND e.page > f.first_page)
"""


def latex_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("latex")
    return read(spark, sf_dir, "latex").select("id", X.balance_brackets(x).alias("balanced"), X.collapse_quads(x).alias("quads"), X.eqno_to_tag(x).alias("tagged"), X.display_math(x).alias("display"))


def _times(piece: str) -> str:
    return f"((length(latex) - length(replace(latex, {q(piece)}, ''))) // {len(piece)})"


LATEX_REPAIRED_SQL = f"""
SELECT id,
  repeat('\\left. ', greatest(0, {_times(chr(92) + 'right')} - {_times(chr(92) + 'left')})) || repeat('{{', greatest(0, {_times('}')} - {_times('{')})) || latex ||
    repeat('}}', greatest(0, {_times('{')} - {_times('}')})) || repeat(' \\right.', greatest(0, {_times(chr(92) + 'left')} - {_times(chr(92) + 'right')})) AS balanced,
  regexp_replace(regexp_replace(latex, '(?:\\\\quad\\s*){{2,}}', '\\\\quad ', 'g'), '\\s+$', '') AS quads,
  regexp_replace(latex, '\\\\eqno\\s*\\(([^)]*)\\)', '\\\\tag{{\\1}}', 'g') AS tagged,
  '\\[' || chr(10) || regexp_replace(latex, '^\\s+|\\s+$', '', 'g') || chr(10) || '\\]' AS display
FROM {INPUT_SQL['latex']}
"""


def text_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(X.collapse_whitespace(t), 256).alias("squeezed"), F.sha2(X.clean_markdown(t), 256).alias("cleaned"), F.sha2(X.escape_html(t), 256).alias("html"), F.sha2(X.escape_cell(t), 256).alias("cell"),
        F.sha2(X.expand_ligatures(t), 256).alias("ligatures"), F.sha2(X.script_digits(t, True), 256).alias("raised"), F.sha2(t, 256).alias("sha256"), F.length(X.code_fence(t)).alias("fence"),
    )


TEXT_CLEANED_SQL = r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\n{2,}', chr(10), 'g')) AS squeezed,
  sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\.{4,}', ' ... ', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10)) AS cleaned,
  sha256(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html,
  sha256(replace(replace(text, '|', '\|'), chr(10), '<br>')) AS cell, sha256(text) AS ligatures, sha256(translate(text, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')) AS raised, sha256(text) AS sha256,
  CAST(greatest(coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0), 2) + 1 AS INT) AS fence
FROM documents
"""


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").withColumn("counts", Q.letter_counts(t)).select(
        "doc_id", Q.replacement_runs(t)["replacements"].alias("replacements"), Q.is_garbage(t).alias("garbage"), Q.private_use_runs(t).alias("private_runs"),
        F.col("counts")[0].alias("a"), F.col("counts")[4].alias("e"), F.round(Q.vowel_share(t), 9).alias("vowels"), X.is_cjk_dominant(t).alias("cjk"),
    )


def _n(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def _garbage(c: str) -> str:
    plain = f"regexp_replace(regexp_replace({c}, {q(Q.LEADERS)}, '', 'g'), {q(Q.MARKUP)}, '', 'g')"
    alnum = _n(plain, r"[\p{L}\p{N}]")
    return f"(length({plain}) >= {Q.GARBAGE_LEAST} AND {alnum} * 2 < length({plain}))"


TEXT_QUALITY_SQL = f"""
WITH d AS (SELECT *, {_n('text', '[A-Za-z]')} AS letters FROM documents)
SELECT doc_id, CAST({_n('text', '�')} AS INT) AS replacements, {_garbage('text')} AS garbage,
  CAST({_n('text', '[\\x{E000}-\\x{F8FF}]{2,}')} AS INT) AS private_runs, CAST(length(text) - length(translate(text, 'aA', '')) AS INT) AS a, CAST(length(text) - length(translate(text, 'eE', '')) AS INT) AS e,
  CASE WHEN letters > 0 THEN round({_n('text', '[AEIOUaeiou]')} / letters, 9) END AS vowels,
  {_n('text', '[^ \\t\\n\\x0B\\f\\r]')} > 0 AND {_n('text', X.HAN)} / {_n('text', '[^ \\t\\n\\x0B\\f\\r]')} >= 0.2 AS cjk
FROM d
"""


def letter_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "documents").select("doc_id", Q.cipher_evidence(F.col("text")).alias("e"))
    shaped = seen.select("doc_id", "e", Q.once(F.col("e.counts"), Q.letter_shape).alias("s"), Q.looks_garbled(F.col("e")).alias("garbled"))
    return shaped.select("doc_id", F.round("s.own", 6).alias("own"), F.round("s.sorted", 6).alias("ranked"), "garbled")


def _evidence(c: str) -> str:
    """Columns of cipher_evidence() of a text c, as a select list."""
    counts = ", ".join(f"length({c}) - length(translate({c}, '{x}{x.upper()}', ''))" for x in "abcdefghijklmnopqrstuvwxyz")
    runs = f"list_sum(list_transform(regexp_extract_all({c}, '[A-Za-z]+'), lambda w: length(w) - 1))"
    # a shift is a small letter before a large one; no two overlap
    return (
        f"[{counts}]::DOUBLE[] AS counts, {_n(c, '[A-Za-z]')} AS letters, {_n(c, '[AEIOUaeiou]')} AS vowels, {_n(c, Q.MORE_LATIN)} AS more_latin, {_n(c, chr(92) + 'p{L}')} - {_n(c, '[A-Za-z]')} - {_n(c, Q.MORE_LATIN)} AS other,"
        f" coalesce({runs}, 0) AS pairs, {_n(c, '[a-z][A-Z]')} AS shifts"
    )


_SORTED_COSINE = f"list_cosine_similarity(list_sort(counts), list_sort({Q.ENGLISH}::DOUBLE[]))"
_OWN_COSINE = f"list_cosine_similarity(counts, {Q.ENGLISH}::DOUBLE[])"
_GARBLED = (
    f"(letters >= {Q.CIPHER_LEAST_LETTERS} AND other <= letters + more_latin AND vowels <= letters * {Q.CIPHER_VOWELS} AND"
    f" ((pairs >= {Q.SHIFT_LEAST_PAIRS} AND shifts >= pairs * {Q.SHIFT_SHARE}) OR ({_OWN_COSINE} < {Q.COSINE_OWN} AND {_SORTED_COSINE} >= {Q.COSINE_SORTED})))"
)
LETTER_SHAPES_SQL = f"""
WITH e AS (SELECT doc_id, {_evidence('text')} FROM documents)
SELECT doc_id, CASE WHEN letters > 0 THEN round({_OWN_COSINE}, 6) END AS own, CASE WHEN letters > 0 THEN round({_SORTED_COSINE}, 6) END AS ranked, {_GARBLED} AS garbled FROM e
"""


def odd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    found = read(spark, sf_dir, "odd_texts").withColumn("issue", Q.span_issue(t)).withColumn("garbled", Q.looks_garbled(Q.cipher_evidence(t)))
    return found.select(
        "id", "issue", "garbled", Q.is_cid_garbage(t).alias("cid"), Q.has_dollar_spaces(t).alias("dollars"), Q.has_private_use_run(t).alias("private_use"), Q.has_cid_control_token(t).alias("controls"),
        Q.has_encoding_issues(t).alias("encoding"), X.is_rtl(t).alias("rtl"), X.expand_ligatures(t).alias("ligatures"), X.word_score(t).alias("score"),
        X.better_decode(t, F.reverse(t)).alias("decoded"), X.preview(t, 7).alias("preview"), L.is_heading_fragment(t).alias("fragment"),
    )


def _between(c: str) -> str:
    p = f"string_split({c}, '$')"
    return f"len(list_filter(range(1, len({p})), lambda k: regexp_matches({p}[k], '[A-Za-z]\\z') AND regexp_matches({p}[k + 1], '^[A-Za-z]')))"


def _score(c: str) -> str:
    letters = f"({_n(c, '[A-Za-z]')} + {_n(c, X.HAN_KANA)})"
    hits = f"len(list_filter(regexp_extract_all({c}, '[A-Za-z]+'), lambda w: list_contains({X.COMMON_WORDS}, lower(w))))"
    broken = _n(c, r"[\p{Cc}\x{FFFD}]")
    other = f"(length({c}) - {letters} - {_n(c, ' ')} - {_n(c, '[0-9]')} - {broken})"
    return f"({hits} * 10 + {letters} + {_n(c, ' ')} * 2 + {_n(c, '[0-9]')} - ({other} + {broken} * 3) * 2 - CASE WHEN {letters} > 15 AND {hits} = 0 THEN 15 ELSE 0 END)"


def _fragment(c: str) -> str:
    t = f"regexp_replace({c}, '[\\s\\p{{Z}}]+$', '')"
    words = f"list_filter(string_split_regex({t}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"
    last, before = f"string_split({t}, ' ')[-1]", f"coalesce(string_split({t}, ' ')[-2], '')"
    eq = lambda w: f"regexp_matches({w}, {q(L.EQUATION_NUMBER)})"
    return (
        f"((len({words}) <= 2 AND regexp_matches(regexp_extract({t}, '\\p{{L}}'), '^\\p{{Ll}}$')) OR ({eq(last)} AND (coalesce(CASE WHEN regexp_matches({before}, '^[0-9]{{1,9}}$') THEN try_cast({before} AS BIGINT) <= try_cast(regexp_extract({last}, '[0-9]+') AS BIGINT) END, false)"
        f" OR regexp_matches({before}, '[,:]$') OR regexp_matches({t}, '[{L.MATHS_SIGNS}]'))) OR (ends_with({t}, ':') AND len(list_filter({words}, lambda w: {eq('w')})) > 0))"
    )


_LIGATED = "text"
for _old, _new in X.LIGATURES:
    _LIGATED = f"replace({_LIGATED}, '{_old}', '{_new}')"
_DOLLARS = f"(len(string_split(t, '$')) - 1 > {Q.DOLLARS_LEAST} AND ({_between('t')} > {Q.DOLLARS_BETWEEN} OR {_between('t')} * 2 > len(string_split(t, '$')) - 1))"
_PRIVATE = f"(regexp_matches(t, {q(Q.PRIVATE_USE + '{3}')}) OR ({_n('t', Q.VISIBLE)} >= 5 AND {_n('t', Q.PRIVATE_USE)} >= 2 AND {_n('t', Q.PRIVATE_USE)} * 2 >= {_n('t', Q.VISIBLE)}))"
_TOKEN = f"(len(list_filter(string_split_regex(t, {q(Q.SPACES)}), lambda w: length(w) >= 5 AND {_n('w', Q.CONTROLS)} >= 2 AND {_n('w', Q.CONTROLS)} * 20 >= length(w))) > 0)"
_CID = (
    f"({_garbage('t')} OR ({_n('t', Q.VISIBLE)} >= 5 AND (({_n('t', Q.CONTROLS)} >= 2 AND {_n('t', Q.CONTROLS)} * 20 >= {_n('t', Q.VISIBLE)})"
    f" OR ({_n('t', Q.VISIBLE)} >= 20 AND {_n('t', Q.HIGH_LATIN)} * 5 >= {_n('t', Q.VISIBLE)} * 2 AND {_n('t', '[A-Za-z]')} * 3 < {_n('t', Q.VISIBLE)}))))"
)
_RTL_LETTERS = _n(f"regexp_replace(regexp_replace(text, {q(X.RTL)}, '', 'g'), {q(X.CJK)}, '', 'g')", r"\p{L}")
ODD_TEXTS_SQL = f"""
WITH s AS (SELECT id, text, text AS t, {_evidence('text')} FROM {INPUT_SQL['odd_texts']}),
f AS (SELECT *, {_DOLLARS} AS dollars, {_PRIVATE} AS private_use, {_TOKEN} AS controls, {_CID} AS cid, {_GARBLED} AS garbled FROM s)
SELECT id, CASE WHEN t = '' THEN NULL WHEN dollars OR private_use OR cid OR controls THEN 'strong' WHEN contains(t, '��') OR {_n('t', '�')} >= 3 THEN 'replacement' END AS issue, garbled, cid, dollars, private_use, controls,
  contains(t, '�') OR dollars OR garbled AS encoding, {_n('text', X.RTL)} > 0 AND {_n('text', X.RTL)} > {_RTL_LETTERS} AS rtl, {_LIGATED} AS ligatures, CAST({_score('text')} AS INT) AS score,
  CASE WHEN text = '' THEN reverse(text) WHEN {_score('reverse(text)')} > {_score('text')} + {X.REMAP_LEAD} THEN reverse(text) ELSE text END AS decoded, left(text, 7) AS preview, {_fragment('text')} AS fragment
FROM f
"""


def page_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of pages made of ten odd texts each."""
    from pagelathe.operators import evidence as E

    items = read(spark, sf_dir, "odd_texts").select(F.floor(F.col("id") / 40).alias("doc_id"), (F.floor(F.col("id") / 3) % 5).alias("page"), "text")
    return E.page_text_quality(items)


PAGE_LETTERS_SQL = f"""
WITH s AS (SELECT CAST(floor(id / 40) AS BIGINT) AS doc_id, CAST(floor(id / 3) AS BIGINT) % 5 AS page, text AS t, {_evidence('text')} FROM {INPUT_SQL['odd_texts']}),
f AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN {_DOLLARS} OR {_PRIVATE} OR {_CID} OR {_TOKEN} THEN 'strong' WHEN contains(t, '��') OR {_n('t', '�')} >= 3 THEN 'replacement' END AS issue FROM s),
g AS (SELECT doc_id, page, CAST(sum({_n('t', Q.VISIBLE)}) AS BIGINT) AS chars, CAST(coalesce(sum({_n('t', '�')}) FILTER (issue = 'replacement'), 0) AS BIGINT) AS replacements, count(*) FILTER (issue = 'replacement') AS spans,
  CAST(coalesce(max(list_max(list_transform(regexp_extract_all(t, '�+'), lambda x: length(x)))) FILTER (issue = 'replacement'), 0) AS INT) AS longest, coalesce(bool_or(issue = 'strong'), false) AS strong,
  [{', '.join(f'sum(counts[{k}])' for k in range(1, 27))}]::DOUBLE[] AS counts, sum(letters) AS letters, sum(vowels) AS vowels, sum(more_latin) AS more_latin, sum(other) AS other, sum(pairs) AS pairs, sum(shifts) AS shifts FROM f GROUP BY 1, 2),
j AS (SELECT *, {_GARBLED} AS garbled, floor(replacements * 10000 / chars) AS density FROM g)
SELECT doc_id, page, chars, replacements, spans, longest, strong, garbled,
  strong OR garbled OR coalesce(replacements > 0 AND chars > 0 AND ((chars <= 80 AND longest >= 2) OR (replacements >= 12 AND density >= 500) OR (spans >= 3 AND density >= 250) OR (longest >= 8 AND density >= 250)), false) AS needs_ocr FROM j
"""


def linked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "url_texts").select("id", X.link_urls(F.col("text")).alias("linked"))


_DEPTH = "(len(regexp_extract_all({0}, '\\[')) - len(regexp_extract_all({0}, '\\]')))"
LINKED_URLS_SQL = f"""
WITH p AS (SELECT id, string_split_regex(text, {q(X.URL)}) AS g, regexp_extract_all(text, {q(X.URL)}) AS u FROM {INPUT_SQL['url_texts']}),
k AS (SELECT id, g, u, list_transform(range(1, len(u) + 1), lambda i: ends_with(g[i], '](') OR {_DEPTH.format("array_to_string(g[1:i], '')")} + {_DEPTH.format("array_to_string(u[1:i - 1], '')")} > 0) AS kept FROM p)
SELECT id, array_to_string(list_transform(range(1, len(u) + 1), lambda i: g[i] || CASE WHEN kept[i] THEN u[i] ELSE '[' || u[i] || '](' || u[i] || ')' END), '') || g[-1] AS linked FROM k
"""


def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = read(spark, sf_dir, "values").select("id", "n", X.roman_lower(n).alias("numeral"))
    return rows.select("id", "numeral", X.roman_value(F.col("numeral")).alias("back"), X.roman_value(F.concat(F.col("numeral"), F.lit("i"))).alias("longer"), X.roman_value(F.lit("civil")).alias("word"))


_TENS = "['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc']"
_ONES = "['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix']"
ROMAN_NUMBERS_SQL = f"""
WITH v AS (SELECT id, n, repeat('c', CAST(n // 100 AS INT)) || {_TENS}[CAST(n // 10 % 10 AS INT) + 1] || {_ONES}[CAST(n % 10 AS INT) + 1] AS numeral FROM {INPUT_SQL['values']})
SELECT id, numeral, CAST(CASE WHEN length(numeral) <= 8 THEN n END AS INT) AS back, CAST(CASE WHEN length(numeral) <= 7 AND n % 10 IN (0, 1, 2, 5, 6, 7) THEN n + 1 END AS INT) AS longer, CAST(NULL AS INT) AS word FROM v
"""


def sparse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return D.needs_ocr(pages)


SPARSE_TEXT_SQL = f"""
SELECT conv_id AS doc_id, count(*) AS pages, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes,
  sum(length(coalesce(text, ''))) < count(*) * {D.SPARSE_PAGE_CHARS} AND sum(strlen(coalesce(text, ''))) < {D.SPARSE_BYTES} AS sparse FROM conversations GROUP BY 1
"""


def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, n = F.col("value"), F.col("n")
    return read(spark, sf_dir, "values").select("id", X.cell_kind(v).alias("kind"), X.roman(n).alias("roman"), X.alphabetic(n).alias("label"), F.array_join(X.numbering(F.concat(n.cast("string"), F.lit(".2) a"))), ".").alias("numbering"))


CELL_VALUES_SQL = f"""
SELECT id, CASE WHEN {_trim('value')} = '' THEN 'empty' WHEN regexp_matches({_trim('value')}, '^[+-]?(?i:inf|infinity|nan|(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?)$') THEN 'number' WHEN lower({_trim('value')}) IN ('true', 'false') THEN 'boolean' ELSE 'text' END AS kind,
  ['', 'M', 'MM', 'MMM'][n // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman,
  CASE WHEN n > 26 THEN chr(CAST(64 + (n - 1) // 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) AS label,
  CAST(n AS STRING) || '.2' AS numbering
FROM {INPUT_SQL['values']}
"""


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "ranges").select("id", F.array_join(R.page_range(F.col("spec")).cast("array<string>"), ",").alias("pages"), R.page_range_error(F.col("spec")).alias("error"))


PAGE_RANGES_SQL = f"""
WITH p AS (SELECT id, list_transform(string_split(spec, ','), lambda x: replace(x, ' ', '')) AS parts FROM {INPUT_SQL['ranges']}),
v AS (SELECT *, len(list_filter(parts, lambda x: NOT regexp_full_match(x, '[0-9]{{1,9}}(-[0-9]{{1,9}})?'))) = 0 AS fine, list_transform(parts, lambda x: try_cast(string_split(x, '-')[1] AS BIGINT)) AS low, list_transform(parts, lambda x: try_cast(string_split(x, '-')[-1] AS BIGINT)) AS high FROM p),
w AS (SELECT *, CASE WHEN NOT fine THEN 'malformed' WHEN list_contains(low, 0) THEN 'zero' WHEN len(list_filter(range(1, len(low) + 1), lambda k: low[k] > high[k])) > 0 THEN 'descending' WHEN list_sum(high) - list_sum(low) + len(low) > {R.MOST_PAGES} THEN 'too many' END AS error FROM v)
SELECT id, CASE WHEN error IS NULL THEN array_to_string(list_sort(list_distinct(flatten(list_transform(range(1, len(low) + 1), lambda k: range(low[k], least(high[k], low[k] + {R.MOST_PAGES}) + 1))))), ',') END AS pages, error FROM w
"""


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cache_stats(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("body")))


CACHE_STATS_SQL = "SELECT count(*) AS entries, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS total_bytes FROM documents"


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", R.data_url(F.encode("text", "UTF-8")).alias("url"))


DATA_URLS_SQL = "SELECT item_id, 'data:image/png;base64,' || base64(encode(text)) AS url FROM benchmark"


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", R.cache_key(F.encode("text", "UTF-8"), F.lit("native"), F.lit(None).cast("string"), F.col("lang")).alias("key"))
    cache = keyed.where("doc_id % 3 = 0").select("key", (F.col("doc_id") * 60).alias("stored_at"))
    return R.not_cached(keyed, cache, F.lit(100_000))


CACHE_MISSES_SQL = f"""
WITH k AS (SELECT doc_id, sha256(text || chr(0) || 'native||' || lang) AS key FROM documents)
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS c WHERE c.doc_id % 3 = 0 AND 100000 - c.doc_id * 60 <= {R.CACHE_HOURS * 3600} AND c.key = k.key)
"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return R.distinct_assets(docs.select(F.when(F.col("doc_id") % 2 == 0, "image/png").when(F.col("doc_id") % 5 == 0, "image/jpeg").otherwise("application/x").alias("media_type"), F.encode("text", "UTF-8").alias("content")))


ASSETS_SQL = """
WITH a AS (SELECT sha256(text) AS sha256, strlen(text) AS n, CASE WHEN doc_id % 2 = 0 THEN 'image/png' WHEN doc_id % 5 = 0 THEN 'image/jpeg' ELSE 'application/x' END AS kind FROM documents)
SELECT sha256, sha256 || CASE min(kind) WHEN 'image/png' THEN '.png' WHEN 'image/jpeg' THEN '.jpg' ELSE '.bin' END AS path, CAST(max(n) AS INT) AS bytes, count(*) AS uses FROM a GROUP BY 1
"""

QUERIES = {
    "line_profile": line_profile, "line_kinds": line_kinds, "page_numbers_dropped": page_numbers_dropped, "code_blocks": code_blocks, "markdown_text": markdown_text,
    "running_lines_stripped": running_lines_stripped, "latex_repaired": latex_repaired, "text_cleaned": text_cleaned, "text_quality": text_quality, "letter_shapes": letter_shapes, "sparse_text": sparse_text,
    "cell_values": cell_values, "page_ranges": page_ranges, "cache_misses": cache_misses, "assets": assets, "odd_texts": odd_texts, "page_letters": page_letters, "linked_urls": linked_urls, "roman_numbers": roman_numbers,
    "cache_stats": cache_stats, "data_urls": data_urls,
}
ORACLE_SQL = {name: globals()[f"{name.upper()}_SQL"] for name in QUERIES if f"{name.upper()}_SQL" in globals()}
