"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import tables as T
from inkwell.functions import text as X
from inkwell.operators import bib, citations, grounding, lint, rules
from inkwell.operators.glyphs import glyph_counts, glyph_rows, glyph_totals
from inkwell.operators.segment import lines, markup_comments, message_lines, paragraph_rows, prose_lines, section_lines
from inkwell.plans.seeded import quoted, seeded, seeded_sql
from inkwell.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


#: The language that word lists and English patterns are for; queries of those read its texts.
LANGUAGE = "en"


def english(spark: SparkSession, sf_dir: str, language: str = LANGUAGE) -> DataFrame:
    return seed(spark, sf_dir).where(F.col("lang") == language).select("doc_id", "text")


def listing(values) -> str:
    return ", ".join(map(quoted, values))


# --- shared SQL ---------------------------------------------------------------
SEED = f"s AS ({seeded_sql()})"
LINES = f"""{SEED}, l AS (
  SELECT doc_id, lang, source, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS text
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS a FROM s))"""
GLYPH_VALUES = ", ".join(f"({quoted(c)}, {quoted(n)})" for c, n in T.GLYPHS.items())
SPLIT = r"(CASE WHEN length({0}) > 120 THEN {0}[1:117] || '...' ELSE {0} END)"
FLAT = r"trim(regexp_replace({0}, '[\s\x{{A0}}]+', ' ', 'g'))"
CONTEXT = SPLIT.format(FLAT.format("text"))
GLYPH_ROWS = f"""WITH {LINES}, g(ch, glyph) AS (VALUES {GLYPH_VALUES}),
c AS (SELECT doc_id, source, line, text, unnest(range(1, length(text) + 1)) AS col, unnest(string_split(text, '')) AS ch FROM l)
SELECT doc_id, source, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, glyph, {CONTEXT} AS context FROM c JOIN g USING (ch)"""


@query(f"SELECT doc_id, line, col, glyph, context FROM ({GLYPH_ROWS})")
def glyph_rows_all(spark, sf_dir):
    return glyph_rows(seed(spark, sf_dir).select("doc_id", "text"))


CATEGORIES = ", ".join(f"({quoted(g)})" for g in T.GLYPH_CODES)


@query(f"SELECT glyph, count(r.doc_id) AS n FROM (VALUES {CATEGORIES}) t(glyph) LEFT JOIN ({GLYPH_ROWS}) r USING (glyph) GROUP BY glyph")
def glyph_totals_all(spark, sf_dir):
    return glyph_totals(glyph_counts(seed(spark, sf_dir).select("text")))


@query(f"SELECT source, glyph, count(*) AS n FROM ({GLYPH_ROWS}) GROUP BY source, glyph")
def glyph_by_source(spark, sf_dir):
    return glyph_counts(seed(spark, sf_dir).select("source", "text"), "source")


FENCED = rf"""{LINES}, f AS (
  SELECT *, regexp_matches(text, '^\s*(```|~~~)') AS fence FROM l),
r AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS k FROM f)"""


@query(rf"WITH {FENCED} SELECT doc_id, CAST(line AS INTEGER) AS line, md5(rtrim(text)) AS digest FROM r WHERE NOT fence AND k % 2 = 0 AND regexp_matches(text, '[^\s\x{{A0}}]')")
def prose_lines_no_fence(spark, sf_dir):
    return prose_lines(seed(spark, sf_dir).select("doc_id", "text")).select("doc_id", "line", F.md5(F.col("text").cast("binary")).alias("digest"))


TRAILED = "text || CASE WHEN conv_id % 3 = 0 THEN chr(10) || 'Signed-off-by: A' || chr(10) || 'cc: B' ELSE '' END"


@query(rf"""SELECT conv_id, turn, line, text FROM (SELECT conv_id, turn, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS line, unnest(a) AS text
  FROM (SELECT conv_id, turn, string_split({TRAILED}, chr(10)) AS a FROM conversations))
  WHERE regexp_matches(text, '[^\s\x{{A0}}]') AND NOT regexp_matches(text, {quoted(T.TRAILER)})""")
def message_lines_no_trailers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("conv_id") % 3 == 0, F.lit("\nSigned-off-by: A\ncc: B")).otherwise("")).alias("text"))
    return message_lines(rows)


@query(r"""SELECT page_id, CAST(unnest(range(len(a))) AS INTEGER) AS ord, trim(unnest(a)) AS text
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS a FROM pages) WHERE len(a) > 0""")
def html_comments(spark, sf_dir):
    return markup_comments(table(spark, sf_dir, "pages").select("page_id", "html"))


@query(rf"WITH {SEED} SELECT doc_id, source FROM s WHERE NOT regexp_matches(text[1:2000], {quoted(T.GENERATED)})")
def generated_filter(spark, sf_dir):
    return seed(spark, sf_dir).where(~files.generated(F.col("text"))).select("doc_id", "source")


PATHS = ["src/a.py", "docs/read.me", "x/vendor/y.md", "Makefile", "a/b/package-lock.json", "CMakeLists.txt", "notes.TXT", "s.min.js", "bin", "bin/tool.sh", "LICENSE", "k.tex", ".gitignore", "deep/er/q.Sql"]
NAMES = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in T.NAME_FAMILY.items())
EXTENSIONS = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in T.EXTENSION_FAMILY.items())


@query(f"""WITH p(base) AS (VALUES {", ".join(f"({quoted(p)})" for p in PATHS)}), f AS (
  SELECT doc_id, base, string_split(base, '/') AS parts, string_split(base, '/')[-1] AS name FROM p CROSS JOIN documents),
x AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS ext FROM f),
n(name, nf) AS (VALUES {NAMES}), e(ext, ef) AS (VALUES {EXTENSIONS}),
k AS (SELECT doc_id, base, parts, nf, ef, CASE WHEN name IN ({listing(T.SKIPPED_NAMES)}) THEN 'skip' WHEN nf IS NOT NULL THEN 'comment'
  WHEN ext IN ({listing(T.PROSE_EXTENSIONS)}) THEN 'prose' WHEN ef IS NOT NULL THEN 'comment' ELSE 'skip' END AS kind
  FROM x LEFT JOIN n USING (name) LEFT JOIN e USING (ext))
SELECT base, kind, CASE WHEN kind = 'comment' THEN coalesce(nf, ef) END AS family, count(*) AS n FROM k
WHERE NOT list_has_any(parts[1:len(parts) - 1], [{listing(T.DENIED_DIRS)}]) GROUP BY ALL""")
def classify_paths(spark, sf_dir):
    every = F.explode(F.array(*map(F.lit, PATHS)))
    rows = table(spark, sf_dir, "documents").select("doc_id", every.alias("path"))
    return files.classify(rows).where(~files.denied(F.col("path"))).groupBy(F.col("path").alias("base"), "kind", "family").agg(F.count(F.lit(1)).alias("n"))


CODE = r"regexp_extract(text, '^((?:[^\\%]|\\.|\\$)*)', 1)"
SQL_CITE = T.CITE
CITES = rf"""{LINES}, m AS (
  SELECT *, {CODE} AS code FROM l),
b AS (SELECT *, substr(text, length(code) + 1) AS comment, sum(CASE WHEN regexp_matches(text, '^\s*(%|$)') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM m),
st AS (SELECT *, max(CASE WHEN regexp_matches(comment, '^\s*%+\s*GROUNDING\b') THEN CASE WHEN contains(comment, '"') THEN 2 ELSE 1 END ELSE 0 END) OVER (PARTITION BY doc_id, block) AS state FROM b),
raw AS (SELECT doc_id, line, state, text, unnest(range(len(c))) AS ord, lower(unnest(c)) AS command, unnest(k) AS blob
  FROM (SELECT *, regexp_extract_all(code, {quoted(SQL_CITE)}, 1) AS c, regexp_extract_all(code, {quoted(SQL_CITE)}, 2) AS k FROM st WHERE contains(code, '\'))),
calls AS (SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(ord AS INTEGER) AS ord, command, list_filter(list_transform(string_split(blob, ','), lambda x: trim(x)), lambda x: x <> '') AS keys,
  ['none', 'todo', 'quote'][state + 1] AS state, {CONTEXT} AS context FROM raw WHERE command IN ({listing(T.GROUNDED_COMMANDS)}))"""
CALL = "doc_id, line, ord, command, array_to_string(keys, ',') AS keys, state, context"


def call_rows(spark, sf_dir):
    return citations.cite_calls(seed(spark, sf_dir).select("doc_id", "text"))


def flat_keys(rows):
    return rows.withColumn("keys", F.array_join("keys", ","))


@query(f"WITH {CITES} SELECT {CALL} FROM calls WHERE len(keys) > 0")
def cite_calls(spark, sf_dir):
    return flat_keys(call_rows(spark, sf_dir))


@query(f"WITH {CITES} SELECT {CALL} FROM calls WHERE len(keys) >= 3")
def cite_clusters(spark, sf_dir):
    return flat_keys(citations.clusters(call_rows(spark, sf_dir)))


@query(f"WITH {CITES} SELECT {CALL} FROM calls WHERE len(keys) > 0 AND state = 'none'")
def missing_grounding(spark, sf_dir):
    return flat_keys(citations.missing_grounding(call_rows(spark, sf_dir)))


@query(f"WITH {CITES} SELECT state, count(*) AS n, CAST(sum(len(keys)) AS BIGINT) AS keys FROM calls WHERE len(keys) > 0 GROUP BY state")
def grounding_state(spark, sf_dir):
    return call_rows(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("keys")).alias("keys"))


@query(f"""WITH {CITES}, u AS (SELECT unnest(keys) AS cite_key, state FROM calls)
SELECT cite_key, count(*) AS sites, count(*) FILTER (state <> 'quote') AS "open" FROM u GROUP BY cite_key HAVING count(*) FILTER (state <> 'quote') > 0""")
def keys_to_ground(spark, sf_dir):
    return citations.keys_to_ground(citations.sites(seed(spark, sf_dir).select("doc_id", "text")))


#: Claims by SQL: boundaries are marked by a character that texts don't have, and points that end nothing are put aside.
ABBREVIATED = "|".join(x.replace(".", r"\.") for x in T.ABBREVIATIONS)
ASIDE = lambda t: f"regexp_replace({t}, '(?i)(^|[^\\p{{L}}.])({ABBREVIATED})\\.', '\\1\\2' || chr(2), 'g')"
POINTED = lambda t: f"regexp_replace({t}, '(\\d)\\.(\\d)', '\\1' || chr(2) || '\\2', 'g')"
STRUCTURE = r"\\(?:" + "|".join(T.STRUCTURAL) + r")\*?\s*(?:\[[^\]]*\])?(?:\{[^}]*\})*"
DROPPED = [T.CITE, r"\\(?:" + "|".join(T.DROPPED_WITH_ARGUMENT) + r")\*?\s*(?:\[[^\]]*\])?(?:\{[^}]*\})*", r"\\[a-zA-Z]+\*?\s*(?:\[[^\]]*\])?"]


def cleaned(text: str) -> str:
    for pattern in DROPPED:
        text = f"regexp_replace({text}, {quoted(pattern)}, ' ', 'g')"
    text = f"regexp_replace(translate({text}, '{{}}~', '   '), '\\\\([&%_#$])', '\\1', 'g')"
    text = f"regexp_replace(trim(regexp_replace({text}, '[\\s\\x{{A0}}]+', ' ', 'g')), ' +([.,;:!?])', '\\1', 'g')"
    text = f"regexp_replace({text}, '^[ ,;]+|[ ,;]+$', '', 'g')"
    return f"CASE WHEN length({text}) > 500 THEN rtrim({text}[1:497]) || '...' ELSE {text} END"


CLAIMS = rf"""{LINES}, code AS (SELECT doc_id, string_agg({CODE}, chr(10) ORDER BY line) AS body FROM l GROUP BY doc_id),
cut AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({ASIDE(ASIDE(POINTED(POINTED("body"))))},
    '([.!?])([ \t\r\n]*)([\p{{Lu}}\p{{Nd}}\\`"''(\[])', '\1\2' || chr(1) || '\3', 'g'), '(\n[ \t]*\n|\\par\b)', '\1' || chr(1), 'g'), {quoted("(" + STRUCTURE + ")")}, '\1' || chr(1), 'g') AS body
  FROM code WHERE contains(body, '\cite') OR contains(body, '\textcite')),
seg AS (SELECT doc_id, unnest(range(len(a))) AS s, translate(unnest(a), chr(2), '.') AS text FROM (SELECT doc_id, string_split(body, chr(1)) AS a FROM cut)),
cites AS (SELECT doc_id, s, text, unnest(range(len(c))) AS k, lower(unnest(c)) AS command, unnest(b) AS blob
  FROM (SELECT *, regexp_extract_all(text, {quoted(T.CITE)}, 1) AS c, regexp_extract_all(text, {quoted(T.CITE)}, 2) AS b FROM seg)),
said AS (SELECT *, {cleaned("text")} AS claim FROM cites WHERE command IN ({listing(T.GROUNDED_COMMANDS + T.STYLE_COMMANDS)})),
claims AS (SELECT doc_id, s, k, claim, unnest(list_filter(list_transform(string_split(blob, ','), lambda x: trim(x)), lambda x: x <> '')) AS cite_key FROM said)"""


@query(f"""WITH {CLAIMS}, one AS (SELECT cite_key, claim, count(*) AS n, min((doc_id, s, k)) AS o FROM claims WHERE claim <> '' GROUP BY cite_key, claim)
SELECT cite_key, claim, n, CAST(row_number() OVER (PARTITION BY cite_key ORDER BY o, claim) AS INTEGER) AS rank FROM one""")
def claims_by_key(spark, sf_dir):
    return citations.claim_rows(citations.sites(seed(spark, sf_dir).select("doc_id", "text")))


@query(f"""WITH {CITES.replace(f"WHERE command IN ({listing(T.GROUNDED_COMMANDS)})", f"WHERE command IN ({listing(T.GROUNDED_COMMANDS + T.STYLE_COMMANDS)})")}
SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, ord) - 1 AS INTEGER) AS ord, command, array_to_string(keys, ',') AS keys, command IN ({listing(T.GROUNDED_COMMANDS)}) AS groundable, state = 'quote' AS grounded
FROM calls WHERE len(keys) > 0""")
def cite_sites(spark, sf_dir):
    return flat_keys(citations.sites(seed(spark, sf_dir).select("doc_id", "text"))).drop("claim")


# --- lexicons -----------------------------------------------------------------
LEXICON = ", ".join("(" + ", ".join("NULL" if x is None else quoted(x) for x in (*e, " ".join(rules.PHRASE_WORD.findall(e[1])))) + ")" for e in rules.default_lexicon())
PARAS = rf"""{SEED}, p AS (
  SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS para, unnest(a) AS text FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: regexp_matches(x, '[^\s]')) AS a FROM s WHERE lang = 'en'))"""
HITS = rf"""{PARAS}, lex(class, phrase, suggestion, exception, words) AS (VALUES {LEXICON}),
lx AS (SELECT *, string_split(words, ' ') AS parts FROM lex),
w AS (SELECT doc_id, para, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS w FROM p),
t AS (SELECT doc_id, para, w, unnest(range(len(w))) AS pos, unnest(w) AS first FROM w),
h AS (SELECT doc_id, para, CAST(pos AS INTEGER) AS pos, class, phrase, suggestion, exception FROM t JOIN lx ON first = parts[1] AND w[pos + 1:pos + len(parts)] = parts)"""


def hits(spark, sf_dir):
    return rules.lexicon_hits(paragraph_rows(english(spark, sf_dir)), rules.lexicon(spark, rules.default_lexicon()))


@query(f"WITH {HITS} SELECT * FROM h")
def lexicon_hits(spark, sf_dir):
    return hits(spark, sf_dir)


def _density(name: str, kind: str, more: int):
    @query(f"WITH {HITS} SELECT doc_id, para, class, count(*) AS n FROM h WHERE class = '{kind}' GROUP BY ALL HAVING count(*) > {more}")
    def f(spark, sf_dir):
        return rules.dense_units(hits(spark, sf_dir).where(F.col("class") == kind), more, "doc_id", "para")

    QUERIES[name], ORACLES[name] = QUERIES.pop("f"), ORACLES.pop("f")


_density("restricted_density", "restricted", 2)
_density("hedging_density", "hedge", 2)
_density("transition_density", "transition", 2)


def _of_class(name: str, kind: str):
    @query(f"WITH {HITS} SELECT doc_id, phrase, suggestion, count(*) AS n FROM h WHERE class LIKE '{kind}%' GROUP BY ALL")
    def f(spark, sf_dir):
        return hits(spark, sf_dir).where(F.col("class").startswith(kind)).groupBy("doc_id", "phrase", "suggestion").agg(F.count(F.lit(1)).alias("n"))

    QUERIES[name], ORACLES[name] = QUERIES.pop("f"), ORACLES.pop("f")


for _name, _kind in (("british_spelling", "british"), ("padding_phrases", "padding"), ("research_phrases", "research"), ("formulaic_openers", "opener"), ("trope_words", "trope"), ("phrases_to_avoid", "avoid"), ("author_asides", "aside"), ("plain_words", "plain")):
    _of_class(_name, _kind)

COUNT = "len(regexp_extract_all(text, {0}))"


@query(rf"""WITH {SEED}, c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')) AS n_words,
  {COUNT.format(quoted(chr(0x2014)))} AS dashes, len(regexp_extract_all(regexp_replace(text, {quoted(rules.EXEMPT)}, '', 'g'), ':[[:space:]]')) AS colons, {COUNT.format("';'")} AS semicolons FROM s)
SELECT doc_id, CAST(n_words AS INTEGER) AS n_words, CAST(dashes AS INTEGER) AS dashes, CAST(colons AS INTEGER) AS colons, CAST(semicolons AS INTEGER) AS semicolons,
  round((dashes + colons + semicolons) / (n_words / 350.0::DOUBLE), 6) AS per_page, round((dashes + colons + semicolons) / (n_words / 350.0::DOUBLE), 6) > 5 AS flagged FROM c WHERE n_words > 0""")
def pause_density(spark, sf_dir):
    return rules.pause_density(seed(spark, sf_dir).select("doc_id", "text"))


# --- sentences ----------------------------------------------------------------
SENTENCES = rf"""{SEED}, e AS (
  SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS ord, unnest(a) AS text FROM (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?:[^.!?\n]+|\.\d)+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS a FROM s)),
sw AS (SELECT *, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS INTEGER) AS n_words FROM e)"""


@query(f"""WITH {SENTENCES}, r AS (SELECT doc_id, ord, min(n_words) OVER x AS low, max(n_words) OVER x AS high, count(*) OVER x AS k FROM sw
  WINDOW x AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT doc_id, ord, low, high FROM r WHERE k = 3 AND high - low <= 5""")
def sentence_runs(spark, sf_dir):
    return rules.sentence_runs(seed(spark, sf_dir).select("doc_id", "text")).select("doc_id", "ord", "low", "high")


@query(rf"""WITH {PARAS.replace(" WHERE lang = 'en'", "")}, o AS (
  SELECT doc_id, para FROM p WHERE len(list_filter(list_transform(regexp_extract_all(text, '(?:[^.!?\n]+|\.\d)+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')) = 1),
i AS (SELECT doc_id, para, para - row_number() OVER (PARTITION BY doc_id ORDER BY para) AS island FROM o)
SELECT doc_id, min(para) AS start, count(*) AS length FROM i GROUP BY doc_id, island HAVING count(*) >= 3""")
def single_sentence_runs(spark, sf_dir):
    return rules.single_sentence_runs(seed(spark, sf_dir).select("doc_id", "text"))


@query(f"""WITH {SENTENCES}, o AS (SELECT doc_id, ord, array_to_string(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')[1:2], ' ') AS opening FROM e),
i AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id, opening ORDER BY ord) AS island FROM o WHERE opening LIKE '% %')
SELECT doc_id, opening, min(ord) AS start, count(*) AS length FROM i GROUP BY doc_id, opening, island HAVING count(*) >= 3""")
def anaphora_runs(spark, sf_dir):
    return rules.anaphora_runs(seed(spark, sf_dir).select("doc_id", "text"))


@query(rf"""WITH {SENTENCES} SELECT doc_id, ord, text, n_words FROM sw WHERE regexp_matches(text, '(?i)\bsignificant(?:ly)?\b')
  AND NOT regexp_matches(text, '(?i)\bp\s*[<=>]|\btest\b|\bconfidence\b|\bCI\b')""")
def significant_audit(spark, sf_dir):
    return rules.significant_audit(seed(spark, sf_dir).select("doc_id", "text"))


@query(f"""WITH {SENTENCES}, n AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'), ' ') AS said FROM sw WHERE n_words >= 4)
SELECT doc_id, said, count(*) AS n FROM n WHERE said <> '' GROUP BY ALL HAVING count(*) > 1""")
def duplicate_sentences(spark, sf_dir):
    return rules.duplicate_sentences(seed(spark, sf_dir).select("doc_id", "text"))


@query(rf"""WITH {PARAS.replace(" WHERE lang = 'en'", "")}, z AS (SELECT doc_id, arg_max(text, para) AS text FROM p GROUP BY doc_id)
SELECT doc_id, {CONTEXT} AS closing FROM z WHERE regexp_matches(text, {quoted(r"(?i)^\s*(?:" + "|".join(T.CLOSINGS) + r")\b")})""")
def signposted_closing(spark, sf_dir):
    return rules.signposted_closing(seed(spark, sf_dir).select("doc_id", "text"))


PASSIVE = next(p.regex for p in rules.PATTERNS if p.rule == "passive")


@query(rf"""WITH {PARAS.replace(" WHERE lang = 'en'", "")}, z AS (
  SELECT doc_id, para, list_filter(list_transform(regexp_extract_all(text, '(?:[^.!?\n]+|\.\d)+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS a FROM p),
c AS (SELECT doc_id, para, CAST(len(a) AS INTEGER) AS sentences, CAST(len(list_filter(a, lambda x: regexp_matches(x, {quoted(PASSIVE)}))) AS INTEGER) AS passive FROM z)
SELECT * FROM c WHERE passive * 3 > sentences""")
def passive_share(spark, sf_dir):
    return rules.passive_share(seed(spark, sf_dir).select("doc_id", "text"))


UNITS = {"line": ("l", "line"), "sentence": ("sw", "ord"), "paragraph": ("p", "para")}


def pattern_sql() -> str:
    ctes = f"{LINES}, {SENTENCES.removeprefix(SEED + ', ')}, {PARAS.removeprefix(SEED + ', ').replace(chr(32) + 'WHERE lang = ' + quoted('en'), '')}"
    ctes = ctes.replace("SELECT doc_id, list_filter(", "SELECT doc_id, lang, list_filter(").replace("SELECT doc_id, CAST(unnest(range(len(a)))", "SELECT doc_id, lang, CAST(unnest(range(len(a)))")
    part = lambda p: CODE if p.layer == "latex" else "text"
    many = lambda p, regex: f"len(regexp_extract_all({part(p)}, {quoted(regex)}))"
    count = lambda p: many(p, p.regex) + (f" - {many(p, p.minus)}" if p.minus else "")
    one = [
        f"SELECT doc_id, '{p.unit}' AS unit, CAST({UNITS[p.unit][1]} AS INTEGER) AS at, '{p.rule}' AS rule, '{p.layer}' AS layer, CAST({count(p)} AS INTEGER) AS n FROM {UNITS[p.unit][0]} WHERE {count(p)} >= {p.least} AND lang = '{LANGUAGE}'"
        for p in rules.PATTERNS
    ]
    return f"WITH {ctes} " + " UNION ALL ".join(one)


@query(pattern_sql())
def pattern_candidates(spark, sf_dir):
    return rules.pattern_candidates(english(spark, sf_dir))


# --- duplication, containment ---------------------------------------------------
@query(rf"""SELECT text, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)
WHERE regexp_matches(text, '[^\s]') GROUP BY text HAVING count(*) > 1""")
def duplicate_lines(spark, sf_dir):
    return rules.duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT md5(text) AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_docs(spark, sf_dir):
    return rules.duplicate_docs(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def passage_containment(spark, sf_dir):
    return rules.passage_containment(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query(rf"""WITH {LINES}, h AS (SELECT doc_id, line, coalesce(nullif(regexp_extract(text, '^#{{1,2}}\s+(.*?)\s*#*\s*$', 1), ''), nullif(regexp_extract(text, '^\s*\\(?:sub)*section\*?\{{([^}}]*)\}}', 1), '')) AS h FROM l),
c AS (SELECT doc_id, line, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM h)
SELECT doc_id, section, count(*) AS n FROM c WHERE section IS NOT NULL GROUP BY ALL""")
def sections(spark, sf_dir):
    rows = section_lines(seed(spark, sf_dir).select("doc_id", "text")).where("section is not null")
    return rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


# --- bibliography ----------------------------------------------------------------
SPACED = ", ' ', "


def bib_text(n: str, sql: bool) -> str:
    """The bibliography of each document as a column expression of both dialects: titles and identifiers follow the id."""
    word = lambda k: f"substring(md5(cast({n} as string)), {4 * k + 1}, 4)" if not sql else f"substring(md5(cast({n} AS VARCHAR)), {4 * k + 1}, 4)"
    title = f"concat('Study ', {SPACED.join(word(k) for k in range(6))})"
    raw = lambda x: quoted(x) if sql else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = [
        raw('@string{x = "y"}\n@article{one, author = {A, B.}, title = {A {Big} '), title, raw('}, journal = "J of Tests", year = 2020}\n@article{two, author = {B C and D E}, title = {No journal here}, year = {2019}, doi = {10.1/'),
        f"cast({n} as {'VARCHAR' if sql else 'string'})", raw('}}\n@book{three, editor = {C}, title = {Book of '), word(6), raw(" "), word(7),
        raw('}, publisher = {P}, year = 2001,}\n@inproceedings{four, author={D}, title={Talks, with commas = signs}, title={'), title, raw(' again}, booktitle={Old Place}, year={1999}, note = "a, b = c"}\n@misc{five, title = {}}\n@online{six, title = {Unknown type '),
        f"cast({n} as {'VARCHAR' if sql else 'string'})", raw("}}\n@comment{zip, zap = {zop}}\n"),
        f"CASE WHEN {n} % 10 = 0 THEN {raw('@misc{seven, title = {open}')} ELSE '' END",
    ]
    return f"concat({', '.join(parts)})"


def bib_files(spark, sf_dir):
    """One bibliography for each document, path its id; every tenth has a brace too few."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(bib_text("doc_id", False)).alias("text"))


WORD = lambda k: f"substring(md5(cast(doc_id AS VARCHAR)), {4 * k + 1}, 4)"
STUDY = f"concat('Study ', {SPACED.join(WORD(k) for k in range(6))})"
#: What the bibliography holds, typed by hand: key, type, ord, names, and SQL of title, year, doi, venue.
ENTRIES = [
    ("one", "article", "author,journal,title,year", f"concat('A Big ', {STUDY})", "'2020'", "''", "'J of Tests'"),
    ("two", "article", "author,doi,title,year", "'No journal here'", "'2019'", "concat('10.1/', doc_id)", "''"),
    ("three", "book", "editor,publisher,title,year", f"concat('Book of ', {WORD(6)}, ' ', {WORD(7)})", "'2001'", "''", "''"),
    ("four", "inproceedings", "author,booktitle,note,title,year", f"concat({STUDY}, ' again')", "'1999'", "''", "'Old Place'"),
    ("five", "misc", "title", "''", "''", "''", "''"),
    ("six", "online", "title", "concat('Unknown type ', doc_id)", "''", "''", "''"),
]
PARSED = "p AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{k}' AS key, '{e}' AS etype, '{n}' AS names, {t} AS title, {y} AS year, {d} AS doi, {v} AS venue FROM documents WHERE doc_id % 10 <> 0" for i, (k, e, n, t, y, d, v) in enumerate(ENTRIES)) + ")"


@query(rf"""WITH {PARSED} SELECT CAST(doc_id AS VARCHAR) AS path, CAST(ord AS INTEGER) AS ord, key, etype, names, title, year, doi, venue, CAST(NULL AS VARCHAR) AS error FROM p
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'misc entry at character ' || (instr(t, '@misc{{seven') - 1) || ': a brace is not closed'
FROM (SELECT doc_id, {bib_text("doc_id", True)} AS t FROM documents WHERE doc_id % 10 = 0)""")
def bib_entries(spark, sf_dir):
    get = lambda f: F.try_element_at("fields", F.lit(f))
    some = F.col("error").isNull()
    field = lambda f, c: F.when(some, F.coalesce(f, F.lit(""))).alias(c)
    venue = F.coalesce(get("journal"), get("booktitle"))
    return bib.entries(bib_files(spark, sf_dir)).select("path", "ord", "key", "etype", F.array_join("names", ",").alias("names"), field(get("title"), "title"), field(get("year"), "year"), field(get("doi"), "doi"), field(venue, "venue"), "error")


REQUIRED_SQL = ", ".join(f"('{k}', '{v}')" for k, v in T.REQUIRED_FIELDS.items())
MISSING = f"""WITH r(etype, req) AS (VALUES {REQUIRED_SQL}), {PARSED},
n AS (SELECT doc_id, key, etype, string_split(names, ',') AS n, CASE WHEN req = '' THEN [] ELSE string_split(req, ' ') END AS req FROM p JOIN r USING (etype)),
m AS (SELECT doc_id, key, etype, list_sort(list_concat(list_filter(req, lambda f: NOT list_contains(n, f)),
  CASE WHEN etype IN ('book', 'inbook') AND NOT list_contains(n, 'author') AND NOT list_contains(n, 'editor') THEN ['author'] ELSE [] END)) AS missing FROM n)"""


@query(f"{MISSING} SELECT doc_id, key, etype, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0")
def bib_missing_fields(spark, sf_dir):
    rows = bib.missing_fields(bib.entries(bib_files(spark, sf_dir))).where(F.size("missing") > 0)
    return rows.select(F.col("path").cast("long").alias("doc_id"), "key", "etype", F.array_join("missing", ",").alias("missing"))


@query(f"{MISSING} SELECT count(*) AS checked, count(*) FILTER (len(missing) > 0) AS flagged, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS failed FROM m")
def bib_counters(spark, sf_dir):
    return bib.counters(bib.entries(bib_files(spark, sf_dir)))


AUTHORITY_SQL = f"""SELECT doc_id, concat('A big ', {STUDY}, '.') AS title, CASE WHEN doc_id % 4 = 1 THEN 'Unlike' ELSE 'Journal of Tests' END AS venue, CASE WHEN doc_id % 3 = 0 THEN '2021' ELSE '2020' END AS year, '' AS doi, 0 AS source, 2 * doc_id AS ord FROM documents WHERE doc_id % 5 <> 2
UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'No journal here' ELSE 'Quite another text' END, '', '2019', concat('10.1/', doc_id), 1, 2 * doc_id + 1 FROM documents WHERE doc_id % 7 <> 0"""


def authority(spark, sf_dir):
    """Works for the references: titles, years and venues that differ, and identifiers that are missing, by rules on the id."""
    table(spark, sf_dir, "documents").select("doc_id").createOrReplaceTempView("inkwell_ids")
    sql = AUTHORITY_SQL.replace("FROM documents", "FROM inkwell_ids").replace("AS VARCHAR", "AS STRING")
    return spark.sql(sql).drop("doc_id")


def references(spark, sf_dir):
    """References of all bibliographies, each key with its file's."""
    found = bib.entries(bib_files(spark, sf_dir)).withColumn("key", F.concat_ws("/", "path", "key"))
    return bib.references(found)


TOKENS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> ''))"
LONG = "list_filter({0}, lambda x: length(x) >= 4)"
SIMILAR = lambda a, b: f"(len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE >= 0.7)"
#: Only an authority title of the same document shares 0.7 of the words: six of them are parts of a digest of the id.
VERDICTS = f"""WITH {PARSED}, db AS ({AUTHORITY_SQL}),
t AS (SELECT p.*, {TOKENS.format("p.title")} AS a, {TOKENS.format("p.venue")} AS va FROM p),
c AS (SELECT t.*, d.title AS db_title, d.year AS db_year, d.venue AS db_venue, {TOKENS.format("d.title")} AS b, {TOKENS.format("d.venue")} AS vb, row_number() OVER (PARTITION BY t.doc_id, t.key ORDER BY d.source, d.ord) AS k
  FROM t LEFT JOIN db d ON d.doc_id = t.doc_id AND CASE WHEN t.doi <> '' THEN lower(t.doi) = d.doi ELSE {SIMILAR("a", TOKENS.format("d.title"))} END)
SELECT doc_id || '/' || key AS key, CASE WHEN doi = '' AND title = '' THEN 'unchecked' WHEN db_title IS NULL AND doi <> '' THEN 'doi-not-found' WHEN db_title IS NULL THEN 'not-found'
  WHEN NOT {SIMILAR("a", "b")} THEN 'title-mismatch' WHEN year <> '' AND db_year <> '' AND year <> db_year THEN 'year-mismatch'
  WHEN venue <> '' AND db_venue <> '' AND len({LONG.format("va")}) > 0 AND len({LONG.format("vb")}) > 0 AND NOT list_has_any({LONG.format("va")}, {LONG.format("vb")}) THEN 'venue-mismatch' ELSE 'ok' END AS verdict FROM c WHERE k = 1"""


@query(VERDICTS)
def reference_verdicts(spark, sf_dir):
    return bib.verify(references(spark, sf_dir), authority(spark, sf_dir)).select("key", "verdict")


@query(f"""SELECT verdict, count(*) AS n FROM (SELECT key, verdict FROM ({VERDICTS}) WHERE key NOT IN (SELECT key FROM ({VERDICTS}) WHERE verdict = 'unchecked')) GROUP BY verdict""")
def verdict_counts(spark, sf_dir):
    found = bib.verify(references(spark, sf_dir), authority(spark, sf_dir))
    return found.where("verdict <> 'unchecked'").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PARSED}, db AS ({AUTHORITY_SQL}), j AS (SELECT p.doc_id, p.key, {TOKENS.format("p.title")} AS a, {TOKENS.format("d.title")} AS b FROM p JOIN db d USING (doc_id) WHERE p.doi = '')
SELECT doc_id || '/' || key AS key, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS jaccard FROM j WHERE {SIMILAR("a", "b")}""")
def title_jaccard(spark, sf_dir):
    """Similarity of whole titles of references without an identifier to the authority titles that match them, by the rarest-token join of verification."""
    return bib.title_pairs(references(spark, sf_dir).where("doi = ''"), authority(spark, sf_dir)).select("key", F.round("jaccard", 6).alias("jaccard"))


# --- grounding, diff ---------------------------------------------------------------
QUOTES = [("alpha2020", "words from the source", None), ("beta2021", None, "paywalled"), ("delta2018", "  ", None)]


def edit_plan(spark, sf_dir):
    docs = seed(spark, sf_dir).select("doc_id", "text")
    quotes = spark.createDataFrame(QUOTES, "key string, quote string, todo string")
    return docs, grounding.plan_edits(docs, citations.sites(docs), quotes)


KEYED = r"list_contains(regexp_split_to_array(regexp_replace(split_part(split_part({0}, ' -- ', 1), '\"', 1), '[\s:]+$', ''), '[^A-Za-z0-9_:.\-+/]+'), {1})"
PLAN = rf"""{CITES}, u AS (SELECT doc_id, line, ord, unnest(range(len(ks))) AS k, unnest(ks) AS cite_key FROM (SELECT *, list_filter(keys, lambda x, i: list_position(keys, x) = i) AS ks FROM calls WHERE len(keys) > 0)),
bl AS (SELECT doc_id, line, block, text AS raw FROM st), g AS (SELECT doc_id, line AS pos, block, comment, text AS old FROM st WHERE regexp_matches(comment, '^\s*%+\s*GROUNDING\b')),
q(cite_key, quote, todo) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else quoted(x) for x in row) + ")" for row in QUOTES)}),
j AS (SELECT u.doc_id, u.line, u.ord, u.k, u.cite_key, bl.raw, q.cite_key AS asked, q.quote, q.todo, coalesce(bool_or(contains(comment, '"')), false) AS quoted,
    min(CASE WHEN g.pos > u.line AND NOT contains(comment, '"') THEN g.pos END) AS stub, arg_min(old, CASE WHEN g.pos > u.line AND NOT contains(comment, '"') THEN g.pos END) AS old
  FROM u JOIN bl USING (doc_id, line) LEFT JOIN q USING (cite_key) LEFT JOIN g ON g.doc_id = u.doc_id AND g.block = bl.block AND g.pos >= u.line AND {KEYED.format("comment", "u.cite_key")} GROUP BY ALL),
w AS (SELECT *, regexp_extract(coalesce(old, raw), '^\s*', 0) || '% GROUNDING: ' || cite_key || CASE WHEN trim(coalesce(quote, '')) <> '' THEN ' -- "' || trim(quote) || '"' ELSE ' -- TODO verify -- ' || coalesce(todo, 'not-found') END AS text FROM j),
pl AS (SELECT *, CASE WHEN trim(coalesce(quote, '')) <> '' THEN 'quote' ELSE 'todo' END AS kind, CASE WHEN asked IS NULL THEN 'no_quote' WHEN quoted OR coalesce(old = text, false) THEN 'existing' WHEN stub IS NOT NULL THEN 'replace' ELSE 'insert' END AS status FROM w)"""


@query(f"WITH {PLAN} SELECT status, CASE WHEN status IN ('insert', 'replace') THEN kind END AS kind, count(*) AS n FROM pl GROUP BY ALL")
def edit_plan_counters(spark, sf_dir):
    return grounding.edit_counters(edit_plan(spark, sf_dir)[1])


@query(f"""WITH {PLAN}, rep AS (SELECT doc_id, stub AS line, arg_max(text, (line, ord, k)) AS new FROM pl WHERE status = 'replace' GROUP BY ALL),
rows AS (SELECT l.doc_id, l.line, 0 AS r, 0 AS k, coalesce(new, text) AS t FROM l LEFT JOIN rep USING (doc_id, line)
  UNION ALL SELECT doc_id, line, ord + 1, k, text FROM pl WHERE status = 'insert')
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY line, r, k)) AS digest FROM rows GROUP BY doc_id""")
def apply_edit_plan(spark, sf_dir):
    docs, plan = edit_plan(spark, sf_dir)
    return grounding.apply_edits(docs, plan).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""SELECT doc_id, line, col, glyph FROM ({GLYPH_ROWS}) g WHERE EXISTS (SELECT 1 FROM (VALUES (2, 4), (6, 9), (8, 12)) r(a, b) WHERE line BETWEEN a AND b)""")
def diff_scoped_findings(spark, sf_dir):
    rows = glyph_rows(seed(spark, sf_dir).select("doc_id", "text")).withColumn("last_line", F.col("line"))
    spans = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((2, 4), (6, 9), (8, 12))])))
    return grounding.within_ranges(rows, spans, "doc_id").select("doc_id", "line", "col", "glyph")


@query(f"""WITH g AS (SELECT doc_id, count(*) AS n FROM ({GLYPH_ROWS}) GROUP BY doc_id)
SELECT quality, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS glyphs FROM labels LEFT JOIN g USING (doc_id) GROUP BY quality""")
def tells_by_quality(spark, sf_dir):
    counts = glyph_counts(seed(spark, sf_dir).select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.sum("n").alias("n"))
    rows = table(spark, sf_dir, "labels").join(counts, "doc_id", "left")
    return rows.groupBy("quality").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("glyphs"))


@query(f"""WITH g AS ({GLYPH_ROWS}) SELECT source, glyph, count(*) AS n, CAST(grouping(source) + grouping(glyph) AS INTEGER) AS level FROM g GROUP BY CUBE (source, glyph)""")
def glyph_cube(spark, sf_dir):
    rows = glyph_rows(seed(spark, sf_dir).select("doc_id", "source", "text")).select("source", "glyph")
    return rows.cube("source", "glyph").agg(F.count(F.lit(1)).alias("n"), (F.grouping("source") + F.grouping("glyph")).cast("int").alias("level"))


# --- lint ------------------------------------------------------------------------------
@query(rf"""WITH RECURSIVE {LINES}, f AS (SELECT doc_id, line, regexp_extract(text, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 1) AS mark, regexp_extract(text, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 2) AS rest,
  row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM l WHERE regexp_matches(text, '^ {{0,3}}(`{{3,}}|~{{3,}})')),
z AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS since, CAST(NULL AS VARCHAR) AS mark FROM f
  UNION ALL SELECT f.doc_id, f.i, CASE WHEN z.mark IS NULL THEN CASE WHEN f.mark[1] = '`' AND contains(f.rest, '`') THEN NULL ELSE f.line END
      WHEN f.mark[1] = z.mark[1] AND length(f.mark) >= length(z.mark) AND trim(f.rest) = '' THEN NULL ELSE z.since END,
    CASE WHEN z.mark IS NULL THEN CASE WHEN f.mark[1] = '`' AND contains(f.rest, '`') THEN NULL ELSE f.mark END
      WHEN f.mark[1] = z.mark[1] AND length(f.mark) >= length(z.mark) AND trim(f.rest) = '' THEN NULL ELSE z.mark END
  FROM z JOIN f ON f.doc_id = z.doc_id AND f.i = z.i + 1),
e AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
h AS (SELECT doc_id, min(line) FILTER (line > 1 AND (rtrim(text) = '---' OR NOT regexp_matches(text, '\S'))) AS stop, bool_or(line = 1 AND rtrim(text) = '---') AS opens FROM l GROUP BY doc_id),
m AS (SELECT h.doc_id FROM h LEFT JOIN l ON l.doc_id = h.doc_id AND l.line = h.stop WHERE opens AND coalesce(stop, 99) > 2 AND coalesce(rtrim(l.text), '') <> '---')
SELECT doc_id, CAST(since AS INTEGER) AS line, 'unclosed-fence' AS rule, length(mark) || CASE WHEN mark[1] = '`' THEN '-backtick' ELSE '-tilde' END || ' fence is not closed' AS message FROM e WHERE mark IS NOT NULL
UNION ALL SELECT doc_id, 1, 'unclosed-frontmatter', 'the block that begins on the first line is not closed' FROM m""")
def markdown_blocks(spark, sf_dir):
    return lint.blocks(seed(spark, sf_dir).select("doc_id", "text"))


@query(rf"""WITH {LINES}, a AS (SELECT *, max(line) OVER (PARTITION BY doc_id) AS last, sum(CASE WHEN regexp_matches(text, '^ {{0,3}}(?:`{{3,}}|~{{3,}})') THEN 1 ELSE 0 END) OVER o % 2 = 1 AS inside,
  length(regexp_extract(text, '^(#{{1,6}})\s', 1)) AS lv, NOT regexp_matches(text, '[^\s]') AS blank FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
b AS (SELECT *, CASE WHEN inside THEN 0 ELSE lv END AS level FROM a),
c AS (SELECT *, last_value(nullif(level, 0) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER o AS firsts, lag(blank) OVER o AS pb, lead(blank) OVER o AS nb FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
r AS (
  SELECT doc_id, line, 'md001' AS rule FROM c WHERE level > coalesce(before + 1, 6)
  UNION ALL SELECT doc_id, line, 'md009' FROM c WHERE regexp_matches(text, '\S[ \t]+$') AND NOT regexp_matches(text, '\S  $')
  UNION ALL SELECT doc_id, line, 'md012' FROM c WHERE blank AND coalesce(pb, false) AND NOT inside AND NOT (line = last AND text = '')
  UNION ALL SELECT doc_id, line, 'md022' FROM c WHERE level > 0 AND (NOT coalesce(pb, true) OR NOT coalesce(nb, true))
  UNION ALL SELECT doc_id, line, 'md025' FROM c WHERE level = 1 AND firsts > 1
  UNION ALL SELECT doc_id, line, 'md047' FROM c WHERE line = last AND text <> '')
SELECT doc_id, CAST(line AS INTEGER) AS line, rule FROM r""")
def markdown_line_rules(spark, sf_dir):
    return lint.line_rules(seed(spark, sf_dir).select("doc_id", "text"))


@query(f"""WITH {SEED}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '([^\\n]*\\n[^\\n]*)\\n', '\\1' || chr(13) || chr(10)) ELSE text END AS text FROM s)
SELECT doc_id, CAST(length(regexp_replace(split_part(text, chr(13), 1), '[^\\n]', '', 'g')) + 1 AS INTEGER) AS line, 'crlf-line-endings' AS rule FROM t WHERE contains(text, chr(13))""")
def carriage_returns(spark, sf_dir):
    """The seeded texts; in every third the end of the second line becomes a carriage return and a line feed."""
    planted = F.expr("CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '^([^\\\\n]*\\\\n[^\\\\n]*)\\\\n', '$1\\r\\n') ELSE text END")
    return lint.carriage_returns(seed(spark, sf_dir).select("doc_id", planted.alias("text"))).select("doc_id", "line", "rule")


GENERATED_SQL = f"regexp_matches(text[1:2000], {quoted(T.GENERATED)})"


@query(rf"""WITH {SEED}, r AS (SELECT doc_id, 'src/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.md' END AS path, text AS body,
  CASE WHEN doc_id % 3 = 0 THEN '#!/bin/x' || chr(10) || 'x = ''# no''  # a note' || chr(10) || '\"\"\"Doc' || chr(10) || 'more\"\"\"' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ') ELSE text END AS text FROM s),
o AS (SELECT path, body, doc_id % 3 = 0 AS code, string_split(CASE WHEN doc_id % 3 = 0 THEN body ELSE text END, chr(10)) AS a FROM r WHERE NOT {GENERATED_SQL}),
n AS (SELECT path, code, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS text FROM o),
f AS (SELECT *, regexp_matches(text, '^\s*(```|~~~)') AS fence FROM n WHERE NOT code), k AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY path ORDER BY line) AS z FROM f),
c AS (SELECT path, line + 4 AS line, trim(regexp_replace(regexp_replace(text, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'), '^[*/!]+\s?', '')) AS text FROM n WHERE code
  UNION ALL SELECT path, unnest([2, 3, 4]), unnest(['a note', 'Doc', 'more']) FROM o WHERE code)
SELECT path, CAST(line AS INTEGER) AS line, text FROM c WHERE text <> '' UNION ALL SELECT path, line, rtrim(text) FROM k WHERE NOT fence AND z % 2 = 0 AND regexp_matches(text, '[^\s\x{{A0}}]')""")
def repository_prose(spark, sf_dir):
    return files.repository_prose(repository(spark, sf_dir))


def repository(spark, sf_dir):
    """Seeded texts as a repository: every third a Python source, the rest Markdown."""
    n = F.col("doc_id")
    path = F.concat(F.lit("src/"), n.cast("string"), F.when(n % 3 == 0, F.lit(".py")).otherwise(F.lit(".md")))
    text = F.when(n % 3 == 0, F.concat(F.lit("#!/bin/x\nx = '# no'  # a note\n\"\"\"Doc\nmore\"\"\"\n# "), F.regexp_replace("text", "\n", "\n# "))).otherwise(F.col("text"))
    return seed(spark, sf_dir).select(path.alias("path"), text.alias("text"))
