"""Queries of the rules that look across a text, of sources, sinks and fixes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import tables as T
from inkwell.operators import bib, citations, grounding, lint, report, review, rules
from inkwell.operators.glyphs import glyph_rows
from inkwell.operators.segment import lines, paragraph_rows, prose_lines
from inkwell.plans.queries import CITES, CODE, CONTEXT, FENCED, GLYPH_ROWS, HITS, LANGUAGE, LINES, MISSING, PARAS, PARSED, SEED, SENTENCES, bib_files, english, hits, listing, query, seed, table
from inkwell.plans.seeded import quoted
from inkwell.sources import files

WORDS = "regexp_extract_all(lower({0}), '[a-z]+(?:''[a-z]+)?')"
EVERY = PARAS.replace(f" WHERE lang = '{LANGUAGE}'", "")
SECTIONS = rf"""{LINES}, sh AS (SELECT doc_id, line, text, coalesce(nullif(regexp_extract(text, '^#{{1,2}}\s+(.*?)\s*#*\s*$', 1), ''), nullif(regexp_extract(text, '^\s*\\(?:sub)*section\*?\{{([^}}]*)\}}', 1), '')) AS h FROM l),
sc AS (SELECT doc_id, line, text, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM sh),
ss AS (SELECT doc_id, line, lower(section) AS section, unnest(range(len(a))) AS k, unnest(a) AS text FROM (
  SELECT *, list_filter(list_transform(regexp_extract_all(text, '(?:[^.!?\n]+|\.\d)+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS a FROM sc WHERE NOT regexp_matches(text, '^#{{1,6}}\s|^\s*\\(?:sub)*section')))"""
INT = "CAST({0} AS INTEGER) AS {0}"


def texts(spark, sf_dir):
    return seed(spark, sf_dir).select("doc_id", "text")


@query(rf"""WITH {LINES}, n AS (SELECT doc_id, line, text, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS following FROM l WHERE regexp_matches(text, '\S'))
SELECT doc_id, {INT.format("line")} FROM n WHERE NOT regexp_matches(text, {quoted(review.LIST_ITEM)}) AND regexp_matches(text, '[a-z]\.\s*$') AND regexp_matches(following, {quoted(review.LIST_ITEM)})""")
def introducers(spark, sf_dir):
    return review.introducers(texts(spark, sf_dir))


def begins(words) -> str:
    return f"regexp_matches(text, {quoted('(?i)^(?:' + '|'.join(words) + r')' + chr(92) + 'b')})"


@query(f"""WITH {SECTIONS}, e AS (SELECT *, (line, k) = min((line, k)) OVER o AS f, (line, k) = max((line, k)) OVER o AS z FROM ss WHERE section IS NOT NULL WINDOW o AS (PARTITION BY doc_id, section))
SELECT doc_id, {INT.format("line")}, section, CASE WHEN f AND {begins(T.OPENINGS)} THEN 'opening' ELSE 'closing' END AS edge, text FROM e WHERE (f AND {begins(T.OPENINGS)}) OR (z AND {begins(T.CLOSINGS)})""")
def section_edges(spark, sf_dir):
    return review.section_edges(texts(spark, sf_dir))


@query(rf"""WITH {SENTENCES}, b AS (SELECT doc_id, text, coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 350 AS page FROM sw)
SELECT doc_id, CAST(page AS BIGINT) AS page, count(*) AS n FROM b WHERE regexp_matches(text, '^[A-Z][a-z]+ing\b[^.]*,') GROUP BY ALL HAVING count(*) > 1""")
def participial_pages(spark, sf_dir):
    return review.participial_pages(texts(spark, sf_dir))


@query(rf"""WITH {EVERY}, w AS (SELECT doc_id, para, len({WORDS.format("text")}) AS w, len(list_filter(list_transform(regexp_extract_all(text, '(?:[^.!?\n]+|\.\d)+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM p),
b AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 350 AS page FROM w)
SELECT doc_id, CAST(page AS BIGINT) AS page, count(*) AS n FROM b WHERE s = 1 GROUP BY ALL HAVING count(*) > 2""")
def single_sentence_pages(spark, sf_dir):
    return review.single_sentence_pages(texts(spark, sf_dir))


@query(f"""WITH {SENTENCES}, f AS (SELECT doc_id, ord, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM sw WHERE n_words <= 3)
SELECT doc_id, min(ord) AS start, count(*) AS length FROM f GROUP BY doc_id, island HAVING count(*) >= 3""")
def fragments(spark, sf_dir):
    return review.fragments(texts(spark, sf_dir))


@query(f"""WITH {SENTENCES} SELECT doc_id, count(*) AS n FROM sw WHERE regexp_matches(text, '(?i)^(?:{"|".join(T.ORDINALS)}),') GROUP BY doc_id HAVING count(*) >= 3""")
def ordinal_lists(spark, sf_dir):
    return review.ordinal_lists(texts(spark, sf_dir))


@query(f"""WITH {HITS}, c AS (SELECT doc_id, class, count(*) AS n FROM h WHERE class LIKE 'trope%' GROUP BY ALL)
SELECT doc_id, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS hits, max(n) AS most FROM c GROUP BY doc_id""")
def trope_score(spark, sf_dir):
    return review.trope_score(hits(spark, sf_dir))


SYNONYMS = [("review", "code review"), ("review", "code inspection"), ("review", "code assessment"), ("model", "language model"), ("model", "large model")]


@query(f"""WITH {SEED}, v(concept, phrase) AS (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in SYNONYMS)}),
f AS (SELECT doc_id, concept, phrase FROM s JOIN v ON contains(' ' || array_to_string({WORDS.format("text")}, ' ') || ' ', ' ' || phrase || ' ') WHERE lang = '{LANGUAGE}')
SELECT doc_id, concept, array_to_string(list_sort(list(DISTINCT phrase)), ',') AS terms FROM f GROUP BY ALL HAVING count(DISTINCT phrase) > 1""")
def mixed_terms(spark, sf_dir):
    return review.mixed_terms(english(spark, sf_dir), rules.lexicon(spark, SYNONYMS)).withColumn("terms", F.array_join("terms", ","))


@query(rf"""WITH {SECTIONS} SELECT doc_id, {INT.format("line")}, unnest(regexp_extract_all(lower(text), '\b({"|".join(T.COMPLIMENTS)})\b', 1)) AS word FROM sc WHERE contains(lower(section), 'related work')""")
def compliments(spark, sf_dir):
    return review.compliments(texts(spark, sf_dir))


@query(rf"""WITH {SECTIONS} SELECT doc_id, {INT.format("line")}, section, lower(unnest(regexp_extract_all(text, '(?i)\bwe ({"|".join(T.STUDY_VERBS)})\b', 1))) AS verb, 'past' AS expected FROM ss WHERE section IN ({listing(T.PAST_SECTIONS)})
UNION ALL SELECT doc_id, CAST(line AS INTEGER), section, lower(unnest(regexp_extract_all(text, '(?i)\bwe ({"|".join(T.PAPER_VERBS)})\b', 1))), 'present' FROM ss""")
def tense(spark, sf_dir):
    return review.tense(texts(spark, sf_dir))


@query(f"""WITH {SECTIONS}, n AS (SELECT doc_id, section, {WORDS.format("text")} AS w FROM ss WHERE section IS NOT NULL AND NOT regexp_matches(section, {quoted(review.ABSTRACT)}))
SELECT doc_id, array_to_string(w, ' ') AS said, count(DISTINCT section) AS sections FROM n WHERE len(w) >= 4 GROUP BY ALL HAVING count(DISTINCT section) > 1""")
def cross_section_duplicates(spark, sf_dir):
    return review.cross_section_duplicates(texts(spark, sf_dir))


@query(rf"""WITH {SECTIONS}, i AS (SELECT *, regexp_matches(section, {quoted(review.ABSTRACT)}) AS inside FROM ss WHERE section IS NOT NULL),
g AS (SELECT doc_id, inside, unnest(regexp_extract_all(text, '\(([A-Z]{{2,6}})\)', 1)) AS acronym FROM i),
u AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z]{{2,6}})\b', 1)) AS acronym FROM i WHERE NOT inside)
SELECT doc_id, acronym, count(*) AS uses FROM u WHERE (doc_id, acronym) IN (SELECT (doc_id, acronym) FROM g WHERE inside) AND (doc_id, acronym) NOT IN (SELECT (doc_id, acronym) FROM g WHERE NOT inside) GROUP BY ALL""")
def terms_left_to_abstract(spark, sf_dir):
    return review.terms_left_to_abstract(texts(spark, sf_dir))


@query(rf"""WITH {LINES}, t AS (SELECT doc_id, line, text, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM l WHERE starts_with(text, '|')),
c AS (SELECT doc_id, i, unnest(range(len(a))) AS col, trim(unnest(a)) AS cell FROM (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(text, '^\|', ''), '\|\s*$', ''), '|') AS a FROM t)),
m AS (SELECT doc_id, i, min(line) AS start FROM t GROUP BY ALL)
SELECT doc_id, {INT.format("start")}, {INT.format("col")}, count(DISTINCT length(regexp_extract(cell, '\.(\d+)', 1))) AS kinds FROM c JOIN m USING (doc_id, i) WHERE regexp_matches(cell, '^\s*[-+]?\d[\d,]*(?:\.\d+)?%?\s*$')
GROUP BY doc_id, start, col HAVING count(DISTINCT length(regexp_extract(cell, '\.(\d+)', 1))) > 1""")
def mixed_decimals(spark, sf_dir):
    return review.mixed_decimals(texts(spark, sf_dir))


@query(rf"""WITH {LINES}, c AS (SELECT doc_id, {CODE} AS code FROM l),
r AS (SELECT doc_id, trim(unnest(string_split(x, ','))) AS label FROM (SELECT doc_id, unnest(regexp_extract_all(code, '\\(?:auto|c|C|v|page|name|eq)?ref\*?\{{([^}}]*)\}}', 1)) AS x FROM c))
SELECT DISTINCT doc_id, label FROM (SELECT doc_id, unnest(regexp_extract_all(code, '\\label\{{((?:fig|tab)[^}}]*)\}}', 1)) AS label FROM c) WHERE (doc_id, label) NOT IN (SELECT (doc_id, label) FROM r)""")
def unreferenced_labels(spark, sf_dir):
    return review.unreferenced_labels(texts(spark, sf_dir))


@query(rf"""WITH {LINES}, c AS (SELECT doc_id, line, regexp_extract(text, '^(Figure|Table)', 1) AS kind, CAST(regexp_extract(text, '^\w+ (\d+)', 1) AS INTEGER) AS n FROM l WHERE regexp_matches(text, '^(?:Figure|Table) \d+[.:]')),
b AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY doc_id, kind ORDER BY line), 0) AS before FROM c) SELECT doc_id, kind, n, before FROM b WHERE n <> before + 1""")
def number_gaps(spark, sf_dir):
    return review.number_gaps(texts(spark, sf_dir))


@query(rf"""WITH {SECTIONS}, i AS (SELECT *, regexp_matches(lower(section), {quoted(review.ABSTRACT)}) AS inside FROM sc WHERE section IS NOT NULL)
SELECT doc_id, {INT.format("line")}, 'citation-in-abstract' AS rule FROM i WHERE inside AND regexp_matches({CODE}, {quoted(T.CITE)})
UNION ALL SELECT doc_id, CAST(line AS INTEGER), 'list-in-body' FROM i WHERE NOT inside AND regexp_matches(text, {quoted(review.LIST_ITEM)})
UNION ALL SELECT doc_id, CAST(line AS INTEGER), 'first-person-singular' FROM i WHERE regexp_matches(text, '\bI (?:am|was|have|will|did|show|find|think)\b')""")
def abstract_and_lists(spark, sf_dir):
    return review.abstract_and_lists(texts(spark, sf_dir))


AUTHORS = "@article{s1, author = {Smith, Ann and Doe, Joe}, title = {T}}\n@misc{s0, author = {Smith}}\n@misc{j1, author = {Jones, X}}"


@query(rf"""WITH {LINES}, c AS (SELECT doc_id, line, {CODE} AS code FROM l WHERE contains(text, 'et al.')),
n AS (SELECT doc_id, line, unnest(regexp_extract_all(code, '\b([A-Z][a-z]+) et al\.', 1)) AS name FROM c)
SELECT doc_id, {INT.format("line")}, name, CASE WHEN name = 'Smith' THEN 's0,s1' ELSE '' END AS cite_keys FROM n""")
def typed_authors(spark, sf_dir):
    entries = bib.entries(spark.createDataFrame([("a.bib", AUTHORS)], "path string, text string"))
    return review.typed_authors(texts(spark, sf_dir), entries).withColumn("cite_keys", F.array_join("cite_keys", ","))


@query(f"""WITH {SEED}, w AS (SELECT doc_id, len({WORDS.format("text")}) AS total, unnest({WORDS.format("text")}) AS word FROM s WHERE lang = '{LANGUAGE}')
SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 6 GROUP BY doc_id, total, word HAVING count(*) >= 5 AND count(*) > 0.05 * total""")
def repeated_nouns(spark, sf_dir):
    return review.repeated_nouns(english(spark, sf_dir))


@query(f"""WITH {HITS} SELECT doc_id, para, pos, phrase, suggestion, exception FROM h WHERE class = 'restricted' AND phrase NOT IN ('foster', 'utilize')""")
def restricted_with_exceptions(spark, sf_dir):
    """Restricted words that a layer doesn't permit, with their alternatives and when they are acceptable."""
    allow = spark.createDataFrame([("foster",), ("utilize",)], "phrase string")
    rows = rules.lexicon_hits(paragraph_rows(english(spark, sf_dir)), rules.lexicon(spark, rules.default_lexicon()), allow)
    return rows.where("class = 'restricted'").select("doc_id", "para", "pos", "phrase", "suggestion", "exception")


# --- fixes, sinks, reports ----------------------------------------------------------
@query(rf"""WITH {LINES}, f AS (SELECT *, sum(CAST(regexp_matches(text, '^ {{0,3}}(?:`{{3,}}|~{{3,}})') AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS z FROM l),
c AS (SELECT doc_id, line, z, CASE WHEN z % 2 = 1 THEN text WHEN regexp_matches(text, '^[ \t]*$') THEN '' ELSE regexp_replace(text, '(\S)(?:[ \t]*\t[ \t]*| | {{3,}})$', '\1') END AS text FROM f),
k AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, z ORDER BY line) AS above FROM c),
j AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line) AS t FROM k WHERE z % 2 = 1 OR text <> '' OR coalesce(above, 'x') <> '' GROUP BY doc_id)
SELECT doc_id, md5(regexp_replace(t, '\n+$', '') || chr(10)) AS digest FROM j""")
def markdown_fixed(spark, sf_dir):
    """The seeded texts, with blank runs and trailing space put in before a third of them, after the fixes."""
    return lint.fixed(texts(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


REPORTS = "concat('# Prose Review\n\n#### Finding 1\n\n**Rule:** a\n**Location:** b\n', CASE WHEN doc_id % 2 = 0 THEN '**Quote:** c\n' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '**Suggested revision:** d\n' ELSE '' END, '```\n#### Finding 2\n```\n#### Finding 3\n**Rule:** **Location:** **Quote:** **Suggested revision:**\n')"
RULE_FILES = "concat('# Writing Rules\n\n', CASE WHEN doc_id % 2 = 0 THEN '## Tropes to Avoid\ntext\n' ELSE '## Other\n' END, CASE WHEN doc_id % 4 = 0 THEN '# Inner\n' ELSE '' END, CASE WHEN doc_id % 6 = 0 THEN '## Tropes to Avoid\n' ELSE '' END)"


@query("""SELECT doc_id, CAST(3 AS INTEGER) AS line, 'finding-block-missing-label' AS rule, '**Quote:**' AS message FROM documents WHERE doc_id % 2 <> 0
UNION ALL SELECT doc_id, 3, 'finding-block-missing-label', '**Suggested revision:**' FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT -doc_id - 1, 1, 'writing-md-structure', 'no catalog section' FROM documents WHERE doc_id % 2 <> 0
UNION ALL SELECT -doc_id - 1, 5, 'writing-md-structure', 'H1 in the catalog section' FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT -doc_id - 1, CASE WHEN doc_id % 4 = 0 THEN 6 ELSE 5 END, 'writing-md-structure', 'second catalog section' FROM documents WHERE doc_id % 6 = 0""")
def document_structure(spark, sf_dir):
    """A report for each document, and (ids below zero) a rules file, whose parts are there by rules on the id; expected rows by hand."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.expr(REPORTS).alias("text")).unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.expr(RULE_FILES).alias("text")))
    return lint.structure(rows)


@query(rf"""WITH {FENCED} SELECT 'doc/' || doc_id || ':' || line || ':' || rtrim(text) AS value FROM r WHERE NOT fence AND k % 2 = 0 AND regexp_matches(text, '[^\s\x{{A0}}]')""")
def grep_lines(spark, sf_dir):
    rows = prose_lines(texts(spark, sf_dir)).select(F.lit(0).alias("section"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "line", "text")
    return report.grep_lines(rows)


def findings(spark, sf_dir):
    """Glyph findings of files, and of commits for every fifth document, in the schema of findings."""
    rows = glyph_rows(texts(spark, sf_dir))
    name = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("doc/"), name))
    return report.as_findings(rows, source=F.concat(F.lit("c"), name), path=path, line=F.col("line"), col=F.col("col"), rule_id=F.col("glyph"), layer="general", tier="D", context=F.col("context"))


@query(f"""WITH g AS ({GLYPH_ROWS}) SELECT CASE WHEN doc_id % 5 = 0 THEN 'commit' ELSE 'file' END AS section, CASE WHEN doc_id % 5 = 0 THEN 'c' ELSE 'doc/' END || doc_id AS place, count(*) AS n, count(DISTINCT glyph) AS rules FROM g GROUP BY doc_id""")
def repository_review(spark, sf_dir):
    return report.by_place(findings(spark, sf_dir))


@query(f"""WITH g AS ({GLYPH_ROWS}) SELECT 'general' AS layer, glyph AS rule_id, count(*) AS n, count(DISTINCT CASE WHEN doc_id % 5 <> 0 THEN doc_id END) AS texts FROM g GROUP BY glyph""")
def finding_metrics(spark, sf_dir):
    return report.metrics(findings(spark, sf_dir))


@query(f"""WITH {HITS}, b AS (SELECT 'doc/' || doc_id AS path, CAST(para AS INTEGER) AS line, class, phrase, suggestion FROM h WHERE class IN ('british', 'padding')),
n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY path, line, 'r', phrase) AS n FROM (SELECT DISTINCT * FROM b))
SELECT class AS section, CAST(n AS INTEGER) AS n, path, line, '#### Finding ' || n || chr(10) || chr(10) || '**Rule:** r' || chr(10) || '**Location:** ' || path || ':' || line || chr(10) || '**Quote:** ' || phrase || chr(10)
  || '**Suggested revision:** ' || coalesce(suggestion, '') || chr(10) AS value FROM n""")
def report_blocks(spark, sf_dir):
    rows = hits(spark, sf_dir).where("class in ('british', 'padding')").select("doc_id", "para", "class", "phrase", "suggestion").distinct()
    place = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return report.markdown_blocks(report.as_findings(rows, path=place, line=F.col("para"), rule_id="r", layer=F.col("class"), quote=F.col("phrase"), suggestion=F.col("suggestion")))


@query(f"""WITH {HITS} SELECT doc_id, phrase, count(*) AS n FROM h WHERE suggestion = '' GROUP BY ALL""")
def empty_suggestions(spark, sf_dir):
    rows = hits(spark, sf_dir)
    found = report.empty_suggestions(report.as_findings(rows, path=F.col("doc_id").cast("string"), quote=F.col("phrase"), suggestion=F.col("suggestion")))
    return found.groupBy(F.col("path").cast("long").alias("doc_id"), F.col("quote").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN list_contains(string_split(text, chr(10)), 'x.cfg') THEN 0 ELSE 1 END AS added FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'x.cfg' ELSE '' END AS text FROM documents)")
def appended_once(spark, sf_dir):
    """How many lines two appends of one entry add to each text; every third has it already."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.lit("\nx.cfg")).otherwise("")).alias("text"))
    twice = report.append_once(report.append_once(F.col("text"), "x.cfg"), "x.cfg")
    count = lambda t: F.size(F.filter(F.split(t, "\n"), lambda x: x == "x.cfg"))
    return docs.select("doc_id", (count(twice) - count(F.col("text"))).alias("added"))


# --- sources -----------------------------------------------------------------------
def project(spark, sf_dir):
    """A LaTeX project: file n includes files 2n+1 and 2n+2, some in comments; every fourth is a root; bibliographies by thousands."""
    n = F.col("doc_id")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    text = F.concat(
        F.when(n % 4 == 0, F.lit("\\documentclass{a}\n\\begin{document}\n")).otherwise(F.lit("% \\documentclass{a}\n\\begin{document}\n")),
        F.lit("\\input{"), name(2 * n + 1), F.lit("}\n"), F.when(n % 7 == 3, F.lit("% ")).otherwise(F.lit("")), F.lit("\\include{"), name(2 * n + 2), F.lit(".tex}\n"),
        F.lit("\\bibliography{refs"), (n % 3).cast("string"), F.lit(", none}\n"),
    )
    docs = table(spark, sf_dir, "documents")
    bibs = spark.createDataFrame([(f"refs{k}.bib", "") for k in range(3)], "path string, text string")
    return docs.select(F.concat(F.when(n % 8 == 0, F.lit("")).otherwise(F.lit("")), name(n), F.lit(".tex")).alias("path"), text.alias("text")).unionByName(bibs)


@query("SELECT 'f' || doc_id || '.tex' AS path FROM documents WHERE doc_id % 4 = 0")
def latex_roots(spark, sf_dir):
    return files.latex_roots(project(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS a, 2 * doc_id + 1 AS b FROM documents UNION ALL SELECT doc_id, 2 * doc_id + 2 FROM documents WHERE doc_id % 7 <> 3),
w AS (SELECT CAST(0 AS BIGINT) AS n UNION SELECT e.b FROM w JOIN e ON e.a = w.n JOIN documents d ON d.doc_id = e.b) SELECT 'f' || n || '.tex' AS path FROM w""")
def include_graph(spark, sf_dir):
    return files.include_graph(project(spark, sf_dir), "f0.tex")


@query("SELECT 'refs' || doc_id % 3 || '.bib' AS path, 'f' || min('' || doc_id) || '.tex' AS first FROM documents GROUP BY doc_id % 3")
def bibliography_files(spark, sf_dir):
    return files.bibliographies(project(spark, sf_dir)).select("path", F.col("ord")["path"].alias("first"))


DIFF = "concat('--- a/f', doc_id, '\n+++ b/f', doc_id, '\n@@ -1 +', doc_id % 5 + 1, ',2 @@\n+a\n@@ -9,2 +10,0 @@\n-c\n@@ -0,0 +', 20 + doc_id % 3, ' @@\n+d')"


@query("""SELECT 'f' || doc_id AS path, CAST(doc_id % 5 + 1 AS INTEGER) AS first, CAST(doc_id % 5 + 2 AS INTEGER) AS last FROM documents
UNION ALL SELECT 'f' || doc_id, CAST(20 + doc_id % 3 AS INTEGER), CAST(20 + doc_id % 3 AS INTEGER) FROM documents""")
def diff_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.expr(DIFF), "\n")).alias("p", "text"))
    return files.diff_ranges(rows.select((F.col("doc_id") * 100 + F.col("p")).alias("line"), "text"))


@query(f"""{MISSING}, cited AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0)
SELECT DISTINCT key, etype, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0 AND key = 'two'""")
def newly_cited_entries(spark, sf_dir):
    """Incomplete entries that a citation on a changed line names: of the keys cited there, ``two`` alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("a\nSee \\cite{one, two} here.\nSee \\cite{four}.").alias("text"))
    ranges = docs.select("doc_id", F.lit(2).alias("first"), F.lit(2).alias("last"))
    rows = bib.missing_fields(bib.entries(bib_files(spark, sf_dir))).where(F.size("missing") > 0)
    return bib.newly_cited(rows, citations.sites(docs), ranges).select("key", "etype", F.array_join("missing", ",").alias("missing")).distinct()


@query(f"""WITH {PARSED} SELECT key, min(etype) AS type, arg_min(title, doc_id || '') AS title, arg_min(year, doc_id || '') AS year, arg_min(doi, doc_id || '') AS doi FROM p WHERE key IN ('one', 'two', 'four') GROUP BY key""")
def bib_metadata(spark, sf_dir):
    """Metadata of three used keys, from the first file in order of path that has them."""
    used = spark.createDataFrame([("one",), ("two",), ("four",), ("gone",)], "key string")
    return bib.metadata(bib.entries(bib_files(spark, sf_dir)), used).select("key", "type", "title", "year", "doi")


@query(f"WITH {CITES} SELECT DISTINCT unnest(keys) AS key FROM calls EXCEPT SELECT key FROM (VALUES ('alpha2020'), ('gamma2019')) t(key)")
def keys_without_metadata(spark, sf_dir):
    entries = bib.entries(spark.createDataFrame([("a.bib", "@misc{alpha2020, title={x}}\n@misc{gamma2019, title={y}}")], "path string, text string"))
    used = citations.sites(texts(spark, sf_dir)).where("groundable").select(F.explode("keys").alias("key"))
    return bib.without_metadata(entries, used)


@query(f"""WITH {CITES}, u AS (SELECT DISTINCT unnest(keys) AS cite_key FROM calls WHERE state <> 'quote') SELECT cite_key, CASE WHEN cite_key = 'alpha2020' THEN 'x' END AS title FROM u""")
def grounding_bundle(spark, sf_dir):
    """Open keys and the title that the bundle for readers has for them."""
    entries = bib.entries(spark.createDataFrame([("a.bib", "@misc{alpha2020, title={x}}")], "path string, text string"))
    found = citations.sites(texts(spark, sf_dir))
    meta = bib.metadata(entries, found.select(F.explode("keys").alias("key")))
    return grounding.input_bundle(found, meta).select("cite_key", F.get_json_object("value", "$.title").alias("title"))


@query(f"SELECT doc_id, {CONTEXT} AS head FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def contexts(spark, sf_dir):
    from inkwell.functions.text import context, empty

    return table(spark, sf_dir, "documents").select("doc_id", context(empty(F.col("text"))).alias("head"))


@query("SELECT turn AS ord, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM conversations) WHERE place < 200 GROUP BY turn")
def newest_messages(spark, sf_dir):
    """The first 200 messages of the table, as a selector of commits takes them (the limit is the feature), counted by turn."""
    rows = table(spark, sf_dir, "conversations").withColumn("ord", F.struct("conv_id", "turn"))
    return files.select_messages(rows).groupBy(F.col("turn").alias("ord")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, title, venue, year FROM (SELECT doc_id, 'T' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'V' ELSE '' END AS venue,
  CASE WHEN doc_id % 3 = 0 THEN '2001' WHEN doc_id % 3 = 1 THEN '1999' ELSE '' END AS year FROM documents)""")
def record_projection(spark, sf_dir):
    """Works as JSON, whose date and venue are there by rules on the id, as authority rows."""
    n = F.col("doc_id")
    date = F.when(n % 3 == 0, F.lit(', "issued": {"date-parts": [[2001, 4]]}, "published-online": {"date-parts": [[2000]]}')).when(n % 3 == 1, F.lit(', "issued": {"date-parts": [[]]}, "published-print": {"date-parts": [[1999]]}')).otherwise(F.lit(""))
    value = F.concat(F.lit('{"DOI": "10.1/x", "title": ["T'), n.cast("string"), F.lit('", "U"]'), F.when(n % 2 == 0, F.lit(', "container-title": ["V", "W"]')).otherwise(F.lit("")), date, F.lit("}"))
    raw = table(spark, sf_dir, "documents").select(n.alias("ord"), value.alias("value"))
    return bib.records(raw).select(F.col("ord").alias("doc_id"), "title", "venue", "year")


@query(f"""WITH {LINES}, q AS (SELECT doc_id, line, text FROM l WHERE regexp_matches(text, '\\S')),
f AS (SELECT doc_id, min(line) AS line, arg_min(text, line) AS quote FROM q GROUP BY doc_id)
SELECT doc_id, CAST(line + 3 AS INTEGER) AS line, CAST(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (SELECT arg_min(l.line, (abs(l.line - f.line - 3), l.line)) FROM l WHERE l.doc_id = f.doc_id AND contains(l.text, f.quote)) END AS INTEGER) AS at,
  CASE WHEN doc_id % 4 = 0 THEN 'absent' ELSE 'found' END AS status FROM f""")
def applied_findings(spark, sf_dir):
    """Findings that quote each text's first line three lines too low (in every fourth with a word that isn't there), with where the quote stands."""
    docs = texts(spark, sf_dir)
    first = lines(docs).where(F.col("text").rlike(r"\S")).groupBy("doc_id").agg(F.min(F.struct("line", "text")).alias("f"))
    quote = F.when(F.col("doc_id") % 4 == 0, F.lit("\x03 no such words")).otherwise(F.col("f.text"))
    found = first.select("doc_id", (F.col("f.line") + 3).alias("line"), quote.alias("quote"), F.lit("x").alias("suggestion"))
    return grounding.apply_findings(docs, found).select("doc_id", "line", "at", "status")
