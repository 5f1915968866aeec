"""The thin ``opN_`` queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.mixing import schedule

    return schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.quality import cascade, metrics

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = metrics(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict, _ = cascade(docs)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict.isNull().alias("kept"))


OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(lines) AS x FROM docs)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters
  FROM docs d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND 4 * n_symbols <= n_words
       AND 2 * n_dup_lines <= n_lines AND (letters = 0 OR 2 * upper <= letters) AS kept
FROM f
"""


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkwell.llm.bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], decoded=False, id_lists=False)


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.mpegts import store

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return store(docs, keep=["doc_id"], media=False, units=False)


def linked_messages(messages: DataFrame) -> DataFrame:
    from inkwell.llm.quotes import conversations

    found = conversations(messages)
    return found.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), "quote_levels", "n_passages", "n_linked", "n_cross", "parent", "thread", "depth")


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_messages(table(spark, sf_dir, "conversations"))


def quoted_messages(messages: DataFrame) -> DataFrame:
    """The conversations with quotes put before the texts, since the table has none: the last message, two levels, and another conversation."""
    from pyspark.sql import Window

    line = lambda c: F.split_part(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(1))
    own = Window.partitionBy("conv_id").orderBy("turn")
    first = messages.where("turn = 0").select((F.col("conv_id") - 1).alias("conv_id"), F.col("text").alias("_next"))
    rows = messages.join(first, "conv_id", "left").withColumns({"_one": F.lag("text").over(own), "_two": F.lag("text", 2).over(own)})
    before = (
        F.when((F.col("conv_id") % 5 == 2) & (F.col("turn") == 0) & F.col("_next").isNotNull(), F.concat(F.lit("> "), line(F.col("_next")), F.lit("\n")))
        .when(((F.col("conv_id") + F.col("turn")) % 4 == 1) & F.col("_two").isNotNull(), F.concat(F.lit("> > "), line(F.col("_two")), F.lit("\n> "), line(F.col("_one")), F.lit("\n")))
        .when(((F.col("conv_id") + F.col("turn")) % 3 == 0) & F.col("_one").isNotNull(), F.concat(F.lit("A. wrote:\n> "), F.replace(F.col("_one"), F.lit("\n"), F.lit("\n> ")), F.lit("\n")))
        .otherwise(F.lit(""))
    )
    return rows.select("conv_id", "turn", "role", F.concat(before, F.coalesce("text", F.lit(""))).alias("text"))


def quotation_linking_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_messages(quoted_messages(table(spark, sf_dir, "conversations")))


def op2_sql(messages: str) -> str:
    marks = r"^[ \t]*((?:>[ \t]?)+)"
    normal = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
    return rf"""
WITH RECURSIVE m AS ({messages}),
l AS (SELECT conv_id, turn, text, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT conv_id, turn, text, string_split(text, chr(10)) AS a FROM m)),
v AS (SELECT *, length(regexp_replace(regexp_extract(line, '{marks}', 1), '[^>]', '', 'g')) AS level, {normal.format(f"regexp_replace(line, '{marks}', '')")} AS said FROM l),
w AS (SELECT *, lead(level, 1, 0) OVER o AS below, CASE WHEN lag(level, 1, -1) OVER o <> level THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS ord FROM w),
q AS (SELECT conv_id, turn, level, ord, list(said ORDER BY pos) AS said FROM r WHERE level > 0 AND said <> '' GROUP BY ALL),
p AS (SELECT conv_id, turn, level, ord, md5(array_to_string(said, ' ')) AS hash, list_transform(said, lambda x: md5(x)) AS each FROM q),
own AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT (below > 0 AND regexp_matches(line, '(?i)\bwrote:[ \t]*$'))), ''), '^\s+|\s+$', '', 'g') AS body
  FROM r GROUP BY conv_id, turn),
parts AS (SELECT conv_id, turn, unnest(list_concat([body], regexp_split_to_array(body, '\n[ \t]*\n'), string_split(body, chr(10)))) AS part FROM own),
offers AS (SELECT conv_id, md5({normal.format("part")}) AS hash, min(turn) AS first FROM parts WHERE {normal.format("part")} <> '' GROUP BY ALL),
asks AS (SELECT conv_id, turn, level, ord, hash, -1 AS k FROM p UNION ALL SELECT conv_id, turn, level, ord, unnest(each), unnest(range(len(each))) FROM p),
fit AS (
  SELECT a.*, o.first AS mine, min(x.conv_id) AS to_conv FROM asks a LEFT JOIN offers o ON o.conv_id = a.conv_id AND o.hash = a.hash AND o.first < a.turn
  LEFT JOIN offers x ON x.hash = a.hash AND x.conv_id <> a.conv_id GROUP BY ALL),
found AS (SELECT f.* EXCLUDE (mine, to_conv), CASE WHEN mine IS NULL THEN f.to_conv ELSE f.conv_id END AS to_conv, coalesce(mine, x.first) AS to_turn
  FROM fit f LEFT JOIN offers x ON x.hash = f.hash AND x.conv_id = f.to_conv),
votes AS (SELECT conv_id, turn, level, ord, to_conv, to_turn, count(*) AS n FROM found WHERE k >= 0 AND to_conv IS NOT NULL GROUP BY ALL),
voted AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn, level, ord ORDER BY to_conv <> conv_id, n DESC, to_conv, to_turn) = 1),
links AS (SELECT f.conv_id, f.turn, f.level, coalesce(f.to_conv, v.to_conv) AS to_conv, CASE WHEN f.to_conv IS NULL THEN v.to_turn ELSE f.to_turn END AS to_turn
  FROM found f LEFT JOIN voted v USING (conv_id, turn, level, ord) WHERE k = -1),
sums AS (SELECT conv_id, turn, max(level) AS quote_levels, count(*) AS n_passages, count(to_conv) AS n_linked, count(*) FILTER (to_conv <> conv_id) AS n_cross FROM links GROUP BY ALL),
up AS (SELECT conv_id, turn, to_turn AS parent FROM links WHERE to_conv = conv_id QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, to_turn DESC) = 1),
tree AS (
  SELECT m.conv_id, m.turn, m.turn AS thread, 0 AS depth FROM m LEFT JOIN up USING (conv_id, turn) WHERE up.parent IS NULL
  UNION ALL SELECT up.conv_id, up.turn, tree.thread, depth + 1 FROM up JOIN tree ON up.conv_id = tree.conv_id AND up.parent = tree.turn)
SELECT m.conv_id, m.turn, m.role, md5(own.body) AS text_md5, CAST(coalesce(quote_levels, 0) AS BIGINT) AS quote_levels, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked,
  coalesce(n_cross, 0) AS n_cross, up.parent, tree.thread, CAST(tree.depth AS BIGINT) AS depth
FROM m JOIN own USING (conv_id, turn) LEFT JOIN sums USING (conv_id, turn) LEFT JOIN up USING (conv_id, turn) JOIN tree USING (conv_id, turn)
"""


QUOTED_SQL = """
SELECT conv_id, turn, role, CASE
  WHEN conv_id % 5 = 2 AND turn = 0 AND following IS NOT NULL THEN '> ' || split_part(following, chr(10), 1) || chr(10)
  WHEN (conv_id + turn) % 4 = 1 AND two IS NOT NULL THEN '> > ' || split_part(two, chr(10), 1) || chr(10) || '> ' || split_part(one, chr(10), 1) || chr(10)
  WHEN (conv_id + turn) % 3 = 0 AND one IS NOT NULL THEN 'A. wrote:' || chr(10) || '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10) ELSE '' END || coalesce(text, '') AS text
FROM (SELECT c.*, n.text AS following, lag(c.text) OVER o AS one, lag(c.text, 2) OVER o AS two
  FROM conversations c LEFT JOIN (SELECT conv_id - 1 AS conv_id, text FROM conversations WHERE turn = 0) n USING (conv_id) WINDOW o AS (PARTITION BY c.conv_id ORDER BY c.turn))"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: an id's thousands, hundreds and tens are its directories; an id that ends in 0, 00 or 000 is
    the licence file of the directory of that size.
    """
    from inkwell.llm.licenses import scan

    part = lambda size: F.expr(f"CAST(doc_id div {size} AS STRING)")
    n = F.col("doc_id")
    path = (
        F.when(n % 1000 == 0, F.concat_ws("/", part(1000), F.lit("LICENSE")))
        .when(n % 100 == 0, F.concat_ws("/", part(1000), part(100), F.lit("LICENSE")))
        .when(n % 10 == 0, F.concat_ws("/", part(1000), part(100), part(10), F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", part(1000), part(100), part(10), F.concat(part(1), F.lit(".txt"))))
    )
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))
    return found.select("doc_id", "path", "own_license", "own_score", "license", "license_dir")


def op8_sql() -> str:
    from inkwell.llm.licenses import TEMPLATES, THRESHOLD

    rows = ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)
    return rf"""
WITH t(license, line) AS (VALUES {rows}),
f AS (
  SELECT doc_id, CASE WHEN doc_id % 1000 = 0 THEN '' || doc_id // 1000 WHEN doc_id % 100 = 0 THEN doc_id // 1000 || '/' || doc_id // 100
              ELSE doc_id // 1000 || '/' || doc_id // 100 || '/' || doc_id // 10 END AS dir,
         CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name, text FROM documents),
h AS (
  SELECT DISTINCT doc_id, dir, name, trim(regexp_replace(x, '\s+', ' ', 'g')) AS line
  FROM (SELECT doc_id, dir, name, unnest(string_split(text, chr(10))) AS x FROM f)
  WHERE regexp_matches(x, '(?i)licen[cs]e|copyright|spdx|public domain')),
every AS (SELECT DISTINCT CAST(NULL AS VARCHAR) AS license, line FROM h UNION ALL SELECT license, line FROM t),
terms AS (
  SELECT license, line, term, count(*) AS tf
  FROM (SELECT license, line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS term FROM every) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
w AS (
  SELECT license, line, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM every)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM terms JOIN df USING (term)),
norms AS (SELECT license, line, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
idx AS (SELECT term, w.license AS dest, w / norm AS u FROM w JOIN norms ON w.license = norms.license),
scores AS (
  SELECT w.line, dest, round(sum(w.w * u) / any_value(norm), 6) AS score
  FROM w JOIN idx USING (term) JOIN norms ON norms.license IS NULL AND norms.line = w.line WHERE w.license IS NULL GROUP BY w.line, dest),
fit AS (
  SELECT h.doc_id, dir, name, score, dest,
         row_number() OVER (PARTITION BY h.doc_id ORDER BY score DESC, dest) AS k
  FROM h JOIN (SELECT * FROM scores WHERE score >= {THRESHOLD}
               QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, dest) = 1) s USING (line)),
own AS (SELECT * FROM fit WHERE k = 1),
givers AS (
  SELECT dir AS license_dir, dest AS given FROM own WHERE name = 'LICENSE'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, dest) = 1),
near AS (
  SELECT f.doc_id, g.license_dir, g.given FROM f JOIN givers g ON f.dir = g.license_dir OR f.dir LIKE g.license_dir || '/%' OR g.license_dir = ''
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.license_dir) DESC) = 1)
SELECT f.doc_id, f.dir || '/' || f.name AS path, own.dest AS own_license, own.score AS own_score,
       coalesce(own.dest, near.given) AS license, CASE WHEN own.dest IS NULL THEN near.license_dir END AS license_dir
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def op3_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.signature_join import link

    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.langid import fit, fold, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold() != 0))
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.withColumn("held_out", fold() == 0)


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.langid import fold
    from inkwell.llm.ngram_lm import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold(parts=7) == 2)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), text=False, spans=False)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS d FROM g GROUP BY doc_id),
one AS (SELECT d, min(doc_id) AS rep, any_value(n) AS n, count(*) AS copies FROM sets GROUP BY d),
k AS (SELECT rep, s FROM g JOIN one ON doc_id = rep),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM k a JOIN k b ON a.s = b.s AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN one x ON x.rep = a JOIN one y ON y.rep = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT rep AS a, rep AS b FROM one UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
least AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(copies, 1) AS n_copies_of_set
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN one USING (d) LEFT JOIN least USING (rep)
"""

#: Bytes as pairs of hexadecimal digits; the windows of a text are cut from parts of a thousand bytes.
OP6_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(length(h), 1), 2000)) AS base, h FROM h),
q AS (SELECT doc_id, base // 2 AS base, substring(h, base + 1, 2400) AS part FROM p),
b AS (SELECT doc_id, base + i AS i, part[2 * i + 1:2 * i + 2] AS x, CASE WHEN length(part) >= 2 * i + 400 THEN hash(part[2 * i + 1:2 * i + 400]) END AS m
  FROM (SELECT doc_id, base, part, unnest(range(0, least(1000, length(part) // 2))) AS i FROM q)),
n AS (SELECT m FROM b WHERE m IS NOT NULL GROUP BY m HAVING count(*) > 1),
s AS (SELECT doc_id, i, x, max(CASE WHEN n.m IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM b LEFT JOIN n USING (m)),
g AS (SELECT doc_id, i, x, coalesce(last > i - 200, false) AS gone FROM s),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
o AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT h.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN o USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_signature_trees": op3_signature_trees,
    "op4_output_codes": op4_output_codes,
    "op10_transport_stream": op10_transport_stream,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_license_scan": op8_license_scan,
    "op9_bpe_encoding": op9_bpe_encoding,
    "quotation_linking_seeded": quotation_linking_seeded,
}
ORACLES: dict[str, str] = {
    "op3_signature_trees": OP3_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op7_quality_cascade": OP7_SQL,
    "op8_license_scan": op8_sql(),
    "op2_quotation_linking": op2_sql("SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations"),
    "quotation_linking_seeded": op2_sql(QUOTED_SQL),
}
