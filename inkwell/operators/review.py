"""Rules that look across sentences, sections, tables and labels of a text: candidates for a reader, not verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import tables as T
from inkwell.functions import text as X
from inkwell.operators.citations import marked_lines
from inkwell.operators.segment import keep, lines, pages_of, paragraph_rows, section_lines, sentence_rows

LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s"
ABSTRACT = r"(?i)^abstract\b"


def section_sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences of lines with their section: line, k (from 0 in the line), section (lower case), text; headings are left out."""
    rows = section_lines(docs, key).where(~F.col("text").rlike(r"^#{1,6}\s|^\s*\\(?:sub)*section")).withColumn("section", F.lower("section"))
    return rows.select(key, "line", "section", F.posexplode(X.sentences(F.col("text"))).alias("k", "text"))


def introducers(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that end with a full stop right before a list (blank lines between them don't count): line."""
    rows = lines(docs).where(F.col("text").rlike(r"\S"))
    following = F.lead("text").over(Window.partitionBy(key).orderBy("line"))
    return rows.withColumn("_n", following).where(~F.col("text").rlike(LIST_ITEM) & F.col("text").rlike(r"[a-z]\.\s*$") & F.col("_n").rlike(LIST_ITEM)).select(key, "line")


def section_edges(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """First sentences of sections that begin with a formulaic opening, last ones that begin with a closing one: line, section, edge, text."""
    rows = section_sentences(docs, key).where("section is not null")
    own = Window.partitionBy(key, "section")
    place = F.struct("line", "k")
    rows = rows.withColumns({"first": F.min(place).over(own) == place, "last": F.max(place).over(own) == place})
    begins = lambda words: F.col("text").rlike(X.edged(r"(?i)^(?:" + "|".join(words) + r")\b"))
    edge = F.when(F.col("first") & begins(T.OPENINGS), "opening").when(F.col("last") & begins(T.CLOSINGS), "closing")
    return rows.withColumn("edge", edge).where("edge is not null").select(key, "line", "section", "edge", "text")


def participial_pages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages (350 words, from 0) with more than one sentence that begins with a participle clause: page, n."""
    before = F.coalesce(F.sum("n_words").over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sentence_rows(docs).withColumn("page", F.floor(before / T.PAGE_WORDS)).where(F.col("text").rlike(X.edged(r"^[A-Z][a-z]+ing\b[^.]*,")))
    return rows.groupBy(key, "page").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def single_sentence_pages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages (350 words, from 0) with more than two paragraphs of one sentence: page, n."""
    rows = paragraph_rows(docs).withColumns({"_w": F.size(X.words(F.col("text"))), "_s": F.size(X.sentences(F.col("text")))})
    before = F.coalesce(F.sum("_w").over(Window.partitionBy(key).orderBy("para").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("page", F.floor(before / T.PAGE_WORDS)).where("_s = 1").groupBy(key, "page").agg(F.count(F.lit(1)).alias("n")).where("n > 2")


def fragments(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of three or more sentences of at most three words: start, length."""
    rows = sentence_rows(docs).withColumn("few", F.col("n_words") <= 3)
    island = F.col("ord") - F.row_number().over(Window.partitionBy(key, "few").orderBy("ord"))
    rows = rows.withColumn("island", island).where("few")
    return rows.groupBy(key, "island").agg(F.min("ord").alias("start"), F.count(F.lit(1)).alias("length")).where("length >= 3").drop("island")


def ordinal_lists(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts with three or more sentences that begin with an ordinal and a comma: a list in disguise; n."""
    rows = sentence_rows(docs).where(F.col("text").rlike(r"(?i)^(?:" + "|".join(T.ORDINALS) + "),"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


def trope_score(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Co-occurrence per text: kinds of tropes, all hits, and the most of one kind; a single hit may be fine."""
    counts = hits.where(F.col("class").startswith("trope")).groupBy(key, "class").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("hits"), F.max("n").alias("most"))


def mixed_terms(units: DataFrame, synonyms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts that use several terms (``synonyms``: class, phrase, of one concept each) for one concept: concept, terms in order."""
    from inkwell.operators.rules import lexicon_hits

    found = lexicon_hits(units, synonyms).groupBy(key, F.col("class").alias("concept")).agg(F.array_sort(F.collect_set("phrase")).alias("terms"))
    return found.where(F.size("terms") > 1)


def compliments(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Complimentary words in related work: line, word."""
    rows = section_lines(docs, key).where(F.lower("section").contains("related work"))
    found = F.regexp_extract_all(F.lower("text"), F.lit(X.edged(r"\b(" + "|".join(T.COMPLIMENTS) + r")\b")), F.lit(1))
    return rows.select(key, "line", F.explode(found).alias("word"))


def tense(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``we`` with a study verb in the present in sections that report (past expected), or with a paper verb in the past anywhere (present expected)."""
    rows = section_sentences(docs, key)
    study = F.regexp_extract_all("text", F.lit(X.edged(r"(?i)\bwe (" + "|".join(T.STUDY_VERBS) + r")\b")), F.lit(1))
    paper = F.regexp_extract_all("text", F.lit(X.edged(r"(?i)\bwe (" + "|".join(T.PAPER_VERBS) + r")\b")), F.lit(1))
    tell = lambda found, want: F.transform(found, lambda v: F.struct(F.lower(v).alias("verb"), F.lit(want).alias("expected")))
    past = F.when(F.col("section").isin(T.PAST_SECTIONS), tell(study, "past")).otherwise(F.array().cast("array<struct<verb: string, expected: string>>"))
    return rows.select(key, "line", "section", F.inline(F.concat(past, tell(paper, "present"))))


def cross_section_duplicates(docs: DataFrame, least_words: int = 4, key: str = "doc_id") -> DataFrame:
    """Sentences that two or more sections state, the abstract left out: said (normalised), sections."""
    rows = section_sentences(docs, key).where(F.col("section").isNotNull() & ~F.col("section").rlike(X.edged(ABSTRACT)))
    rows = rows.select(key, "section", F.array_join(X.words(F.col("text")), " ").alias("said")).where(F.size(F.split("said", " ")) >= least_words)
    return rows.groupBy(key, "said").agg(F.countDistinct("section").alias("sections")).where("sections > 1")


def terms_left_to_abstract(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Acronyms that the abstract introduces and the body uses without introducing them: acronym, uses."""
    rows = section_sentences(docs, key).where("section is not null").withColumn("inside", F.col("section").rlike(X.edged(ABSTRACT)))
    found = lambda where, pattern: rows.where(where).select(key, F.explode(F.regexp_extract_all("text", F.lit(X.edged(pattern)), F.lit(1))).alias("acronym"))
    given, again = found("inside", r"\(([A-Z]{2,6})\)"), found("not inside", r"\(([A-Z]{2,6})\)")
    uses = found("not inside", r"\b([A-Z]{2,6})\b").groupBy(key, "acronym").agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(given.distinct(), [key, "acronym"], "left_semi").join(again.distinct(), [key, "acronym"], "left_anti")


def table_cells(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells of Markdown tables, runs of lines that begin with a bar: start (the table's first line), line, col (from 0), cell."""
    rows = lines(docs).where(F.col("text").startswith("|"))
    island = F.col("line") - F.row_number().over(Window.partitionBy(key).orderBy("line"))
    rows = rows.withColumn("_i", island).withColumn("start", F.min("line").over(Window.partitionBy(key, "_i")))
    cells = F.split(F.regexp_replace("text", r"^\||\|\s*$", ""), r"\|")
    return rows.select(key, "start", "line", F.posexplode(cells).alias("col", "cell")).withColumn("cell", F.trim("cell"))


def mixed_decimals(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Columns of tables whose numbers have several counts of decimals: start, col, kinds."""
    rows = table_cells(docs, key).withColumn("d", X.decimals(F.col("cell"))).where("d is not null")
    return rows.groupBy(key, "start", "col").agg(F.countDistinct("d").alias("kinds")).where("kinds > 1")


def unreferenced_labels(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels of figures and tables in LaTeX code that no reference names: label."""
    code = lines(docs).where(F.col("text").contains("\\")).select(key, X.code_part(F.col("text")).alias("code"))
    found = lambda pattern: code.select(key, F.explode(F.regexp_extract_all("code", F.lit(pattern), F.lit(1))).alias("label")).distinct()
    named = found(r"\\(?:auto|c|C|v|page|name|eq)?ref\*?\{([^}]*)\}").select(key, F.explode(F.split("label", ",")).alias("label")).withColumn("label", F.trim("label"))
    return found(r"\\label\{((?:fig|tab)[^}]*)\}").join(named, [key, "label"], "left_anti")


def number_gaps(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbered captions (``Figure n:``, ``Table n.``) that skip or repeat a number: kind, n, before."""
    rows = lines(docs).where(F.col("text").rlike(r"^(?:Figure|Table) \d+[.:]"))
    rows = rows.select(key, "line", F.regexp_extract("text", r"^(Figure|Table)", 1).alias("kind"), F.regexp_extract("text", r"^\w+ (\d+)", 1).cast("int").alias("n"))
    before = F.coalesce(F.lag("n").over(Window.partitionBy(key, "kind").orderBy("line")), F.lit(0))
    return rows.withColumn("before", before).where("n <> before + 1").select(key, "kind", "n", "before")


def abstract_and_lists(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Citations in the abstract, list items in other sections, and ``I`` where the text is to say ``we``: line, rule."""
    rows = section_lines(docs, key).where("section is not null").withColumn("inside", F.lower("section").rlike(X.edged(ABSTRACT)))
    rule = lambda hit, name: F.when(hit, F.lit(name))
    found = F.array_compact(
        F.array(
            rule(F.col("inside") & (F.size(X.cite_calls(X.code_part(F.col("text")))) > 0), "citation-in-abstract"),
            rule(~F.col("inside") & F.col("text").rlike(LIST_ITEM), "list-in-body"),
            rule(F.col("text").rlike(X.edged(r"\bI (?:am|was|have|will|did|show|find|think)\b")), "first-person-singular"),
        )
    )
    return rows.select(key, "line", F.explode(found).alias("rule"))


def typed_authors(docs: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Typed author names before ``et al.`` in LaTeX code, with the entries of that first author: line, name, cite_keys in order."""
    code = lines(docs).where(F.col("text").contains("et al.")).select(key, "line", X.code_part(F.col("text")).alias("code"))
    named = code.select(key, "line", F.explode(F.regexp_extract_all("code", F.lit(X.edged(r"\b([A-Z][a-z]+) et al\.")), F.lit(1))).alias("name"))
    first = F.regexp_extract(F.col("fields")["author"], r"^\s*([^,\s]+)(?:,|\s+and\b|\s*$)|^.*?(\S+)\s+and\b", 1)
    authors = entries.where("error is null").select(F.col("key").alias("cite_key"), first.alias("name")).where("name <> ''")
    known = authors.groupBy("name").agg(F.array_sort(F.collect_set("cite_key")).alias("cite_keys"))
    return named.join(known, "name", "left").select(key, "line", "name", F.coalesce("cite_keys", F.array().cast("array<string>")).alias("cite_keys"))


def repeated_nouns(docs: DataFrame, share: float = 0.05, least: int = 5, key: str = "doc_id") -> DataFrame:
    """Words of six letters or more that are over ``share`` of a text's words and occur ``least`` times: word, n (an overworked image)."""
    rows = pages_of(docs).select(*keep(docs), "n_words", F.explode(X.words(F.col("text"))).alias("word")).where(F.length("word") >= 6)
    counts = rows.groupBy(key, "n_words", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= least) & (F.col("n") > share * F.col("n_words"))).select(key, "word", "n")
