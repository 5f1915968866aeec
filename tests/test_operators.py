"""Fixtures with known counts, in our own words."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from inkwell.operators import bib, citations, grounding, lint, report, review, rules
from inkwell.operators.glyphs import glyph_counts, glyph_rows, glyph_totals
from inkwell.operators.segment import comments_of, lines, prose_lines
from inkwell.sources import files


def docs(spark, *texts, key="doc_id"):
    return spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string")


def test_glyphs(spark):
    text = "plain -- text ->\nfirst — and — second\n# note — here\na → b ← c\n“x” ‘y’\n3–4 and so on…\na\u00a0b"
    df = docs(spark, text, None, "")
    rows = glyph_rows(df)
    counts = {r.glyph: r.n for r in rows.groupBy("glyph").agg(F.count("*").alias("n")).collect()}
    assert counts == {r.glyph: r.n for r in glyph_totals(glyph_counts(df)).collect()} == {"em-dash": 3, "en-dash": 1, "arrow": 2, "curly-quote": 4, "ellipsis": 1, "nbsp": 1}
    assert [(r.line, r.col) for r in rows.where("line = 2").orderBy("col").collect()] == [(2, 7), (2, 13)]
    zero = glyph_totals(glyph_counts(docs(spark, "a -- b -> c")))
    assert zero.count() == 6 and zero.agg(F.sum("n")).first()[0] == 0
    long = glyph_rows(docs(spark, "word " * 40 + "—" + " end" * 20)).first().context
    assert len(long) == 120 and long.endswith("...")


CITED = r"""A claim \cite{a1}. % GROUNDING: a1 -- "said so"
Next \citep{b1}.
% GROUNDING b1: "also said"
Two \citet{c1, c2} here.
Three \cite{d1,d2,d3} now.
More \autocite[see][p. 2]{e1,e2,e3} now.
Start \Textcite{f1,f2,f3} now.
Star \citep*{g1,g2,g3} now.
Foot \footcite{h1,h2,h3} now.
% \cite{x1,x2,x3}
Style \citeauthor{y1} and \nocite{z1} and \other{q}.
Owed \cite{k1}.

% unrelated
% GROUNDING: k1 -- TODO verify -- book
Late \cite{m1}.
prose between
% GROUNDING: m1 -- "too late"
"""


def test_citations(spark):
    df = docs(spark, CITED)
    calls = citations.cite_calls(df)
    assert calls.count() == 10 and citations.clusters(calls).count() == 5
    assert citations.missing_grounding(calls).count() == 7
    assert {r.line: r.state for r in calls.collect() if r.line in (1, 2, 12, 16)} == {1: "quote", 2: "quote", 12: "todo", 16: "none"}
    sites = citations.sites(df)
    assert sites.where("not groundable").count() == 1 and sites.count() == 11
    open_keys = {r.cite_key for r in citations.keys_to_ground(sites).collect()}
    assert "k1" in open_keys and "a1" not in open_keys and "y1" not in open_keys


def test_claims(spark):
    text = "\\section{Intro}\nSee e.g. Fig. 3.5 of \\emph{all} work by Smith et al. \\cite{one} shows it. Next.\n\nNew paragraph cites \\citep{two,\nthree} over lines. % c\nEnd"
    got = {tuple(r["keys"]): (r.line, r.claim) for r in citations.sites(docs(spark, text)).collect()}
    assert got[("one",)] == (2, "See e.g. Fig. 3.5 of all work by Smith et al. shows it.")
    assert got[("two", "three")] == (4, "New paragraph cites over lines.")
    keys = {r.cite_key: r for r in citations.by_key(citations.sites(docs(spark, "A \\cite{k}. B \\cite{k}.", "A \\cite{k}."))).collect()}
    assert keys["k"].claims == ["A.", "B."] and len(keys["k"].sites) == 3


def test_grounding_is_idempotent(spark):
    text = "  Cites \\cite{a, b, c}.\r\nOther \\cite{s}.\r\n  % GROUNDING: s -- TODO verify -- book\r\nend"
    df = docs(spark, text, "nothing")
    quotes = spark.createDataFrame([("a", "two  words", None), ("b", None, "paywalled"), ("c", " ", None), ("s", "found", None)], "key string, quote string, todo string")
    plan = grounding.plan_edits(df, citations.sites(df), quotes)
    assert {(r.status, r.kind): r.n for r in grounding.edit_counters(plan).collect()} == {("insert", "quote"): 1, ("insert", "todo"): 2, ("replace", "quote"): 1}
    once = grounding.apply_edits(df, plan).orderBy("doc_id").collect()
    want = '  Cites \\cite{a, b, c}.\r\n  % GROUNDING: a -- "two words"\r\n  % GROUNDING: b -- TODO verify -- paywalled\r\n  % GROUNDING: c -- TODO verify -- not-found\r\nOther \\cite{s}.\r\n  % GROUNDING: s -- "found"\r\nend'
    assert once[0].text == want and once[1].text == "nothing"
    again = spark.createDataFrame(once, df.schema)
    second = grounding.plan_edits(again, citations.sites(again), quotes)
    assert {r.status for r in second.collect()} == {"existing"}
    moved = grounding.plan_edits(df, citations.sites(df).withColumn("line", F.col("line") + 1), quotes)
    assert "moved" in {r.status for r in moved.collect()}
    twice = spark.createDataFrame([("a", "other"), ("a", "here are two words"), ("a", "two words")], "key string, text string")
    assert sorted((r.key, r.quote) for r in grounding.verified_quotes(quotes, twice).where("quote is not null").collect()) == [("a", "two  words")]
    sure = grounding.verified_quotes(quotes, spark.createDataFrame([("a", "here are two words")], "key string, text string"))
    assert {r.key: r.quote for r in sure.collect()} == {"a": "two  words", "b": None, "c": None, "s": None}


BIB = """@string{x = "y"}
@article{one, author = {A}, title = {A {Big} Study of Things}, journal = "J of Tests", year = 2020}
@article{two, author = {B}, title = {No journal here}, year = {2019}, doi = {10.1/2}}
@book{three, editor = {C}, title = {Book of Words}, publisher = {P}, year = 2001,}
@inproceedings{four, author={D}, title={Talks, with commas = signs}, year={1999}, note = "a, b = c"}
@misc{five, title = {Anything}}
@online{six, title = {Unknown type}}
"""
AUTHORITY = [("A Big Study of Things", "Journal of Tests", "2021", "", 0, 0), ("No journal here at all", "Somewhere", "2019", "10.1/2", 1, 0), ("Talks with commas signs", "Proceedings", "1999", "", 1, 1), ("Book of Words", "P", "2001", "", 1, 2)]


def test_entry_parser():
    parse = lambda x: [(k, e, names, values) for _, k, e, names, values, _ in bib.split_entries(x)]
    assert parse('@a{k, T = {x {y = z}}, u="q, v = w", w = 3}') == [("k", "a", ["t", "u", "w"], [("t", "{x {y = z}}"), ("u", '"q, v = w"'), ("w", " 3"[1:])])]
    assert parse('@a{k, t = "say \\"n = {1}\\" ok", z = 1}')[0][2] == ["t", "z"]
    assert parse("@Comment{x}@string{s = {t}}@b{ key }") == [("key", "b", [], [])]
    assert bib.split_entries("@a{k, t = {x}") == [(0, None, None, None, None, "a entry at character 0: a brace is not closed")]
    assert parse("@a{{k,l}, 2b = 1}")[0][:3] == ("{k,l}", "a", ["b"])


def test_verdicts(spark):
    db = spark.createDataFrame([("The same long title here", "Journal of Things", "2020", "10.1/a", 0, 0), ("The same long title here", "Elsewhere", "1999", "", 1, 0), ("Other words", "", "", "10.1/b", 0, 1)], "title string, venue string, year string, doi string, source int, ord int")
    rows = [
        ("ok", "10.1/A", "The same long title here", "2020", "Things Journal", "ok"), ("year", "", "the same LONG title here", "1999", "", "year-mismatch"), ("venue", "", "The same long title here", "2020", "Proceedings", "venue-mismatch"),
        ("title", "10.1/b", "The same long title here", "", "", "title-mismatch"), ("doi", "10.9/x", "The same long title here", "", "", "doi-not-found"), ("none", "", "Nothing like that", "", "", "not-found"), ("empty", "", "", "2020", "", "unchecked"),
    ]
    refs = spark.createDataFrame([r[:5] for r in rows], "key string, doi string, title string, year string, venue string")
    got = {r.key: (r.verdict, r.detail) for r in bib.verify(refs, db).collect()}
    assert {k: v for k, (v, _) in got.items()} == {r[0]: r[5] for r in rows}
    assert got["year"][1] == "entry: 1999 | record: 2020" and got["ok"][1] == ""
    limited = bib.verify(refs, db, 2).collect()  # of the cache keys the first two by entry key
    assert sum(r.verdict == "unchecked" for r in limited) == 5 and {r.key for r in limited if r.verdict != "unchecked"} == {"doi", "none"}


def test_bibliography(spark):
    found = bib.entries(spark.createDataFrame([("x.bib", BIB), ("bad.bib", "@misc{a, title={x}"), ("e.bib", None)], "path string, text string"))
    assert found.where("error is not null").count() == 1 and found.where("error is null").count() == 6
    checked = bib.missing_fields(found)
    assert checked.count() == 5 and {r.key: r.missing for r in checked.where(F.size("missing") > 0).collect()} == {"two": ["journal"], "four": ["booktitle"]}
    four = found.where("key = 'four'").first()
    assert four.fields["title"] == "Talks, with commas = signs" and four.names == ["author", "note", "title", "year"]
    meta = bib.metadata(found, spark.createDataFrame([("one",), ("none",)], "key string")).collect()
    assert len(meta) == 1 and meta[0].title == "A Big Study of Things" and meta[0].doi == ""
    db = spark.createDataFrame(AUTHORITY, "title string, venue string, year string, doi string, source int, ord int")
    got = {r.key: r.verdict for r in bib.verify(bib.references(found), db).collect()}
    assert got["one"] == "year-mismatch" and got["five"] == "not-found"


def test_comments():
    python = '#!/usr/bin/x\nx = "# no" # yes\ny = 1\n"""Doc\n  more"""  # tail\nit\'s # hidden\n'
    assert [(n, c.strip()) for n, c in comments_of(python, "python")] == [(2, "yes"), (4, "Doc"), (5, "more"), (5, "tail")]
    assert [(n, c.strip()) for n, c in comments_of("a /* b */ c // d\n/* open\nend", "slash")] == [(1, "b"), (1, "d"), (2, "open"), (3, "end")]
    assert list(comments_of("<!-- x --> <!-- y -->", "markup")) == [(1, " x "), (1, " y ")]


def test_files(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    for name, data in {"a.md": b"Text\n```\ncode\n```\n\nEnd\n", "b.py": b"# hi\nx=1\n", "n.txt": b"a\x00b", "bad.txt": b"\xff\xfe", "gen.md": b"Generated by x\nt", "vendor/v.md": b"no", "go.sum": b"x", "big.txt": b"x" * 1_000_001}.items():
        (tmp_path / name).write_bytes(data)
    tree = files.read_tree(spark, str(tmp_path))
    assert {r.path for r in tree.collect()} == {"a.md", "b.py", "gen.md", "go.sum"}
    assert {(r.path, r.line, r.text) for r in files.repository_prose(tree).collect()} == {("a.md", 1, "Text"), ("a.md", 6, "End"), ("b.py", 1, "hi")}
    assert files.git_files(spark, str(tmp_path)).count() == 0 and files.git_messages(spark, str(tmp_path)).count() == 0
    subprocess.run(["git", "-C", str(tmp_path), "init", "-q"], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "add", "."], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", "commit", "-qm", "Subject\n\nBody\nCc: z"], check=True)
    assert {r.path for r in files.git_files(spark, str(tmp_path)).collect()} >= {"a.md", "b.py"}
    assert [r.sha for r in files.git_messages(spark, str(tmp_path)).collect()][0].__len__() == 9
    toggled = prose_lines(docs(spark, "a\n~~~\nb\n```\nc"))
    assert [r.text for r in toggled.orderBy("line").collect()] == ["a", "c"]


def test_latex(spark):
    root = "\\documentclass{x}\n\\begin{document}\n\\input{sec/one}\n% \\input{sec/no}\n\\include{two.tex}\n\\bibliography{refs, refs,more}"
    tree = spark.createDataFrame([("main.tex", root), ("other.tex", root), ("sec/one.tex", "\\input{three}\\input{main}"), ("sec/three.tex", "x"), ("sec/no.tex", "x"), ("two.tex", "y"), ("refs.bib", ""), ("more.bib", ""), ("c.tex", "% \\documentclass\n% \\begin{document}")], "path string, text string")
    roots = files.latex_roots(tree)
    assert {r.path for r in roots.collect()} == {"main.tex", "other.tex"}
    assert (files.choose_root(roots).first().status, files.choose_root(roots).first().path) == (0, "main.tex")
    assert files.choose_root(roots.limit(0)).first().status == 1
    assert files.choose_root(spark.createDataFrame([("p.tex",), ("q.tex",)], "path string")).first().status == 2
    assert files.scope("a.TEX") == "latex" and files.scope("a.md") == "general" and files.scope("d", roots) == "latex"
    assert {r.path for r in files.include_graph(tree, "main.tex").collect()} == {"main.tex", "sec/one.tex", "sec/three.tex", "two.tex"}
    assert {r.path for r in files.bibliographies(tree).collect()} == {"refs.bib", "more.bib"}


def test_diff(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n+a\n+b\n@@ -9,2 +10,0 @@\n-c\n+++ b/y\n@@ -0,0 +5 @@\n+d"
    rows = spark.createDataFrame(list(enumerate(diff.split("\n"))), "line int, text string")
    ranges = files.diff_ranges(rows)
    assert {(r.path, r.first, r.last) for r in ranges.collect()} == {("x", 1, 2), ("y", 5, 5)}
    found = spark.createDataFrame([("x", 2, 4), ("x", 3, 3), ("y", 1, 9)], "path string, line int, last_line int")
    assert {(r.path, r.line) for r in grounding.within_ranges(found, ranges).collect()} == {("x", 2), ("y", 1)}
    spots = spark.createDataFrame([(0, 9, "b", "c"), (0, 1, "zz", "")], "doc_id long, line int, quote string, suggestion string")
    got = {r["quote"]: (r.status, r["at"]) for r in grounding.apply_findings(docs(spark, "b\nx\nb"), spots).collect()}
    assert got == {"b": ("found", 3), "zz": ("absent", None)}


def test_lint(spark):
    text = lambda rows: {(r.line, r.rule) for r in rows.collect()}
    assert text(lint.blocks(docs(spark, "a\n```\nx"))) == {(2, "unclosed-fence")}
    assert text(lint.blocks(docs(spark, "````\n```\n````\n~~~\n~~~"))) == set()
    assert text(lint.blocks(docs(spark, "``` a ` b\nx"))) == set()
    assert text(lint.blocks(docs(spark, "---\na: 1\n\nx"))) == {(1, "unclosed-frontmatter")}
    assert text(lint.blocks(docs(spark, "---\na: 1\n---\n```\n"))) == {(4, "unclosed-fence")}
    assert text(lint.blocks(docs(spark, "---\n\nx"))) == set()
    bad = "# A\n### B\ntext  x \n\n\n# C"
    got = lint.line_rules(docs(spark, bad))
    assert text(got) >= {(2, "md001"), (3, "md009"), (5, "md012"), (6, "md025"), (6, "md047"), (2, "md022")}
    kept = "a  \nb   \nc\t\n\n\n\nd\n```\nx   \n\n\n\ny\n```\n\n"
    assert lint.fixed(docs(spark, kept)).first().text == "a  \nb\nc\n\nd\n```\nx   \n\n\n\ny\n```\n"
    again = lint.line_rules(lint.fixed(docs(spark, bad)))
    assert {r for _, r in text(again)} == {"md001", "md022", "md025"}
    page = "# Prose Review\n\n#### Finding 1\n\n**Rule:** x\n**Location:** y\n**Quote:** z\n\n```\n#### Finding 9\n```\n"
    assert [r.message for r in lint.structure(docs(spark, page)).collect()] == ["**Suggested revision:**"]
    rule = "# Writing Rules\n## Tropes to Avoid\n# Inner\n## Tropes to Avoid\n"
    assert text(lint.structure(docs(spark, rule))) == {(3, "writing-md-structure"), (4, "writing-md-structure")}
    printed = spark.createDataFrame([("a.md:3:1: MD009: Trailing spaces (no-trailing-spaces)",), ("other",)], "text string")
    assert [tuple(r) for r in lint.lint_rows(printed).collect()] == [(3, "md009", "Trailing spaces")]


def test_rules_and_report(spark):
    df = docs(spark, "We utilize and leverage and foster it. " * 2)
    lex = rules.lexicon(spark, rules.default_lexicon())
    assert rules.lexicon_hits(df, lex).count() == 6
    allow = spark.createDataFrame([("foster",)], "phrase string")
    assert rules.lexicon_hits(df, lex, allow).count() == 4
    many = rules.lexicon(spark, [("long", "one two three four five six seven eight nine ten", "x"), ("dash", "low-hanging fruit", "y", "never")])
    said = docs(spark, "Zero one two three four five six seven eight nine ten. The low-hanging fruit.")
    assert [(r["class"], r.pos, r.exception) for r in rules.lexicon_hits(said, many).orderBy("pos").collect()] == [("long", 1, None), ("dash", 12, "never")]
    f = report.as_findings(lines(df).where("text <> ''"), path=F.col("doc_id").cast("string"), line=F.col("line"), rule_id="x", layer="general", tier="H", quote=F.col("text"))
    assert len(f.columns) == 11 and report.metrics(f).first().n == 1 and report.markdown_blocks(f).first().value.count("**") == 8
    page = "\n".join(x for _, x in report.markdown_heads(["general"], report.header("repository", files=1, commits=0))) + "\n" + report.markdown_blocks(f).first().value
    assert "#### Finding 1\n" in page and "Scope: repository (1 files, 0 commits)" in page and lint.structure(docs(spark, page)).count() == 0
    assert lint.structure(docs(spark, page.replace("**Quote:**", ""))).count() == 1
    assert (report.status(0, 0), report.status(1, 2), report.status(1, 0)) == (2, 1, 0)
    layers = spark.createDataFrame([(0, "# T\nintro\n## One\nx", False), (1, "# C\n## Two\n### Three", True)], "ord int, text string, is_catalog boolean")
    assert [r.text for r in report.compose_rules(layers).orderBy("ord").collect()] == ["## One\nx", "### Two\n#### Three"]
    fenced = spark.createDataFrame([(0, "## A\n```\n# code\n```\n### B", True)], "ord int, text string, is_catalog boolean")
    assert report.compose_rules(fenced).first().text == "### A\n```\n# code\n```\n#### B"
    assert json.loads(report.as_json(df, df, df).first().value)["doc_id"] == 0


def test_streaming(spark, tmp_path):
    from inkwell.streaming.detect import documents, glyph_counts

    df = docs(spark, "a — b", "c → d — e")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = glyph_counts(documents(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("complete").format("memory").queryName("g").start()
    q.processAllAvailable()
    q.stop()
    assert {r.glyph: r.n for r in spark.table("g").collect()} == {"em-dash": 2, "arrow": 1}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


#: Texts and, by hand, the rules that they break (line, sentence and paragraph rules of the general and scientific layers).
RULED = [
    ("The data are good.", {"data-plural"}), ("The data shows it.", set()), ("The data is good and the data were bad.", {"data-plural"}),
    ("We use tasks like parsing.", {"like-for-examples"}), ("It looks like parsing.", set()),
    ("We test code-generation benchmarks here.", {"noun-stack"}), ("An instruction-following model and a test-based tool.", set()),
    ("It holds (a, b, c) now.", {"parenthetical-list"}), ("It holds (e.g., a, b) now.", set()),
    ("Parsing has become increasingly hard.", {"topic-opening"}), ("We saw p < 0.05 here.", {"p-threshold", "effect-size-missing"}), ("We saw p = 0.031 and d = 0.4 here.", set()),
    ("So r = .31 it is.", {"no-leading-zero"}), ("As section 3 says.", {"lower-reference", "typed-reference"}), ("It works; we agree.", {"semicolon-pronoun"}),
    ("The reader is warned of it.", {"aside"}), ("% The reader beware", {"aside"}), ("Three facts: it ran; dogs slept; cats ate.", {"semicolon-chain", "clause-chain"}),
    ("\\caption{Experimental results}", {"vague-caption"}), ("We had 3 participants there.", {"small-numeral"}), ("We had 3 minutes there.", set()),
]


def test_patterns_by_hand(spark):
    got = {}
    for r in rules.pattern_candidates(docs(spark, *(t for t, _ in RULED))).collect():
        got.setdefault(r.doc_id, set()).add(r.rule)
    extra = {"passive", "trailing-participle", "straight-quote", "tricolon", "lower-after-colon", "enumeration"}
    assert [(t, got.get(i, set()) - extra) for i, (t, _) in enumerate(RULED)] == RULED


def test_research_phrases(spark):
    said = ["It aims to explore this", "sheds light on", "This provides valuable insights into x", "this highlights the fact that", "It has emerged as", "extends far beyond", "navigating the complexities of", "It plays a pivotal role", "paving the way for", "keyed to", "a growing body of work", "recent studies suggest"]
    got = rules.lexicon_hits(docs(spark, *said), rules.lexicon(spark, rules.default_lexicon())).where("class = 'research'")
    assert {r.doc_id for r in got.collect()} == set(range(12)) and got.count() == 12


def test_review_rules(spark):
    text = "# Abstract\nA Long Name (LN) \\cite{x}.\n# Results\nThe LN is used. We measure it. Overall, it is fine.\n# Related Work\nA seminal tool. The LN is used."
    df = docs(spark, text, "No sections here. The (LN) is.")
    assert [tuple(r) for r in review.terms_left_to_abstract(df).collect()] == [(0, "LN", 2)]
    assert [tuple(r)[1:] for r in review.compliments(df).collect()] == [(6, "seminal")]
    assert [tuple(r)[1:] for r in review.cross_section_duplicates(df).collect()] == [("the ln is used", 2)]
    assert [(r.verb, r.expected) for r in review.tense(df).collect()] == [("measure", "past")]
    assert [(r.line, r.edge) for r in review.section_edges(df).collect()] == [(4, "closing")]
    assert [(r.line, r.rule) for r in review.abstract_and_lists(df).collect()] == [(2, "citation-in-abstract")]
    table = docs(spark, "|a|b|\n|-|-|\n|1.5|2|\n|1.25|3|\ntext\n|1|")
    assert [(r.start, r.col, r.kinds) for r in review.mixed_decimals(table).collect()] == [(1, 0, 2)]
    assert [r.line for r in review.introducers(docs(spark, "We list.\n\n- a\n- b\nEnd.\nWe list:\n1. a")).collect()] == [1]
    assert review.terms_left_to_abstract(df.limit(0)).count() == 0


def test_short_passages(spark):
    df = docs(spark, "alpha beta gamma delta epsilon zeta eta", "xalpha betax", "nothing", None)
    items = ["beta", "pha be", "alpha beta gamma", "gamma delta epsilon zeta eta", "beta gamma delta epsilon", "", None, "absent words here now ok"]
    passages = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(d, i) for d, t in enumerate(["alpha beta gamma delta epsilon zeta eta", "xalpha betax", "nothing"]) for i, x in enumerate(items) if x and x in t}
    assert {(r.doc_id, r.item_id) for r in rules.passage_containment(df, passages).collect()} == want
    assert rules.passage_containment(df, passages.limit(0)).count() == 0


def test_json_and_settings(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"a": {"quote": "x y"}, "b": {"todo": "paywalled"}, "c": {"quote": 3}}')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "bad.json").write_text("{")
    assert {r.key: (r.quote, r.todo) for r in files.quote_results(spark, str(tmp_path / "q.json")).collect()} == {"a": ("x y", None), "b": (None, "paywalled"), "c": (None, None)}
    for name, kind in (("none.json", "missing"), ("list.json", "not-object"), ("bad.json", "not-json")):
        with pytest.raises(files.Unreadable) as e:
            files.json_object(spark, str(tmp_path / name))
        assert e.value.kind == kind
    good = "extensions:\n" + "".join(f"  {x}:\n    enabled: true\n" for x in ("front-matter", "markdown-tables", "markdown-task-list-items", "markdown-strikethrough", "markdown-extended-autolinks"))
    good += "plugins:\n" + "".join(f"  {x}:\n    enabled: false\n" for x in ("md013", "md033", "md041"))
    assert files.baseline(good) == [] and files.front_matter_settings(good) == (True, False)
    loose = good.replace("front-matter:\n    enabled: true", "front-matter:\n    enabled: yes\n    allow_blank_lines: true")
    assert files.front_matter_settings(loose) == (False, True) and files.baseline(loose) == ["extension front-matter is not enabled"]
    assert files.front_matter_settings("- a\n- b") == (False, False) and len(files.baseline("")) == 8


def test_partial_reads(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    rows, failed = files.read_some(spark, [str(tmp_path / n) for n in ("a.txt", "b.bin", "none.txt")])
    assert [r.text for r in rows.collect()] == ["one"] and [f.rsplit("/", 1)[1] for f in failed] == ["b.bin", "none.txt"]
    with pytest.raises(files.Unreadable):
        files.read_some(spark, [str(tmp_path / "none.txt")])


def test_catalogs(spark, tmp_path):
    for name, rows in (("one", "trope-a\tquietly\t\n"), ("two", "trope-a\tquietly\tsoftly\ntrope-b\tvery loud\t\n"), ("empty", "")):
        (tmp_path / name).write_text(rows)
    paths = {n: str(tmp_path / n) for n in ("one", "two", "empty")}
    name, table = files.catalog(spark, [("web", str(tmp_path / "none")), ("viewer", paths["empty"]), ("bundled", paths["two"])])
    assert name == "bundled" and table.count() == 2 and table.where("phrase = 'very loud'").first().parts == ["very", "loud"]
    with pytest.raises(Exception):
        files.catalog(spark, [("web", str(tmp_path / "none")), ("viewer", paths["empty"])])
    both = files.lexicon_files(spark, [paths["one"], paths["two"]])
    assert {(r.phrase, r.suggestion) for r in both.collect()} == {("quietly", None), ("very loud", None)}
    fresh = spark.read.csv(paths["two"], sep="\t", schema=files.LEXICON)
    snapshot = str(tmp_path / "snapshot")
    assert files.refresh(spark, fresh, snapshot) and not files.refresh(spark, fresh, snapshot) and not files.refresh(spark, fresh.limit(0), snapshot)
    assert spark.read.csv(snapshot, sep="\t", schema=files.LEXICON).count() == 2


def test_deep_includes(spark):
    tree = spark.createDataFrame([(f"f{k}.tex", f"\\input{{f{k + 1}}}\\input{{f0}}") for k in range(70)], "path string, text string")
    assert files.include_graph(tree, "f0.tex").count() == 70


def test_json_document(spark):
    df = docs(spark, "A \\cite{k}. B \\cite{k, l}.")
    found = citations.sites(df)
    meta = bib.metadata(bib.entries(spark.createDataFrame([("x.bib", "@misc{k, title={T}}")], "path string, text string")), found.select(F.explode("keys").alias("key")))
    held = json.loads(report.json_document("r", found, citations.by_key(found), meta, ["doc_id", "line", "ord"]).first().value)
    assert held["root"] == "r" and len(held["sites"]) == 2 and held["by_key"]["k"]["claims"] == ["A.", "B."] and held["meta"]["k"]["title"] == "T"
    assert {r.cite_key for r in grounding.input_bundle(found, meta).collect()} == {"k", "l"}


def test_stream_windows_and_first_seen(spark, tmp_path):
    from inkwell.streaming.detect import documents, first_seen, windowed_events

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "events"))
    q = windowed_events(documents(spark, str(tmp_path / "events"), events.schema)).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    want = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    key = lambda r: (r["window"].start, r.event_type, r.n)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, want.collect()))
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0) as at, concat('text ', id % 3) as text from range(9)")
    rows.coalesce(1).write.parquet(str(tmp_path / "texts"))
    q = first_seen(documents(spark, str(tmp_path / "texts"), rows.schema), "at").writeStream.outputMode("append").format("memory").queryName("f").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.table("f").collect()) == ["text 0", "text 1", "text 2"]


def test_edges_of_words_are_ascii(spark):
    df = docs(spark, "wei\u00dfbe den See", "\u00e9was opened, data are\u00e9 here", "caf\u00e9s open")
    assert [(r.doc_id, r.sentences, r.passive) for r in rules.passive_share(df).orderBy("doc_id").collect()] == [(0, 1, 1), (1, 1, 1)]
    assert rules.pattern_candidates(df).where("rule in ('passive', 'data-plural')").count() == 3
    assert rules.significant_audit(docs(spark, "\u00e9significant\u00e9 x", "insignificant")).count() == 1


def test_titles_meet_over_pairs_of_rare_tokens(spark):
    import random

    rng = random.Random(5)
    texts = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 9, 14, 16, 17, 19, 23, 24]))] for _ in range(120)]
    other = [[w for w in t if rng.random() > 0.12] + [f"v{rng.randrange(9)}"] * rng.randrange(3) for t in texts] + [[f"w{i}"] for i in range(5)]
    refs = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(texts)], "key string, title string")
    db = spark.createDataFrame([(0, i, " ".join(t)) for i, t in enumerate(other)], "source int, ord int, title string")
    got = {(r.key, r.ord) for r in bib.title_pairs(refs, db).collect()}
    want = {(str(i), j) for i, x in enumerate(map(set, texts)) for j, y in enumerate(map(set, other)) if x and y and len(x & y) / len(x | y) >= 0.7}
    assert got == want and len(want) > 50
    # few words, many titles: one shared word makes no candidates
    sets = spark.range(2000).select(F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substring(F.md5(F.concat_ws("-", "id", i)), 1, 2)))).alias("_s"))
    counts = sets.select(F.explode("_s").alias("_t")).groupBy("_t").agg(F.count("*").alias("_f"))
    one, two = (bib._meeting_keys(sets, counts, x).withColumnRenamed("_id", n) for x, n in ((True, "a"), (False, "b")))
    assert one.join(two, "_key").where("a <> b").select("a", "b").distinct().count() < 2000 * 40
