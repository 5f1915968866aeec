"""File, repository, diff and LaTeX project sources.

The tree itself is read by Spark's ``binaryFile``; only listing a git
repository runs a command, on the driver.
"""

from __future__ import annotations

import json
import re
import subprocess
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import tables as T
from inkwell.functions import text as X
from inkwell.operators.segment import lines


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def denied(path: Column) -> Column:
    """Any directory above the file is on the deny list; the name itself is not tested."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, T.DENIED_DIRS)))


def classify(files: DataFrame) -> DataFrame:
    """Adds kind (prose, comment, skip) and family: skipped names, then known names, then extensions."""
    name = name_of(F.col("path"))
    ext = F.lower(F.when(name.contains("."), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(F.lit("")))
    maps = [F.create_map(*[F.lit(x) for p in m.items() for x in p]) for m in (T.NAME_FAMILY, T.EXTENSION_FAMILY)]
    by_name, by_ext = F.try_element_at(maps[0], name), F.try_element_at(maps[1], ext)
    kind = F.when(name.isin(T.SKIPPED_NAMES), "skip").when(by_name.isNotNull(), "comment").when(ext.isin(T.PROSE_EXTENSIONS), "prose").when(by_ext.isNotNull(), "comment").otherwise("skip")
    return files.withColumn("kind", kind).withColumn("family", F.when(kind == "comment", F.coalesce(by_name, by_ext))).withColumn("is_markdown", ext.isin("md", "markdown", "mdx"))


def generated(text: Column) -> Column:
    """A marker of generated files in the first 2,000 characters."""
    return F.substring(text, 1, T.HEAD_CHARS).rlike(T.GENERATED)


def read_tree(spark: SparkSession, root: str, max_bytes: int = T.MAX_FILE_BYTES) -> DataFrame:
    """path (relative), text of the readable files below ``root``: at most ``max_bytes`` (pushed to the scan), no NUL, valid UTF-8, not denied."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    rows = found.select(F.substring(path, len(base) + 2, 1 << 20).alias("path"), "content").where(~F.coalesce(denied(F.col("path")), F.lit(False)))
    rows = rows.where(F.expr("is_valid_utf8(CAST(content AS STRING))"))
    return rows.select("path", F.col("content").cast("string").alias("text")).where(~F.col("text").contains("\x00"))


def git_files(spark: SparkSession, root: str) -> DataFrame:
    """Tracked paths of a git work tree, denied directories dropped; empty where git fails."""
    done = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, text=True, check=False)
    rows = [(p,) for p in done.stdout.split("\0") if p] if done.returncode == 0 else []
    return spark.createDataFrame(rows, "path string").where(~denied(F.col("path")))


def git_messages(spark: SparkSession, root: str, select: str | int | None = None) -> DataFrame:
    """sha (9 characters), ord (newest first), text of commit messages; ``select``: a number, ``all``, a revision range, or 200."""
    select = T.COMMIT_LIMIT if select is None else select
    extra = [] if select == "all" else [f"-{int(select)}"] if str(select).isdigit() else [str(select)]
    done = subprocess.run(["git", "-C", root, "log", "--no-merges", "-z", "--format=%H%n%B", *extra], capture_output=True, text=True, check=False)
    found = [c for c in done.stdout.split("\0") if c.strip()] if done.returncode == 0 else []
    rows = [(c.split("\n", 1)[0][:9], i, c.split("\n", 1)[1] if "\n" in c else "") for i, c in enumerate(found)]
    return spark.createDataFrame(rows, "sha string, ord int, text string")


def select_messages(messages: DataFrame, limit: int | None = T.COMMIT_LIMIT) -> DataFrame:
    """The newest ``limit`` messages by ``ord``; all where it is None."""
    return messages if limit is None else messages.orderBy("ord").limit(limit)


def repository_prose(files: DataFrame) -> DataFrame:
    """path, line, text of a repository's prose and comments (path, text): classified, generated files skipped."""
    from inkwell.operators.segment import comment_lines, prose_lines

    rows = classify(files).where((F.col("kind") != "skip") & ~generated(F.col("text")))
    prose = prose_lines(rows.where("kind = 'prose'"), "path", F.col("is_markdown")).select("path", "line", "text")
    comments = comment_lines(rows.where("kind = 'comment'").select("path", "family", "text")).select("path", "line", "text")
    return prose.unionByName(comments)


def diff_ranges(diff: DataFrame) -> DataFrame:
    """path, first, last: new-side line ranges of a unified diff without context (line, text); deletions give none."""
    head = F.nullif(F.regexp_extract("text", r"^\+\+\+ b/(.*)$", 1), F.lit(""))
    rows = diff.where(F.col("text").startswith("+++ ") | F.col("text").startswith("@@"))  # the heads alone, of one command's output
    rows = rows.withColumn("path", F.last(head, ignorenulls=True).over(Window.orderBy("line"))).where(F.col("text").startswith("@@"))
    start, size = F.regexp_extract("text", r"^@@ [^+]*\+(\d+)(?:,(\d+))? @@", 1), F.regexp_extract("text", r"^@@ [^+]*\+(\d+)(?:,(\d+))? @@", 2)
    rows = rows.select("path", start.cast("int").alias("first"), F.coalesce(F.nullif(size, F.lit("")), F.lit("1")).cast("int").alias("n"))
    return rows.where("n > 0").select("path", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def latex_roots(files: DataFrame) -> DataFrame:
    """Roots (path, text): both document markers uncommented; those at the top if any, else at any depth."""
    marker = lambda m: F.col("text").rlike(r"(?m)^[^%\n]*\\" + m)
    found = files.where(F.lower("path").endswith(".tex") & marker("documentclass") & marker(r"begin\{document\}")).select("path", (~F.col("path").contains("/")).alias("top"))
    any_top = found.agg(F.coalesce(F.bool_or("top"), F.lit(False))).scalar()
    return found.where(F.col("top") | ~any_top).select("path")


def choose_root(roots: DataFrame) -> DataFrame:
    """One row: status 0 with path, 1 (none), or 2 (several, none preferred) with the candidates."""
    rows = roots.agg(F.sort_array(F.collect_list("path")).alias("all"))
    named = lambda n: F.get(F.filter("all", lambda p: (p == n) | p.endswith("/" + n)), F.lit(0))
    path = F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(F.coalesce(named("main.tex"), named("paper.tex")))
    return rows.select(F.when(F.size("all") == 0, 1).when(path.isNotNull(), 0).otherwise(2).alias("status"), path.alias("path"), F.col("all").alias("candidates"))


def scope(path: str, roots: DataFrame | None = None, exists: bool = True) -> str:
    """``latex`` for a .tex file or a directory with a root (also several), else ``general``; a missing path goes by its suffix."""
    if roots is None or not exists:
        return "latex" if path.lower().endswith(".tex") else "general"
    return "general" if roots.isEmpty() else "latex"


def _references(files: DataFrame, macro: str) -> DataFrame:
    rows = lines(files, universal=True).withColumn("code", X.code_part(F.col("text"))).where(F.col("code").contains("\\"))
    rows = rows.select("path", "line", F.posexplode(F.regexp_extract_all("code", F.lit(r"\\(?:" + macro + r")\*?\s*(?:\[[^\]]*\])?\{([^}]*)\}"), F.lit(1))).alias("k", "blob"))
    return rows.select("path", "line", "k", F.posexplode(X.cite_keys(F.col("blob"))).alias("j", "ref"))


def resolved(references: DataFrame, files: DataFrame, base: str, suffix: str) -> DataFrame:
    """References (path, ref) with ``target``: the first existing of base and own directory, each with and without suffix."""
    own = F.regexp_replace("path", r"/?[^/]*$", "")
    names = F.when(F.lower("ref").endswith(suffix), F.array("ref")).otherwise(F.array(F.concat("ref", F.lit(suffix)), F.col("ref")))
    join = lambda d, n: F.when(d == "", n).otherwise(F.concat(d, F.lit("/"), n))
    options = F.concat(F.transform(names, lambda n: join(F.lit(base), n)), F.transform(names, lambda n: join(own, n)))
    options = F.transform(options, lambda p: F.regexp_replace(p, r"(^|/)\./", "$1"))
    rows = references.select("*", F.posexplode(options).alias("rank", "target")).join(files.select(F.col("path").alias("target")).distinct(), "target")
    best = Window.partitionBy(*references.columns).orderBy("rank")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "rank")


def include_graph(files: DataFrame, root: str) -> DataFrame:
    """Paths that ``root`` pulls in, itself included, each once: a breadth-first walk, one join a level, to its end.

    Levels are checkpointed where a checkpoint folder is set, so that the plan doesn't grow with the depth.
    """
    held = files.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    settle = lambda df: df.checkpoint() if held else df.cache()
    base = root.rsplit("/", 1)[0] if "/" in root else ""
    edges = settle(resolved(_references(files, "input|include"), files, base, ".tex").select("path", "target").distinct())
    seen = front = settle(files.where(F.col("path") == root).select("path"))
    while not front.isEmpty():
        front = settle(front.join(edges, "path").select(F.col("target").alias("path")).distinct().join(seen, "path", "left_anti"))
        seen = settle(seen.unionByName(front))
    return seen


def bibliographies(files: DataFrame, base: str = "") -> DataFrame:
    """Bibliography files that the files name, each once, in order of first mention (path, ord)."""
    found = resolved(_references(files.where(F.lower("path").endswith(".tex")), "bibliography|addbibresource"), files, base, ".bib")
    return found.groupBy(F.col("target").alias("path")).agg(F.min(F.struct("path", "line", "k", "j")).alias("ord"))


LEXICON = "class string, phrase string, suggestion string"


def lexicon_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lexicons (class, phrase, suggestion as tab-separated text) concatenated in order; the first path with rows wins a phrase."""
    tables = [spark.read.csv(p, sep="\t", schema=LEXICON).withColumn("ord", F.lit(i)) for i, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, tables)
    first = Window.partitionBy("class", "phrase").orderBy("ord")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("parts", F.regexp_extract_all(F.lower("phrase"), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0)))


def catalog(spark: SparkSession, sources: list[tuple[str, str]]) -> tuple[str, DataFrame]:
    """(name, table) of the first of the (name, path) sources that can be read and has rows; the last failure is raised where none has."""
    failure: Exception = ValueError("no source given")
    for name, path in sources:
        try:
            table = lexicon_files(spark, [path]).where("phrase is not null")
            if not table.isEmpty():
                return name, table
            failure = ValueError(f"{name}: {path} is empty")
        except AnalysisException as e:
            failure = e
    raise failure


def refresh(spark: SparkSession, fresh: DataFrame, path: str) -> bool:
    """Writes a lexicon (LEXICON) to ``path`` if it differs from what is there; an empty one never replaces one.  True where it wrote."""
    state = lambda df: tuple(df.select(*[c.split()[0] for c in LEXICON.split(", ")]).agg(F.count(F.lit(1)), F.sum(F.crc32(F.to_json(F.struct("*")).cast("binary")))).first())
    new = state(fresh)
    try:
        old = state(spark.read.csv(path, sep="\t", schema=LEXICON))
    except AnalysisException:
        old = None
    if not new[0] or new == old:
        return False
    fresh.select(*[c.split()[0] for c in LEXICON.split(", ")]).coalesce(1).write.mode("overwrite").csv(path, sep="\t")
    return True


class Unreadable(ValueError):
    """A source that could not be read, or has not the form asked for; ``kind``: missing, not-json, not-object, none-read."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"{kind}: {path}")
        self.kind, self.path = kind, path


def json_object(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The one JSON object in a file as a row (key, value as JSON), or parsed by ``schema``; raises :class:`Unreadable`."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        raise Unreadable("missing", path) from e
    try:
        held = json.loads(text["value"] if text else "")
    except ValueError as e:
        raise Unreadable("not-json", path) from e
    if not isinstance(held, dict):
        raise Unreadable("not-object", path)
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in held.items()], "key string, value string")
    return rows.select("key", F.from_json("value", schema).alias("v")).select("key", "v.*") if schema else rows


def quote_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of grounding (key, quote, todo) of a JSON object by key; a quote that is no text counts as none."""
    rows = json_object(spark, path)
    field = lambda f: F.when(F.col("value").rlike(r'"' + f + r'"\s*:\s*"'), F.get_json_object("value", f"$.{f}")).alias(f)
    return rows.select("key", field("quote"), field("todo"))


def read_some(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(files (path, text) of the paths that can be read, the others); raises :class:`Unreadable` where none can."""
    found, failed = [], []
    for path in paths:
        try:
            rows = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
            if rows.where(F.expr("NOT is_valid_utf8(text)")).isEmpty():
                found.append(rows)
            else:
                failed.append(path)
        except AnalysisException:
            failed.append(path)
    if not found:
        raise Unreadable("none-read", ", ".join(paths))
    return reduce(DataFrame.unionByName, found), failed


def settings(text: str) -> dict:
    """A nested mapping of a YAML file's plain part: keys by indentation, scalars as text, true and false as booleans; {} of others."""
    out: dict = {}
    stack = [(-1, out)]
    for row in text.split("\n"):
        if not row.strip() or row.lstrip().startswith("#"):
            continue
        m = re.fullmatch(r"( *)([\w-]+):(?:\s+(.*?))?\s*(?:#.*)?", row)
        if not m:
            return {}
        depth, value = len(m[1]), m[3]
        while stack[-1][0] >= depth:
            stack.pop()
        if value:
            stack[-1][1][m[2]] = {"true": True, "false": False}.get(value, value)
        else:
            stack[-1][1][m[2]] = inner = {}
            stack.append((depth, inner))
    return out


def _inner(held: dict, *names: str):
    for name in names:
        held = held.get(name) if isinstance(held, dict) else None
    return held


def front_matter_settings(text: str) -> tuple[bool, bool]:
    """(enabled, blank lines allowed) of the front-matter extension; only the booleans themselves count."""
    held = _inner(settings(text), "extensions", "front-matter") or {}
    return _inner(held, "enabled") is True, _inner(held, "allow_blank_lines") is True


def baseline(text: str) -> list[str]:
    """What a linter configuration lacks: extensions that are not enabled, rules that are not disabled."""
    held = settings(text)
    out = [f"extension {x} is not enabled" for x in T.REQUIRED_EXTENSIONS if _inner(held, "extensions", x, "enabled") is not True]
    return out + [f"rule {x} is not disabled" for x in T.DISABLED_PLUGINS if _inner(held, "plugins", x, "enabled") is not False]
