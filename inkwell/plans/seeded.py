"""A view of ``documents`` with appended snippets that hold what the rules look for.

The tables' own texts have none of the tells, so that an empty result would
prove nothing.  The same snippets are appended, in the same order, by Spark and
by the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Appended where doc_id is a multiple of the number.
TAILS = {
    7: "\n\nWe leverage a robust plan — it can foster and utilize more — and help; it works well; we agree. Moreover, furthermore and notably, conversely it is said: this helps us here and now today.",
    11: "\nPages 10–12 → done… see “note” here now",
    13: "\n```python\nx = 1; y = 2\n```",
    17: "\nSee prior work \\cite{alpha2020, beta2021,gamma2019} here.\n% GROUNDING: alpha2020 -- TODO verify -- not-found",
    19: "\nOne source \\citep[p. 3]{delta2018} says so.\nProse follows here.\n% GROUNDING: delta2018 -- \"a quote\"",
    23: "\n\nFirst short one.\n\nSecond short one.\n\nThird short one.",
    29: "\n\nThis may help and might work and could perhaps matter. The behaviour and colour of the organisation changed in order to improve. It did so due to the fact that a significant gain was seen.",
    31: "\n\n## Method\nThe text under the heading was tested (a, b, c).\nSigned-off-by: A Person",
    41: "\nA result \\textcite{alpha2020} was quoted.\n% GROUNDING: alpha2020 -- \"kept words\"\n% other note",
    43: "\n\nThe model learns. The model runs. The model wins.\n\nIn conclusion, the model serves as a tapestry of ideas.",
    47: "\n~~~~\nopen to the end  ",
    53: "\nWith p < 0.05 and r = .31 over 25000 rows, Smith et al. show \"gains\" in section 3. **A** and **B** are bold.",
    61: "\n\nThis sheds light on what was tested and it is used. A growing body of work plays a crucial role. The parts were checked.",
    67: "\n\n# Abstract\nA Large Model (LM) is described \\cite{zeta2022}.\n\n# Related Work\nIn today's field a seminal and impressive tool was shown. The tool works well on all of the inputs.\n\n# Results\n- one point\nThe LM and the Fast Parser (FP) show gains, and we measure them as we proposed. The tool works well on all of the inputs. Overall, I think it holds.",
    71: "\nThe options are as follows.\n\n- first thing\n- second thing",
    73: "\n\n| name | score | more |\n|---|---|---|\n| a | 1.25 | 7.5 |\n| b | 3.5 | 1,000.1 |\n\nFigure 1: One.\nFigure 3: Three.",
    79: "\nThe data are good and the data show gains. The data is fine. Scenarios like code completion help.",
    83: "\n\nThis is a worked example of it. Reader beware, as we shall see. It is important to note that it boils down to a write and a double-edged sword; low-hanging fruit.",
    89: "\n\\begin{figure}\\caption{Overview of our approach}\\label{fig:a}\\end{figure}\n\\begin{table}\\label{tab:b}\\end{table}\nSee \\autoref{fig:a} here. % \\ref{tab:b}",
    97: "\n\nHe came.\n\nHe saw.\n\nHe won.\n\nFirst, it ran on and on. Second, it slept. Third, it ate the rest.",
    101: "\nRunning fast, the model ended. Looking back, the data was lost. Here code-generation benchmarks and instruction-following tools remain.",
    103: "\n\nThe code review was done. The code inspection was done. The truth is simple and experts say so, a testament.",
}
HEAD_EVERY, HEAD = 37, "// Code generated by a tool. Do not edit.\n"
FRONT_EVERY, FRONT = 59, "---\ntitle: x\n\n"


def seeded(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text."""
    n = F.col("doc_id")
    tails = [F.when(n % k == 0, F.lit(t)).otherwise(F.lit("")) for k, t in TAILS.items()]
    heads = [F.when(n % k == 0, F.lit(t)).otherwise(F.lit("")) for k, t in ((FRONT_EVERY, FRONT), (HEAD_EVERY, HEAD))]
    return docs.select("doc_id", "lang", "source", F.concat(*heads, F.coalesce("text", F.lit("")), *tails).alias("text"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def seeded_sql() -> str:
    case = lambda k, t: f"CASE WHEN doc_id % {k} = 0 THEN {quoted(t)} ELSE '' END"
    parts = [case(FRONT_EVERY, FRONT), case(HEAD_EVERY, HEAD), "coalesce(text, '')", *(case(k, t) for k, t in TAILS.items())]
    return f"SELECT doc_id, lang, source, {' || '.join(parts)} AS text FROM documents"
