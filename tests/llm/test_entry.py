import ast
import pathlib

from test_operators import brute_components, brute_lines

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import lines, pipeline, queries

DATA = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parents[2]


def test_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and "pipeline" in found
    assert len(corpus_pipeline.STAGES) == 5


def test_top_k_against_sql(spark, same_rows):
    same_rows(queries.QUERIES["op7_top_k"](spark, DATA), queries.ORACLES["op7_top_k"])


def test_pipeline(spark):

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = corpus_pipeline.run(spark, DATA).collect()
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    kept = brute_lines(rows, exact=True)
    rows = [(d, kept[d]) for d, t in rows if kept[d] == t or kept[d].strip()]
    rows = [(d, t) for (d, t), (_, c) in zip(rows, brute_components(rows, 5)) if d == c]
    got = {r.doc_id: r.text for r in found}
    missing = {d for d, _ in rows} - set(got)
    assert len(missing) <= 2 and set(got) <= {d for d, _ in rows}  # very short texts may be in no language
    assert all(got[d] == t for d, t in rows if d in got) and all(r.decodes for r in found)
    assert lines.MIN_DOCS == 5


def test_pipeline_odd(spark, odd, none):
    """Nulls, repeats, long texts, and columns of internal names, through all stages."""
    clashing = odd.withColumns({"_q_key": F.lit(1), "_Q_text": F.lit("x"), "r_0": F.lit(2)})
    found = pipeline.run_on(spark, clashing, "")
    assert found.columns == [*clashing.columns, "piece_ids", "n_pieces", "decodes"]
    kept = [(r.doc_id, r.text) for r in found.collect()]
    assert all(t and t.strip() for _, t in kept) and len(kept) == len(set(kept)) and {None, 8, 9} <= {d for d, _ in kept}
    assert found.where("_q_key <> 1 or r_0 <> 2 or _Q_text <> 'x' or key <> 'clash'").count() == 0
    assert pipeline.run_on(spark, none, "").count() == 0


def test_nothing_else_imports_the_subpackage():
    for path in pathlib.Path(ROOT, "quarry").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n for n in names), path
