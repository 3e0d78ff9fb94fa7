import re

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE, SF_SMALL

# queries without an SQL oracle, and why
ROWS_ONLY = {"evidence_rows", "hurdle_scores", "tweedie_cv", "attribution_long",
             "model_importance"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "nation_key" in df.columns


def test_every_query_has_oracle_unless_listed():
    own = {n for n in E.queries() if not n.startswith("op") or "_" not in n or not n[2:n.index("_")].isdigit()} - {"pipeline"}
    assert own - set(E.oracle_sql()) == ROWS_ONLY
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["alloc_weighted_any", "assemble_outer", "agg_median", "prep_impute", "metric_auc",
                                  "html_text", "rank_scores", "knn", "spec_compile", "stream_signal"])
def test_oracle_matches_small(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(sdf.columns)

    def norm(rows, names):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)
    assert norm([tuple(r) for r in sdf.collect()], sdf.columns) == norm(rel.fetchall(), cols)


def test_evidence_rows_equal_python_re(spark):
    """Brute force with Python's (Unicode-aware) regex on the whole small documents table."""
    from regionscore.functions.text import place_name_pattern
    from regionscore.plans.catalog_text import RUN_SUFFIX
    pat = re.compile(place_name_pattern(RUN_SUFFIX))
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "source", "text").collect()
    expect = {(d["doc_id"], m.strip()) for d in docs for m in pat.findall(d["source"] + " " + d["text"])}
    got = {(r["doc_id"], r["county"]) for r in E.queries()["evidence_rows"](spark, SF_ORACLE).collect()}
    assert got == expect
