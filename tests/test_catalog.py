import pytest
from compare import duck, rows
from data import SF
from tidemark import catalog

Q, S = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert not set(S) - set(Q)


@pytest.mark.parametrize("name", sorted(S))
def test_same_rows_as_sql(spark, con, name):
    got, want = Q[name](spark, SF).toPandas(), con.execute(S[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_others_run(spark, name):
    assert Q[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_order_tables_deal_lines_once(spark):
    plan = Q["order_tables"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_symbols_of_overlapping_pieces(spark, tmp_path):
    """A lone dollar shifts the pieces behind it, so they overlap: two distinct ones, where the order decides the text."""
    import pandas as pd
    from pyspark.sql import functions as F
    from tidemark.operators.rules import resolve_math

    texts = ["x of y costs $5 and z of w", "$5 the x of y", "a of b", "costs $5 and $6 of x of y, $7", "x of y $5 and z of w, x of y", None]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    con = duck(SF)
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet'")
    assert rows(Q["document_symbols"](spark, str(tmp_path)).toPandas()) == rows(con.execute(S["document_symbols"]).df())
    text = r"$\beta + x$ costs $5 ± $\beta + x$"
    resolved = [spark.range(1).select(resolve_math(F.lit(text), last_first=x)["resolved"]).first()[0] for x in (False, True)]
    beta = "beta (market sensitivity)"
    assert resolved == [f"{beta} costs $5 plus or minus {beta}", f"{beta} costs plus or minus{beta} + x$"]
