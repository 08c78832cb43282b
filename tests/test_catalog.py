import pytest

from strandflow.plans import catalog

NEITHER = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    ours = catalog.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    c = sorted(ours.columns)
    assert c == sorted(theirs.columns) and len(ours) == len(theirs)
    a, b = (x[c].sort_values(c).reset_index(drop=True) for x in (ours, theirs))
    for column in c:
        if a[column].dtype.kind == "f":
            near = ((a[column] - b[column].astype(float)).abs() < 1e-9) | (a[column].isna() & b[column].isna())
        else:
            near = (a[column].astype(str) == b[column].astype(str)) | (a[column].isna() & b[column].isna())
        assert near.all(), (column, a[~near].head(), b[~near].head())


@pytest.mark.parametrize("name", NEITHER)
def test_has_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
