"""What several test modules use."""

DATA = "/root/testdata/sf0.001"


def same_rows(df, con, sql):
    """Whether a DataFrame and a DuckDB query have the same rows, whatever their order."""
    mine, theirs = df.toPandas(), con.sql(sql).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True) for x in (mine, theirs))
    assert len(a) == len(b)
    assert (a == b).all().all(), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head()
