"""Reading what a query gives and how it ran."""


def rows(df, *order):
    """Plain tuples in key order."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def executed_plan(df) -> str:
    """Final adaptive plan after running the query."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
