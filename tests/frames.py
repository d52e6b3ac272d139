"""What tests read off DataFrames. Not in conftest: that name is shared by all test folders."""


def rows(df):
    return [tuple(row) for row in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
