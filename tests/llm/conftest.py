import pytest


@pytest.fixture()
def clash(spark):
    """Adds columns whose names operators use inside, so that a clash would show."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["k", "t", "s", "uid", "h", "a", "b", "rep", "size", "item", "line", "kind", "form", "place", "n", "d", "part", "total", "x"]
        return df.withColumns({c: F.lit("?") for c in names if c not in df.columns})

    return add
