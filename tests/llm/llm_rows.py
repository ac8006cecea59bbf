"""Helpers of the training-data tests."""

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def result(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
