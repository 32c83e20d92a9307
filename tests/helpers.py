"""Small in-memory corpora for the tests."""

from factloom.sources.corpus import to_lines

FILES = "repo string, file string, content string"


def files(spark, contents, repo="r"):
    return spark.createDataFrame([(repo, f, c) for f, c in contents.items()], FILES)


def lines(spark, contents, repo="r"):
    return to_lines(files(spark, contents, repo))


def rows(df, *columns, order=None):
    out = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))
