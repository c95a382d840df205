from collections import defaultdict

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts, or from ``(doc_id, text)``; the other columns clash with names inside."""

    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        schema = "doc_id long, text string, id string, row int, key long, words string, start int"
        return spark.createDataFrame([(*r, "x", 7, None, "w", 1) for r in rows], schema)

    return make


class Groups:
    """Union of linked things, for brute force."""

    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, x, y):
        self.parent[self.root(x)] = self.root(y)

    def members(self):
        found = defaultdict(set)
        for x in self.parent:
            found[self.root(x)].add(x)
        return list(found.values())


@pytest.fixture
def groups():
    return Groups()
