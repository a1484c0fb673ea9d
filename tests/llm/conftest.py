import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    """The session, with the package on its workers."""
    from pyrewatch.session import ship_package

    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def documents(llm):
    return llm.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(llm):
    """Null and empty texts, null ids, repeated rows, copies, a long text, and columns with names used inside."""
    import random

    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    base, other, shared = prose(120), prose(90), prose(55)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base), (2, base), (3, near), (4, other), (4, other), (5, None), (6, ""), (7, "   \t\n"), (None, base),
        (None, prose(70)), (8, f"{prose(30)} {shared} {prose(20)}"), (9, f"{prose(12)}  {shared}\n{prose(44)}"),
        (10, prose(20_000)), (11, "one two"), (12, "one two"), (13, "ÉCOLE naïve İstanbul 日本語 😀"), (14, "x" * 3000),
        (15, "x" * 400), (16, "a b " * 80), (17, "b a " * 90), (-3, other), (18, "1234 !!"),
    ]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, key long, grp int, shard int, "
              "component_id string, smallest double, n string, `a.b` int")
    return llm.createDataFrame([(i, t, "en" if t else None, "s", len(t or ""), 1, 2, 3, "c", 0.5, "n", 7) for i, t in rows], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
