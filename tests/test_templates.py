import itertools
import random

import pytest
from builders import minute

from pyrewatch.functions.text import template_of
from pyrewatch.operators import templates as tp
from pyrewatch.schemas import FAILURES


def cases(n, words, seed=1):
    """Cases of two scenarios, some with equal sets, some without anything in common."""
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(words)]
    sets = {}
    for i in range(n):
        own = pool[:4] if i % 7 == 0 else draw.sample(pool, draw.randint(1, 5))
        sets[f"INC-{i:03}"] = (FAILURES[i % 2], {f"failed {w}" for w in own})
    return sets


def tables(spark, sets):
    logs = [(i, minute(k), "ERROR", message) for i, (_, own) in sets.items() for k, message in enumerate(sorted(own) * 2)]
    logs += [(i, minute(0), "WARN", "unlike the others") for i in sets]
    labels = [(i, scenario) for i, (scenario, _) in sets.items()]
    return (spark.createDataFrame(logs, "incident_id string, timestamp timestamp_ntz, level string, message string"),
            spark.createDataFrame(labels, "incident_id string, scenario string"))


@pytest.mark.parametrize("block_sets", [1024, 7, 1])
def test_similarity_of_all_pairs(spark, block_sets):
    sets = cases(60, 40)
    logs, labels = tables(spark, sets)
    found = {r["scenario"]: r for r in tp.template_similarity(logs, labels, block_sets).collect()}
    for scenario in FAILURES[:2]:
        own = [s for name, s in sets.values() if name == scenario]
        scores = [len(a & b) / len(a | b) for a, b in itertools.combinations(own, 2)]
        row = found[scenario]
        assert row["pairs"] == len(scores) and row["max_similarity"] == max(scores)
        assert row["mean_similarity"] == pytest.approx(sum(scores) / len(scores))
    assert set(found) == set(FAILURES[:2])


def test_blocks_without_a_common_template_do_not_meet(spark):
    """Sets of disjoint families: the posting lists join blocks of one family only."""
    sets = {f"INC-{f}{i}": (FAILURES[0], {f"family {chr(97 + f) * 4} {chr(97 + i) * 3}", f"family {chr(97 + f) * 4}"}) for f in range(6) for i in range(4)}
    logs, labels = tables(spark, sets)
    row = tp.template_similarity(logs, labels, 4).first()
    scores = [len(a & b) / len(a | b) for (_, a), (_, b) in itertools.combinations(sets.values(), 2)]
    assert row["pairs"] == len(scores) and row["mean_similarity"] == pytest.approx(sum(scores) / len(scores))


def test_similarity_of_one_case_and_of_none(spark):
    logs, labels = tables(spark, dict(list(cases(1, 8).items())))
    row = tp.template_similarity(logs, labels).first()
    assert (row["pairs"], row["max_similarity"], row["mean_similarity"]) == (0, 0.0, None)
    assert tp.template_similarity(logs.limit(0), labels).count() == 0


def test_templates_of_the_cases_differ(spark):
    rows = spark.createDataFrame([("failed abc",), ("failed abd",)], "message string")
    assert rows.select(template_of(rows["message"]).alias("t")).distinct().count() == 2
