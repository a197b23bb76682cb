"""Clash chains in registration batches, and attributes of imported vehicles."""

import random

import pytest
from parkops import schemas as S
from parkops.operators import imports
from parkops.plans.components import connected_components


def sequential(rows):
    names, mails, won = set(), set(), set()
    for i, u, e in sorted(rows):
        if u not in names and e not in mails:
            won.add(i)
            names.add(u)
            mails.add(e)
    return won


def accepted(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, u string, e string").repartition(4)
    return {r.id for r in imports.greedy_unique(df, "id", ["u", "e"], **options).collect()}


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("counted", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before


def test_a_long_clash_chain_takes_few_jobs(spark):
    """Row i shares its name with row i - 1 and its e-mail with row i + 1: every second one wins."""
    def chain(n):
        return [(i, f"u{(i + 1) // 2}", f"e{i // 2}") for i in range(n)]
    few, jobs_few = jobs_of(spark, lambda: accepted(spark, chain(100)))
    many, jobs_many = jobs_of(spark, lambda: accepted(spark, chain(10_000)))
    assert few == sequential(chain(100)) and many == sequential(chain(10_000))
    assert len(many) == 5000 and jobs_many < 3 * jobs_few   # a hundred times as long


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_random_batches_equal_the_sequential_rule(spark, rounds):
    rng = random.Random(rounds)
    rows = [(i, f"u{rng.randrange(60)}", f"e{rng.randrange(200)}") for i in range(400)]
    rows += [(1000 + i, "hot", f"h{rng.randrange(150)}") for i in range(300)]   # a name that a third of all rows share
    rng.shuffle(rows)
    assert accepted(spark, rows, rounds=rounds) == sequential(rows)
    assert accepted(spark, [], rounds=rounds) == set()


def test_components_equal_a_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)]
    label = {}
    for a, b in edges:
        for n in (a, b):
            label.setdefault(n, n)
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_vehicle_attributes(spark):
    req = spark.createDataFrame([(1, 1, "a-1", "car", "Make", "", None), (2, 1, "A-1", "car", "", "Model", "red")],
                                "request_id long, user_id long, license_plate string, vehicle_type string, make string, model string, color string")
    r = {x.request_id: x for x in imports.vehicle_import_validate(req, spark.createDataFrame([], S.VEHICLES)).collect()}
    assert (r[1].accepted, r[1].plate, r[1].make, r[1].model, r[1].color) == (True, "A-1", "Make", None, None)
    assert (r[2].accepted, r[2].make, r[2].model, r[2].color) == (False, None, "Model", "red")
