import random
from collections import Counter, defaultdict

from helpers import CLASHING, frame, words
from parkops.llm import mixing


def rows():
    rng = random.Random(2)
    out = []
    for i in range(600):
        source = rng.choice(["hot"] * 5 + ["b", "c", "d", None])
        out.append((i, "  " + " \t".join(words(rng, rng.randrange(1, 40))) + "\n", "en", source))
    return out + [(600, None, None, "b"), (601, "", None, "void"), (602, " \n", None, None), (5, out[5][1], "en", out[5][3])]


def water(totals, weights, share):
    """Targets by repeated sharing."""
    names = sorted((n for n in totals if n is not None)) + [n for n in totals if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, target, free = share * sum(totals.values()), {}, set(names)
    while free:
        level = left / sum(weight[n] for n in free)
        full = {n for n in free if weight[n] * level > 2 * totals[n]}
        if not full:
            target |= {n: weight[n] * level for n in free}
            break
        target |= {n: 2.0 * totals[n] for n in full}
        left -= sum(2 * totals[n] for n in full)
        free -= full
    return target


def test_targets_and_takes(spark):
    data = rows()
    got = mixing.mix(frame(spark, data, CLASHING)).collect()
    size = Counter()
    for i, t, _, s in data:
        size[s] += len((t or "").split())
    target = water(size, (5, 2, 1), 1.5)
    source = {i: s for i, _, _, s in data}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert len(got) == len(data)
    for s in size:
        assert abs(taken[s] - target[s]) <= 80
    again = mixing.mix(frame(spark, list(reversed(data)))).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixed_rows_come_as_often_as_taken(spark):
    data = rows()
    df = frame(spark, data, CLASHING)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    times = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.taken // r.size if r.size else 0
    assert times == +want


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed_rows(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None, None)])).collect()] == [0]


def test_repeats_are_numbered_in_blocks(spark, monkeypatch):
    """No window gathers all rows of a key that is repeated whole."""
    monkeypatch.setattr(mixing, "_BLOCK", 4)
    df = frame(spark, [(None if i % 2 else 5, "a b", None, "s") for i in range(60)] + [(7, "c", None, None)] * 9)
    got = mixing._numbered(df, ["doc_id", "source"]).collect()
    assert sorted(r._nth for r in got if r.doc_id == 7) == list(range(1, 10))
    assert sorted(r._nth for r in got if r.doc_id == 5) == sorted(r._nth for r in got if r.doc_id is None) == list(range(1, 31))
    plan = mixing.mixed_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    numbers = [x for x in plan.splitlines() if "row_number" in x and "_digest" in x and "Window" in x]
    assert numbers and all("_block" in x for x in numbers)
