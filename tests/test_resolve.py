import random
from difflib import SequenceMatcher

import pytest
from lorequarry.operators.resolve import best_matches


def _near(rng, s, letters):
    for _ in range(rng.randint(0, 4)):
        i = rng.randint(0, len(s))
        s = s[:i] + rng.choice(["", rng.choice(letters)]) + s[i + rng.randint(0, 1) :]
    return s


@pytest.mark.parametrize("threshold", [0.93, 0.8])
def test_equals_brute_force(spark, threshold):
    rng, letters = random.Random(3), "abcdefgé漢"
    roots = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 3, 8, 12, 17, 23, 23, 29, 36, 45, 62, 66, 70)] + ["the brotherhood of ab", "ab" * 130, ""]
    names = sorted({_near(rng, r, letters) for r in roots for _ in range(8)} | {""})
    candidates = sorted({_near(rng, r, letters) for r in roots for _ in range(6)} | {"", "ab" * 130})
    order = {c: i % 3 for i, c in enumerate(candidates)}
    rows = best_matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([*order.items()], "candidate string, ord long"), threshold).collect()
    got = {r.name: (r.match, r.ratio) for r in rows}
    assert len(rows) == len(names)
    for n in names:
        ratio, _, c = min((-SequenceMatcher(None, n, c).ratio(), o, c) for c, o in order.items())
        assert got[n] == ((c, -ratio) if -ratio >= threshold else (n, None))


def _shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_moves_little_more_than_the_names(spark):
    """Of names that share most of their words, few parts move: 90 KB of names, not the 4 MB of all their parts."""
    rng = random.Random(8)
    some = lambda: "Brotherhood of " + "".join(rng.choice("bdgklmnprstv") + rng.choice("aeiou") for _ in range(5))
    subjects = [some() for _ in range(2000)]
    objects = [s[:-2] + s[-1] for s in subjects[:50]] + [some() for _ in range(2000)]
    before = _shuffled(spark)
    rows = best_matches(spark.createDataFrame([(o,) for o in objects + subjects], "name string"), spark.createDataFrame([(s, 0) for s in subjects], "candidate string, ord long")).collect()
    assert sum(r.ratio is not None and r.ratio < 1 for r in rows) >= 50
    assert _shuffled(spark) - before < 1_000_000
