"""The n-gram Jaccard join against all pairs compared one by one."""

import random
import re

import numpy as np
import pytest

from tablescope.llm import jaccard
from tablescope.llm.components import components


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((str(doc), len(s), str(least.get(top(i)) if s else doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, families, sizes, copies, edits, noise):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(noise)]
    rows = []
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.randint(*sizes))]
        for _ in range(r.randint(1, copies)):
            own = list(base)
            for _ in range(r.randint(0, max(1, int(len(own) * edits)))):
                at = r.randrange(len(own))
                if r.random() < 0.5:
                    own[at] = r.choice(words)
                elif len(own) > 2:
                    del own[at]
                else:
                    own.insert(at, r.choice(words))
            rows.append(" ".join(own))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(
    ("case", "crowded"),
    [
        (dict(seed=1, families=40, sizes=(1, 30), copies=10, edits=0.05, noise=500), 3),
        (dict(seed=3, families=3, sizes=(20, 60), copies=120, edits=0.06, noise=30), 3),
        (dict(seed=4, families=60, sizes=(3, 80), copies=8, edits=0.1, noise=3), jaccard.CROWDED),
    ],
)
def test_components(spark, case, crowded):
    rows = corpus(**case)
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), crowded=crowded).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (None, "one"), (7, "a b c d e"), (7, "a b c d e"), (8, "x y " * 30_000), (0, "A b c D e"), (None, "lonely words here")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sig string, component_id int")
    got = jaccard.link(df).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)
    assert jaccard.link(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + j) for i in range(9) for j in range(i)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} | {2000 + i: 2000 for i in range(9)}


def test_bands_keep_linked_sizes_adjacent():
    starts = jaccard.band_starts(5000, 85)
    band = np.searchsorted(starts, np.arange(5001), side="right") - 1
    for a in range(1, 4000):
        assert band[100 * a // 85] - band[a] <= 1


def test_histograms_never_overstate_a_difference():
    r = np.random.default_rng(1)
    for _ in range(200):
        common, one, two = (np.unique(r.integers(0, 1 << 48, n)).astype(np.uint64) for n in r.integers(0, 3000, 3))
        a, b = np.union1d(common, one), np.union1d(common, two)
        bound = jaccard.least_difference(jaccard.histogram(a), jaccard.histogram(b))
        assert bound <= len(np.setxor1d(a, b))
    assert jaccard.least_difference(jaccard.histogram(a), jaccard.histogram(a)) == 0


def test_any_order_of_shingles_finds_linked_sets_in_their_prefixes():
    r = np.random.default_rng(7)
    for percent in (60, 80, 85, 99):
        for counts in (np.zeros(jaccard.CELLS, np.int64), r.integers(0, 1 << 26, jaccard.CELLS)):
            for _ in range(60):
                common = np.unique(r.integers(0, 1 << 48, r.integers(1, 400))).astype(np.uint64)
                more = [np.unique(r.integers(0, 1 << 48, r.integers(0, 2 + len(common) * (100 - percent) // percent))).astype(np.uint64) for _ in range(2)]
                both = [np.union1d(common, x) for x in more]
                if 100 * len(np.intersect1d(*both)) < percent * len(np.union1d(*both)):
                    continue
                sets = jaccard.Sets.__new__(jaccard.Sets)
                sets.elements, sets.sizes = np.concatenate(both), np.array([len(x) for x in both])
                sets.rows, sets.offsets = np.repeat([0, 1], sets.sizes), np.concatenate([[0], np.cumsum(sets.sizes)])
                found, members, _ = jaccard.signatures(sets, np.array([0, 1]), np.array([1, 2]), counts, percent)
                node, early = members & jaccard.NODE, members < jaccard.BEYOND
                assert any(np.isin(found[(node == a) & early], found[node == 3 - a]).any() for a in (1, 2))


def test_signatures_are_few_and_rare_ones_come_first():
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join(common + [f"t{k}x{i}" for i in range(100)]) for k in range(50)]
    sets = jaccard.Sets(jaccard.pa.array(texts), 4)
    counts = np.bincount(jaccard.cell_of(sets.elements), minlength=jaccard.CELLS)
    found, members, _ = jaccard.signatures(sets, np.arange(50), np.arange(50), counts, 85)
    assert len(found) < 0.35 * len(sets.elements)
    # Texts with three quarters of their shingles in common never meet.
    owners = {}
    for sig, member in zip(found.tolist(), members.tolist()):
        owners.setdefault(sig, set()).add(member & jaccard.NODE)
    assert max(map(len, owners.values())) == 1


def test_crowded_bucket_with_one_short_prefix(spark):
    # The smaller set alone stands in its band; larger ones look for it and are dealt over many parts.
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))] + [(i, " ".join([*base, *(f"x{i}y{k}" for k in range(14 + i % 3))])) for i in range(1, 40)]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), crowded=2).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows)
