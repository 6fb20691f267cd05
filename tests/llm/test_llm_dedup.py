"""Jaccard join and repeated passages against brute force over every pair and every window."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spendlens.llm import common, signature_tree, suffix_dedup
from spendlens.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 50_000)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def groups_by_brute_force(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            inter = len(a & b)
            if i == j or den * inter >= num * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), i if i is None or not s else root(i)) for i, s in sets)


def family(rng, size, copies, changes):
    """Near copies of one random text, with ``changes`` words replaced in each."""
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    for _ in range(copies):
        text = list(base)
        for _ in range(changes):
            text[rng.randrange(size)] = f"v{rng.randrange(10**6)}"
        yield " ".join(text)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(SMALL).limit(150).collect()]
    for size, copies, changes in ((40, 30, 1), (120, 25, 2), (200, 10, 8), (30, 8, 0), (400, 12, 5)):
        texts += family(rng, size, copies, changes)
    texts += ["", None, " \n", "a b", "A  b\n", "a b c", "x y z w", "X y z w", "longer " * 3000, "one two three four five"]
    rng.shuffle(texts)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    return rows + [(None, "x y z w"), (None, None), (2001, "a b"), (2001, "x y z w"), (2002, "p q r s"), (2002, "p q r s")]


@pytest.mark.parametrize("n, num, den, block", [(4, 85, 100, 2_000_000), (4, 85, 100, 3000), (5, 80, 100, 1500), (3, 1, 2, 5000)])
def test_link_groups_equal_brute_force(spark, corpus, n, num, den, block):
    df = spark.createDataFrame([(i, t, "m", 1) for i, t in corpus], "doc_id long, text string, component string, n int")
    got = signature_tree.link_groups(df.repartition(4), n, num, den, block_grams=block).collect()
    assert Counter(map(tuple, got)) == groups_by_brute_force(corpus, n, num, den)


def test_link_groups_of_empty_tables(spark):
    assert signature_tree.link_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert sorted(map(tuple, signature_tree.link_groups(blank).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_prefix_is_long_enough():
    for n in range(1, 300):
        p = signature_tree.prefix_length(n, 85, 100)
        assert 1 <= p <= n and n - p < -(-85 * n // 100)


def test_tree_links_a_large_family_with_few_comparisons(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = []
    for _ in range(600):
        s = base.copy()
        s[rng.integers(0, 200, 3)] = rng.integers(0, 2**63, 3).astype(np.uint64)
        sets.append(np.unique(s))
    calls = []
    real = np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda *a, **k: calls.append(1) or real(*a, **k))
    links = signature_tree.exact_links(list(range(600)), sets, 85, 100)
    assert len(links) == 599 and len(calls) < 3000


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(2)
    sets = []
    for size in (5, 15, 17, 60, 200, 1000):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, 3 * k).astype(np.uint64)])) for k in range(6)]
    for num, den in ((85, 100), (1, 2)):
        for width in (64, 1024):
            bits = np.stack([signature_tree.bitmap(s, width) for s in sets])
            size = np.array([len(s) for s in sets])
            tree = signature_tree.SignatureTree(bits, size)
            allowed = tree.possible(0, slice(0, len(sets)), slice(0, len(sets)), num, den)
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    inter = len(np.intersect1d(a, b))
                    assert allowed[i, j] or den * inter < num * (len(a) + len(b) - inter)


def test_only_texts_that_share_most_grams_go_on(spark, monkeypatch):
    """Texts with one common line are no candidates: bitmaps and prefixes are made of the others only."""
    rng = random.Random(11)
    line = " ".join(f"c{k}" for k in range(15))
    rows = [(k, " ".join([line] + [f"w{rng.randrange(5000)}" for _ in range(120)])) for k in range(200)]
    rows += [(1000 + k, f"{line} {t}") for k, t in enumerate([*family(rng, 150, 6, 2), *family(rng, 40, 4, 0)])]
    rows += [(None, rows[0][1]), (3000, "")]
    made, whole = [], common.cut

    def cut(df):
        made.append(whole(df))
        return made[-1]

    monkeypatch.setattr(common, "cut", cut)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = signature_tree.link_groups(docs).collect()
    assert Counter(map(tuple, got)) == groups_by_brute_force(rows, 4, 85, 100)
    assert [{r.doc_id for r in t.select("doc_id").collect()} <= {*range(1000, 1010)} for t in made if "bits" in t.columns] == [True]


@pytest.mark.parametrize("num, den", [(85, 100), (80, 100), (1, 2)])
def test_grams_held_alone_are_counted_over_all_packs(num, den):
    rng = np.random.default_rng(7)
    texts = [np.unique(rng.integers(0, 2**64, 30, np.uint64)) for _ in range(60)]
    texts += [np.unique(np.concatenate([texts[k][::2], texts[-1][:5]])) for k in range(0, 60, 3)] + [texts[0], texts[0][:0]]
    held = Counter(g for t in texts for g in t.tolist())
    zones = [signature_tree.zone_of(t, num, den) for t in texts]
    assert [z.tolist() for z in zones] == [[g for g in t.tolist() if g <= signature_tree.zone_top(num, den)] for t in texts]
    alone, packed = [], []
    for a, b in ((0, 25), (25, 26), (26, 70), (70, len(texts))):
        own, rows = signature_tree._pack(100 + a, zones[a:b], num, den)
        alone += own.tolist()
        packed.append(rows)
    parts = pa.Table.from_batches(packed)
    met = pa.concat_tables(signature_tree._met(parts.filter(pa.array([p % 3 == k for p in parts["part"].to_pylist()]))) for k in range(3))
    assert met.num_rows <= 3 * len(packed)
    met = signature_tree._add_met(met)
    for entry, times in zip(met["entry"].to_pylist(), met["times"].to_pylist(), strict=True):
        alone[entry - 100] -= times
    assert alone == [sum(held[g] == 1 for g in z.tolist()) for z in zones] and sum(map(len, zones)) == sum(
        sum(p["size"].to_pylist()) for p in packed) + sum(
        n - 1 for a, b in ((0, 25), (25, 26), (26, 70), (70, len(texts))) for n in Counter(g for z in zones[a:b] for g in z.tolist()).values())


def test_prefixes_go_by_exact_counts(spark):
    """The rarest grams of a list come first, whatever the sketch says; those that one entry has alone aren't given."""
    rng = random.Random(4)
    lists = {e: sorted({rng.randrange(30) ** 2 - 200 for _ in range(14)} | {1000 + e, 2000 + e}) for e in range(25)}
    rows = [(e, 10, g) for e, g in lists.items()] + [(0, 10, lists[0])]  # a row that repeats
    times = Counter(g for _, _, grams in rows for g in grams)
    held = Counter(g for grams in lists.values() for g in grams)
    want = set()
    for e, grams in lists.items():
        first = sorted(grams, key=lambda g: (held[g] > 1, times[g], g))[:signature_tree.prefix_length(10, 1, 2)]
        want |= {(e, g) for g in first if held[g] > 1}
    got = signature_tree.prefixes(spark.createDataFrame(rows, "entry long, n long, prefix array<long>"), 1, 2).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 500)] + [(1000, 1001), (1001, 1000), (1002, 1001), (5000, 5000)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()))
    assert got == {i: 0 for i in range(501)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def covered_by_brute_force(rows, size):
    """Word positions in a window that occurs at an earlier place."""
    seen, covered = set(), defaultdict(set)
    for i, t in sorted((i, t or "") for i, t in rows if i is not None):
        w = words(t)
        for k in range(len(w) - size + 1):
            gram = tuple(w[k:k + size])
            if gram in seen:
                covered[i].update(range(k, k + size))
            seen.add(gram)
    return dict(covered)


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(3)
    rnd = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    long, exact, short = rnd(60), rnd(50), rnd(49)
    rows = [(k, " ".join(rnd(rng.randint(0, 30)) + long + rnd(rng.randint(0, 30)))) for k in range(40)]
    rows += [(100 + k, " ".join(rnd(rng.randint(0, 30)) + exact + rnd(rng.randint(0, 30)))) for k in range(40)]
    rows += [(200 + k, " ".join(rnd(rng.randint(1, 30)) + short + rnd(rng.randint(1, 30)))) for k in range(10)]
    rows += [(300, " ".join(rnd(5) + long + rnd(3) + long)), (301, None), (302, ""), (303, " ".join(["x"] * 500)),
             (304, " ".join(rnd(5) + long[:55] + rnd(3) + long[2:])), (305, " ".join(long)), (306, " ".join(long)),
             (307, " ".join(long).upper())]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(SMALL).select("doc_id", "text").collect()]
    return rows


@pytest.mark.parametrize("partitions, min_words", [(8, 50), (40, 50), (8, 30)])
def test_spans_equal_every_repeated_window(spark, passages, partitions, min_words):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(i, t, 0) for i, t in passages], "doc_id long, text string, key int").repartition(6)
        got = defaultdict(set)
        for r in suffix_dedup.repeated_spans(df, min_words).collect():
            assert not got[r.doc_id] & set(range(r.start, r.stop)) and (r.of_doc_id, r.of_start) < (r.doc_id, r.start)
            got[r.doc_id].update(range(r.start, r.stop))
        assert dict(got) == covered_by_brute_force(passages, min_words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_removal_leaves_each_window_once(spark, passages):
    extra = [(None, passages[0][1]), (None, None), (5, passages[5][1])]
    schema = "doc_id long, text string, spans string, start int"
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in passages + extra], schema)
    got = suffix_dedup.remove_repeats(df).collect()
    assert len(got) == len(passages) + len(extra) and got[0].spans == "s"
    assert sum(r.doc_id is None for r in got) == 2
    seen = Counter()
    for r in got:
        w = words(r.text)
        if r.doc_id is not None and r.doc_id != 5:
            seen.update({tuple(w[k:k + 50]) for k in range(len(w) - 49)})
    assert not [g for g, n in seen.items() if n > 1]
    clean = {i: t for i, t in passages if i not in covered_by_brute_force(passages, 50)}
    assert all(r.text == clean[r.doc_id] for r in got if r.doc_id in clean)


def test_spans_of_empty_tables(spark):
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string"), 10)


def test_a_repeated_row_at_the_first_place_keeps_its_passage(spark):
    rng = random.Random(9)
    rnd = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared = rnd(70)
    first, later = (" ".join(rnd(20) + shared + rnd(20)) for _ in range(2))
    rows = [(1, first)] * 5 + [(2, later), (2, later), (3, " ".join(rnd(80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.repeated_spans(df).collect()))
    assert got == [(2, 20, 90, 1, 20)]
    texts = {(r.doc_id, r.text) for r in suffix_dedup.remove_repeats(df).collect()}
    assert (1, first) in texts and len(texts) == 3 and all(" ".join(shared) not in t for i, t in texts if i == 2)


def test_anchor_rows_are_flat(spark):
    """A key takes 16 bytes of an anchor row, not a struct and a list of its own, and has all its places."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=2000)) for _ in range(40)]
    texts.append(" ".join(f"p{k}" for k in range(60)) + " " + texts[0] + " " + " ".join(f"p{k}" for k in range(60)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).withColumns(suffix_dedup._text_keys())
    rows = docs.mapInArrow(suffix_dedup._anchor_rows(50), suffix_dedup.ANCHORS)
    hashed, at = common.word_hashes(pa.array(texts))
    own = [suffix_dedup._keys(w, suffix_dedup.anchors(w, 50), 50) for w in (hashed[a:b] for a, b in zip(at, at[1:]))]
    keys = [np.unique(np.concatenate(k)[np.concatenate(k) != 0]) for k in own]
    got = rows.orderBy("doc_id").collect()
    for row, key, (ahead, behind) in zip(got, keys, own, strict=True):
        assert row["keys"] == common.as_signed(key).tolist()
        for i, k in enumerate(key):
            places = [p for a in range(len(ahead)) for p, x in ((2 * a, ahead[a]), (2 * a + 1, behind[a])) if x == k]
            assert row["places"][row["at"][i]:row["at"][i + 1]] == places


def test_only_texts_with_wanted_suffixes_travel(spark):
    """Every wanted row passes the sketch, whatever its size; of the others few do."""
    rows = [(k - 1000, k * k, -k) for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, h1 long, bucket long").repartition(5)
    wanted = table.where("doc_id % 40 = 0").select("doc_id", "h1")
    own = {r[:2] for r in rows if r[0] % 40 == 0}
    for bits, most in ((common.SKETCH_BITS, 55), (1 << 16, 60), (32, 2000)):
        passed = common.sketched(table, wanted, ["doc_id", "h1"], bits)
        got = list(map(tuple, passed.collect()))
        assert passed.columns == table.columns and set(got) <= set(rows) and len(got) == len(set(got))
        assert own <= {r[:2] for r in got} and len(got) <= most
    assert common.sketched(table, wanted.where("false"), ["doc_id", "h1"]).count() == 0


def test_anchors_are_the_last_least_grams():
    rng = np.random.default_rng(4)
    for n, most in ((16, 3), (50, 2), (51, 4), (400, 5), (400, 1 << 60)):
        grams = rng.integers(0, most, n).astype(np.uint64)
        for span in (1, 2, 3, 15, 16):
            want = [max(range(i, i + span), key=lambda k: (-int(grams[k]), k)) for i in range(n - span + 1)]
            assert suffix_dedup._anchor_of_windows(grams, span).tolist() == want


def peak_of(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_word_steps_is_small(monkeypatch):
    """No copy of each passage's grams; gram counts are held once; a batch is taken in quarters of a slice."""
    grams = np.random.default_rng(1).integers(0, 1 << 60, 500_000).astype(np.uint64)
    assert peak_of(lambda: suffix_dedup._anchor_of_windows(grams, 35)) < 10 * grams.nbytes
    batch = pa.RecordBatch.from_pydict({"text": ["some few words"] * 3})
    assert peak_of(lambda: list(signature_tree._count_cells(2)(iter([batch])))) < 1.5 * signature_tree.CELLS
    monkeypatch.setattr(common, "SLICE_BYTES", 400)
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 50] * 80, "doc_id": range(80), "h1": range(80), "h2": range(80)})

    class Task:
        def partitionId(self):
            return 0

    for module in (suffix_dedup, signature_tree):
        monkeypatch.setattr(module.TaskContext, "get", staticmethod(Task))
    counts = type("Counts", (), {"value": np.zeros(signature_tree.CELLS, np.uint8)})
    for step in (suffix_dedup._anchor_rows(50), signature_tree._sets(4, 85, 100, counts)):
        assert max(b.num_rows for b in step(iter([batch]))) <= 2


def test_places_of_one_surrounding_travel_as_one_row(spark, monkeypatch):
    """A line that texts repeat over and over makes a few suffixes and matches a text, not some for each time."""
    rng = random.Random(8)
    line, tail = ([f"w{rng.randrange(3000)}" for _ in range(n)] for n in (11, 60))
    rows = [(k, " ".join([f"a{k}"] + line * (40 + k) + [f"b{k}"] + tail + line * 9)) for k in range(30)]
    rows += [(7, " ".join(line * 80)), (7, " ".join(["c"] + line * 50)), (40, rows[3][1]), (41, " ".join(["x"] * 700))]
    made, whole = [], common.cut

    def cut(df):
        made.append(whole(df))
        return made[-1]

    monkeypatch.setattr(common, "cut", cut)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = defaultdict(set)
    for r in suffix_dedup.repeated_spans(docs).collect():
        got[r.doc_id].update(range(r.start, r.stop))
    assert {k: v for k, v in got.items() if k != 7} == {
        k: v for k, v in covered_by_brute_force(rows, 50).items() if k != 7}
    suffixes, found = made[-2:]
    places = suffixes.selectExpr("count(*) as n", "sum(1 + size(more)) as places").first()
    assert places.places > 2500 and places.n < 33 * 60
    assert found.count() < 33 * 120
    assert suffixes.groupBy("doc_id", "key", "further", "other").count().where("count > 1 and doc_id != 7").count() == 0


def test_words_are_hashed_once_a_slice(monkeypatch):
    """Grams and keys of all texts of a slice are made in three calls, not five a text, and are those of each text alone."""
    rng = np.random.default_rng(6)
    texts = [None, "", *(" ".join(f"w{k}" for k in rng.integers(0, 40, n)) for n in (3, 49, 50, 51, 0, 80, 300, 50, 700)), None]
    hashed, at = common.word_hashes(pa.array(texts))
    whole, first, last = suffix_dedup._minimisers(hashed, at, 50)
    for a, b in zip(at, at[1:]):
        mine = (whole >= a) & (whole < b)
        alone = suffix_dedup._minimisers(hashed[a:b], np.array([0, b - a]), 50)
        assert [(x[mine] - a).tolist() for x in (whole, first, last)] == [x.tolist() for x in alone]
    places = np.array([5, 0, 17])
    assert common.gram_hashes(hashed, 33, places).tolist() == common.gram_hashes(hashed, 33)[places].tolist()
    calls, grams = [], common.gram_hashes
    monkeypatch.setattr(common, "gram_hashes", lambda *a: calls.append(1) or grams(*a))
    monkeypatch.setattr(suffix_dedup.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda _: 0})()))
    ids = range(len(texts))
    batch = pa.RecordBatch.from_pydict({"text": texts, "doc_id": ids, "h1": ids, "h2": ids})
    rows = pa.Table.from_batches(suffix_dedup._anchor_rows(50)(iter([batch])))
    assert rows["n_words"].to_pylist() == np.diff(at).tolist() and len(calls) == 3
