"""License scan and Merkle audit: SQL on the given tables, and small fixtures."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import compare
from spendlens.llm import license_scan, merkle_audit, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    result = compare(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
    assert result["ok"], result


def test_licenses_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.txt", "plain words"), (3, "a/b/COPYING", gpl), (4, "a/b/c/y.txt", None),
        (5, "a/z.txt", "text\n" * 50 + gpl + "\nmore"), (6, "q/r.txt", ""), (7, None, mit), (8, None, "words"),
        (9, "ab/x.txt", "mit freundlichen"), (10, "top.txt", "x"), (11, "a/w.txt", "All rights reserved.\n" + mit),
        (None, "a/n.txt", "words"), (2, "a/b/c/x.txt", "plain words"), (12, "n/LICENSE.md", "no notice here"),
        (13, "n/x.txt", "words"), (14, "a/deep/" + "d/" * 40 + "f.txt", "long path " * 5000),
    ]
    rows += [(20 + k, f"m/{k}.txt", gpl) for k in range(300)]  # one line very often
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, path string, text string, license string, line int")
    got = {}
    for r in license_scan.scan(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.evidence, r.folder))
    assert got[1] == [("MIT", "own", None)] and got[3] == [("GPL-3.0", "own", None)]
    assert got[2] == [("GPL-3.0", "inherited", "a/b")] * 2 and got[4] == [("GPL-3.0", "inherited", "a/b")]
    assert got[5] == [("GPL-3.0", "own", None)] and got[6] == [(None, "none", None)]
    assert got[7] == [("MIT", "own", None)] and got[8] == [(None, "none", None)]
    assert got[9] == [(None, "none", None)] and got[10] == [(None, "none", None)]
    assert got[None] == [("MIT", "inherited", "a")] and got[13] == got[12] == [(None, "none", None)]
    assert got[14] == [("MIT", "inherited", "a")] and got[25] == [("GPL-3.0", "own", None)]
    assert sum(map(len, got.values())) == len(rows)
    assert license_scan.scan(df.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, file int"


def test_audit_locates_faults(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>", 0) for i in range(0, 9000, 3)]
    rows += [(None, None, None, 0), (None, "u", None, 0), (5000, "same", "rows", 0), (-5, "neg", "x" * 100_000, 0)]
    rows += [(12, "copy", "copy", 0)] * 50
    other = [r for r in rows if r[0] != 300]
    other[2] = (6, "http://h/6", "<p>7</p>", 0)
    other += [(8999, "new", "", 0), (12, "copy", "copy", 0)]
    a, b = (merkle_audit.manifest(spark.createDataFrame(x, PAGES)) for x in (rows, other))
    found = merkle_audit.audit(a, b).collect()
    got = {(r.page_id, r.status, r.primary_copies, r.replica_copies) for r in found if r.status != "displaced"}
    assert {(6, "changed", 1, 0), (6, "changed", 0, 1), (12, "changed", 50, 51)} <= got
    assert {(i, p, r) for i, _, p, r in got} == {(6, 1, 0), (6, 0, 1), (12, 50, 51), (300, 1, 0), (8999, 0, 1)}
    # the files of the one more copy and the lost record go on at other offsets, none else does
    moved = {r.page_id for r in found if r.status == "displaced"}
    assert moved and all(12 <= i < 1024 for i in moved) and 299 < max(moved)
    assert merkle_audit.audit(a, merkle_audit.manifest(spark.createDataFrame(rows, PAGES).repartition(3))).count() == 0
    assert merkle_audit.audit(a.limit(0), b.limit(0)).count() == 0
    whole = merkle_audit.audit(a, a.limit(0)).collect()
    assert len(whole) == len(set(rows)) and {r.status for r in whole} == {"missing"}


def test_audit_equals_a_loop_over_the_runs(spark):
    """Shuffled offsets, null values and repeated rows; every row against plain dictionaries."""
    rng = random.Random(5)
    schema = "file long, offset long, id long, length long, digest string, copies long, node string, side int"
    one, size = [], 0
    for k in range(400):
        one.append((rng.choice([0, 0, 0, 1, None]), size, rng.choice([None, 7, k]), 500 + k, f"d{k}", 1, "x", 0))
        size += 20_000 * (500 + k) // 500
    one += [(2, None, 1, 1, "n", 1, "x", 0), (2, None, None, None, None, None, "x", 0)] + [(3, 0, 1, 1, "r", 1, "x", 0)] * 9
    two = list(one)
    x, y = two[50], two[51]  # a swapped pair
    two[50], two[51] = (*x[:2], *y[2:]), (*y[:2], *x[2:])
    two[100] = (*two[100][:4], "other", *two[100][5:])
    del two[-1], two[300]
    two += [(2, None, 9, 9, "lost and found", 2, "x", 0), (1, -5, 9, 9, "before", 1, "x", 0)]

    def sums(rows):
        out = Counter()
        for f, o, i, n, d, c, *_ in rows:
            out[f, o, i, n, d] += c or 0
        return out

    p, r = sums(one), sums(two)
    left = {k for k in p.keys() | r.keys() if p[k] != r[k]}
    want = set()
    for k in left:
        other = r if p[k] else p
        if p[k] and r[k]:
            status = "changed"
        elif any(q[0] == k[0] and q[2:] == k[2:] and other[q] for q in left):
            status = "displaced"
        elif k[1] is not None and any(q[:2] == k[:2] and other[q] for q in left):
            status = "changed"
        else:
            status = "missing" if p[k] else "extra"
        want.add((*k, p[k], r[k], status))
    a, b = (spark.createDataFrame(rows, schema) for rows in (one, two))
    got = [(x.file, x.offset, x.page_id, x.length, x.digest, x.primary_copies, x.replica_copies, x.status)
           for x in merkle_audit.audit(a, b).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {w[-1] for w in want} == {"changed", "displaced", "missing", "extra"}


def test_descent_opens_only_differing_branches(spark):
    rows = [(0, k * merkle_audit.RANGE, k, 10, f"d{k}", 1) for k in range(merkle_audit.FAN**2 * 2)]
    schema = "file long, offset long, id long, length long, digest string, copies long"
    a = spark.createDataFrame(rows, schema)
    b = a.withColumn("digest", F.when(F.col("id") == 100, "x").otherwise(F.col("digest")))
    levels = merkle_audit.tree(merkle_audit.leaves(a, b))
    assert [x.count() for x in levels] == [1024, 64, 4, 2]
    assert [[tuple(r) for r in merkle_audit.differing(x).collect()] for x in levels] == [[(0, 100)], [(0, 6)], [(0, 0)], [(0, 0)]]


def test_offsets_follow_the_records(spark):
    rows = [(i, "u", "b" * i, 0) for i in range(20)] + [(None, "u", "b" * i, 0) for i in range(300)] + [(7, "u", "c", 0)] * 3
    placed = merkle_audit.manifest(spark.createDataFrame(rows, PAGES)).collect()
    at = {}
    for r in sorted(placed, key=lambda r: (r.file is None, r.id or 0, r.digest)):
        assert r.offset == at.get(r.file, 0)
        at[r.file] = r.offset + r.length * r.copies
    assert sum(r.copies for r in placed) == len(rows)


def test_lines_of_one_template_term_are_scored(spark):
    rows = [(1, "a/LICENSE", "Rights"), (2, "a/b/x.txt", "plain words"), (3, "b/x.txt", "MIT")]
    rows += [(10 + k, f"c/{k}.txt", "some longer line of plain words says version here") for k in range(200)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert (got[1].license, got[1].evidence) == ("Proprietary", "own") and got[1].score >= license_scan.THRESHOLD
    assert (got[2].license, got[2].evidence, got[2].folder) == ("Proprietary", "inherited", "a")
    assert got[10].evidence == "none"


def test_wrapped_headers_bodies_and_sentences_are_found(spark):
    filler = [" ".join(f"w{k * j % 997}x" for j in range(30)) for k in range(60)]
    texts = {t: [x for i, x in license_scan.TEMPLATES if i == t][-1] for t in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC")}
    gnu = [x for i, x in license_scan.TEMPLATES if i == "GPL-3.0"][-1].replace("\n", " ").split()
    wrapped = "\n".join(" * " + " ".join(gnu[k:k + 8]) for k in range(0, len(gnu), 8))
    rows = [(k, f"d{k}/LICENSE", f"Copyright 2020 somebody\n\n{x}\n") for k, x in enumerate(texts.values())]
    rows += [(10 + k, f"d{k}/a/b.txt", filler[k]) for k in range(4)]
    rows += [(20, "e/x.c", f"/*\n{wrapped}\n *\n * {filler[5]}\n */\n" + "\n".join(filler)),
             (21, "e/y.c", " ".join(filler) + ". Licensed under the Apache License, Version 2.0. " + " ".join(filler)),
             (22, "e/z.c", "\n".join(filler)), (23, "e/LICENSE", None), (24, "f/LICENSE", "")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[k].license for k in range(4)] == list(texts) == [got[10 + k].license for k in range(4)]
    assert {got[10 + k].evidence for k in range(4)} == {"inherited"}
    assert (got[20].license, got[20].evidence) == ("GPL-3.0", "own") and (got[21].license, got[21].evidence) == ("Apache-2.0", "own")
    assert {got[k].evidence for k in (22, 23, 24)} == {"none"}
