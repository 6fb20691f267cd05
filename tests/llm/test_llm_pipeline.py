"""The pipeline: every stage against its operator's brute force, odd rows, and the library without this subpackage."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from spendlens.llm import bm25_leaks, common
from spendlens.plans.inspect import count_nodes
from test_llm_dedup import covered_by_brute_force, groups_by_brute_force
from test_llm_search import leaks_by_brute_force

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = common.read_table(spark, SF, "documents")
    root = tmp_path_factory.mktemp("stages")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1][1], SF).write.parquet(f"{root}/{name}")
        out.append((name, spark.read.parquet(f"{root}/{name}")))
    return dict(out)


def _texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontaminate",
                                                       "tokens"]
    assert all(df.columns == stages["documents"].columns for n, df in stages.items() if n != "tokens")
    assert stages["tokens"].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_stage_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in common.read_table(spark, SF, "labels").collect()}
    kept = {i for i, _ in _texts(stages["quality"])}
    all_ids = {i for i, _ in _texts(stages["documents"])}
    clean = {i for i in all_ids if labels.get(i) == 1}
    assert len(clean - kept) <= 0.02 * len(clean)
    assert len({i for i in kept if labels.get(i) == 0}) <= 0.1 * sum(q == 0 for q in labels.values())


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before = _texts(stages["quality"])
    groups = groups_by_brute_force(before, 5, 80, 100)
    assert sorted(i for i, _ in _texts(stages["near_duplicates"])) == sorted(i for i, _, c in groups if i == c)


def test_passage_stage_cuts_only_repeats(stages):
    before, after = _texts(stages["near_duplicates"]), _texts(stages["repeated_passages"])
    covered = covered_by_brute_force(before, 50)
    assert dict(covered_by_brute_force(after, 50)) == {}
    now = dict(after)
    assert all(now[i] == t for i, t in before if i not in covered)
    assert all(len(now.get(i, "").split()) == len(dict(before)[i].split()) - len(c) for i, c in covered.items())


def test_decontamination_stage_drops_every_leak(spark, stages):
    before = _texts(stages["repeated_passages"])
    items = [(r.item_id, r.text) for r in common.read_table(spark, SF, "benchmark").collect()]
    leaks = {i for i, _ in leaks_by_brute_force(before, items)}
    assert sorted(i for i, _ in _texts(stages["decontaminate"])) == sorted(i for i, _ in before if i not in leaks)
    assert bm25_leaks.find_leaks(stages["decontaminate"], common.read_table(spark, SF, "benchmark")).count() == 0


def test_run_equals_its_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["tokens"].collect()))


def test_stages_take_odd_rows(spark, stages):
    text = stages["decontaminate"].first().text
    rows = [(None, text), (None, None), (1, None), (2, ""), (2, ""), (3, text), (3, text), (4, text), (5, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "a", "b", 0.5) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, "
                               "_again2 string, spans string, score double")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
        assert ids.count(-1) == 2
        if name == "near_duplicates":
            assert ids == [-1, -1, 1, 2, 2, 3, 5]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
    assert corpus_pipeline.quality(spark, df, SF).columns == df.columns


def test_stages_keep_columns_of_any_name(spark, stages):
    text = " ".join(f"word{k}" for k in range(60))
    names = ["again", "_again", "row", "quality", "_quality", "spans", "_spans", "span_doc", "_span_doc", "before", "_whole", "entry",
             "component_id", "score", "h1", "label", "text_crc"]
    rows = [(i, t, "en", "s", 5, *[f"{n}-{i}" for n in names]) for i, t in
            [(1, text), (2, text + " more"), (3, "other words " * 9 + text), (4, None), (None, text)]]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame(rows, kinds)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert all(tuple(r)[5:] == tuple(f"{n}-{r.doc_id}" for n in names) for r in out.collect()), name


def test_texts_of_a_repeated_doc_id_stay(spark):
    one, two = (" ".join(f"{w}{k}" for k in range(70)) for w in "ab")
    rows = [(3, one, "x"), (3, two, "y"), (3, two, "a"), (3, two, "a"), (9, two, "z"), (4, "", "e"), (4, "", "e"), (4, one + " q", "f")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 7):
        kept = corpus_pipeline.near_duplicates(spark, df.repartition(parts), SF).collect()
        assert sorted((r.doc_id, r.text, r.source) for r in kept) == sorted([(3, one, "x"), (3, two, "a")])
        cut = corpus_pipeline.repeated_passages(spark, df.repartition(parts), SF).collect()
        assert sorted((r.doc_id, r.text) for r in cut) == sorted((i, t) for i, t, _ in rows if i != 9)


def test_the_rest_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    for entry in os.listdir(ROOT):
        if entry not in ("corpus_pipeline.py", "spendlens", ".git", "tests"):
            os.symlink(f"{ROOT}/{entry}", copy / entry)
    (copy / "spendlens").mkdir()
    for entry in os.listdir(f"{ROOT}/spendlens"):
        if entry != "llm":
            os.symlink(f"{ROOT}/spendlens/{entry}", copy / "spendlens" / entry)
    os.remove(copy / "__spark_entry__.py")
    (copy / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'all_projects' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True)


def test_groups_are_planned_once(spark):
    """The driver plans the joins behind the groups once, not for each of their uses."""
    out = corpus_pipeline.near_duplicates(spark, common.read_table(spark, SF, "documents"), SF)
    assert count_nodes(out, r"Join\b") <= 6


def _shuffled_texts(plan):
    """Rows with a text that the exchanges of an executed plan wrote."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _shuffled_texts(plan.executedPlan())
    if "QueryStage" in name:
        return _shuffled_texts(plan.plan())
    own = name == "Exchange" and "text#" in plan.output().mkString(",")
    below = plan.children()
    return (plan.metrics().apply("shuffleRecordsWritten").value() if own else 0) + sum(
        _shuffled_texts(below.apply(i)) for i in range(below.size()))


def test_texts_without_near_duplicates_are_not_shuffled(spark):
    """Those that go, and those of a repeated doc_id, are met in joins; the rest pass, a null and an odd doc_id type too."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(300)]
    rows += [(400 + i, rows[i][1]) for i in range(8)] + [(7, rows[7][1]), (9, "another text of this document")]
    rows += [(None, rows[0][1]), (500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id int, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([*rows[:300], (9, "another text of this document"), *rows[-3:]], key=str)
    assert _shuffled_texts(kept._jdf.queryExecution().executedPlan()) <= 50
