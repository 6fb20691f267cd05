"""Importance resampling and chat formatting against row-by-row versions, round trips and odd rows."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spendlens.llm import chat_format, common, importance_resample
from spendlens.llm import registry

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
NOT_WORD = re.compile("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 50_000)


# --- importance resampling ----------------------------------------------------

def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in NOT_WORD.split(lowered) if w]


def resample_by_hand(docs, target, low, high, buckets, seed, min_words, percent):
    def grams(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(low, high + 1) for i in range(len(w) - k + 1)]

    own, aim = Counter(), Counter()
    for _, t in docs:
        own.update(grams(t))
    for t in target:
        aim.update(grams(t))
    s_all, t_all = sum(own.values()), sum(aim.values())
    rows = []
    for i, t in docs:
        found = grams(t)
        total = sum(math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets))))
                    for b in found)
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [r for r, (_, t) in zip(rows, docs) if len(words(t)) >= min_words]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(map(tuple, rows))


def test_resampling_equals_a_loop_on_the_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in common.read_table(spark, SF, "documents").collect()]
    target = [r.text for r in common.read_table(spark, SF, "benchmark").collect()]
    got = registry.queries()["op12_importance_resample"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == resample_by_hand(docs, target, 1, 1, 10_000, "2024", 20, 10)


ODD = [(1, "One two, THREE-four"), (2, None), (3, ""), (None, "one two three"), (None, None), (4, "one " * 30_000), (5, "Äpfel über ÀÉ x1"),
       (6, " ,;\n"), (7, "one two"), (7, "one two"), (7, "two one three four"), (8, "a b   c\x00d")]
ODD += [(9, "the same words again and again")] * 400 + [(100 + k, f"word{k} other word{k % 7} one") for k in range(300)]


@pytest.mark.parametrize("low, high, buckets, min_words, percent", [(1, 1, 10_000, 2, 10), (1, 3, 97, 1, 50), (2, 2, 5, 4, 100)])
def test_resampling_of_odd_rows(spark, monkeypatch, low, high, buckets, min_words, percent):
    monkeypatch.setattr(importance_resample, "RANK_ROWS", 40)
    target = ["one two three four", None, "", "other words"]
    docs = spark.createDataFrame([(i, t, "s", 1, 2, "p") for i, t in ODD],
                                 "doc_id long, text string, rank string, n_words int, place int, part string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample.resample(docs.repartition(5), aim, low, high, buckets, "s", min_words, percent)
    assert got.columns == ["doc_id", "text", "n_words", "place", "part", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    assert {(r.n_words, r.place, r.part) for r in rows} == {(1, 2, "p")}
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(ODD)
    expected = resample_by_hand(ODD, target, low, high, buckets, "s", min_words, percent)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows) == expected


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    assert importance_resample.resample(none, some).count() == 0
    got = importance_resample.resample(some, none, min_words=1, percent=50).collect()
    assert Counter(map(tuple, [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got])) == \
        resample_by_hand([(1, "a b c"), (2, "d")], [], 1, 1, 10_000, "2024", 1, 50)
    with pytest.raises(ValueError):
        importance_resample.resample(some, none, 0, 1)


def test_spans_lie_between_spaces():
    text = importance_resample.collapse("One, two\tTHREE  été!".encode())
    assert text == "one two three été".encode()
    assert [text[a:b].decode() for a, b in importance_resample.spans(text, 1, 2)] == [
        "one", "two", "three", "été", "one two", "two three", "three été"]


# --- chat formatting ------------------------------------------------------------

def digest_by_hand(turns):
    """turns: (role, text) in order."""
    said = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest())


def test_chats_are_read_back_from_their_output(spark):
    convs = defaultdict(list)
    for r in sorted(common.read_table(spark, SF, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs[r.conv_id].append((r.role, r.text or ""))
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: tuple(r)[1:] for r in registry.queries()["op13_chat_format"](spark, SF).collect()}
    assert {i: g[:4] for i, g in got.items()} == {i: digest_by_hand(t) for i, t in convs.items()}
    assert all(got[i][4] == 3 + sum(len(chat_format.format_turn(*t)[0]) for t in turns) for i, turns in convs.items())


TRICKY = ["", " ", "</s>", "<s>", "[INST] a [/INST]", "[\\INST]", "<\\\\/s>", "<[INST]", "a</s><s>[/INST]\\", "[ROLE] system\nx [/ROLE]",
          "line\nend\r\n", "<", "[", "</", "[/INST", "\\", "ü\U0001f600</s>", "<\\<s>", "INST]", "[/ROLE] [/ROLE]", "s>", "/s>"]


def test_escaping_is_reversible():
    texts = TRICKY + [a + b for a in TRICKY for b in TRICKY]
    for t in texts:
        escaped = chat_format.escape(t)
        assert chat_format.unescape(escaped) == t
        assert not re.search(r"</?s>|\[/?(INST|ROLE)\]", escaped)
    turns = [(role, t) for t in texts for role in ("user", "assistant", "tool", "", "a\nb\\n", "[/ROLE]")]
    assert list(chat_format.parse("<s>" + "".join(chat_format.format_turn(*t)[0] for t in turns))) == turns


LAYOUTS = {
    "row": [{"turn": 1, "role": "user", "text": "q"}, {"turn": 0, "role": "system", "text": None}, {"turn": 2, "role": "assistant", "text": "a"}],
    "messages": [{"messages": [{"role": "system", "content": None}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}],
    "message parts": [{"messages": [{"role": "system", "content": []}, {"role": "user", "content": [{"type": "text", "text": "q"}]},
                                    {"role": "assistant", "content": [{"text": ""}, {"text": "a"}]}]}],
    "from and value": [{"system": "", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}],
    "instruction": [{"system": "", "instruction": "q", "input": "", "output": "a", "more": {"score": [1, 2]}}],
    "prompt and response": [{"system": "", "prompt": "q", "response": "a"}],
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts_give_the_same_turns(spark, name):
    df = spark.createDataFrame([(5, json.dumps(r)) for r in LAYOUTS[name]], "conv_id long, record string")
    turns = chat_format.canonical_turns(df)
    assert {r.layout for r in turns.collect()} == {name}
    got = chat_format.read_back(chat_format.format_chats(turns)).collect()
    assert [tuple(r)[:5] for r in got] == [(5, *digest_by_hand([("system", ""), ("user", "q"), ("assistant", "a")]))]


def test_other_layouts_and_undeclared_ones(spark):
    records = [{"prompt": "p", "completion": "c"}, {"question": "p", "answer": "c"}, {"context": "x", "question": "p", "answer": "c"},
               {"data": {"prompt": "p", "response": "c"}}, {"instruction": "p", "input": "i", "output": "c"},
               {"messages": []}, {"other": 1}, 7, [1], {}]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(20, "not json"), (21, None), (None, '{"prompt": 1, "completion": true}')]
    turns = chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string"))
    got = defaultdict(list)
    for r in turns.collect():
        got[r.conv_id].append((r.role, r.text))
    assert got[0] == got[1] == got[3] == [("user", "p"), ("assistant", "c")]
    assert got[2] == [("user", "x\n\np"), ("assistant", "c")] and got[4] == [("user", "p\n\ni"), ("assistant", "c")]
    assert all(got[k] == [(None, None)] for k in (5, 6, 7, 8, 9, 20, 21)) and got[None] == [("user", "1"), ("assistant", "true")]
    report = {(r.layout, r.n_turns) for r in chat_format.layout_report(turns).collect()}
    assert (None, 1) in report and ("question and answer", 2) in report
    ids = {r.conv_id for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    assert ids == {0, 1, 2, 3, 4, None}


def test_same_paths_same_fingerprint():
    a, b = {"messages": [{"role": "x", "content": 1}]}, {"messages": [{"content": "y", "role": None}, {"role": "z", "content": ""}]}
    assert chat_format.fingerprint(chat_format.field_paths(a)) == chat_format.fingerprint(chat_format.field_paths(b))
    assert chat_format.field_paths({"a": {"b": [{"c": 1}, []]}, "d": {}}) == {"a.b[].c", "a.b[]", "d"}


@pytest.mark.parametrize("piece, size", [(1 << 20, 64 << 20), (300, 2000), (1, 500)])
def test_odd_conversations(spark, monkeypatch, piece, size):
    monkeypatch.setattr(chat_format, "PIECE_CHARS", piece)
    monkeypatch.setattr(chat_format, "RANGE_CHARS", size)
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} </s> é" * (k % 5)) for k in range(700)]  # most of all rows
    rows += [(2, 0, "user", "x " * 30_000), (2, 1, "assistant", "y " * 30_000), (3, None, "assistant", "first"), (3, 0, None, None),
             (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 9, "assistant", ""),
             (None, 0, "user", "no id"), (None, 1, "assistant", "no id"), (-7, 0, "tool", "[ROLE]")]
    df = spark.createDataFrame([(*r, "l", "f", 3) for r in rows],
                               "conv_id long, turn long, role string, text string, layout string, record string, part int")
    chats = chat_format.format_chats(chat_format.canonical_turns(chat_format.as_records(df.repartition(3))))
    convs = defaultdict(list)
    for i, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "")):
        convs[i].append((role or "", text or ""))
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(chats).collect()}
    assert {i: g[:4] for i, g in got.items()} == {i: digest_by_hand(t) for i, t in convs.items()}
    text, loss = defaultdict(str), defaultdict(list)
    for r in sorted(chats.collect(), key=lambda r: r.piece):
        assert len(text[r.conv_id]) == r.start and len(r.text) == r.chars
        text[r.conv_id] += r.text
        loss[r.conv_id] += r.loss
    for i, turns in convs.items():
        assert list(chat_format.parse(text[i])) == turns and got[i][4] == len(text[i])
        assert [chat_format.unescape(text[i][a:b]) for a, b in loss[i]] == [t for r, t in turns if r == "assistant"]
    assert chat_format.format_chats(chat_format.canonical_turns(chat_format.as_records(df.limit(0)))).count() == 0
