"""The corpus pipeline: every stage on hostile tables, and the whole against brute force."""

import hashlib
import random
import re

import pytest

import corpus_pipeline as P
from tidegauge.llm import quality, scratch
from tidegauge.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone long, _id long, id long, key string, keeper long, recipe string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, "k", 4, "r") for i, t in rows], SCHEMA).repartition(4)


def corpus(seed=0, n=90):
    rnd = random.Random(seed)
    words = ["river", "stone", "morning", "quiet", "under", "opens", "the", "of", "and", "light", "window", "paper", *[f"term{k}" for k in range(200)]]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(12, 30))) for _ in range(6)]
    rows, labels = [], []
    for i in range(n):
        kind = rnd.random()
        if rows and kind < 0.15:
            text = re.sub(" ", rnd.choice(["  ", "\n", " "]), rnd.choice(rows)[1])
        elif rows and kind < 0.3:
            w = rnd.choice(rows)[1].split()
            w[rnd.randrange(len(w))] = "changed"
            text = " ".join(w)
        else:
            w = [rnd.choice(words) for _ in range(rnd.randint(20, 90))]
            if kind > 0.9:
                at = rnd.randint(0, len(w))
                w[at:at] = rnd.choice(items).split()
            text = " ".join(w)
        bad = rnd.random() < 0.3
        rows.append((i * 7 % 1009, "$$$ ".join(text.split()) + "###" if bad and "$$$" not in text else text))
        labels.append((rows[-1][0], int("$$$" not in rows[-1][1]), 0))
    return rows, labels, items


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels, items = corpus()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, items


def near(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (a.lower().split(), b.lower().split()))
    return 100 * len(x & y) >= 80 * len(x | y)


def distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        cur = [i + 1]
        for j, b in enumerate(text):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_the_pipeline_equals_brute_force(spark, folder):
    from tokenizers import Tokenizer

    d, rows, items = folder
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    left = [(i, t) for i, t in rows if i in good]
    assert 20 < len(left) < len(rows)
    groups = {}
    for i, t in left:
        groups.setdefault(re.sub(r"\s", "", t), []).append((-len(t), i, t))
    left = sorted((i, t) for _, i, t in map(min, groups.values()))
    parent = {i: i for i, _ in left}
    for i, s in left:
        for j, t in left:
            if i < j and parent[i] != parent[j] and near(s, t):
                x, y = sorted((parent[i], parent[j]))
                parent = {k: x if p == y else p for k, p in parent.items()}
    alone = [(i, t) for i, t in left if parent[i] == i]
    clean = [(i, t) for i, t in alone if all(distance(x.split(), re.findall(r"[\w']+", t.lower())) > len(x.split()) // 5 for x in items)]
    assert len(left) > len(alone) > len(clean) > 5
    library = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, d).collect()} == want


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stages_on_hostile_tables(spark, folder, name, stage):
    d, rows, items = folder
    hostile = [*rows, *rows[:20], (rows[0][0], "another text of one id, quiet under the morning light of stone"), (None, rows[1][1]), (None, None), (5000, None), (5001, ""), (5002, " \n\t"), (5003, "light " * 60_000), (5004, items[0])]
    docs = frame(spark, hostile)
    out = stage(spark, docs, d)
    last = name == P.STAGES[-1][0]
    got = out.collect()
    assert last or out.schema == docs.schema
    if last:
        assert len(got) == len(hostile)
    else:
        given = {}
        for i, t in hostile:
            given[i, t] = given.get((i, t), 0) + 1
        kept = {}
        for r in got:
            kept[r.doc_id, r.text] = kept.get((r.doc_id, r.text), 0) + 1
            assert (r._gone, r._id, r.id, r.key, r.keeper, r.recipe) == (1, 2, 3, "k", 4, "r")
        assert kept and all(n <= given[k] for k, n in kept.items())
    empty = stage(spark, docs.where("false"), d)
    assert empty.columns == out.columns and empty.count() == 0


def test_written_tables_can_be_removed(spark, tmp_path):
    scratch.forget(spark)
    df = scratch.written(spark.range(5), "some")
    path = df.inputFiles()[0]
    assert df.count() == 5 and scratch.forget(spark) == 1 and scratch.forget(spark) == 0
    with pytest.raises(Exception, match="[Ff]ile|[Pp]ath"):
        spark.read.parquet(path).count()
    assert scratch.text_bytes(spark.createDataFrame([("é",), (None,), ("ab",)], "t string"), "t") == 4 + 3 * 16
    assert scratch.text_bytes(spark.createDataFrame([], "t string"), "t") == 0
    assert scratch.parts_for(0, 10) == 17 and scratch.parts_for(1000, 10) == 101 and scratch.parts_for(10**18, 1) == (1 << 22) + 1


def test_misspelt_items_go_however_many_items_are_like_them(spark, tmp_path):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    item = [rnd.choice(words) for _ in range(30)]
    like = [" ".join([*item[:k], f"z{k}", *item[k + 1 :]]) for k in range(8)]
    text = "".join("q" if c != " " and rnd.random() < 0.16 else c for c in " ".join(item))
    rows = [(1, " ".join(["before", text, "after"])), (2, " ".join(rnd.choice(words) for _ in range(60))), (3, None)]
    for name, items in (("copies", [" ".join(item)] * 6), ("like", like)):
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert {r.doc_id for r in P.benchmark_decontamination(spark, frame(spark, rows), str(tmp_path / name)).collect()} == {2, 3}
