"""Registered corpus queries: SQL where there is some, the pipeline stage by stage, and the guard of the entry module."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rimshot.llm import linededup, queries
from tests.conftest import SF_SMALL
from tests.test_oracle import _canon


def test_one_query_for_each_operator():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    cur = duck(SF_SMALL).execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(cur.fetchall(), names)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(70)
    docs = {i: prose(80) for i in range(60)}
    docs[100] = f"{prose(60)}\n{passage}\n{prose(60)}"
    docs[101] = f"{prose(60)}\n{passage}\n{prose(60)}"
    near = prose(200).split()
    docs[110], docs[111] = " ".join(near), " ".join(near[:100] + ["changed"] + near[101:])
    docs[120] = docs[5]
    docs[130] = f"{prose(40)} password=0123456789abcdef01 {prose(40)}"
    toxic = {}
    for i in range(200, 260):
        w = prose(60).split()
        for _ in range(4):
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "nastyone"]))
        toxic[i] = " ".join(w)
    rows = [(i, t, "en", "s", len(t)) for i, t in {**docs, **toxic}.items()] + [(None, None, None, None, None), (300, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(i, 1, 1) for i in range(200, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        df.write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: r.text for r in df.collect()}
    assert set(kept["toxicity"]) == set(docs) | {None, 300}
    assert 120 not in kept["line_dedup"] and kept["line_dedup"][5] == docs[5]
    assert passage in kept["line_dedup"][100] and passage not in kept["line_dedup"][101]
    assert set(kept["line_dedup"]) - set(kept["ngram_jaccard"]) == {111}
    assert kept["secret_scan"][130].count("[SECRET]") == 1 and "password" not in kept["secret_scan"][130]
    assert {i: t for i, t in kept["secret_scan"].items() if i != 130} == {i: t for i, t in kept["ngram_jaccard"].items() if i != 130}
    packed = corpus_pipeline.STAGES[-1][1](spark, df, folder).collect()
    assert {r.doc_id for r in packed} == set(kept["secret_scan"])
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_near_copies_under_shared_ids(spark):
    """A near copy under an id that another group has too goes; clashing column names are no trouble."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    base, own = prose(200), prose(80)
    words = base.split()
    near = " ".join([*words[:90], "changed", *words[91:]])
    rows = [(3, base, 1, "a"), (5, own, 2, "a"), (5, near, 3, "a"), (5, own, 2, "a"), (5, own.upper(), 2, "a"), (None, base, 4, "a"), (None, base, 4, "a"),
            (7, None, 5, "a"), (7, None, 5, "a"), (8, "", 6, "b"), (9, near, 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept_id int, _content string")
    got = corpus_pipeline.dedup_near(spark, df, "")
    assert got.columns == df.columns
    got = [tuple(r) for r in got.collect()]
    mine = [r for r in got if r[0] == 5]
    assert len(mine) == 1 and mine[0][1].lower() == own
    rest = sorted((r for r in got if r[0] != 5), key=str)
    assert rest == sorted([(3, base, 1, "a"), (None, base, 4, "a"), (7, None, 5, "a"), (8, "", 6, "b")], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string, x int")
    assert corpus_pipeline.dedup_near(spark, empty, "").count() == 0


def test_lines_of_tables_with_clashing_names(spark):
    text = "\n".join(f"line {i} of a passage that comes twice" for i in range(10))
    rows = [(1, text, "p", 1), (2, "own start\n" + text, "q", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d string, _x int")
    for words in (False, True):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(df, words=words).collect()}
        assert got == {1: text, 2: "own start"}
