"""Every query of the catalogue against its SQL, or, without SQL, for its rows."""

import pytest
from conftest import SMALL, rows_of

from lumenspan.plans.catalogue import catalogue

QUERIES = catalogue()


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_against_sql(spark, duck, name):
    run, sql = QUERIES[name]
    assert rows_of(run(spark, SMALL).toPandas()) == rows_of(duck.execute(sql).fetchdf())


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_rows(spark, name):
    frame = QUERIES[name][0](spark, SMALL)
    assert frame.columns and frame.count() > 0


def test_mock_answer_over_all_documents(spark):
    """Every question is answered from all documents, as by trying every sentence of each."""
    import hashlib

    from pyspark.sql import functions as F

    from lumenspan.functions import text as T
    from lumenspan.operators import evidence

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.transform(T.premises(F.col("text")), lambda s: F.struct(s.alias("s"), T.tokens(s).alias("t"))).alias("sentences")).collect()
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", F.col("text").alias("question"), T.tokens(F.col("text")).alias("t")).collect()
    read = [(d.doc_id, [(x.s, set(x.t)) for x in d.sentences or ()]) for d in docs]
    expected = set()
    for q in asked:
        wanted, best = set(q.t), []
        for doc, sentences in read:
            scored = [(-len(t & wanted), n, s) for n, (s, t) in enumerate(sentences) if t & wanted]
            if scored:
                shared, _, sentence = min(scored)
                best.append((shared, doc, sentence))
        expected |= {(q.item_id, nth, hashlib.md5(s[:220].encode()).hexdigest(), str(doc)) for nth, (_, doc, s) in enumerate(sorted(best)[:3], 1)}
    got = [tuple(r) for r in QUERIES["mock_answer"][0](spark, SMALL).select("qid", "nth", "text_md5", "id").collect()]
    assert len(got) == len(expected) and set(got) == expected
    units = spark.createDataFrame([(d, str(d), " ".join(s for s, _ in x[:5])) for d, x in read[:20]], "rank long, id string, content string")
    questions = spark.createDataFrame([(q.item_id, q.question) for q in asked[:10]], "qid long, question string")
    plain = evidence.quoted_answers(units.crossJoin(questions.select("qid")), questions)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, evidence.quoted_from_all(units, questions).collect()))


def test_prompt_batches_hold_every_document(spark, tmp_path):
    """Every document is in a batch, by first fit; one beyond the limit is alone in its own."""
    from collections import Counter

    rows = [(i, "en" if i % 3 else "de", n) for i, n in enumerate([9000, 30000, 11000, 500, 20001, 20000, *[100] * 30, 19950, 128000])]
    spark.createDataFrame(rows, "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    expected = Counter()
    for lang in ("en", "de"):
        batches = []
        for _, own, n in rows:
            if own == lang:
                room = next((b for b in batches if sum(b) + n <= 20_000 and len(b) < 10), None)
                batches.append([n]) if room is None else room.append(n)
        expected.update((lang, i, len(b), sum(b)) for i, b in enumerate(batches))
    got = QUERIES["prompt_batches"][0](spark, str(tmp_path)).select("lang", "batch", "n", "chars").collect()
    assert Counter(map(tuple, got)) == expected
    assert sum(r.n for r in got) == len(rows)


def test_entry_points():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.queries())


def test_entry_without_the_optional_subpackage(tmp_path):
    """The entry module works in a copy without the optional folders, and nothing else imports them."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "lumenspan", tmp_path / "lumenspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as E; assert E.queries() and E.oracle_sql() and 'pipeline' not in E.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
