"""The pipeline's stages against plain decisions on a small corpus."""

import random
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noticeflow.llm import queries
from noticeflow.session import ARROW_BYTES
from tests.llm.test_operators import DOCS, base_counts, base_spans, linked

PASSAGE = "Marta counted 42 seeds in 7 baskets while Jonas carried 15 kg of grain across the yard before noon on monday"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    pool = ["".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(3, 7))) for _ in range(500)]
    text = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    clean = [text(60) for _ in range(30)]
    base = text(100)
    texts = [*clean, base, base, base + " tail", text(40) + " " + PASSAGE + " " + text(40), text(50) + " password=hunter2hunter2 " + text(10),
             None, "", "too short", "same words again and " * 30]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, texts


def test_stages_take_effect(spark, corpus):
    root, texts = corpus
    docs = queries.table(spark, root, "documents")
    expected = {i for i, t in enumerate(texts) if (c := base_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    first = [i for i, (_, c) in enumerate(linked(texts)) if i == c]
    for (name, stage), decide in zip(
        corpus_pipeline.STAGES[:4],
        (lambda ids: ids, lambda ids: ids & set(first), lambda ids: {i for i in ids if PASSAGE not in texts[i]}, lambda ids: ids),
        strict=True,
    ):
        columns = docs.columns
        docs = stage(spark, docs, root)
        expected = decide(expected)
        rows = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(rows) == expected, name
        docs = spark.createDataFrame(list(rows.values()), DOCS)
    for i, r in rows.items():
        assert (r.text == texts[i]) == (not base_spans(texts[i])) and r.n_chars == len(r.text) and not base_spans(r.text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, root).where("round_trip").collect()} == expected


def test_stages_bound_arrow_batches_by_bytes(spark, corpus):
    root, _ = corpus
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = queries.table(spark, root, "documents")
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, docs, root)
        assert spark.conf.get(key) == str(ARROW_BYTES), name


def test_few_contaminated_documents_move_no_texts(spark, corpus):
    root, _ = corpus
    out = corpus_pipeline.drop_contaminated(spark, queries.table(spark, root, "documents"), root)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("== Initial Plan ==")[0], plan


def test_empty_corpus(spark, corpus):
    root, _ = corpus
    docs = queries.table(spark, root, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, root).count() == 0


def test_one_row_of_a_document_whatever_the_order(spark, corpus):
    root, _ = corpus
    x, y = "one two three four five six seven eight", "a b c d e f g h i j k l"
    rows = [(1, x, "s", {"k": 1}, 5), (1, x, "r", {"k": 2}, 5), (1, y, "s", None, 5), (2, y, "s", None, 6), (None, x, "s", None, 7), (None, x, "s", None, 7)]
    kept = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        table = spark.createDataFrame(order, "doc_id int, text string, source string, place map<string,int>, __gone int")
        out = corpus_pipeline.drop_near_duplicates(spark, table, root)
        assert out.columns == table.columns
        got = out.collect()
        assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 1 for r in got) == 1
        kept.add(tuple(sorted(str(r) for r in got)))
    assert len(kept) == 1
    table = table.select("doc_id", "text", F.lit(1).alias("_doc"))
    assert corpus_pipeline.drop_contaminated(spark, table, root).count() == len(rows)
