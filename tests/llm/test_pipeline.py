import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline


def test_stages(spark, data):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "secrets", "mixing", "bpe"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 2 * docs.count()


def test_filters_keep_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("__toxicity", F.lit(1.0))
    once = corpus_pipeline.drop_copies(spark, docs, data)
    assert once.columns == docs.columns
    again = corpus_pipeline.drop_copies(spark, once.drop("__toxicity"), data)
    assert again.count() == once.count() < docs.count()
    hidden = corpus_pipeline.hide_secrets(spark, docs, data)
    assert hidden.columns == docs.columns and hidden.count() == docs.count()


def test_copies_at_five_words_and_80_percent(spark, docs_of, data):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for k in range(60):
        text = rng.choices(words, k=rng.randint(40, 120))
        texts.append(text)
        texts.append(text + rng.choices(words, k=len(text) * rng.randint(10, 30) // 100))  # an appended tail
        if k % 3 == 0:
            edited = list(text)
            for _ in range(rng.randint(1, 4)):
                edited[rng.randrange(len(text))] = rng.choice(words)
            texts.append(edited)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if 100 * len(x & y) >= 80 * len(x | y):
                one, other = find(a), find(b)
                root[max(one, other)] = min(one, other)
    kept = corpus_pipeline.drop_copies(spark, docs_of([" ".join(t) for t in texts]), data).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({find(a) for a in root})


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert "op5_url_filter" in __spark_entry__.oracle_sql()


def test_stages_on_empty_and_odd_tables(spark, docs_of, tmp_path):
    """Each stage in turn on nothing, and on nulls, blanks, repeated rows and one long text."""
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (99, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"w{k}" for k in range(30_000))
    for rows in ([], [(1, None, "s"), (2, "", None), (3, " \n", "s"), (4, "a b", "s"), (4, "a b", "s"), (None, "a b", "s"), (5, long, "t"), (6, long, "t")]):
        docs = docs_of(rows)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(rows)}-{name}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            made = spark.read.parquet(path)
            assert (made.count() > 0) == bool(rows) and (name == "bpe" or made.columns == docs.columns)
            docs = made
