"""The stages one after the other, each against its operator's own verdicts."""

import corpus_pipeline
from runloom.llm import mixing, ngram_join, quality_rules, toxicity
from runloom.llm.common import ship, stored


def test_stages(spark, sf_dir):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    wanted = {
        "quality_rules": lambda d: quality_rules.score(d).where("kept"),
        "toxicity": lambda d: toxicity.score(d, labels).where("predicted = 0"),
        "ngram_join": lambda d: ngram_join.near_groups(d).where("doc_id = component_id"),
        "mix_sources": lambda d: mixing.score(d).selectExpr("explode(array_repeat(doc_id, cast(times AS int))) AS doc_id"),
    }
    assert [name for name, _ in corpus_pipeline.STAGES] == [*wanted, "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        assert ids(docs) == ids(wanted[name](before)) and docs.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert ids(last) == ids(docs)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, last.collect()))


PROSE = " ".join(f"word{k}" for k in range(90)) + "."
CLASHES = ("row", "text_key", "class", "size", "score", "_text", "_doc", "times", "a.b")


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows and columns whose names operators use inside."""
    rows = [
        (1, PROSE, "en", "s", 9),
        (2, PROSE, "en", "s", 9),  # a copy
        (3, PROSE.replace("word7 ", "other "), "en", None, None),  # a near copy
        (4, None, None, None, None),
        (5, "", "en", "s", 0),
        (6, PROSE.replace("word", "long") + " " + " ".join(f"w{k}" for k in range(60_000)) + ".", "en", "t", 1),
        (None, PROSE.replace("word", "nameless"), None, "t", 1),
        (8, PROSE.replace("word", "twice"), "en", "s", 9),
        (8, PROSE.replace("word", "twice"), "en", "s", 9),  # the same row again
        (9, "Home | News | Shop | Cart\n" * 40, "en", "s", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        df = df.withColumn(name, df["text"])
    return df


def test_stages_on_edge_cases(spark, sf_dir):
    docs = edge_documents(ship(spark))
    columns, reached = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "test-edges")
        assert docs.columns == columns
        reached[name] = sorted(str(r[0]) for r in docs.select("doc_id").collect())
    # The menu and the texts of too few words go; a null id stays.
    assert reached["quality_rules"] == ["1", "2", "3", "6", "8", "8", "None"]
    assert reached["toxicity"] == reached["quality_rules"]
    assert reached["ngram_join"] == ["1", "6", "8", "None"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == len(reached["mix_sources"])


def test_stages_on_no_rows(spark, sf_dir):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test-empty")
        assert docs.count() == 0


def test_words_end_with_their_task():
    """No module keeps words from one stage to the next."""
    from runloom.llm import common, language_model, quality_classifier

    for module in (common, language_model, ngram_join, quality_classifier, toxicity):
        assert not [name for name, value in vars(module).items() if isinstance(value, dict) and not name.startswith("__")]
