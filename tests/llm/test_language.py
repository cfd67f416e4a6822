"""Language identification: held-out accuracy, and each row against compressing it alone."""

import pytest
import zstandard
from pyspark.sql import functions as F

from marlstone.llm import language

from ..conftest import SF


def test_right_on_rows_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    done = language.op13_compression_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right, sure = done.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg((~F.col("rejected")).cast("int"))).first()
    assert n > 150 and right > 0.97 and sure > 0.9


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_sizes_by_plain_compression(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    by_doc = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for doc, text in ((r.doc_id, r.text) for r in docs.collect()):
        words = language.letters(text)
        sizes = {}
        for name, content in model:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(language.FILLER + words[i : i + 4096])) for i in range(0, len(words), 4096))
        r = by_doc[doc]
        assert sizes[r.lang_pred] <= min(sizes.values()) * 1.01  # prepared dictionaries may parse a little otherwise
        assert 0 < r.score <= 1


def test_learning_is_bounded_and_repeatable(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(0 < len(d) <= language.DICTIONARY for _, d in model)
    assert language.learn(docs.repartition(5)) == model
    assert [n for n, _ in model][0] == docs.groupBy("lang").count().orderBy(F.desc("count")).first().lang


def test_odd_rows(spark, model):
    """Null, empty, blank and letterless texts are unknown; repeated rows alike; long texts whole; other columns unread."""
    rows = [(1, None), (2, ""), (3, " \n"), (4, "123 ... ²"), (5, "the"), (5, "the"), (None, "the"), (6, "den und die " * 40_000), (7, "퟿中文")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "lang": F.lit("fr"), "lang_pred": F.lit("fr")})
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(df, model).collect()]
    assert [g for g in got if g[0] in (1, 2, 3, 4)] == [(k, "und", 0.0) for k in (1, 2, 3, 4)]
    assert len({g[1:] for g in got if g[0] in (5, None)}) == 1 and len(got) == len(rows)
    assert dict((g[0], g[1]) for g in got)[6] == "de"
    assert dict((g[0], g[1]) for g in got)[7] in {n for n, _ in model}


def test_nothing_learned_and_no_rows(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert language.learn(docs.limit(0)) == []
    assert {r.lang_pred for r in language.identify(docs.limit(5), []).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0
    one = language.learn(docs.limit(20).withColumn("lang", F.lit("xx")))
    assert {(r.lang_pred, r.rejected) for r in language.identify(docs.limit(5), one).collect()} == {("xx", False)}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
