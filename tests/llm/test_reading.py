import numpy as np

from postgrain.llm import reading
from postgrain.session import table


def test_isotonic_is_monotone_and_least_squares():
    x, y = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert np.allclose(np.interp([1, 2, 3, 4], x, y), [1, 2.5, 2.5, 4])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "level_labels")
    rows = sorted(labels.collect())
    train = spark.createDataFrame(rows[::2], labels.schema)
    test = dict((r["doc_id"], r["reading_level"]) for r in rows[1::2])
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, train).collect()}
    hits = [got[k] == v for k, v in test.items() if k in got]
    assert len(hits) > 150 and np.mean(hits) >= 0.95


def test_edges(spark):
    easy, hard = "we like the dog and it can run to you " * 8, "epistemological jurisprudential contemporaneous deliberations notwithstanding " * 12
    docs = [(1, easy, "en", 0), (2, hard, "en", 0), (3, None, "en", 0), (4, "", "en", 0), (5, "short text", "en", 0), (6, easy, "de", 0), (7, easy * 3000, "en", 0), (1, easy, "en", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, reading_level int")
    l = spark.createDataFrame([(1, 1), (2, 4), (9, 2), (3, 1)], "doc_id bigint, reading_level int")
    got = sorted((r["doc_id"], r["reading_level"]) for r in reading.reading_levels(d, l).collect())
    assert got == [(1, 1), (1, 1), (2, 4), (7, 1)]
    none = reading.reading_levels(d, l.where("false")).collect()
    assert {r["reading_level"] for r in none} == {None} and len(none) == 4
    assert reading.reading_levels(d.where("false"), l).count() == 0


def test_layout_does_not_matter():
    t = "The candidate should <b>write</b> a letter, and wait."
    m = reading.Model(64, np.arange(reading.n_features(64), dtype=float), (np.array([0.0, 1.0]), np.array([1.0, 2.0])))
    s = m.scores([t, "the\nCANDIDATE should write;a letter and wait"], m.cache())
    assert s[0] == s[1]
