import math
import random

import pytest

import corpus_pipeline
from tests.llm.test_text_operators import brute_components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean documents in two languages, junk, copies, benchmark passages and texts without letters, and what should stay."""
    rnd = random.Random(11)
    kinds = {"xx": [f"{a}{b}" for a in ("the", "and", "thing", "wet") for b in ("ly", "er", "ness")], "yy": [f"{a}{b}" for a in ("ñandú", "que", "año", "señ") for b in ("or", "ía", "és")]}
    text = lambda k, n: " ".join(rnd.choice(kinds[k]) for _ in range(n))
    item = text("xx", 14)
    rows, good = [], set()
    for i in range(240):
        lang = rnd.choice(sorted(kinds))
        if i % 8 == 1:
            rows.append((i, " ".join(rnd.choice(["BUY!!", "$$$", "CLICK!!"]) for _ in range(60)), lang))
        elif i % 8 == 2 and i > 8:
            words = rows[i - 2][1].split()
            words[0] = "changed"
            rows.append((i, " ".join(words), rows[i - 2][2]))
        elif i % 40 == 3:
            rows.append((i, text("xx", 30) + " " + item + " " + text("xx", 30), "xx"))
        elif i % 40 == 4:
            rows.append((i, rnd.choice([None, "", "123 456", "!!!"]), lang))
        else:
            rows.append((i, text(lang, 70), lang))
            good.add(i)
    where = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 1), 0) for i in range(0, 240) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, docs, dict((i, t) for i, t, _ in rows), good


def test_each_stage_decides_on_what_it_is_given(spark, tables):
    where, docs, texts, good = tables
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before = set(texts)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, where), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append((before, ids(docs)))
        before = ids(docs)
    (a, language), (_, quality), (c, near), (_, clean) = kept
    assert a - language == {i for i in a if i % 40 == 4 and not any(map(str.isalpha, texts[i] or ""))}
    # the sample is as large as the labelled share of good documents, and SLACK more, asks for
    assert good <= quality and len({i for i in quality if i % 8 == 1}) == math.ceil((136 / 156 + corpus_pipeline.quality.SLACK) * len(language)) - 204
    roots = brute_components([(i, texts[i]) for i in c], corpus_pipeline.SIMILARITY)
    assert near == {i for i in c if roots[i][1] == i}
    assert near - clean == {i for i in near if i % 40 == 3} and good & near <= clean
    whole = corpus_pipeline.run(spark, where)
    assert ids(whole) == clean
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "decontaminate", "pack"]


def test_stages_of_no_rows(spark, tables):
    where, docs, _, _ = tables
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), where).count() == 0


def test_stages_keep_clashing_columns(spark, tables):
    where, docs, _, _ = tables
    mine = docs.selectExpr("*", "'mine' AS kept", "9.5D AS score", "1 AS n_ngrams", "2 AS log_ratio", "'l' AS lang_pred", "3 AS sample_key", "4L AS component_id", "5 AS doc_key", "6 AS c0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, mine, where)
        assert left.columns == mine.columns and left.dtypes == mine.dtypes
        assert left.where("kept = 'mine' AND score = 9.5 AND n_ngrams = 1 AND log_ratio = 2 AND lang_pred = 'l' AND sample_key = 3 AND component_id = 4 AND doc_key = 5 AND c0 = 6").count() == left.count() > 0
