"""The pipeline's stages take effect and keep clean documents."""

import corpus_pipeline as P
from streetworth.llm.language import identify, train


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs.limit(1).selectExpr("900001L doc_id", "'12 34' text", "lang", "source", "5L n_chars")
    mail = docs.limit(1).selectExpr("900002L doc_id", "concat(text, ' x@y.org') text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(mail)
    now = docs
    for name, stage in P.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packed":
            assert now.columns == docs.columns
        if name == "language":
            assert now.where("doc_id = 900001").count() == 0 and now.count() == docs.count() - 1
        if name == "near_duplicates":
            kept = now.count()
            assert now.where("doc_id = 900002").count() == 0 or now.where("doc_id < 900001").count() < 200
        if name == "personal_data":
            assert now.count() == kept and now.where("text rlike '[a-z0-9]@mail[0-9]*[.]example'").count() == 0
    assert now.count() > 0


def test_near_duplicates_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "other words that stand alone here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect()) == [1, 3, 4, 5]


def test_language_keeps_texts_with_half_of_their_letters_in_one_language(spark):
    english, german, russian = "the house and a garden with it ", "der Garten und das Haus mit ihm ", "предложение существование "
    rows = [(i, t * 20, lang) for lang, t in (("en", english), ("de", german), ("ru", russian)) for i in range(100 * len(lang + t), 100 * len(lang + t) + 20)]
    planted = [
        (1, "it " * 100 + "существование " * 60),  # 200 and 780 letters; more words of the script that Russian has not
        (2, "garden " * 30 + "существо " * 15),  # 180 and 120 letters, but 180 and 240 bytes
        (3, "the house and a garden " * 9 + german * 8),  # two languages of one script
        (4, "12 34"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows + [(i, t, "en") for i, t in planted]], "doc_id long, text string, lang string, source string, n_chars long")
    model = train(docs.where("doc_id > 100"))
    got = {r["doc_id"]: r for r in identify(docs.where("doc_id < 100"), model).collect()}
    assert got[1]["lang_pred"] == "ru" and got[1]["lang_share"] == 780 / 980 and got[1]["lang_score"] < 0.5
    assert got[2]["lang_pred"] == "en" and got[2]["lang_share"] == 180 / 300
    assert got[3]["lang_pred"] == "de" and 0.5 < got[3]["lang_share"] < 0.6
    assert got[4]["lang_pred"] == "und" and got[4]["lang_share"] == 0
    assert {r["doc_id"] for r in P.language(spark, docs, "").collect() if r["doc_id"] < 100} == {1, 2, 3}


def test_near_duplicates_knows_rows_by_doc_id_and_text(spark):
    same, clean = "a b c d e f g h i j k l", "other words that stand alone under a doc_id met before"
    rows = [(1, same), (1, same), (1, same.upper()), (2, same), (2, clean), (3, same + " m"), (4, None), (4, None), (5, "x y z"), (5, "x y z"), (None, same)]
    rows += [(6, "p q r s t u v w x y z 0 1 2 3"), (6, "p q r s t u v w x y z 0 1 2 3 4"), (6, "nothing in common with the other two rows of six")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, "").collect()]
    assert sorted(str(i) for i, _ in got) == ["1", "2", "4", "4", "5", "6", "6", "None"]
    assert (2, clean) in got and any(i == 6 and t.startswith("nothing") for i, t in got) and all(t.lower() == same for i, t in got if i == 1)
