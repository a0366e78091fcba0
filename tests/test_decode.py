"""Tokenisers, projection and prediction."""

from pyspark.sql import functions as F

from lodestone.functions.spans import bio_decode
from lodestone.operators import decode


def test_word_pieces(spark):
    split = decode.word_pieces({"mate", "##60", "pro", "华", "为", "!"})
    assert split("华为Mate60 Pro!zz") == [("华", 0, 1), ("为", 1, 2), ("mate", 2, 6), ("##60", 6, 8), ("pro", 9, 12), ("!", 12, 13), ("[UNK]", 13, 15)]
    rows = spark.createDataFrame([(1, "华为 华为"), (2, None)], "id long, text string")
    got = {r.id: (len(r.tokens), r.truncated) for r in decode.tokenize(rows, split, 5).collect()}
    assert got == {1: (3, True), 2: (0, False)}


def test_there_and_back(spark):
    rows = spark.createDataFrame([("华为 Mate60", [(0, 2, "BRAND"), (3, 9, "MODEL")]), ("", [])], "text string, spans array<struct<start:int,end:int,label:string>>")
    t = decode.characters(F.col("text"))
    tagged = rows.withColumn("tokens", t).withColumn("tags", decode.tags(F.col("tokens"), F.col("spans")))
    back = tagged.select(decode.character_spans(F.col("text"), F.col("tokens"), bio_decode(F.col("tags"))).alias("x")).collect()
    assert [[(s.start, s.end, s.label, s.text) for s in r.x] for r in back] == [[(0, 2, "BRAND", "华为"), (3, 9, "MODEL", "Mate60")], []]


def test_cut_tokens(spark):
    rows = spark.createDataFrame([([("abc", 0, 3), ("d", 3, 4)], [(1, 3, "X"), (3, 4, "Y")])], f"tokens {decode.TOKENS}, spans array<struct<start:int,end:int,label:string>>")
    got = rows.select(decode.tags(F.col("tokens"), F.col("spans")).alias("a"), decode.tags(F.col("tokens"), F.col("spans"), "drop").alias("b")).first()
    assert (got.a, got.b) == (["B-X", "B-Y"], ["O", "B-Y"])


def test_predict(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[{"start": 0, "end": len(t), "label": "ALL"}] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad one")], "id long, text string").coalesce(1)
    got = {r.id: r.entities and r.entities[0].end for r in decode.predict(rows, model, "array<struct<start:int,end:int,label:string>>", batch=1).collect()}
    assert got == {1: 1, 2: None}
