"""Rules and text functions against worked examples."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.operators import rules

GOLDEN = [
    ("What color is the car?", "red", "what_color", "The car is red."),
    ("What color is the car they are in?", "red", "what_color", "The car they are in are red."),
    ("What colors are the cars?", "blue", "what_color", "The cars are blue."),
    ("How many dogs are there?", "3", "how_many", "There are three dogs."),
    ("How many dogs are there?", "0", "how_many", "There are no dogs."),
    ("How many people are in the room?", "2", "how_many", "There are two people are."),
    ("How many cars?", "1", "how_many", "There is one cars."),
    ("What is the man doing?", "surfing", "what_is_doing", "The man is surfing."),
    ("What kind of dog is this?", "poodle", "what_kind_type", "This is a poodle."),
    ("Where is the cat?", "on bed", "where", "The cat is on bed."),
    ("Who is holding the bat?", "man", "who", "Man is holding the bat."),
    ("Which hand is raised?", "left", "which", "The hand is raised is left."),
    ("Is there a dog?", "yes", "is_there", "There is a dog."),
    ("Is there a dog?", "no", "is_there", "There is no dog."),
    ("Is there any dog?", "no", "is_are_yesno", "The there is not any dog."),
    ("Are there any clouds?", "yes", "are_there", "There are clouds."),
    ("Is this a train?", "yes", "is_are_yesno", "This is a train."),
    ("Is this a train?", "no", "is_are_yesno", "It is not true that this is a train."),
    ("Is the boy wearing glasses?", "no", "is_are_yesno", "The boy is not wearing glasses."),
    ("Does the pizza have pepperoni?", "no", "is_are_yesno", "The pizza have not pepperoni."),
    ("Is it raining?", "maybe", "is_are_yesno", "The it is raining."),
    ("What sport is this?", "tennis", "what_brand_sport", "The sport is this is tennis."),
    ("What is this ?", "cat", "what_is", "The this is cat."),
    ("What is the man holding?", "yes", "fallback", "What is the man holding — yes."),
    ("Can you see it?", "yes", "fallback", "Can you see it — yes."),
]


def test_golden_captions(spark):
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _, _) in enumerate(GOLDEN)], "i int, question string, answer string")
    got = rules.with_captions(df).orderBy("i").collect()
    assert [(r.rule, r.caption) for r in got] == [(rule, caption) for _, _, rule, caption in GOLDEN]


def test_stream_and_batch_share_the_rules(spark, tmp_path):
    from plumbline.streaming.captions import caption_stream

    df = spark.createDataFrame([(q, a) for q, a, _, _ in GOLDEN], "question string, answer string")
    df.write.parquet(str(tmp_path / "in"))
    stream = caption_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("said").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.caption for r in spark.table("said").collect()} == {c for _, _, _, c in GOLDEN}


@pytest.mark.parametrize(
    ("value", "want"), [("It's a T-Shirt über!", ["it's", "a", "t", "shirt", "ber"]), ("", []), ("  \t ", [])]
)
def test_tokens(spark, value, want):
    assert spark.range(1).select(t.tokens(F.lit(value)).alias("x")).first().x == want


@pytest.mark.parametrize(("value", "want"), [(" 3 ", "three"), ("12", "twelve"), ("13", "13"), ("Red\t", "red")])
def test_normalized_answer(spark, value, want):
    assert spark.range(1).select(t.normalized_answer(F.lit(value)).alias("x")).first().x == want


@pytest.mark.parametrize(("value", "want"), [("apple", "an apple"), ("dog", "a dog"), ("the dog", "the dog"), ("", "")])
def test_with_article(spark, value, want):
    assert spark.range(1).select(t.with_article(F.lit(value)).alias("x")).first().x == want
