from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ionweave.llm import tokens as T

ODD = [
    None, "", " ", "\n\n", "a", "don't  stop\t\n now", "naïve café 12345 ²³ Ⅷ", "日本語のテキスト。次", "emoji 👩‍👩‍👧 \U0001f9ff x", "<|endoftext|> as text", "x​y﻿z", "   wide　space\x85\x1c\x1d", "a" * 5000, "!?" * 3000,
    "�� damaged Ã© â€œ", " \n \r\n\t ", "it's I'LL they'Ve", "ǅ ᾼ ͅ á", "\U00010380\U0001e900\U00020000 ext", "٣٤٥ १२३ 𝟙𝟚", "\U0001fae8 \U0001f6dc \U0001e4d0 new", "tab\x0bvt\x0cff",
]


def reference(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("size", [0, 5, 50_000])
def test_equals_the_tokenizer(spark, size):
    rnd = random.Random(2)
    pool = [chr(c) for c in (*range(9, 14), *range(32, 127), 0xA0, 0xE9, 0x416, 0x3042, 0x4E2D, 0x1F600, 0x200B, 0xB2, 0x0301)]
    texts = ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in T.encode(df, size=size).collect()}
    want = reference(texts)
    assert [got[i] for i in range(len(texts))] == want
    n = {r["doc_id"]: r["n_tokens"] for r in T.encode(df, counts_only=True, size=size).collect()}
    assert [n[i] for i in range(len(texts))] == [len(x) for x in want]


def test_words_join_to_the_text(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, t string")
    assert all("".join(r["w"]) == (r["t"] or "") for r in df.select("t", T.words(F.col("t")).alias("w")).collect())


def test_decode_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in T.decode(T.encode(df)).collect()}
    assert [back[i] for i in range(len(ODD))] == [x or "" for x in ODD]


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.encode(df).collect() == []
    twice = spark.createDataFrame([(1, "ab ab"), (1, "ab ab")], "doc_id long, text string")
    assert len(T.encode(twice).collect()) == 2


def test_most_frequent_words_are_bounded(spark):
    df = spark.createDataFrame([(1, " b b b a a c c " + "z" * 99 + " " + "z" * 99)], "doc_id long, text string")
    assert T.frequent_words(df, size=2) == [" b", " a"]
    rare, often = [f" q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)], [f" s{chr(97 + i)}" for i in range(7)]
    many = spark.createDataFrame([(i, rare[i % 40] + often[i % 7]) for i in range(120)], "doc_id long, text string")
    assert T.frequent_words(many, size=9) == [*often, " qaa", " qab"]  # 40 words of one class, more than four times the size


def test_public_vocabulary(spark):
    assert T.pieces(spark).select("id").distinct().count() == 50_256
