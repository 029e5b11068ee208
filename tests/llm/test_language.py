from __future__ import annotations

import random

from pyspark.sql import functions as F

from ionweave.llm import language as L
from ionweave.llm import prose as P

WORDS = {
    "en": "the change is small although we should have caught this while testing nobody needs it",
    "de": "die änderung ist klein obwohl wir das beim testen hätten sehen müssen niemand braucht es",
    "fr": "le changement est petit bien que nous aurions dû le voir pendant les essais personne",
    "ja": "変更は小さいですがもっと早く気づくべきでした誰も使っていません",
}
DIFF = "\ndiff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-    return fit[0]\n+    while (a < b) { c++; }\n"


def sentence(lang, rnd):
    w = WORDS[lang]
    if lang == "ja":
        k = rnd.randrange(6, 15)
        at = rnd.randrange(0, len(w) - k)
        return w[at : at + k] + "。"
    w = w.split()
    return " ".join(rnd.choice(w) for _ in range(7)).capitalize() + "."


def commit(*lines, tail=DIFF):
    return "commit " + "a" * 40 + "\nAuthor: x <x@y>\nDate:   2031-01-01\n\n" + "".join(f"    {x}\n" for x in lines) + tail


def corpus(n=240):
    rnd, rows = random.Random(8), []
    for i in range(n):
        lang = list(WORDS)[i % 4]
        label = {"en": "en_GB", "de": "German", "fr": "FRA", "ja": "jpn"}[lang] if i % 12 else "??"
        rows.append((i, commit(*[sentence(lang, rnd) for _ in range(4)]), label, lang))
    return rows


def test_prose_only():
    text = commit("fix(io): Guard the reader.", "> Quoted one. And two!", "Refs: #12", "Signed-off-by: a-b", "Change-Id: Iabc", "[#7] Ticket text here.") + "+    # Comment sentence here.\n-\t// Another one.\n * Third of them.\n+#temp\n"
    assert list(P.sentences(text)) == ["Guard the reader.", "Quoted one.", "And two!", "Ticket text here.", "Comment sentence here.", "Another one.", "Third of them."]


def test_automatic_messages_are_no_prose():
    for m in ("Merge branch 'a' into main", "Merge pull request #5 from x/y", "Merge remote-tracking branch 'origin/a'", "Bump libion from 1.0.0 to 2.0.0", "chore(release): v2.4.5 [skip ci]", "Automatic backport of #12", "Update lockfile (9a)", "Sync generated files", "Release v1.2.3", "v1.2.3"):
        assert list(P.sentences(commit(m))) == [], m


def test_no_prose():
    for t in (None, "", "  \n ", "\r\n", commit(), "diff --git a/x b/x\n+x = 1"):
        assert list(P.sentences(t)) == []


def test_line_ends_and_invisible_characters():
    assert list(P.sentences(commit("Guard th​e reader.\r"))) == ["Guard the reader."]


def test_labels(spark):
    cases = {"en": "en", "en_GB": "en", "EN": "en", " German ": "de", "de-AT": "de", "jpn": "ja", "Português": "pt", "??": None, "n/a": None, "xx": None, "": None, "unknown": None, "und": None, None: None, "pt-BR": "pt"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r["l"]: r["c"] for r in df.select("l", L.label_code(F.col("l")).alias("c")).collect()} == cases


def test_held_out_documents_segments_and_cases(spark):
    rows = corpus()
    rnd = random.Random(9)
    extra = [
        (1000, commit(*[sentence("de", rnd) for _ in range(3)]), "en"),
        (1001, commit(*[sentence("fr", rnd) for _ in range(3)]), "fr-CA"),
        (1002, commit(*[sentence("en", rnd) for _ in range(3)], *[sentence("ja", rnd) for _ in range(3)]), "en"),
        (1003, commit(), "en"), (1004, None, None), (1005, "", "de"), (1006, commit(*[sentence("ja", rnd) for _ in range(3)]), None),
    ]
    train = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    df = spark.createDataFrame([r[:3] for r in rows] + extra, "doc_id long, text string, lang string").withColumn("segment", F.lit("clash"))
    model = L.fit(train)
    segs = L.segments(df, model=model).cache()
    by = {}
    for r in segs.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert all({s["lang"] for s in by[i]} == {lang} for i, _, _, lang in rows)
    assert all(0.9 < s["confidence"] <= 1.0 for i in range(240) for s in by[i])
    assert [(s["lang"], s["first_sentence"], s["n_sentences"]) for s in sorted(by[1002], key=lambda s: s["segment"])] == [("en", 0, 3), ("ja", 3, 3)]
    assert 1003 not in by and 1004 not in by and 1005 not in by
    found = {tuple(r) for r in L.mislabelled(segs).collect()}
    assert found == {(i, lang) for i, _, label, lang in rows if label == "??"} | {(1000, "de"), (1002, "en"), (1002, "ja"), (1006, "ja")}
    assert L.languages(segs).where("doc_id = 1002").count() == 2


def test_unseen_words_fall_back_to_shorter_grams(spark):
    train = spark.createDataFrame([r[:3] for r in corpus()], "doc_id long, text string, lang string")
    m = L.fit(train)
    assert L.CODES[m.margin(m.score("obwohlig testenden müssens"))[0]] == "de"
    assert L.CODES[m.margin(m.score("小さな変化"))[0]] == "ja"
    assert m.score("").tolist() == [0.0] * len(L.CODES)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.mislabelled(L.segments(df)).collect() == []
