import random

from pyspark.sql import functions as F

from tidemark.llm import language


def naive(sample, text):
    """Phrases of a greedy parse by searching the sample itself."""
    n = i = 0
    while i < len(text):
        size = 1
        while i + size < len(text) and text[i : i + size + 1] in sample:
            size += 1
        if text[i] not in sample:
            size = 1
        n, i = n + 1, i + size
    return n


def test_phrases_equal_a_naive_parse():
    rng = random.Random(1)
    samples = {k: language.normalised("".join(rng.choices(letters, k=600))) for k, letters in (("a", "abcd "), ("b", "cdef "))}
    model = language.Model(samples)
    texts = [language.normalised("".join(rng.choices("abcdefg ", k=n))) for n in (1, 2, 50, 400)]
    texts = [t for t in texts if t]
    assert model.phrases(texts).tolist() == [[naive(samples[k], t) for k in ("a", "b")] for t in texts]


def test_long_texts_are_parsed_whole():
    """Beyond a piece, the count is that of one greedy parse: random texts, texts out of the sample, and repetitions that never fall into step."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(60)]
    samples = {"a": " ".join(rng.choices(words, k=700)), "b": " ".join(rng.choices("abcdefg", k=300)), "c": "abc " * 30}
    texts = [" ".join(rng.choices(words, k=900)), samples["a"], samples["a"][17:2900] + "xyz " + samples["a"][100:], "abc " * 700, "a" * 1537, "abcdefghijk" * 150, "abc"]
    model = language.Model(samples)
    assert all(len(t) > 2 * language.STEP for t in texts[:6])
    assert model.phrases(texts).tolist() == [[naive(samples[k], t) for k in "abc"] for t in texts]


def test_whole_texts_and_all_languages_are_learned_from(spark):
    """What stands late in a text is learned, and no language is left out, however many there are."""
    rows = [(1, "x" * 300 + " " + "y" * 300, "l0")] + [(i, f"{chr(0x4E00 + i)} " * 40, f"l{i}") for i in range(2, 400)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 399
    one = language.learn(spark.createDataFrame(rows[:1] * 3, "doc_id long, text string, lang string"))
    assert one.phrases(["y" * 99])[0, 0] == 1 and one.phrases(["x" * 300])[0, 0] == 1


def test_columns_of_the_outputs_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, "abc", "en", "old", 7.0)], "doc_id long, text string, lang string, lang_pred string, score double")
    found = language.identify(rows, language.learn(rows))
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and [tuple(r)[3:] for r in found.collect()] == [("en", 1.0)]


def test_every_letter_of_a_sample_matches():
    """Languages of thousands of letters, beyond the first 65,536 code points too, parse as by the naive search."""
    rng = random.Random(2)
    scripts = {"a": "abcdefgh ", "b": [chr(0x4E00 + i) for i in range(900)], "c": [chr(0x4E00 + i) for i in range(600, 1500)], "d": [chr(0x20000 + i) for i in range(300)]}
    samples = {k: "".join(rng.choices(letters, k=3000)).strip() for k, letters in scripts.items()}
    texts = [samples[k][1000 : 1000 + n] for k in scripts for n in (40, 300)] + ["zz", samples["b"][:100] + "z" + samples["d"][:100]]
    model = language.Model(samples)
    found = model.phrases(texts)
    assert found.tolist() == [[naive(samples[k], t) for k in scripts] for t in texts]
    assert [model.languages[i] for i in found[:8].argmin(axis=1)] == [k for k in scripts for _ in range(2)]


def test_odd_rows(spark, odd_docs, no_docs):
    model = language.learn(odd_docs.withColumn("lang", F.coalesce("lang", F.lit("xx"))))
    found = language.identify(odd_docs, model).collect()
    assert len(found) == 8 and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 5)} == {"und"}
    assert all(r.lang_pred != "und" for r in found if r.doc_id in (1, 4, 6))
    nothing = language.learn(no_docs)
    assert {r.lang_pred for r in language.identify(odd_docs, nothing).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op6_language

    found = op6_language(spark, "/root/testdata/sf0.01").filter("held_out")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def test_many_languages_are_each_learned_as_well_as_few(spark, monkeypatch):
    monkeypatch.setattr(language, "CHARS", 6_000)  # of each
    rng = random.Random(8)
    vocabulary = {f"l{i:02d}": ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(120)] for i in range(60)}
    text = lambda k, n: " ".join(rng.choices(vocabulary[k], k=n))
    train = [(text(k, 300), k) for k in vocabulary for _ in range(5)]
    held = [(text(k, 8), k) for k in sorted(vocabulary)[:4] for _ in range(25)]

    def right(languages):
        model = language.learn(spark.createDataFrame([r for r in train if r[1] in languages], "text string, lang string"))
        found = language.identify(spark.createDataFrame(held, "text string, lang string"), model).collect()
        return {k: sum(r.lang_pred == k for r in found if r.lang == k) for k in sorted(vocabulary)[:4]}

    few, many = right(sorted(vocabulary)[:4]), right(sorted(vocabulary))
    assert all(many[k] >= few[k] - 1 for k in few) and min(few.values()) >= 24
