import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import pii

KEY = "test"


def hidden(spark, texts, key=KEY):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), key).orderBy("i").collect()
    return [r.text for r in rows], [r.n_private for r in rows]


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_each_kind_keeps_its_format(spark):
    values = ["4845168114407329", "4845 1681 1440 7329", "DE89 3704 0044 0532 0130 00", "+1 (499) 555-6503", "(499) 555-6503", "123-45-6789", "97.51.17.173", "2020-02-29", "31.12.1999", "12/31/1999", "a.b@mail2.example.com", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"']
    texts, found = hidden(spark, [f"so {v}, then" for v in values])
    assert found == [1] * len(values)
    out = [t[3:-6] for t in texts]
    assert all(a != b for a, b in zip(out, values))
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    assert [shape(x) for x in out[:6]] == [shape(x) for x in values[:6]]
    assert luhn(out[0]) and re.sub(" ", "", out[1]) == out[0] and re.sub(r"\D", "", out[3])[1:] != re.sub(r"\D", "", values[3])[1:]
    assert out[2].startswith("DE") and mod97(out[2]) == 1 and out[3].startswith("+1 (")
    assert all(int(x) <= 255 for x in out[6].split("."))
    assert dt.date.fromisoformat(out[7]) and dt.datetime.strptime(out[8], "%d.%m.%Y") and dt.datetime.strptime(out[9], "%m/%d/%Y")
    assert re.fullmatch(r"[a-z]\.[a-z]@[a-z]{4}\d\.[a-z]{7}\.com", out[10]) and re.fullmatch(r'token = "[0-9a-f]{40}"', out[11])


def test_cards_beside_short_groups(spark):
    """A card is found although other digits follow or precede it."""
    cards = ["4111 1111 1111 1111", "4111111111111111", "3782-822463-10005"]
    texts = [f"{a}{c}{b}" for c in cards for a, b in (("", " 123 "), ("", " 12/27"), ("no 12 ", "."))]
    out, found = hidden(spark, texts)
    assert found == [1] * len(texts) and not any(c in t for c in cards for t in out)
    assert luhn(out[0][:19]) and out[0][19:] == " 123 " and out[4][16:] == " 12/27" and out[8].startswith("no 12 ")
    assert hidden(spark, ["4111 1111 1111 1112 123"]) == (["4111 1111 1111 1112 123"], [0])


def test_equal_values_stay_linked_and_keys_differ(spark):
    card = "4845168114407329"
    texts, _ = hidden(spark, [f"{card} x", f"y {card}.", f"{card}"])
    assert len({re.search(r"\d{16}", t)[0] for t in texts}) == 1
    other, _ = hidden(spark, [card], key="another")
    assert other[0] != texts[2]


def test_what_is_not_valid_stays(spark):
    texts = ["4845168114407320", "300.1.1.1", "2021-02-30", "000-12-3456", "DE88 3704 0044 0532 0130 00", "1.2.3", "no digits", "a @ b", "version 1.2.3.4.5", "12345", ""]
    assert hidden(spark, texts) == (texts, [0] * len(texts))
    assert hidden(spark, [None]) == ([None], [0])


def test_the_network_is_a_permutation(spark):
    rows = spark.range(1000).select(F.format_string("%03d", "id").alias("v"))
    both = rows.withColumn("p", pii.permuted(F.col("v"), KEY)).withColumn("back", pii.permuted(F.col("p"), KEY, sign=-1)).toPandas()
    assert both.p.nunique() == 1000 and (both.back == both.v).all()
    n = spark.range(0, 189 * 773, 37).withColumn("p", pii.permuted_number(F.col("id"), pii.DAYS, KEY)).withColumn("back", pii.permuted_number(F.col("p"), pii.DAYS, KEY, sign=-1)).toPandas()
    assert n.p.nunique() == len(n) and n.p.between(0, 189 * 773 - 1).all() and (n.back == n.id).all()


def test_long_texts_and_odd_rows(spark, odd_docs, no_docs):
    long = "word " * 100_000 + "97.51.17.173" + " word" * 100_000 + " a@" + "b" * 50_000
    (text,), (n,) = hidden(spark, [long])
    assert n == 1 and len(text.split()) == len(long.split()) and "97.51.17.173" not in text
    assert pii.pseudonymise(odd_docs, KEY).count() == 8 and pii.pseudonymise(no_docs, KEY).count() == 0
    many, (n,) = hidden(spark, ["; ".join(f"10.0.{i // 200}.{i % 200}" for i in range(3000))])
    assert n == 3000 and len(set(many[0].split("; "))) == 3000


def test_one_number_has_one_pseudonym_in_all_layouts(spark):
    same = [["4845168114407329", "4845 1681 1440 7329", "4845-1681-1440-7329"], ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"], ["+1 (499) 555-6503", "+1 499 555 6503", "+14995556503"], ["(499) 555-6503", "499-555-6503", "499.555.6503"]]
    all_, found = hidden(spark, sum(same, []))
    assert found == [1] * len(all_)
    for layouts in same:
        out, all_ = all_[: len(layouts)], all_[len(layouts) :]
        assert len({re.sub("[^0-9A-Z]", "", x) for x in out}) == 1
        assert [re.sub("[0-9A-Z]", "", x) for x in out] == [re.sub("[0-9A-Z]", "", x) for x in layouts]


def test_failed_candidates_are_searched_again(spark):
    texts = ["ID12 4845168114407329", "AB12 CDEF 4845 1681 1440 7329", "+1 4845 1681 1440 7329", "DE89370400440532013000 ABCD EFGH", "XY00 10.1.2.3"]
    out, found = hidden(spark, texts)
    assert found == [1] * len(texts)
    assert out[0].startswith("ID12 4") and luhn(out[0][5:]) and out[1].startswith("AB12 CDEF 4") and out[3].endswith(" ABCD EFGH") and mod97(out[3][:22]) == 1


def test_numbers_of_no_issuer_stay(spark):
    """Sixteen random digits pass the Luhn sum once in ten, so the issuer's range counts too."""
    texts = [next(b + c for c in "0123456789" if luhn(b + c)) for b in ("868799696973550", "099752394720028", "111111111111111", "999999999999999")]
    assert hidden(spark, texts) == (texts, [0] * len(texts))


def test_planted_values_against_what_was_planted(spark):
    """Random texts of words, valid values and look-alikes: exactly the planted values change, each to a value of its kind."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban():
        body = digits(18)
        return next(f"DE{c:02d}{body}" for c in range(2, 99) if mod97(f"DE{c:02d}{body}") == 1)

    def not_card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if not luhn(body + c))

    good = [card, iban, lambda: f"+1 ({rng.randint(200, 999)}) 555-{digits(4)}", lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.7.{rng.randint(0, 255)}", lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"n{digits(2)}@mail{digits(1)}.example.com", lambda: f"{rng.randint(100, 899)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"]
    bad = [not_card, lambda: f"DE00{digits(18)}", lambda: f"{rng.randint(256, 999)}.1.2.3", lambda: f"2021-13-{rng.randint(10, 28)}", lambda: digits(6), lambda: f"000-{digits(2)}-{digits(4)}", lambda: "word"]
    rows, want = [], []
    for _ in range(150):
        parts, n = [], 0
        for _ in range(rng.randint(0, 8)):
            ok = rng.random() < 0.5
            parts += [rng.choice(("then", "and", "so it is")), (rng.choice(good) if ok else rng.choice(bad))()]
            n += ok
            want.append((len(rows), parts[-1], ok))
        rows.append(" , ".join(parts))
    out, found = hidden(spark, rows)
    got = [list(zip(a.split(" , ")[1::2], b.split(" , ")[1::2], strict=True)) for a, b in zip(rows, out, strict=True)]
    assert [(i, v, v != w) for i, pairs in enumerate(got) for v, w in pairs] == want
    assert found == [sum(a != b for a, b in pairs) for pairs in got]


def test_the_key_is_not_in_the_plan(spark, capsys):
    pii.pseudonymise(spark.createDataFrame([("a@b.com",)], "text string"), "very-secret-key").explain("extended")
    shown = capsys.readouterr().out
    assert "very-secret-key" not in shown and not re.search("pii-key-[0-9a-f]{8}", shown)


def test_long_runs_that_repeat_a_pattern(spark):
    long = ["x@" + "a." * 100_000 + "com", "x@" + "a-" * 100_000, "token: " + "a1" * 100_000, "1 " * 5_000, "x@" + "a.." * 50_000, "DE12 " + "3456 " * 50_000, "+1 " + "22-" * 50_000]
    rows = [(i, t) for i, t in enumerate([*long, "see x@a.com.. or y@b-c.de1 or z@q.r or w@m.co1.b"])]
    found = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert found[0].n_private == 1 and found[0].text != rows[0][1] and found[0].text.endswith(".com") and len(found[0].text) == len(rows[0][1])
    assert [found[i].n_private for i in (1, 4)] == [0, 0] and found[2].n_private == 1
    assert found[7].n_private == 3 and found[7].text.endswith(".b") and " z@q.r or " in found[7].text


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, "mail a.b@example.com", "m", "n", "k")]
    found = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, _met string, _NEW string, n_private_ string"), "k")
    assert found.columns == ["doc_id", "text", "_met", "_NEW", "n_private_", "n_private"]
    assert [(r._met, r._NEW, r.n_private) for r in found.collect()] == [("m", "n", 1)]
