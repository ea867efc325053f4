import datetime
import itertools
import random

from pyspark.sql import functions as F

from tallyloom.llm import pseudonyms


def masked(spark, texts, key="k", **columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return [r for r in pseudonyms.pseudonymise(df, key, count="n").orderBy("doc_id").collect()]


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1] if c.isdigit()]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_values_change_inside_their_format(spark):
    pairs = {
        "card 4111 1111 1111 1111.": r"card [0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}\.",
        "4111111111111111": "[0-9]{16}",
        "mail a.b12@mail7.example.com, ok": r"mail [a-z]\.[a-z][0-9]{2}@mail7\.example\.com, ok",
        "+1 (974) 555-3436": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
        "97.51.17.173": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
        "123-45-6789": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "on 1987-02-28": "on [12][0-9]{3}-[0-9]{2}-[0-9]{2}",
        "31.12.1999": r"[0-9]{2}\.[0-9]{2}\.[12][0-9]{3}",
        "DE89370400440532013000": "DE[0-9]{20}",
        "GB82 WEST 1234 5698 7654 32": "GB[0-9]{2} [A-Z]{4} [0-9]{4} [0-9]{4} [0-9]{4} [0-9]{2}",
    }
    import re

    for text, row in zip(pairs, masked(spark, list(pairs))):
        assert row.text != text and row.n == 1 and re.fullmatch(pairs[text], row.text), row
    cards = [r.text for r in masked(spark, ["4111 1111 1111 1111", "4111111111111111"])]
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1])
    iban = masked(spark, ["DE89370400440532013000"])[0].text
    moved = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert int(moved) % 97 == 1


def test_what_does_not_validate_stays(spark):
    texts = ["9807915762804490", "1987-02-31", "300.1.2.3", "000-12-1234", "version 3.0, 1.2", "plain text", "", None, "0000000000000000"]
    assert [r.text for r in masked(spark, texts)] == texts
    assert [r.n for r in masked(spark, texts)] == [0] * len(texts)


def test_equal_values_stay_linked_and_keys_differ(spark):
    a, b = masked(spark, ["x 4111111111111111 y", "and 4111111111111111"])
    assert a.text.split()[1] == b.text.split()[1]
    assert masked(spark, ["4111111111111111"], key="other")[0].text != a.text.split()[1]


def test_permutation_of_whole_formats(spark):
    """Every value of a small format gets a value of its own there."""
    shape = list(itertools.product(range(3), range(5), range(7)))
    df = spark.createDataFrame([(list(s),) for s in shape], "s array<long>")
    radices = F.array(*[F.lit(r).cast("long") for r in (3, 5, 7)])
    got = {tuple(r[0]) for r in df.select(pseudonyms.feistel(F.col("s"), radices, "k", "t")).collect()}
    assert got == set(shape)
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in random.Random(1).sample(range(73049), 400)]
    got = [r.text for r in masked(spark, [d.isoformat() for d in days])]
    assert len(set(got)) == 400 and all(1900 <= datetime.date.fromisoformat(d).year <= 2099 for d in got)


def test_columns_and_long_texts(spark):
    row = masked(spark, ["1.2.3.4 " * 3000 + "w" * 100000 + "@", "x"], _values=1, _pseudonyms="p")[0]
    assert row._values == 1 and row._pseudonyms == "p" and row.n == 3000 and "1.2.3.4 " not in row.text
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pseudonyms.pseudonymise(df, "k").count() == 0


def test_main_path_is_native(spark):
    df = pseudonyms.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
