import datetime
import itertools
import re

from pyspark.sql import functions as F

from bagstats.llm.pii import permuted, pseudonymize


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _changed(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n) for r in pseudonymize(df, key, count_col="n").orderBy("doc_id").collect()]


def test_network_is_one_to_one(spark):
    for bases in ([7], [3, 5], [10, 2, 4], [2, 2, 2, 2, 2]):
        every = list(itertools.product(*map(range, bases)))
        df = spark.createDataFrame([(list(v),) for v in every], "v array<int>")
        out = df.select(permuted(F.col("v"), F.array(*map(F.lit, bases)), "kind", "key").alias("v")).collect()
        assert {tuple(r.v) for r in out} == set(every)


def test_valid_values_change_and_stay_valid(spark):
    texts = [
        "4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "4111111111111112", "378282246310005", "3782 822463 10005",
        "2024-02-29", "29.02.2024", "2023-02-29", "1999/12/31", "31/12/1999", "123-45-6789", "666-45-6789", "10.2.3.255", "10.2.3.256",
        "+1 (643) 555-5742", "643-555-5742", "(643) 555-5742", "jo.X9@mail.example.com", "DE89370400440532013000",
        "DE89 3704 0044 0532 0130 00", "DE89370400440532013001",
    ]
    out = dict(zip(texts, _changed(spark, texts), strict=True))
    kept = {"4111111111111112", "2023-02-29", "666-45-6789", "10.2.3.256", "DE89370400440532013001"}
    assert {t for t, (_, n) in out.items() if n == 0} == kept
    assert all((new == old) == (old in kept) for old, (new, _) in out.items())
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", t)))
    assert all(shape(new) == shape(old) for old, (new, _) in out.items() if not old.startswith("10."))
    bare = lambda t: re.sub("[^0-9A-Za-z]", "", out[t][0])
    assert bare(texts[0]) == bare(texts[1]) == bare(texts[2]) and _luhn(bare(texts[0])) and _luhn(bare(texts[4]))
    assert bare(texts[4]) == bare(texts[5]) and bare(texts[19]) == bare(texts[20])
    day = datetime.date.fromisoformat(out["2024-02-29"][0])
    assert out["29.02.2024"][0] == day.strftime("%d.%m.%Y") and 1900 <= day.year < 2100
    assert all(0 <= int(o) < 256 for o in out["10.2.3.255"][0].split("."))
    assert out["643-555-5742"][0].replace("-", "") == re.sub("[^0-9]", "", out["+1 (643) 555-5742"][0])[1:]
    land, rest = out["DE89370400440532013000"][0][:4], out["DE89370400440532013000"][0][4:]
    assert int("".join(str(int(c, 36)) for c in rest + land)) % 97 == 1


def test_different_values_stay_different_and_keys_matter(spark):
    days = [(datetime.date(1990, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(300)]
    first, second = _changed(spark, days), _changed(spark, days, key="other")
    assert len({t for t, _ in first}) == len(days)
    assert sum(a == b for a, b in zip(first, second, strict=True)) < 5


def test_text_around_stays(spark):
    text = "a 4111111111111111 5500005555555559, x@y.org\nv1.2.3.4.5 and order 1234567890123456 (2024-02-29)."
    (new, count), *rest = _changed(spark, [text, text, None, "", "no data 12"])
    assert count == 4 and rest == [(new, 4), (None, 0), ("", 0), ("no data 12", 0)]
    pattern = r"a [0-9]{16} [0-9]{16}, [a-z]@y\.org\nv1\.2\.3\.4\.5 and order 1234567890123456 \([0-9]{4}-[0-9]{2}-[0-9]{2}\)\."
    assert re.fullmatch(pattern, new)


def test_odd_rows(odd, empty):
    new = pseudonymize(odd, "k", count_col="n").collect()
    old = odd.collect()
    assert len(new) == len(old) and set(new[0].asDict()) == set(old[0].asDict())
    assert sorted(r.n for r in new)[-1] == 1 and sum(r.n for r in new) == 1  # the card at the end of the long text
    assert {r.text for r in new if r.n == 0} == {r.text for r in old if r.doc_id != 13}
    assert pseudonymize(empty, "k").count() == 0
