import re
from datetime import date

from pyspark.sql import functions as F

from lodestar.llm import pseudonyms as P


def run(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in P.pseudonymise(df, "k").orderBy("doc_id").collect()]


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10 == 0


def test_permutations_are_one_to_one(spark):
    codes = spark.range(0, 10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("t"))
    assert codes.select(P.permute_digits(F.col("t"), "k", "card").alias("y")).distinct().count() == 10_000
    days = spark.range(0, 72_900).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = P.pseudonymise(days, "k")
    assert out.select("text").distinct().count() == 72_900 and out.where(~F.rlike("text", F.lit(r"^\d{4}-\d\d-\d\d$"))).isEmpty()
    assert out.where(F.try_to_date("text", "yyyy-MM-dd").isNull()).isEmpty()


def test_formats_are_kept_and_values_stay_linked(spark):
    a, b, c, d = run(spark, "é 4111 1111 1111 1111, x", "4111-1111-1111-1111 4111111111111111!", "+1 (017) 555-7713 and 617-555-1234", "97.51.17.173 born 28.02.1987, 1987-02-28")
    x = re.search(r"\d{4} \d{4} \d{4} \d{4}", a)[0]
    assert luhn(x) and x != "4111 1111 1111 1111" and a == f"é {x}, x"
    assert b == x.replace(" ", "-") + " " + x.replace(" ", "") + "!"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and \d{3}-\d{3}-\d{4}", c) and "555-7713" not in c
    assert re.fullmatch(r"\d+(\.\d+){3} born \d\d\.\d\d\.\d{4}, \d{4}-\d\d-\d\d", d) and "97.51.17.173" not in d
    day, iso = re.search(r"born (\S+),", d)[1], d.split()[-1]
    assert day.split(".")[::-1] == iso.split("-")
    assert run(spark, "97.51.17.173")[0] == d.split()[0]


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_further_formats(spark):
    texts = ["on 12/31/1987", "on 1899-12-31 and 2100-01-01 or 9999-12-31, 0001-01-01", "+44 20 7946 0958.", "call 6175551234!", "DE89 3704 0044 0532 0130 00 or DE89370400440532013000", "123-45-6789", "at 2001:db8::ff00:42:8329, FE80:0:0:0:0:0:0:1A", "5 March 1987, March 5, 1987; 05 March 1987; 5. März 1987; 5 mars 1987; 5 de marzo de 1987; 1987-03-05; 5.3.1987", "+442079460958", "617-555-1234 017-555-1234", "GB82WEST12345698765432"]
    out = run(spark, *texts)
    assert all(x != y for x, y in zip(texts, out, strict=True)) and out == run(spark, *texts)
    assert re.fullmatch(r"on (0[1-9]|1[0-2])/(1[3-9]|2\d|3[01])/(19|20|21)\d\d", out[0])
    assert re.fullmatch(r"on \d{4}-\d\d-\d\d and \d{4}-\d\d-\d\d or \d{4}-\d\d-\d\d, \d{4}-\d\d-\d\d", out[1]) and not set(re.findall(r"\S+-\d\d", texts[1])) & set(re.findall(r"\S+-\d\d", out[1]))
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}\.", out[2]) and out[8] == out[2].replace(" ", "").rstrip(".")
    plan = re.fullmatch(r"call ([2-9]\d\d[2-9]\d{6})!", out[3])[1]
    assert out[9].split()[0] == f"{plan[:3]}-{plan[3:6]}-{plan[6:]}" and not re.match(r"[2-9]\d\d-[2-9]", out[9].split()[1])
    spaced, plain = out[4].split(" or ")
    assert spaced.replace(" ", "") == plain and mod97(plain) == 1 and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", spaced)
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", out[5])
    assert re.fullmatch(r"at [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{2}:[0-9a-f]{4}, [0-9A-F]{4}(:[0-9A-F]){6}:[0-9A-F]{2}", out[6])
    iso = out[7].split("; ")[5]
    y, m, d = (int(x) for x in iso.split("-"))
    name = [names[m - 1] for names in P.MONTHS]
    assert out[7] == f"{d} {name[0]} {y:04}, {name[0]} {d}, {y:04}; {d:02} {name[0]} {y:04}; {d}. {name[2]} {y:04}; {d} {name[3]} {y:04}; {d} de {name[4]} de {y:04}; {iso}; {d}.{m}.{y:04}"
    assert mod97(out[10]) == 1 and re.fullmatch(r"GB\d\dWEST\d{14}", out[10])


def test_further_permutations_are_one_to_one(spark):
    def distinct(df, shape):
        out = P.pseudonymise(df, "k").select("text")
        n = df.count()
        assert out.distinct().count() == n and out.where(~F.rlike("text", F.lit(shape))).isEmpty()

    ids = lambda n: spark.range(n).withColumnRenamed("id", "doc_id")
    distinct(ids(4096).withColumn("text", F.concat(F.lit("1:"), F.lower(F.lpad(F.hex("doc_id"), 3, F.lit("0"))), F.lit("::9"))), r"^[0-9a-f]:[0-9a-f]{3}::[0-9a-f]$")
    distinct(ids(9999).withColumn("text", F.concat(F.lit("219-09-"), F.lpad((F.col("doc_id") + 1).cast("string"), 4, "0"))), r"^\d{3}-\d{2}-\d{4}$")
    distinct(ids(8000).withColumn("text", F.concat(F.lit("212555"), F.lpad(F.col("doc_id").cast("string"), 4, "0"))), r"^[2-9]\d\d[2-9]\d{6}$")
    months = ids(8766).select("doc_id", F.date_add(F.lit("1990-01-01").cast("date"), F.col("doc_id").cast("int")).alias("d")).where("day(d) > 12")
    distinct(months.select("doc_id", F.date_format("d", "MM/dd/yyyy").alias("text")), r"^\d\d/(1[3-9]|[23]\d)/\d{4}$")
    days = [(date(1900, 1, 1) - date(1, 1, 1)).days, (date(2101, 1, 1) - date(1, 1, 1)).days, date.max.toordinal()]
    assert [(first, first + a * b) for first, a, b in P._SPANS] == list(zip([0, *days], days, strict=False))


def test_no_plan_shows_the_key(spark):
    out = P.pseudonymise(spark.createDataFrame([(1, "5 March 1987 a@b.cd")], "doc_id long, text string"), "hidden key")
    out.collect()
    assert "hidden key" not in out._jdf.queryExecution().toString()


def test_what_fails_validation_stays(spark):
    texts = ["4111111111111112", "300.1.1.1", "31.02.1987 1987-13-01", "1.2.3.4.5", "version 4.0. and 12345", "no data", "DE88370400440532013000", "666-12-3456 123-00-4567", "1123456789 x6175551234 6175551234.5", "31 April 1987, March 32, 1987", "::1 a::b std::cafe 12:30:45", "+12 34", "13/13/1987 0000-01-01"]
    assert run(spark, *texts) == texts


def test_neighbouring_numbers_and_glued_ones(spark):
    (a,) = run(spark, "4111111111111111 4111111111111111 end.4111111111111111!!")
    n = re.findall(r"\d{16}", a)
    assert len(n) == 3 and len(set(n)) == 1 and n[0] != "4111111111111111"


def test_mail_addresses(spark):
    a, b = run(spark, "to Jo.Doe@mail1.example.com.", "JO.DOE@mail1.example.com")
    assert "Doe" not in a and a.startswith("to u") and a.endswith("@mail1.example.com.")
    assert b == a[3:-1]


def test_odd_rows_and_native_plan(spark, odd_docs):
    out = P.pseudonymise(odd_docs, "k")
    rows = {r.doc_id: r for r in out.collect()}
    for d in odd_docs.collect():
        assert rows[d.doc_id].text == d.text
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert P.pseudonymise(odd_docs.limit(0), "k").collect() == []
