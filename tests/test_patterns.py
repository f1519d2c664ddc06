import random
import re

from veriframe.operators.patterns import expressions


def found_in(df, columns, n=1000):
    out = {}
    for r in expressions(df, columns, n).collect():
        out.setdefault(r.column_name, []).append((r.expression.replace(r"\z", r"\Z"), r.copies, r.share))
    return out


def check(values, found):
    """Every value matches one expression at least, and copies add up to all values."""
    assert sum(n for _, n, _ in found) == len(values)
    for v in values:
        assert any(re.match(e, v) for e, _, _ in found), v
    for e, n, share in found:
        assert sum(bool(re.match(e, v)) for v in values) >= n and abs(share - n / len(values)) < 1e-4


def test_expressions_of_known_formats(spark):
    rng = random.Random(1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phones = [f"({digits(3)}) {digits(3)}-{digits(4)}" for _ in range(400)]
    brands = [f"Brand#{digits(rng.randrange(1, 3))}" for _ in range(400)]
    codes = ["".join(rng.choice("ABCdef0123") for _ in range(8)) for _ in range(400)]
    df = spark.createDataFrame(list(zip(phones, brands, codes)), "phone string, brand string, code string").repartition(3)
    found = found_in(df, ["phone", "brand", "code"])
    assert [e for e, _, _ in found["phone"]] == [r"^(?s:\([0-9]{3}\) [0-9]{3}-[0-9]{4})\Z"]
    assert [e for e, _, _ in found["brand"]] == [r"^(?s:[A-Z][a-z]{4}#[0-9]{1,2})\Z"]
    assert [e for e, _, _ in found["code"]] == [r"^(?s:[A-Za-z0-9]{8})\Z"]  # hundreds of sequences are one
    for name, values in (("phone", phones), ("brand", brands), ("code", codes)):
        check(values, found[name])


def test_any_text(spark):
    rng = random.Random(2)
    values = ["", "\n", "a.b*c", "[x]{2}", "^$|\\", "é" * 3, "中文 12", "A" * 500, " ".join(["ab1-"] * 200), "x\r\n\r\ny", "9", "𝒳𝒳"]
    values += ["".join(rng.choice("aB7 .-_\n(é") for _ in range(rng.randrange(12))) for _ in range(150)]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None)], "t string, none string")
    found = found_in(df, ["t", "none"])
    assert set(found) == {"t"}
    check(values, found["t"])
    assert found_in(df.where("false"), ["t"]) == {}


def test_the_most_frequent_ones(spark):
    df = spark.createDataFrame([("x1",)] * 5000 + [("-",)] * 900 + [("1-1-1-1",)] * 30, "t string")
    rows = expressions(df, ["t"], 2).orderBy("rank").collect()
    assert [(r.expression, r.copies, r["rank"]) for r in rows] == [(r"^(?s:[a-z][0-9])\z", 5000, 1), (r"^(?s:-)\z", 900, 2)]
