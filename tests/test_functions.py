import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlight import fixed
from wardlight.functions import rules, scale, text, time


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_timestamps(make):
    df = make([("3/6/2010 1:41:56",), ("03/06/2010 01:41:56",), ("/21/2011 01:02:03",), ("2010-03-06 01:41:56",),
               ("2/30/2010 1:2:3",), (" 3/6/2010 1:41:56",), (None,)], "c string")
    when = dt.datetime(2010, 3, 6, 1, 41, 56)
    assert column(df, time.parse_timestamp("c")) == [when, when, None, None, None, None, None]


def test_after_hours_edges(make):
    df = make([(f"1/1/2010 {h}:59:00",) for h in (6, 7, 20, 21)], "c string")
    assert column(df.withColumn("t", time.parse_timestamp("c")), time.after_hours("t")) == [1, 0, 0, 1]


def test_lists_and_words(make):
    df = make([("a@x; ;b@x",), ("",), (None,), (" ; ",), ("one",)], "c string")
    assert column(df, text.list_size("c")) == [2, 0, 0, 0, 1]
    df = make([(" a  b\tc\n",), ("   ",), ("one",)], "c string")
    collapsed = df.select(text.collapse_blanks("c").alias("c"))
    assert column(collapsed, F.col("c")) == ["a b c", "", "one"]
    assert column(collapsed, text.word_count("c")) == [3, 0, 1]


def test_flags_numbers_releases(make):
    df = make([("TRUE",), ("false",), ("1",), ("",), (None,), (" True ",), ("yes",)], "c string")
    assert column(df, text.flag("c")) == [1, 0, 1, 0, 0, 1, 0]
    df = make([("4.2",), ("2",), ("2.0",), ("10",), ("5.20",), ("r6",)], "c string")
    assert column(df, text.release_label("c")) == ["4.2", "2", "2", "10", "5.2", "r6"]
    df = make([("1.5",), ("x",), (" 3 ",)], "c string")
    assert column(df, text.lenient_double("c")) == [1.5, None, 3.0]


HITS = [
    ("my Password here", 3), ("the api_key", 3), ("auth token", 3), ("social-security", 3), ("tax id", 3),
    ("routing number", 3), ("cvv", 3), ("a medical record", 3), ("salary", 2), ("quarterly results quarterly result", 2),
    ("strategic", 2), ("stratég strategî", 2), ("restructuring", 2), ("trade secret", 2), ("attorney-client", 2),
    ("non disclosure", 2), ("nda", 2), ("draft", 1), ("meeting notes", 1), ("project plan", 1), ("action.item", 1),
    ("confidential", 2),
]
MISSES = ["passwords", "draftee", "strateg", "xpassword", "api  key", "éndaé", "ipod", "contracts", "budgetary",
          "api\nkey", "", None]


@pytest.mark.parametrize("value,tier", HITS)
def test_keyword_hit(make, value, tier):
    assert column(make([(value,)], "c string"), rules.keyword_tier("c")) == [tier]


def test_keyword_misses(make):
    df = make([(m,) for m in MISSES], "c string")
    assert column(df, rules.keyword_tier("c")) == [0] * len(MISSES)


def test_every_term_of_every_rule(make):
    samples = []
    for tier, pattern in fixed.KEYWORD_RULES:
        for term in pattern.replace(r"\b", "").split("|"):
            samples.append((term.replace(".?", "-").replace(r"\w+", "ing"), tier))
    df = make(samples, "c string, want int").withColumn("got", rules.keyword_tier("c"))
    wrong = df.where("got < want").collect()
    assert wrong == []
    assert df.where("got > want").select("c").distinct().collect() == [("confidential",)]


def test_factored_pattern_agrees_with_plain_alternation(make):
    import itertools
    words = ["password", "passwordx", "x password", "api key", "api\nkey", "nda", "andas", "draft.", "_draft"]
    rows = [(f"{a} {b}",) for a, b in itertools.product(words, words)]
    df = make(rows, "c string")
    plain = F.lit(0)
    for tier in (1, 2, 3):
        for t, p in fixed.KEYWORD_RULES:
            if t == tier:
                plain = F.when(F.col("c").rlike("(?Ud)" + p), tier).otherwise(plain)
    assert df.where(rules.keyword_tier("c") != plain).count() == 0


def test_extensions(make):
    rows = [(f"x{e}", t) for e, t in fixed.EXTENSION_TIERS.items()]
    rows += [("x.EXE", 3), ("noext", 1), ("x.toolong", 1), ("x.abc", 1), (None, 1), ("a.exe.txt", 1)]
    df = make(rows, "f string, want int")
    assert df.where(rules.extension_tier("f") != F.col("want")).collect() == []


def test_signatures(make):
    rows = [(s + "-00 rest", t) for s, t in fixed.SIGNATURE_TIERS.items()]
    df = make(rows + [("4d-5a-90", 0), (None, 0), ("x 4D-5A", 0)], "c string, want int")
    assert df.where(rules.signature_tier("c") != F.col("want")).collect() == []


def test_scaling_expressions(make):
    df = make([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert column(df, scale.min_max("x", 1.0, 3.0)) == [0.0, 0.5, 1.0, None]
    assert column(df.limit(1), scale.min_max("x", 2.0, 2.0)) == [0.0]
    assert column(df, scale.severity("x", 2.0, 3.0)) == ["normal", "suspicious", "high", "undetermined"]
    assert column(df, scale.at_least("x", 2.0)) == [0, 1, 1, 0]
    got = column(make([(0.002034,), (0.003932,), (0.0,), (1.0,)], "x double"), scale.error_score("x", 0.002034, 0.003932))
    assert got[0] == pytest.approx(0.3489, abs=1e-4) and got[2:] == [0.0, 1.0]


def test_lenient_double_takes_decimals_only(make):
    rows = [("1.5", 1.5), (" -2e3 ", -2000.0), (".5", 0.5), ("7.", 7.0), ("1d", None), ("2f", None), ("0x1p3", None), ("", None), (None, None), ("1,5", None)]
    df = make(rows, "t string, want double")
    assert df.where(~text.lenient_double("t").eqNullSafe(F.col("want"))).collect() == []


def test_first_letter_lookahead_keeps_every_rule(spark):
    """Words found by the joined pattern are those of the plain rules, with letters that may be absent."""
    import re

    odd = ((3, r"\bab?c\b|\bxyz\w+\b"), (1, r"\bq*rs\b|\bno.?go\b"))
    texts = ["ac", "abc", "abbc", "xyz", "xyzz", "rs", "no-go", "nogo", "noo", "a c", "unabc", "passwords", "a password.", None]
    for case in (odd, rules.fixed.KEYWORD_RULES):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.keyword_tier("t", case).alias("x")).collect()
        for row in got:
            want = max([tier for tier, p in case if row["t"] and re.search(p, row["t"])], default=0)
            assert row["x"] == want, row
