import pytest

from tallyforge.llm.mixing import _encoder, draw, fill_shares, mixing_plan, token_counts, DEFAULT_VOCABULARY


def test_water_filling():
    assert fill_shares({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 4, "b": 4}, 200) == {"a": 100, "b": 100}
    got = fill_shares({"a": 10, "b": 100, "c": 100}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 2, "b": 4, "c": 4}, 200)
    assert got == pytest.approx({"a": 20, "b": 90, "c": 90})
    chain = fill_shares({"a": 10, "b": 30, "c": 1000}, {"a": 0.4, "b": 0.2, "c": 0.4}, {"a": 1, "b": 1, "c": 9}, 150)
    assert chain == pytest.approx({"a": 10, "b": 30, "c": 110})
    assert fill_shares({"a": 10}, {"a": 1.0}, {"a": 2}, 100) == {"a": 20}
    assert fill_shares({}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 0}, 0) == {"a": 0.0, "b": 0.0}


DOCS = [(1, "one two three", " Web ", 1), (2, "one", "web", 1), (2, "one", "web", 1), (3, None, "web", 1), (4, "", "books", 1), (5, "a b c d e f", "BOOKS", 1), (6, "x <|endoftext|> y", None, 1), (7, "zzz", "other", 1), (None, "n", "other", 1)]


def test_counts(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string, tokens int")
    enc = _encoder(DEFAULT_VOCABULARY)
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in token_counts(df).collect()}
    assert got == {d: (s and s.strip().lower(), len(enc.encode_ordinary(t)) if t else 0) for d, t, s, _ in DOCS}


def test_plan_and_draw(spark):
    counts = spark.createDataFrame([(i, "a", 10) for i in range(1000)] + [(5000 + i, "b", 10) for i in range(200)] + [(9000, None, 5)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("A", 0.5, 3), ("b ", 0.4, 2), ("none", 0.1, 5), (None, 0.1, 1), ("A", 0.5, 3)], "source string, target_share double, max_repeats long")
    plan = mixing_plan(counts, targets)
    by = {r["source"].strip().lower(): r for r in plan.collect()}
    assert by["b"]["drawn_tokens"] == 4000 and by["b"]["falls_short"] and by["b"]["repeats"] == 2
    assert by["none"]["size"] == 0 and by["none"]["falls_short"]
    assert by["a"]["drawn_tokens"] == pytest.approx(8000) and not by["a"]["falls_short"]
    drawn = draw(counts, plan, 1).collect()
    assert sum(r["copies"] for r in drawn if r["source"] == "b") == 400
    assert sum(r["copies"] for r in drawn if r["source"] == "a") == pytest.approx(800, abs=60)
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, draw(counts.repartition(7), plan, 1).collect()))
    assert sorted(map(tuple, drawn)) != sorted(map(tuple, draw(counts, plan, 2).collect()))


def test_empty(spark):
    counts = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats long")
    row = mixing_plan(counts, targets).first()
    assert (row["size"], row["drawn_tokens"], row["falls_short"]) == (0, 0.0, False)
    assert mixing_plan(counts, targets.limit(0)).count() == 0


def test_a_source_clamped_above_its_share_does_not_fall_short(spark):
    # b must make up for a and is clamped, too, but above its own target
    counts = spark.createDataFrame([(1, "a", 10), (2, "b", 30), (3, "c", 110)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.19, 1), ("c", 0.41, 9)], "source string, target_share double, max_repeats long")
    got = {r["source"]: (r["drawn_tokens"], r["falls_short"]) for r in mixing_plan(counts, targets).collect()}
    assert got["a"] == (10.0, True) and got["b"] == (30.0, False) and not got["c"][1]
