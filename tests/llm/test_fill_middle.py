"""Fill-in-middle: equal to slices of the text, and an exact way back."""

import hashlib
import random

import pytest
import regex
from corpus_cases import EDGES, SF, needs_tables, prose
from pyspark.sql import functions as F

from millrace.llm import fill_middle
from millrace.llm.fill_middle import FillMiddle, Marks


def rows_of(df):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256) for r in df.collect()), key=str)


def wanted(rows, how):
    out = []
    for i, t in rows:
        w = fill_middle.brute_force(i, t, how)
        out.append((i, w["n"], w["form"], w["prefix_chars"], w["middle_chars"], w["output"], hashlib.sha256(w["output"].encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [FillMiddle(), FillMiddle(seed="x", cut_percent=100, spm_percent=50), FillMiddle(cut_percent=0)])
def test_equals_brute_force(documents, how):
    rng = random.Random(5)
    bits = ["<P>", "<", "P>", "<S", ">", "é", "日本", "🤪", "\n", "\r\n", " ", "word", "é", "\x00"]
    rows = EDGES + [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for k in range(100, 400)] + [(k, prose(k, 900)) for k in range(400, 420)]
    got = fill_middle.transform(documents(rows).repartition(5), how)
    assert rows_of(got) == wanted(rows, how)
    back = got.select("output", fill_middle.restored(F.col("output"), F.col("form"))["text"].alias("text"))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in rows)
    if how.cut_percent == 100:
        assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_shares(documents):
    """About a tenth plain, a fifth of the others suffix first."""
    forms = [r.form for r in fill_middle.transform(documents([(k, "some text") for k in range(4000)])).select("form").collect()]
    assert 0.08 < forms.count("plain") / 4000 < 0.12 and 0.17 < forms.count("spm") / (4000 - forms.count("plain")) < 0.23


def test_same_rows_at_any_partitioning(documents):
    rows = [(k % 50, prose(k % 50, k % 50 + 3)) for k in range(100)]
    assert rows_of(fill_middle.transform(documents(rows).repartition(1))) == rows_of(fill_middle.transform(documents(rows).repartition(7)))


def test_empty_table_and_clashing_names(documents, spark):
    assert fill_middle.transform(documents([])).collect() == []
    clash = spark.createDataFrame([(1, "abc", "f", "o")], "doc_id long, text string, form string, output string")
    assert fill_middle.transform(clash).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]


@pytest.mark.parametrize("unit", [fill_middle.CODE_POINTS, fill_middle.WORDS, fill_middle.LINES, fill_middle.GRAPHEMES, r"[a-z]+", r"(a)(b)?"])
def test_runs_of_units_are_single_units(unit):
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "ab", " ", "\n", "é", "é", "🤪", "\r\n"]) for _ in range(rng.randint(0, 900)))
        assert fill_middle.unit_ends(text, fill_middle.units(unit)).tolist() == [m.end() for m in regex.finditer(unit, text)]


def test_other_units_come_back(documents):
    rows = [(k, prose(k, 40) + "\n" + prose(k + 1, 30)) for k in range(60)]
    for unit in (fill_middle.WORDS, fill_middle.LINES, fill_middle.GRAPHEMES):
        got = fill_middle.transform(documents(rows), FillMiddle(unit=unit, cut_percent=100, marks=Marks("[p]", "[s]", "[m]")))
        back = fill_middle.restored(F.col("output"), F.col("form"), Marks("[p]", "[s]", "[m]"))["text"]
        assert sorted(r[0] for r in got.select(back).collect()) == sorted(t for _, t in rows)


def test_marks_and_units_that_cannot_work():
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "c", "d"), ("ab", "bc", "d"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            Marks(*bad)
    for unit in ("x*", "", "(?=a)"):
        with pytest.raises(ValueError):
            fill_middle.units(unit)


@needs_tables
def test_query_over_the_table(spark):
    from millrace.llm import queries
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_fill_middle(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w, r = fill_middle.brute_force(d.doc_id, d.text), got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (w["n"], w["form"], w["prefix_chars"], w["middle_chars"])
        assert r.output_sha256 == hashlib.sha256(w["output"].encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
