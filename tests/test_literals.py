"""The literal reader against Python's own."""

import ast
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perkframe.functions import parse_dict, parse_list

text = st.text(st.one_of(st.sampled_from("'\"\\\n\t\x07\x0b\x01, ()[]{}NoneTrueFalse+._09uU"),
                         st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), max_size=30)
items = st.lists(st.one_of(st.none(), text, text), max_size=6)


def read(spark, literals, parse):
    rows = [(i, x) for i, x in enumerate(literals)]
    got = spark.createDataFrame(rows, "i INT, x STRING").select("i", parse("x").alias("y")).collect()
    return [r["y"] for r in sorted(got, key=lambda r: r["i"])]


def escaped(value) -> str:
    """Another literal of the same value: every character as an escape."""
    out = []
    for x in value:
        out.append("None" if x is None else "u'" + "".join(
            f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04x}" if ord(c) < 65536 else f"\\U{ord(c):08x}"
            for c in x) + "'")
    return "(" + ", ".join(out) + ("," if out else "") + ")"


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(items, min_size=30, max_size=60))
def test_lists_equal_python(spark, values):
    forms = (repr, lambda v: repr(tuple(v)), escaped, ascii)
    literals = [form(v) for form in forms for v in values]
    assert [list(ast.literal_eval(x)) for x in literals] == values * len(forms)
    assert read(spark, literals, parse_list) == values * len(forms)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.tuples(st.one_of(st.none(), st.floats(-1e6, 1e6)), st.one_of(st.none(), text),
                                 st.one_of(st.none(), st.integers(-10**6, 10**6))), min_size=20, max_size=40))
def test_dicts_equal_python(spark, values):
    literals = [repr({"amount": a, "offer_id": o, "reward": r}) for a, o, r in values]
    got = read(spark, literals, parse_dict)
    assert [(g["amount"], g["offer_id"], g["reward"]) for g in got] == values


def test_forms_of_numbers_strings_and_commas(spark):
    literals = ["{'amount': 1_000.5, 'reward': +3,}", "{'amount': .5, 'offer_id': 'a\\101\\'\"'}", "{'amount': 5.}",
                "{'amount': None, 'reward': 2 , }", "{'offer_id': '(None)', 'reward': None}", "{'amount': 1e3}",
                "{'offer_id': 'C:\\\\dir'}"]
    got = read(spark, literals, parse_dict)
    want = [ast.literal_eval(x) for x in literals]
    assert [(g["amount"], g["offer_id"], g["reward"]) for g in got] == [
        (w.get("amount"), w.get("offer_id"), w.get("reward")) for w in want]
    assert read(spark, ["[1, (2, None), 'x']", "not a list (", "", None, "['a', None"], parse_list) == [
        ["1", "[2,null]", "x"], None, None, None, None]


def test_a_megabyte_is_read_in_linear_time(spark):
    def took(n):
        values = [["it's \"quoted\" \\ (None)", None] * n, ["x" * (20 * n), None], ["\\'" * (5 * n), None]]
        literals = [repr(tuple(v)) for v in values]
        t = time.perf_counter()
        assert read(spark, literals, parse_list) == values
        return time.perf_counter() - t
    took(10)
    small, large = took(5_000), took(50_000)  # the large ones are of 1 MB and more
    assert large < 30 * small + 5


def test_the_plan_has_no_look_ahead_over_the_text():
    from perkframe.functions import literals
    assert "(?=" not in literals._PIECES + literals._ESCAPES + literals._PYTHON_ONLY


def test_pieces_are_only_cut_where_needed(spark):
    df = spark.createDataFrame([("{'amount': 4.5}",)], "x STRING")
    assert df.select(F.col("x").rlike(__import__("perkframe.functions.literals", fromlist=["x"])._PYTHON_ONLY)
                     .alias("y")).first()["y"] is False
