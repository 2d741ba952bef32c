"""Packed values against literal cases and a character scanner."""

import pytest

from loomql.operators.packed_values import unpack


def run(spark, raws):
    rows = [("t", "f", str(i), r) for i, r in enumerate(raws)]
    df = spark.createDataFrame(rows, "tbl string, fld string, row_key string, raw string")
    out = {}
    for r in unpack(df).collect():
        out.setdefault(int(r.row_key), []).append((r.pos, r.val))
    return {k: [v for _, v in sorted(x)] for k, x in out.items()}


CASES = [
    ("Drama, Crime", ["Drama", "Crime"]),
    ("Drama| Crime ;War", ["Drama", "Crime", "War"]),
    ('"Tusk, Ann";Crime', ["Tusk, Ann", "Crime"]),
    ('"The ""Big"" One"|War', ['The "Big" One', "War"]),
    ("['It' , \"O'Neil, Ed\"]", ["It", "O'Neil, Ed"]),
    ("“A/B”/War", ["A/B", "War"]),
    ("Drama\tWar\n", ["Drama", "War"]),
    (",,Drama,, War,", ["Drama", "War"]),
    ("  War  ", ["War"]),
    ("Rock & Roll·Film-Noir", ["Rock & Roll", "Film-Noir"]),
    ("War, War", ["War", "War"]),
    ('" Drama"', ["Drama"]),
    ("\\N", None),
    ("N/A", None),
    ("", None),
    ("  ", None),
    (None, None),
    (",;|", None),
]


def test_cases(spark):
    got = run(spark, [c for c, _ in CASES])
    for i, (raw, want) in enumerate(CASES):
        assert got.get(i) == want, raw


def test_the_column_decides_what_splits(spark):
    """A value known from quoted fields keeps its delimiter where it is written without quotes."""
    known = ['"Mora / Tisk", Crime', '"Mora / Tisk"|War', 'War,"Mora / Tisk"', '"Velt; Anders"/War'] * 6
    raws = known + ["Mora / Tisk, War", "Velt; Anders", "Drama / War", "Crime; War"] + ["Drama/Crime", "Drama, War", "Crime|War"] * 30
    got = run(spark, raws)
    at = len(known)
    assert [got[at + i] for i in range(4)] == [["Mora / Tisk", "War"], ["Velt; Anders"], ["Drama", "War"], ["Crime", "War"]]
    # without the quoted fields the same strings split
    got = run(spark, raws[at:])
    assert got[0] == ["Mora", "Tisk", "War"] and got[1] == ["Velt", "Anders"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "tbl string, fld string, row_key string, raw string, extra int")
    assert unpack(df).count() == 0


def test_repeated_rows_and_long_field(spark):
    long = ",".join(f"v{i % 50}" for i in range(5000))
    got = run(spark, ["Drama", "Drama", long])
    assert got[0] == got[1] == ["Drama"]
    assert got[2] == long.split(",")


def test_hot_string_is_split(spark):
    df = spark.createDataFrame([("t", "f", str(i), "Drama,War" if i % 3 else f"V{i}|W{i}") for i in range(900)], "tbl string, fld string, row_key string, raw string")
    assert unpack(df).count() == 1800


@pytest.mark.parametrize("bad", ['"open, never closed', "it's, a 'b' c"])
def test_stray_quotes_do_not_crash(spark, bad):
    assert 0 in run(spark, [bad])
