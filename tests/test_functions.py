import math

import pytest
from pyspark.sql import functions as F

from sidlens.functions import sid as S
from sidlens.functions import stats


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("sid", "valid"),
    [("<a_1><b_2><c_3>", True), ("<c_1><c_2><a_3>", True), ("<a_1><b_2>", False), ("<a_1><b_2><c_3>\n", False), ("<a_1><b_2><c_3>x", False), ("x/y/z", True), ("x//z", False), ("x/y", False), ("", False), (None, False), ("<a>/b/c", False)],
)
def test_validity(spark, sid, valid):
    assert one(spark, S.is_valid(F.col("s")), s=sid) is valid


def test_text(spark):
    assert one(spark, S.normalize(F.col("s")), s='  " <a_1> "\n') == "<a_1>"
    assert one(spark, S.product_key(F.col("s")), s="  Red\t  WIDGET\x01") == "red widget"
    assert one(spark, S.parse_ids(F.col("s")), s=None) == []
    assert one(spark, S.parse_ids(F.col("s")), s="[12, 7, x3]") == [12, 7, 3]
    assert one(spark, S.parse_id_list(F.col("s")), s="['12', \"7\", ]") == ["12", "7"]
    assert one(spark, S.parse_sid_list(F.col("s")), s="['x/y/z', '<a_1><b_2><c_3>']") == ["x/y/z", "<a_1><b_2><c_3>"]
    assert one(spark, S.parse_sid_list(F.col("s")), s="<a_1><b_2><c_3><a_4>") == ["<a_1><b_2><c_3>", "<a_4>"]
    assert one(spark, S.parse_sid_list(F.col("s")), s=None) == []
    assert one(spark, S.parse_history(F.col("s")), s="[1, ") == []
    assert one(spark, S.parse_history(F.col("s")), s="('a', 'b')") == ["a", "b"]
    assert one(spark, S.target_of(F.col("s")), s='["q"]') == "q"
    assert one(spark, S.target_of(F.col("s")), s="[]") == ""
    assert one(spark, S.target_of(F.col("s")), s="q") == "q"
    assert one(spark, S.code(F.col("s"), "a"), s="<a_1><a_5><c_2>") == 5
    assert sorted(one(spark, S.title_tokens(F.col("s")), s="An 80mm USB-cable usb")) == ["80mm", "cable", "usb"]


def test_numbers(spark):
    assert one(spark, stats.u32(42, 1, 7)) == 3254254507
    assert one(spark, stats.discount(F.lit(0))) == pytest.approx(1)
    assert one(spark, stats.discount(F.lit(2))) == pytest.approx(0.5)
    assert one(spark, stats.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    for t, df in ((2.892, 2), (-0.964, 2), (1.5, 1), (1.96, 9)):
        assert one(spark, stats.t_two_sided_p_column(F.lit(t), F.lit(df))) == pytest.approx(stats.t_two_sided_p(t, df), abs=1e-6)
    assert round(stats.t_two_sided_p(2.892, 2), 4) == 0.1017
    assert math.isclose(stats.t_two_sided_p(0, 1), 1)
