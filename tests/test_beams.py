import pytest

from sidlens.operators import metrics
from sidlens.plans.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_beams_made_at_once_equal_those_made_apart(spark):
    at_once, apart = Fixtures(spark, SF), Fixtures(spark, SF)
    at_once.beams(42, 43)
    for seed in (42, 43):
        for arm in ("catalog", "catalog_b"):
            one, other = (sorted(map(tuple, f.beam(seed, getattr(f, arm)()).collect())) for f in (at_once, apart))
            assert one == other and one


def test_strict_hits_look_up_no_candidates(spark):
    fx = Fixtures(spark, SF)
    b, c = fx.beam(), fx.catalog()
    strict = metrics.hit_columns(b, c, protocols=["strict"])
    assert "posexplode" not in strict._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, strict.collect())) == sorted(map(tuple, metrics.hit_columns(b, c).select("row_id", "strict").collect()))
