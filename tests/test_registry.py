import pytest

from boxkit import registry


def test_operators_are_created_by_name_and_settings(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, "a"), (1, 1, 2, 0.0, 0.0, 5.0, 10.0, 0.8, "a")], "seq_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls string")
    match = registry.create("matching.match_greedy", least=0.4)
    assert {(r.c_id, r.t_id) for r in match(df, df).collect()} == {(1, 1), (2, 2)}
    with pytest.raises(TypeError):
        registry.create("matching.match_greedy", most=1)
    with pytest.raises(KeyError):
        registry.create("matching.nothing")
    registry.operator("mine")(lambda d, n=1: d.limit(n))
    assert registry.create("mine", n=2)(df).count() == 2
