"""Each registered query of the engine against its SQL."""

import pytest

from maskwell import queries as engine, scenarios  # noqa: F401


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(name, spark, sf, duck, same):
    got = engine.QUERIES[name](spark, sf).toPandas()
    if name in engine.ORACLES:
        same(got, duck(engine.ORACLES[name]))
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "masked_text", "n_spans", "n_findings", "blocked"] and df.count() > 0
    assert set(engine.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
