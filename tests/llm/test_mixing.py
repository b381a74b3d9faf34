import math

import pytest
from pyspark.sql import functions as F

from papyrine.llm import mixing


def data(spark):
    rows = [(i, "w " * (20 + i % 30), "big" if i % 3 else ("mid" if i % 2 else "s%d" % (i % 5))) for i in range(900)]
    rows += [(2000, None, "big"), (2001, "", None), (2002, "a b c", None), (None, "x y", "mid"), (7, rows[7][1], rows[7][2])]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, full int")


def total(df):
    return {r[0]: r[1] for r in df.groupBy(F.coalesce("source", F.lit(""))).agg(F.sum(mixing.tokens(F.col("text")))).collect()}


def test_weights_meet_the_entropy(spark):
    docs = data(spark)
    made, cuts, a = mixing.plan(docs, entropy=0.8, passes=1e9)
    own = total(docs)
    z = sum((n / sum(own.values())) ** a for n in own.values())
    w = {s: (n / sum(own.values())) ** a / z for s, n in own.items()}
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(0.8 * math.log(len(w)), abs=1e-3)
    got = {r._source: r.weight for r in made.collect()}
    assert got == pytest.approx(w)
    out = mixing.mix(docs, entropy=0.8, passes=1e9)
    assert out.columns == [*docs.columns, "copies", "weight"]
    spent = {r[0]: r[1] for r in out.groupBy(F.coalesce("source", F.lit(""))).agg(F.sum(mixing.tokens(F.col("text")) * F.col("copies"))).collect()}
    for s in own:  # each source's budget is used up to one document
        assert 0 <= spent[s] - w[s] * sum(own.values()) < 50 or spent[s] == pytest.approx(w[s] * sum(own.values())), s
    kept = {}
    for r in out.collect():
        kept.setdefault(r.source or "", set()).add(r.copies)
    assert all(max(x) - min(x) <= 1 for x in kept.values())


def test_limit_of_passes(spark):
    docs = data(spark)
    made, _, a = mixing.plan(docs, entropy=1.0, passes=2.0)
    assert made.agg(F.max("passes")).first()[0] <= 2.0 + 1e-6
    assert 0 < a < 1


def test_whole(spark):
    docs = data(spark)
    out = mixing.mix(docs, passes=3.0, whole=True)
    assert out.count() == docs.count()
    assert {r.copies for r in out.select("copies").distinct().collect()} >= {1, 3}
    assert out.agg(F.max("copies")).first()[0] <= 3


def test_twice_the_same(spark):
    docs = data(spark)
    one, two = ({(r.doc_id, r.copies) for r in mixing.mix(x).collect()} for x in (docs, docs.repartition(7)))
    assert one == two


def test_degenerate(spark):
    docs = data(spark)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("source = 'big'")).count() == docs.where("source = 'big'").count()
    assert mixing.mix(docs.where("text is null")).count() == 1
