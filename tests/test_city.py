"""The miniature city gives its known numbers."""

import pytest
from pyspark.sql import functions as F

from streetworth.plans import city as Y
from streetworth.plans.ledgers import scenario_ledger


def test_known_numbers(spark):
    c = Y.city(spark)
    assert {r.edge: r.lts for r in Y.with_stress(c["edges"]).collect()} == {"ab": 4, "bc": 4, "be": 4, "de": 1, "ef": 1, "ad": 1, "cf": 1}
    units = c["units"].withColumn("status", F.lit("assigned"))
    sums = units.agg(F.sum("eligible").alias("e"), F.sum("observed").alias("o")).first()
    assert (sums.e, sums.o) == (1800, 51)
    ledger = scenario_ledger(units.select("od", "eligible", "observed", "distance_km", "gradient", "status"), 0.08, sums.e, sums.o)
    users = ledger.where("scenario = 'target'").select("od", "users")
    assert users.agg(F.sum("users")).first()[0] == pytest.approx(144.0) and ledger.count() == 15
    demand = users.join(c["units"].select("od", "origin", "destination"), "od")
    share = lambda edges: Y.connectivity(edges, demand).first().share
    main = c["candidates"].where("candidate = 'main_street'")
    assert share(c["edges"]) == pytest.approx(0.284792, abs=1e-6)
    assert share(Y.treated(c["edges"], main)) == pytest.approx(0.850931, abs=1e-6)
    assert share(Y.treated(c["edges"], c["candidates"])) == pytest.approx(1.0)
