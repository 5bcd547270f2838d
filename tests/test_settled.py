"""Flows on a heavily loaded network, where cheapest paths take more links than the SQL relaxes."""

from netloom.plans import network, registry
from tests.compare import connect, rows

registry.load_all()


def test_msa_takes_paths_of_any_length(spark, monkeypatch):
    """At sf0.1 second-round times differ by orders of magnitude, and labels settle in the eleventh round; the SQL stops after eight."""
    sf, given = "/root/testdata/sf0.1", registry.ORACLES["msa_2_iterations"]
    stopped = network.labels_sql("q", "e2", "t")
    assert stopped in given
    monkeypatch.setattr(network, "ROUNDS", 16)
    settled = given.replace(stopped, network.labels_sql("q", "e2", "t"))
    want = rows(connect(sf).sql(settled).fetchdf())
    assert rows(registry.QUERIES["msa_2_iterations"](spark, sf).toPandas()) == want != rows(connect(sf).sql(given).fetchdf())
