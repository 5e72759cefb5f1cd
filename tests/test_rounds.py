from weftgraph.operators import matching


def test_greedy_assignment_has_no_last_round(spark, monkeypatch):
    # A bound on the rounds, made small: each pair of this chain waits for the one before.
    monkeypatch.setattr(matching, "range", lambda n: [0], raising=False)
    pairs = [("r0", "c0", 0.99), ("r0", "c1", 0.98), ("r1", "c1", 0.97), ("r1", "c2", 0.96), ("r2", "c2", 0.95)]
    found = matching.greedy_assignment(spark.createDataFrame(pairs, "ref_id string, cand_id string, score double"))
    assert {(r.ref_id, r.cand_id) for r in found.collect()} == {("r0", "c0"), ("r1", "c1"), ("r2", "c2")}
