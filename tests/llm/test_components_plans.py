"""Rounds of connected components go by small plans."""

from grouploom.llm import components


def test_no_plan_of_a_round_holds_many_exchanges(spark, monkeypatch):
    counts, save = [], components.saved

    def counted(df, name):
        counts.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return save(df, name)

    monkeypatch.setattr(components, "saved", counted)
    links = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(20, k) for k in range(30, 45)], "u long, v long")
    got = {r.node: r.root for r in components.roots(links).collect()}
    assert got == {k: 0 for k in range(13)} | {20: 20} | {k: 20 for k in range(30, 45)}
    assert max(counts) <= 8
