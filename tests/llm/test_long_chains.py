import random

import pytest
from pyspark.sql import functions as F

from driftwood.llm import chat_format


def _plain(deps: dict[int, list[int]]) -> dict[int, tuple]:
    """``ready, level`` (None: cyclic) of calls that are named by their seq."""
    def reach(edges, x):
        seen, todo = set(), list(edges[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += edges[y]
        return seen

    deps = {x: [y for y in ys if y in deps] for x, ys in deps.items()}
    ready = {x: max([x, *reach(deps, x)]) for x in deps}
    tied = {x: [y for y in ys if ready[x] == ready[y]] for x, ys in deps.items()}
    circles = {x for x in deps if x in reach(tied, x)}
    level = {}
    for x in sorted(deps, key=lambda x: len(reach(tied, x))):
        level[x] = None if x in circles or reach(tied, x) & circles else max((1 + level[y] for y in tied[x]), default=0)
    return {x: (ready[x], level[x]) for x in deps}


@pytest.mark.parametrize("most", [1, 3])
def test_order_of_random_graphs(spark, most):
    rng = random.Random(most)
    graphs = {str(c): {x: [rng.choice([*range(25), 99]) for _ in range(rng.randint(0, most))] for x in rng.sample(range(25), 20)} for c in range(12)}
    rows = [(c, x, str(x), [str(y) for y in ys]) for c, deps in graphs.items() for x, ys in deps.items()]
    got = chat_format.order(spark.createDataFrame(rows, "conv_id string, seq long, call_id string, depends_on array<string>")).collect()
    want = {(c, str(x)): v for c, deps in graphs.items() for x, v in _plain(deps).items()}
    assert {(r.conv_id, r.call_id): (r.ready, r.level) for r in got} == want
    assert all(r.cyclic == (r.level is None) for r in got)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """5000 calls, each on the next: steps double, so some 13 rounds follow the chain."""
    n, tables, written = 5000, [], chat_format.written

    def counted(df):
        tables.append(1)
        assert len(tables) < 100
        return written(df)

    monkeypatch.setattr(chat_format, "written", counted)
    calls = spark.range(n).select(F.lit("c").alias("conv_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("call_id"), F.array((F.col("id") + 1).cast("string")).alias("depends_on"))
    got = chat_format.order(calls)
    assert got.where(f"ready = {n - 1} and level = {n - 1} - cast(call_id as int) and not cyclic").count() == n
