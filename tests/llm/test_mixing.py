"""One schedule for any number of sources."""

import heapq

import numpy as np
import pytest
from archlake.llm import mixing


def earliest_deadlines(weights):
    """The slots of each source, from one queue of released blocks; ties to the heavier source, then by name."""
    period, order = sum(weights.values()), sorted(weights, key=lambda s: (-weights[s], s))
    waiting, queue, slots = sorted((0, k) for k in range(len(order))), [], {s: [] for s in order}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            u = weights[order[k]]
            heapq.heappush(queue, (-(-(len(slots[order[k]]) + 1) * period // u), k))
        due, k = heapq.heappop(queue)
        assert t < due
        mine = slots[order[k]]
        mine.append(t)
        if len(mine) < weights[order[k]]:
            heapq.heappush(waiting, (len(mine) * period // weights[order[k]], k))
    return slots


@pytest.mark.parametrize(("n", "stretch"), [(1, mixing.STRETCH), (7, 100), (1500, mixing.STRETCH), (1500, 3000)])
def test_one_law_for_any_number_of_sources(spark, n, stretch):
    """Beyond 1,024 sources, too, each is less than one block off at any slot, and gets the slots of one queue of deadlines."""
    rng = np.random.default_rng(n)
    weights = spark.createDataFrame([(f"s{k}", float(w)) for k, w in enumerate(rng.pareto(1.1, n) + 0.01)], "source string, weight double")
    rows = mixing.period_schedule(mixing.whole_weights(weights, 5000 + 8 * n), stretch).collect()
    period = rows[0].period
    assert len(rows) == n and sorted(t for r in rows for t in r.slots) == list(range(period))
    at = np.arange(period + 1)
    for r in rows:
        assert len(r.slots) == r.units and np.abs(np.searchsorted(r.slots, at) - r.units * at / period).max() < 1
    assert {r.source: r.slots for r in rows} == earliest_deadlines({r.source: r.units for r in rows})
