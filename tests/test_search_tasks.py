"""The task that keeps a candidate's best users, run here over several batches."""

import numpy as np
import pandas as pd

from wardlight.operators import search
from wardlight.operators.risk import NORMS
from wardlight.plans import registry


class Users:
    """Stands for a table: keeps the function that its tasks would run."""

    class schema:
        def __class_getitem__(cls, name):
            return type("Field", (), {"dataType": type("Type", (), {"simpleString": staticmethod(lambda: "long")})})

    def select(self, *names):
        return self

    def mapInPandas(self, task, schema):
        self.task = task
        raise StopIteration


def test_best_users_of_several_batches(monkeypatch):
    """Ties within and between batches go to the smaller user; a batch makes one frame, not one a candidate."""
    rnd = np.random.default_rng(4)
    n, k = 900, 50
    table = pd.DataFrame(rnd.integers(0, 4, (n, len(NORMS))) / 4.0, columns=list(NORMS))
    table.insert(0, "user", rnd.permutation(n))
    table.insert(1, "is_insider", (table["user"] % 7 == 0).astype(np.int32))
    candidates = [(c, list(rnd.integers(1, 4, 2 * search.N) / 4.0)) for c in range(12)]
    users = Users()
    try:
        search.best_users(users, candidates, k)
    except StopIteration:
        pass
    made, assign = [], pd.DataFrame.assign
    monkeypatch.setattr(pd.DataFrame, "assign", lambda self, **kw: made.append(1) or assign(self, **kw))
    sizes = [30, 370, 10, 490]
    got = pd.concat(users.task(iter(np.split(table, np.cumsum(sizes)[:-1]))))
    assert len(made) <= len(sizes)
    for c, genes in candidates:
        raw = np.clip(genes[:search.N], search._P["weight_low"], search._P["weight_high"])
        score = sum((table[s] * w for s, w in zip(list(NORMS)[1:], (raw / raw.sum())[1:])), table[list(NORMS)[0]] * (raw / raw.sum())[0])
        want = table.assign(score=score).sort_values(["score", "user"], ascending=[False, True]).head(k)
        mine = got[got["cand"] == c]
        assert list(mine["user"]) == list(want["user"]) and np.allclose(mine["score"], want["score"])
        assert list(mine["is_insider"]) == list(want["is_insider"])
        limits = np.clip(genes[search.N:], search._P["threshold_low"], search._P["threshold_high"])
        assert list(mine["flagged"]) == list((want[list(NORMS)].to_numpy() >= limits).any(axis=1).astype(int))


def test_searched_users_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    table = spark.range(200).selectExpr("id as user", "1 as is_insider", *[f"rand() as {s}" for s in NORMS]).coalesce(1)
    monkeypatch.setattr(registry.roles, "risk_table", lambda *_: table)
    assert len(registry.search_users(spark, "").inputFiles()) > 1
