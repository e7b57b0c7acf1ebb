"""A small constant model, so that scoring can be checked against plain SQL."""

from __future__ import annotations

from types import SimpleNamespace

from tidewatch import constants as K
from tidewatch.operators.forest import Model, Scaler, average_path

MEAN = [57000.0, 1500.0, 90000.0, 7500.0, 3.0, 0.5, 3.0, 1.5, 4.0, 11.5, 0.5]
STD = [4700.0, 2500.0, 300000.0, 4300.0, 8.0, 1.0, 3.0, 1.5, 5.0, 7.0, 0.5]
SAMPLE = 256
OFFSET = -0.5

# (tree, node, feature, cut, left, right, depth, n)
NODES = [
    (0, 0, 2, 0.25, 1, 2, 0, 256), (0, 1, -1, 0.0, -1, -1, 1, 220),
    (0, 2, 8, 1.5, 3, 4, 1, 36), (0, 3, -1, 0.0, -1, -1, 2, 34), (0, 4, -1, 0.0, -1, -1, 2, 2),
    (1, 0, 1, 1.0, 1, 2, 0, 256), (1, 1, 4, -0.37, 3, 4, 1, 246), (1, 2, -1, 0.0, -1, -1, 1, 10),
    (1, 3, -1, 0.0, -1, -1, 2, 6), (1, 4, -1, 0.0, -1, -1, 2, 240),
    (2, 0, 7, 0.5, 1, 2, 0, 256), (2, 1, -1, 0.0, -1, -1, 1, 252), (2, 2, 6, 1.2, 3, 4, 1, 4),
    (2, 3, -1, 0.0, -1, -1, 2, 3), (2, 4, -1, 0.0, -1, -1, 2, 1),
]
NAMES = ("tree_id", "node_id", "feature_idx", "threshold", "left", "right", "depth", "n")


class _Row(SimpleNamespace):
    def __getitem__(self, name):
        return getattr(self, name)


def forest() -> list:
    return [_Row(**dict(zip(NAMES, node))) for node in NODES]


def model() -> Model:
    return Model(Scaler(list(K.CORE_FEATURES), MEAN, STD), forest(), SAMPLE, OFFSET, 0.1, 3, SAMPLE)


def _scaled(feature: int) -> str:
    name = K.CORE_FEATURES[feature]
    return f"((CAST({name} AS DOUBLE) - {MEAN[feature]!r}e0) / {STD[feature]!r}e0)"


def _walk(tree: int, node: int) -> str:
    _, _, feature, cut, left, right, depth, n = next(r for r in NODES if r[0] == tree and r[1] == node)
    if left < 0:
        return f"CAST('{depth + average_path(n)!r}' AS DOUBLE)"
    return (f"(CASE WHEN {_scaled(feature)} <= {cut!r}e0 THEN {_walk(tree, left)} "
            f"ELSE {_walk(tree, right)} END)")


MEAN_PATH_SQL = f"((({_walk(0, 0)} + {_walk(1, 0)}) + {_walk(2, 0)}) / 3)"
RAW_SCORE_SQL = f"(-pow(CAST(2 AS DOUBLE), -({MEAN_PATH_SQL}) / CAST('{average_path(SAMPLE)!r}' AS DOUBLE)))"
