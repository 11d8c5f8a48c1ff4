"""Named queries of the segmentation engine and their SQL."""

from __future__ import annotations


def queries() -> dict:
    from . import queries as q

    return dict(q.QUERIES)


def oracles() -> dict[str, str]:
    from . import oracles as o

    return dict(o.ORACLES)
