"""Plan assertions used by tests and the bench: read the physical plan text."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def count_ops(df: DataFrame, op: str) -> int:
    """Number of physical operators whose name starts with ``op`` in the plan tree
    (e.g. 'Exchange', 'BroadcastHashJoin', 'Window')."""
    tree = plan_text(df).split("\n\n\n(")[0]
    return len(re.findall(r"[-+:* ]" + re.escape(op) + r"\b", tree))
