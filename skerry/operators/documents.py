"""Snapshot documents: frozen evidence as canonical JSON, named by its hash, and plans over it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(*fields: Column) -> Column:
    """One JSON text for equal values: fields in the given order, nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def snapshots(members: DataFrame, subject: str, order: list[str], evidence: list[str]) -> DataFrame:
    """subject, members, document and sha256: each subject's rows, ordered, as one document.

    The hash excludes nothing but is taken of the evidence alone, so that freezing the same
    evidence twice gives one identity.
    """
    row = F.struct(*order, *[c for c in evidence if c not in order])
    grouped = members.groupBy(subject).agg(F.array_sort(F.collect_list(row)).alias("members"))
    document = canonical(F.lit(1).alias("v"), F.col(subject).alias("subject"), F.col("members"))
    return grouped.select(subject, F.size("members").cast("long").alias("members"), document.alias("document")).withColumn("sha256", F.sha2(F.col("document").cast("binary"), 256))


def appended(new: DataFrame, old: DataFrame) -> DataFrame:
    """The snapshots of `new` whose hash `old` doesn't have."""
    return new.join(old.select("sha256"), "sha256", "left_anti")


def verified(stored: DataFrame) -> DataFrame:
    """Adds `intact`: whether the document still has the hash it was stored under."""
    return stored.withColumn("intact", F.sha2(F.col("document").cast("binary"), 256) == F.col("sha256"))


def anchored_phases(rows: DataFrame, by: str, order: str, vector: str, threshold: float) -> DataFrame:
    """by, order, phase: a new phase when a row is less than `threshold` similar to its phase's first known vector.

    What a row is compared with depends on all decisions before it, so one `by` is one task's work.
    """
    import numpy as np

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        phase, anchor, out = 0, None, []
        for v in group[vector]:
            if v is not None:
                v = np.asarray(v, float)
                v = v / (np.linalg.norm(v) or 1.0)
                if anchor is None:
                    anchor = v
                elif float(anchor @ v) < threshold:
                    phase, anchor = phase + 1, v
            out.append(phase)
        return pd.DataFrame({by: group[by], order: group[order], "phase": out})

    kinds = dict(rows.dtypes)
    return rows.select(by, order, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, phase int")


def family_phases(rows: DataFrame, by: str, order: str, vector: str, threshold: float) -> DataFrame:
    """by, order, family: rows whose known vectors are linked by `threshold` or more, whatever lies between them.

    A family is named by its first row; a row without a vector is a family of its own. One `by`
    is one task's work, in blocks of its similarity matrix.
    """
    import numpy as np

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable").reset_index(drop=True)
        up = list(range(len(group)))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        known = [i for i, v in enumerate(group[vector]) if v is not None]
        if known:
            m = np.array([np.asarray(group[vector][i], float) for i in known])
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, n, out=m.copy(), where=n > 0)
            for k in range(0, len(known), 512):
                for x, y in np.argwhere(m[k : k + 512] @ m.T >= threshold).tolist():
                    a, b = root(known[k + x]), root(known[y])
                    up[max(a, b)] = min(a, b)
        names = [group[order][root(i)] for i in range(len(group))]
        return pd.DataFrame({by: group[by], order: group[order], "family": names})

    kinds = dict(rows.dtypes)
    return rows.select(by, order, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, family {kinds[order]}")


def unresolved(references: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """References that name nothing known."""
    return references.join(known.select(on), on, "left_anti")
