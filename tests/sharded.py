"""The one-record-after-another sweep in shards, in Python: a cross-check of the distributed sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenospark.functions.rand import np_uniform
from phenospark.operators.counts import Priors, attach_counts, live_totals, new_weight
from phenospark.operators.vectors import block
from phenospark.schema import AXES


def sharded_sweep(
    assigned: DataFrame, counts: DataFrame, dims: dict[str, int], priors: Priors, seed: int = 1, sweep: int = 1,
    shards: int = 1,
) -> DataFrame:
    """Each shard visits its own records one after the other, and sees its own earlier moves but
    the other shards' counts as of the start: (rec_id, k).

    One shard is the plain sequential rule. This is for cross-checks: it loops over records in
    Python, so use the blocked sampler for large data.
    """
    totals = live_totals(counts)
    live, size = [k for k, _ in totals], len(totals)
    fresh, birth = max(live) + 1, new_weight(dims, priors)
    gammas = {a: (priors.gamma[a], dims[a] * priors.gamma[a]) for a in ("patient", "med", "diag")}
    shard = F.pmod("rec_id", F.lit(shards)).cast("int")
    rows = attach_counts(assigned, counts, dims, live).select(
        "rec_id", "k", *AXES, *[f"_{a}" for a in AXES], shard.alias("_shard"))
    rows = rows.repartition(shards, "_shard").sortWithinPartitions("_shard", "rec_id")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(live)}
        states: dict[int, tuple[np.ndarray, dict]] = {}
        for batch in batches:
            shard_of, rec_id, old = (batch.column(c).to_numpy() for c in ("_shard", "rec_id", "k"))
            idx = {a: batch.column(a).to_numpy() for a in AXES}
            start = {a: block(batch.column(f"_{a}")) for a in AXES}
            draws = np_uniform(rec_id, seed, sweep)
            out = np.empty(batch.num_rows, dtype=np.int64)
            for i in range(batch.num_rows):
                s = int(shard_of[i])
                if s not in states:
                    states[s] = (np.array([float(c) for _, c in totals]), {})
                total, seen = states[s]
                cells = []
                for a in gammas:
                    key = (a, idx[a][i])
                    cell = seen.get(key, start[a][i])
                    if len(cell) < len(total):
                        cell = np.pad(cell, (0, len(total) - len(cell)))
                    seen[key] = cell = np.array(cell) if key not in seen else cell
                    cells.append((key, cell))
                k = place[old[i]]
                total[k] -= 1.0
                for _, cell in cells:
                    cell[k] -= 1.0
                w = total.copy()
                for (_, cell), (g, mass) in zip(cells, gammas.values()):
                    w *= (cell + g) / (total + mass)
                run = np.append(w, birth).cumsum()
                z = int((run < draws[i] * run[-1]).sum())
                if z == len(total):
                    empty = np.flatnonzero(total == 0)
                    if len(empty):
                        z = int(empty[0])
                    else:
                        total = np.append(total, 0.0)
                        states[s] = (total, seen)
                        for key, cell in cells:
                            seen[key] = np.append(cell, 0.0)
                        cells = [(key, seen[key]) for key, _ in cells]
                total[z] += 1.0
                for _, cell in cells:
                    cell[z] += 1.0
                out[i] = live[z] if z < size else fresh + (z - size) * shards + s
            yield pa.RecordBatch.from_arrays([pa.array(rec_id), pa.array(out)], names=["rec_id", "k"])

    return rows.mapInArrow(visit, "rec_id bigint, k bigint")
