"""Region ids over a stream of frames, held as state by video."""

from __future__ import annotations

import math
import pickle

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kernels as K

COLUMNS = ("f", "z", "area", "cx", "cy", "l", "t", "r", "b", "mean_b", "mean_g", "mean_r")


def track(frames: DataFrame, width: int, height: int, most: float = 0.34) -> DataFrame:
    """(video, f, z, id) of a stream of regions (video and COLUMNS, with n, the number of the frame's regions).

    Frames may come in any order within and across batches. The state holds the
    last emitted frame's regions, the next id, and what came early; frames are
    emitted in order as soon as all before them are whole. A missing frame
    holds its video back, as no later id can be told without it.
    """
    diagonal = math.hypot(width, height)

    def run(key, batches, state: GroupState):
        import pandas as pd

        due, next_id, previous, early = pickle.loads(state.get[0]) if state.exists else (0, 1, [], {})
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.f >= due:
                    early.setdefault(r.f, {})[r.z] = r._asdict()
        out = []
        while due in early and len(early[due]) == next(iter(early[due].values()))["n"]:
            rows = [v for _, v in sorted(early.pop(due).items())]
            now = [{"area": v["area"], "center": (v["cx"], v["cy"]), "color": (v["mean_b"], v["mean_g"], v["mean_r"]), "box": (v["l"], v["t"], v["r"], v["b"])} for v in rows]
            ids, next_id = K.greedy_match(now, previous, lambda a, b: K.region_score(a, b, diagonal), most, next_id)
            for region, i, v in zip(now, ids, rows):
                region["id"] = i
                out.append((key[0], due, v["z"], i))
            previous, due = now, due + 1
        state.update((pickle.dumps((due, next_id, previous, early)),))
        yield pd.DataFrame(out, columns=["video", "f", "z", "id"])

    return frames.groupBy("video").applyInPandasWithState(run, "video string, f int, z int, id int", "state binary", "append", GroupStateTimeout.NoTimeout)
