"""Small fleets and brute-force answers."""

import numpy as np
import pandas as pd


def fleet(lengths: dict, seed: int = 0, sensors=("sensor_1", "sensor_2"), gaps: bool = False) -> pd.DataFrame:
    """One row per engine and cycle; ``lengths`` maps (dataset_id, unit) to the number of cycles."""
    draw = np.random.default_rng(seed)
    frames = []
    for (dataset, unit), n in lengths.items():
        cycles = np.arange(1, n + 1)
        if gaps:
            cycles = np.cumsum(draw.integers(1, 5, n))
        data = {"dataset_id": dataset, "unit": unit, "cycle": cycles}
        for name in sensors:
            data[name] = np.round(draw.normal(10, 3, n), 3)
        frames.append(pd.DataFrame(data))
    made = pd.concat(frames, ignore_index=True)
    return made.sample(frac=1, random_state=seed).reset_index(drop=True)


def with_rul(frame: pd.DataFrame) -> pd.DataFrame:
    end = frame.groupby(["dataset_id", "unit"])["cycle"].transform("max")
    return frame.assign(RUL=(end - frame["cycle"]).astype(float))


def brute_windows(frame: pd.DataFrame, window: int, horizon: int, names) -> dict:
    made = {}
    for (dataset, unit), group in frame.groupby(["dataset_id", "unit"]):
        group = group.sort_values("cycle")
        values, target, cycles = group[list(names)].to_numpy(), group["RUL"].to_numpy(), group["cycle"].to_numpy()
        for start in range(len(group) - window - horizon + 1):
            end = start + window - 1
            made[(dataset, unit, int(cycles[end]))] = (values[start : end + 1].tolist(), float(target[end + horizon]))
    return made


def ordered(df, *keys) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
