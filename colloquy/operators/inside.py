"""What the searches run inside tasks, over Arrow batches.

Each maker returns nested functions: they are pickled by value, so that they
reach workers that do not have this package installed.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

PLACES = 9  # digits of a score that count for its rank
TILE = 4_000_000  # scores held in memory at a time
PAIRS = 500_000  # words of units met with words of requests at a time


def make_values():
    def values(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.to_numpy(zero_copy_only=False)

    return values


def make_places():
    def places(words: pa.Array, known: pa.Array) -> np.ndarray:
        """Where each of the distinct `words` is in `known`, or -1. Only `words` become a hash table: `known` may be large and stays in Arrow."""
        of = pc.index_in(known, value_set=words)
        met = of.is_valid()
        at = np.full(len(words), -1, dtype=np.int64)
        at[of.filter(met).to_numpy()] = np.flatnonzero(met.to_numpy(zero_copy_only=False))
        return at

    return places


def make_whole():
    def whole(column) -> pa.Array:
        """A column in one piece."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column

    return whole


def make_forbidden():
    def forbidden(conditions: dict, lo: int, hi: int, n: int, convs, roles) -> np.ndarray:
        """(units, requests) pairs that a condition of one of the requests lo..hi rules out."""
        out = np.zeros((n, hi - lo), dtype=bool)
        role_codes, role_names = pd.factorize(roles) if "roles" in conditions else (None, None)
        alike: dict[tuple, list[int]] = {}  # requests with equal conditions share one mask
        for j in range(lo, hi):
            one = tuple((c, tuple(v) if isinstance(v, list) else v) for c, listed in conditions.items() if (v := listed[j]) is not None)
            alike.setdefault(one, []).append(j - lo)
        for one, places in alike.items():
            one, mask = dict(one), np.zeros(n, dtype=bool)
            if "conv_ids" in one:
                mask |= ~np.isin(convs, one["conv_ids"])
            if "roles" in one:
                # The code of a unit without a role is -1, the last place: no list of roles admits it.
                mask |= ~np.append(np.isin(role_names, one["roles"]), False)[role_codes]
            if "exclude_conv" in one:
                mask |= convs == one["exclude_conv"]
            out[:, places] |= mask[:, None]
        return out

    return forbidden


def make_keeper(key: Sequence[str], limit: int):
    """Functions that keep the `limit` best hits per request while batches go by.

    The state is small whatever is offered: `limit` rows per request, and per
    request the score of its last hit, which later pairs must reach.
    """
    key, places = list(key), PLACES

    def start(n_asked: int) -> dict:
        return {"hits": None, "floor": np.full(n_asked, -np.inf)}

    def candidates(scores: np.ndarray, floor: np.ndarray):
        """Pairs of a (units, requests) block that may still be among the best; -inf is never one."""
        # Scores that are equal once rounded are decided by key, so they stay in for now.
        slack = 10.0**-places
        open_ = scores >= floor - slack
        if len(scores) > limit and np.count_nonzero(open_) > 4 * limit * len(floor):
            last = len(scores) - limit
            open_ &= scores >= np.partition(scores, last, axis=0)[last] - slack
        return np.nonzero(open_ & (scores > -np.inf))

    def offer(state: dict, q: np.ndarray, keys: dict, score: np.ndarray) -> None:
        if not len(q):
            return
        hits = pd.DataFrame({"q": q, **keys, "score": score})
        if state["hits"] is not None:
            hits = pd.concat([state["hits"], hits], ignore_index=True)
        by_key = [hits[c].to_numpy() for c in reversed(key)]
        # Half up, as Spark rounds where it ranks in the end.
        rounded = np.floor(hits["score"].to_numpy() * 10.0**places + 0.5)
        order = np.lexsort([*by_key, -rounded, hits["q"].to_numpy()])
        q = hits["q"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        hits = hits.iloc[order[place < limit]].reset_index(drop=True)
        q = hits["q"].to_numpy()
        ends = np.r_[np.flatnonzero(q[1:] != q[:-1]), len(q) - 1]
        full = np.bincount(q, minlength=len(state["floor"]))[q[ends]] >= limit
        state["floor"][q[ends][full]] = hits["score"].to_numpy()[ends][full]
        state["hits"] = hits

    def result(state: dict, ids: np.ndarray) -> pa.RecordBatch | None:
        hits = state["hits"]
        if hits is None:
            return None
        columns = [ids[hits["q"].to_numpy()], *[hits[c].to_numpy() for c in [*key, "score"]]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["req_id", *key, "score"])

    return start, candidates, offer, result
