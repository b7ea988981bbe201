"""Variant ids of cases of any length: one pass over the events in order, with a fixed state a case."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.enrich import ORDER

#: Hex digits of an id.
ID_DIGITS = 12
VARIANT = "case_id string, variant_id string, variant_length long, first_activities array<string>"


class _Case:
    """What is kept of a case while its events go by: the digest so far, their number, the first ones."""

    def __init__(self, case_id: str | None, first: int):
        self.id, self.first, self.n, self.head, self.digest, self.begun = case_id, first, 0, [], hashlib.md5(usedforsecurity=False), False

    def add(self, activities: list[str | None]) -> None:
        self.n += len(activities)
        self.head += activities[:self.first - len(self.head)]
        text = "|".join(a for a in activities if a is not None)
        if any(a is not None for a in activities):
            self.digest.update((("|" if self.begun else "") + text).encode())
            self.begun = True

    def row(self) -> tuple:
        return self.id, self.digest.hexdigest()[:ID_DIGITS], self.n, self.head


def folded(first: int):
    """Arrow batches of (case_id, activity), cases one after the other and their events in order, to a row a case.

    A case may go on over any number of batches; of each only its own part of one batch is held.
    """
    def fold(batches):
        case = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, activities, done = batch.column(0), batch.column(1), []
            code = ids.dictionary_encode()
            runs = np.flatnonzero(np.diff(code.indices.fill_null(-1).to_numpy(zero_copy_only=False))) + 1
            for a, b in zip([0, *runs.tolist()], [*runs.tolist(), batch.num_rows]):
                here = ids[a].as_py()
                if case is None or case.id != here:
                    if case is not None:
                        done.append(case.row())
                    case = _Case(here, first)
                case.add(activities.slice(a, b - a).to_pylist())
            yield _rows(done)
        if case is not None:
            yield _rows([case.row()])

    return fold


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["case_id", "variant_id", "variant_length", "first_activities"])


def variant_ids(events: DataFrame, first: int = 3) -> DataFrame:
    """case_id, variant_id, variant_length and first_activities of every case with events.

    The ids are those of expr.variant_id.  Events are sorted by case and order (a sort that spills) and digested as they stream
    by, so a case costs the same memory whatever its number of events; nothing is gathered.  Null activities count in the length and
    not in the id.
    """
    ordered = events.select("case_id", "activity", *ORDER).repartition("case_id").sortWithinPartitions("case_id", *ORDER)
    return ordered.select("case_id", "activity").mapInArrow(folded(first), VARIANT)


def variant_frequencies(events: DataFrame, first: int = 3) -> DataFrame:
    """variant_id, case_count, variant_length and first_activities (as text) of every variant, from the ids alone."""
    return variant_ids(events, first).groupBy("variant_id").agg(
        F.count("*").alias("case_count"), F.min("variant_length").alias("variant_length"), F.min(F.array_join("first_activities", "|")).alias("first_activities"))
