"""Calls of services outside of Spark, such as OCR or a language model, for the rows that need one.

Rows are split by a condition: those that aren't due never reach a Python worker.  The others are
called from their own partition, by a client that is made once for each of them, a bounded number at a
time, with retries; what goes wrong becomes the row's error and not the job's.  Spark may run a
task again, after a loss or by speculation, so that a call is made at least once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Call = Callable[..., str | None]
RESULT = "value string, error string, status int, attempts int"
#: Bytes of inputs, about, that a partition makes Python values of at a time.
SLICE = 1 << 20
_ARROW = pa.struct([("value", pa.string()), ("error", pa.string()), ("status", pa.int32()), ("attempts", pa.int32())])


@dataclass(frozen=True)
class Limits:
    """Calls of a partition at a time, tries of a call, and seconds before the second try, doubled each time."""

    at_once: int = 4
    tries: int = 3
    wait: float = 0.5


def _tried(call: Call, values: tuple, limits: Limits) -> dict:
    """A ValueError is the input's fault: status 400, at once.  All else is tried again, then 500."""
    for k in range(1, limits.tries + 1):
        try:
            return {"value": call(*values), "error": None, "status": 200, "attempts": k}
        except ValueError as e:
            return {"value": None, "error": str(e), "status": 400, "attempts": k}
        except Exception as e:  # the row fails, not the job
            failure = {"value": None, "error": str(e) or type(e).__name__, "status": 500, "attempts": k}
        if k < limits.tries:
            time.sleep(limits.wait * 2 ** (k - 1))
    return failure


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about so many bytes: the inputs and results of one slice are held at a time."""
    for batch in batches:
        step = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def called(df: DataFrame, due: Column, inputs: list[str], connect: Callable[[], Call], out: str = "result", limits: Limits = Limits()) -> DataFrame:
    """Adds `out`, a struct of value, error, status and attempts, null for rows that aren't due (a null
    condition: not due).  `connect` makes a partition's client, a function of the inputs."""
    marked = df.withColumn("_due", F.coalesce(due, F.lit(False)))
    rest = marked.where(~F.col("_due")).drop("_due").withColumn(out, F.lit(None).cast(StructType.fromDDL(RESULT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        with ThreadPoolExecutor(limits.at_once) as pool:
            for batch in slices(batches):
                call = call or connect()
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
                results = pool.map(lambda values, call=call: _tried(call, values, limits), zip(*columns, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(results), _ARROW)], [*batch.schema.names, out])

    mine = marked.where("_due").drop("_due")
    schema = StructType([*mine.schema.fields, *StructType.fromDDL(f"{out} struct<{RESULT.replace(' ', ':').replace(',:', ',')}>").fields])
    return rest.unionByName(mine.mapInArrow(run, schema))
