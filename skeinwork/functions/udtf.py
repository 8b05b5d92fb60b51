"""Table functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.functions import arrow_udtf

from skeinwork.operators.events import message_bounds


@arrow_udtf(returnType="id: bigint, part: int, res: bigint, data: binary")
class SplitMessages:
    """Messages of the multi-message buffers of a table (id, data), whole Arrow batches at a time: repeated ``uint32 size +
    data``; the last part may be cut. ``SELECT * FROM split_messages(TABLE(SELECT id, data FROM ...))``."""

    def eval(self, batch: pa.RecordBatch):
        ids, parts, bodies = [], [], []
        for row, buffer in zip(batch.column("id").to_pylist(), batch.column("data"), strict=True):
            view = memoryview(buffer.as_buffer() or b"")
            for part, (at, size) in enumerate(message_bounds(view)):
                ids.append(row)
                parts.append(part)
                bodies.append(bytes(view[at : at + size]))
        yield pa.table({"id": pa.array(ids, pa.int64()), "part": pa.array(parts, pa.int32()), "res": pa.array([len(b) for b in bodies], pa.int64()), "data": pa.array(bodies, pa.binary())})
