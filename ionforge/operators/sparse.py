"""Arrow batches of sparse rows (``idx array<int>``, ``val array<double>``) as flat arrays and dense blocks."""

import numpy as np
import pyarrow as pa


def entries(batch):
    """Row number, column and value of every entry of a batch."""
    idx, val = batch.column("idx"), batch.column("val")
    sizes = np.diff(idx.offsets.to_numpy())
    # flatten() honours the slice that a batch may be of a larger array
    return np.repeat(np.arange(len(idx)), sizes), idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)


def dense(batch, width):
    """A batch as one block of rows x ``width`` doubles."""
    row, column, value = entries(batch)
    out = np.zeros((batch.num_rows, width))
    out[row, column] = value
    return out


def column(batch, name):
    return batch.column(name).to_numpy(zero_copy_only=False)


#: A table of packed batches.
PACKED = "block binary"


def packed(batch):
    """A batch as one row that holds it in Arrow's own format; a pass over stored rows then reads no value one by one."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def unpacked(batches):
    """The batches that packed rows hold."""
    for batch in batches:
        for block in batch.column("block"):
            yield from pa.ipc.open_stream(block.as_buffer())
