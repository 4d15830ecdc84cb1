"""A stateful operator that cuts keyed, ordered chunks into frames as they arrive."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colpack.functions import codec
from colpack.operators.frames import DEFAULT_FRAME, check_frame_size


def frame_stream(df: DataFrame, key: str, order: str, payload: str, last: str, frame_size: int = DEFAULT_FRAME) -> DataFrame:
    """(key, frame_no, n_bytes, block, closed): full frames as soon as a key's bytes suffice.

    A chunk whose column last is true closes its stream: the tail becomes a frame and a row with
    closed = true and no block stands for the end marker.  The state of a key is its next frame number
    and under frame_size bytes.  Chunks of a key must arrive in order over batches; within a batch they
    are put in order.  Null and empty chunks add nothing; chunks after the last one begin a new stream.
    """
    check_frame_size(frame_size)
    kind = df.schema[key].dataType.simpleString()

    def run(keys, parts, state: GroupState):
        number, tail = state.get if state.exists else (0, b"")
        encoder, out = codec.Encoder(), []
        for row in pd.concat(parts).sort_values(order, kind="stable").itertuples(index=False):
            tail += getattr(row, payload) or b""
            closed = bool(getattr(row, last))
            while len(tail) >= frame_size or closed and tail:
                data, tail = tail[:frame_size], tail[frame_size:]
                out.append((keys[0], number, len(data), encoder.compress(data), False))
                number += 1
            if closed:
                out.append((keys[0], number, 0, None, True))
                number = 0
        if number or tail:
            state.update((number, tail))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "frame_no", "n_bytes", "block", "closed"])

    chunks = df.select(key, order, payload, last)
    return chunks.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, frame_no int, n_bytes int, block binary, closed boolean", "frame_no int, tail binary", "append", GroupStateTimeout.NoTimeout)
