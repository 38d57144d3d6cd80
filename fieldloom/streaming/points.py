"""Point location of a stream: the mesh is a static side, every micro-batch is an ordinary join with it.

Defined cases: points outside of the mesh, and those with a null, NaN or infinite coordinate, have cell -1; an empty batch gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.mesh import Mesh
from ..operators.spatial import locate
from ..sources.shared import written


def locate_stream(points: DataFrame, mesh: Mesh, h: float, to: str, checkpoint: str) -> StreamingQuery:
    """Writes pid, cell_id and batch_id of a stream of points (pid, x, y) to Parquet under ``to``; a repeated batch replaces its own folder."""
    fixed = Mesh(written(mesh.nodes, "nodes"), written(mesh.cells, "cells"), mesh.order)

    def batch(df: DataFrame, batch_id: int) -> None:
        locate(df, fixed, h).write.mode("overwrite").parquet(f"{to}/batch_id={batch_id}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
