"""Reading tables and keeping intermediate results in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrasphere.session import checkpoint_root


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application, so that they need no copy of it."""
    context = spark.sparkContext
    if getattr(context, "_terrasphere_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="terrasphere-")) / "terrasphere-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._terrasphere_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and read them back: later steps do not
    repeat the work, and the loss of an executor costs nothing that is written."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by rows so that the texts of each part hold about `most` bytes; a single
    longer text is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        release()
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Give freed memory of this Python worker back to the system: workers live on from stage to stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def offsets_of(counts):
    """Start of each run of the given lengths, and the end of the last."""
    import numpy as np

    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ranges(starts, lengths):
    """Indices of several runs one after the other."""
    import numpy as np

    off = offsets_of(lengths)
    return np.repeat(np.asarray(starts, np.int64) - off[:-1], lengths) + np.arange(off[-1])


def large_list(offsets, values, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by key, cut so that no group is split between two of them."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def in_blocks(df: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """Deal each group to tasks of at most about 2 * rows rows, so that any two rows of a group meet in one.

    A group of more than `rows` rows is cut into blocks by hash of `id`; each pair of blocks is a task group of its
    own. Adds `g`, by which the rows of a task group stand together inside a partition.
    """
    from pyspark.sql import functions as F

    blocks = F.ceil(F.col(size) / rows).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    others = F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: j != own))
    dealt = df.withColumn("_own", own).withColumn("_other", F.explode(others))
    dealt = dealt.withColumn("g", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "g").sortWithinPartitions("g")


def bit_field(df: DataFrame, column: str, bits: int = 24):
    """Packed bit field of fixed size (2**bits / 8 bytes) over the leading bits of a hashed column: what it does not
    hold is surely absent, what it holds may be present."""
    import numpy as np
    from pyspark.sql import functions as F

    cells = df.select(F.shiftrightunsigned(F.col(column), 64 - bits).alias("c")).distinct().toPandas()["c"].to_numpy(np.int64)
    field = np.zeros(1 << bits, bool)
    field[cells] = True
    return np.packbits(field)
