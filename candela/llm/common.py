"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the id's decimal form, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by spark.checkpoint.dir.

    The folder is read from the session. Only where none is set, as in tests on one machine, a folder is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="candela-"))
    return df.checkpoint(eager=True)


def checkpointed_by(df: DataFrame, parts: int, *columns: str) -> DataFrame:
    """The same, dealt by columns; what groups or joins by them later needs no exchange of these rows again.

    Spark keeps the partitioning of a checkpoint only if its plan is not adaptive, so for this one it is not.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df.repartition(parts, *columns))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


#: Rows and bytes of an Arrow batch at most, as texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches, so that buffers on both sides of a worker stay small."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}").lower()).groups()
        now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def place(df: DataFrame, name: str) -> str:
    """What `numbered` calls a column of df."""
    names = df.columns
    if name in names:
        return f"c{names.index(name)}"
    return f"c{[n.lower() for n in names].index(name.lower())}"


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1 and so on, which clash with no helper column; `.toDF(*df.columns)` turns the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]], schema: str | T.StructType, finish: bool = False) -> DataFrame:
    """Run a function over Arrow batches given as column lists.

    make() runs once in each task and returns the function; with finish, the function is called once more
    with None at the end of the task, to give what it has gathered.
    """
    bound_batches(df.sparkSession)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            # parts of about 8 MB of text, so that memory does not follow the number of rows in a batch
            step = max(1, int(batch.num_rows * 8e6 / max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                out = work({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        if finish:
            out = work(None)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def map_texts(df: DataFrame, text: str, keep: tuple[str, ...], make: Callable[[], Callable[[list[str]], dict[str, list]]], results: str) -> DataFrame:
    """keep columns and the results of a function of a list of texts, null as the empty text.

    A kept column that is named like a result gets `_in` at its end.
    """
    own = [f"k{i}" for i in range(len(keep))]
    given = numbered(df).select(*[F.col(place(df, n)).alias(k) for n, k in zip(keep, own, strict=True)], text_of(place(df, text)).alias("__text"))
    added = T.StructType.fromDDL(results)

    def start():
        work = make()
        return lambda rows: work(rows.pop("__text")) | {k: rows[k] for k in own}

    out = map_rows(given, start, T.StructType([*given.schema.fields[:-1], *added.fields]))
    taken = {n.lower() for n in added.names}
    return out.toDF(*[n + "_in" if n.lower() in taken else n for n in keep], *added.names)


def vocabulary_path(name: str) -> str:
    """A tokenizer file by its path, or by its name in the installed vocabulary package."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load_tokenizer(name: str):
    """The tokenizer of a .json file, kept for the life of the worker process; runs in the caller's thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer
