"""Folds over long ordered sequences as associative scans: a sequence is cut into stretches, and each stretch becomes a map from the state before it to the state behind it.

Maps are made by one task a stretch, without knowing the state that comes in; they compose, in groups of FAN, to maps of longer stretches,
until a sequence has FAN at most. From the start state the states before all stretches follow, level by level, and a second pass over the rows, again
one task a stretch, gives each row its result. So one long session is as many tasks as it has stretches, no group of rows is larger than one, and
a lost executor repeats some stretches. Stretches are ranges of the first ordering column, which must be a whole number.

A machine says what the fold is. Maps and states are kept as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..lineage import cut

#: Values of the ordering column in a stretch, and maps that are composed at a time.
STRETCH, FAN = 4096, 4096


class Machine(Protocol):
    """A fold that can be cut. ``then`` is associative, and ``apply(then(a, b), s)`` is ``apply(b, apply(a, s))``."""

    start: Any
    out: str

    def summary(self, rows: pa.Table) -> Any: ...

    def then(self, first: Any, second: Any) -> Any: ...

    def apply(self, way: Any, state: Any) -> Any: ...

    def replay(self, rows: pa.Table, state: Any) -> list[pa.Array]: ...


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, of which one at a time is held."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        differs = np.zeros(len(rows) - 1, bool)
        for k in keys:
            column = rows.column(k).combine_chunks()
            coded = column.dictionary_encode("encode") if not pa.types.is_integer(column.type) else None
            values = (coded.indices if coded is not None else column.fill_null(np.iinfo(column.type.to_pandas_dtype()).min)).to_numpy(zero_copy_only=False)
            differs |= values[1:] != values[:-1]
        borders = [0, *(np.flatnonzero(differs) + 1).tolist(), len(rows)]
        for begin, end in zip(borders, borders[1:], strict=False):
            part = rows.slice(begin, end - begin)
            if held and any(held[-1].column(k)[-1].as_py() != part.column(k)[0].as_py() for k in keys):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _by_run(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table], list[pa.Array]], out: T.StructType) -> DataFrame:
    """``f`` over the rows of equal keys, in order; it gives the columns behind the keys, one value for each row or one for all."""
    names = [x.name for x in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, keys):
            columns = f(rows)
            n = len(columns[0])
            kept = [rows.column(k).combine_chunks().slice(0, n) for k in names[: len(names) - len(columns)]]
            if n:
                yield pa.RecordBatch.from_arrays([*kept, *columns], names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def _schema(df: DataFrame, keys: list[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(more).fields])


def with_stretch(df: DataFrame, by: str, size: int = STRETCH) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(by) / size).cast("long"))


def by_stretch(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to rows what a written table holds of their stretch, all of which it has. As a left join, so that only that table is ever broadcast:
    Spark's estimate of rows knows nothing of what was exploded or compressed, and may be a hundredth of their size."""
    return rows.dropna(subset=[*keys, "_stretch"]).join(held, [*keys, "_stretch"], "left")


def maps(rows: DataFrame, keys: list[str], order: list[str], machine: Machine) -> DataFrame:
    """(keys, _stretch, way): the map of each stretch, in a table of the shared folder."""
    out = _schema(rows, [*keys, "_stretch"], "way string")
    return cut(_by_run(rows, [*keys, "_stretch"], order, lambda r: [pa.array([json.dumps(machine.summary(r))])], out), "scan-maps")


def _composed(ways: DataFrame, keys: list[str], machine: Machine, fan: int) -> DataFrame:
    """The maps of ``fan`` stretches each."""

    def compose(rows: pa.Table) -> list[pa.Array]:
        found = [json.loads(w) for w in rows.column("way").to_pylist()]
        while len(found) > 1:
            found = [machine.then(found[i], found[i + 1]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
        return [pa.array([json.dumps(found[0])])]

    up = ways.select(*keys, F.floor(F.col("_stretch") / fan).cast("long").alias("_up"), "_stretch", "way")
    done = _by_run(up, [*keys, "_up"], ["_stretch"], compose, _schema(up, [*keys, "_up"], "way string"))
    return cut(done.withColumnRenamed("_up", "_stretch"), "scan-maps")


def _levels(ways: DataFrame, keys: list[str], machine: Machine, fan: int) -> list[DataFrame]:
    """The maps of stretches, of their groups, and so on until every sequence fits one group."""
    span = ways.agg(F.max("_stretch"), F.min("_stretch")).first()
    levels, most = [ways], max(abs(span[0] or 0), abs(span[1] or 0))
    while most >= fan:
        levels.append(_composed(levels[-1], keys, machine, fan))
        most //= fan
    return levels


def entries(ways: DataFrame, keys: list[str], machine: Machine, fan: int = FAN) -> DataFrame:
    """(keys, _stretch, state): the state before each stretch."""
    levels = _levels(ways, keys, machine, fan)

    def walk(rows: pa.Table) -> list[pa.Array]:
        given = rows.column("state")[0].as_py()
        state, out = machine.start if given is None else json.loads(given), []
        for way in rows.column("way").to_pylist():
            out.append(json.dumps(state))
            state = machine.apply(json.loads(way), state)
        return [rows.column("_stretch").combine_chunks(), pa.array(out)]

    above = None
    for k, level in reversed(list(enumerate(levels))):
        rows = level.withColumn("_up", F.floor(F.col("_stretch") / fan).cast("long") if above is not None else F.lit(0).cast("long"))
        if above is None:
            rows = rows.withColumn("state", F.lit(None).cast("string"))
        else:
            rows = rows.join(above.withColumnRenamed("_stretch", "_up"), [*keys, "_up"])
        above = _by_run(rows, [*keys, "_up"], ["_stretch"], walk, _schema(rows, keys, "_stretch long, state string"))
    return cut(above, "scan-states")


def final_states(rows: DataFrame, keys: list[str], order: list[str], machine: Machine, fan: int = FAN) -> DataFrame:
    """(keys, state): the state behind each sequence's last row."""
    top = _levels(maps(rows, keys, order, machine), keys, machine, fan)[-1]

    def end(found: pa.Table) -> list[pa.Array]:
        state = machine.start
        for way in found.column("way").to_pylist():
            state = machine.apply(json.loads(way), state)
        return [pa.array([json.dumps(state)])]

    return _by_run(top, keys, ["_stretch"], end, _schema(top, keys, "state string"))


def scanned(rows: DataFrame, keys: list[str], order: list[str], machine: Machine, fan: int = FAN, also: tuple[str, ...] = ()) -> DataFrame:
    """(keys, the columns ``also``, order, what the machine gives each row)."""
    states = entries(maps(rows, keys, order, machine), keys, machine, fan)
    joined = by_stretch(rows, states, keys)
    return _by_run(joined, [*keys, "_stretch"], order, lambda r: machine.replay(r, json.loads(r.column("state")[0].as_py())), _schema(rows, [*keys, *also, *order], machine.out))


#: Bytes of an Arrow batch of packed stretches, and stretches that are written at a time.
BATCH_BYTES, PACKED = 1 << 20, 16


def packed(rows: DataFrame, keys: list[str], order: str, most: dict[str, str]) -> DataFrame:
    """(keys, _stretch, the greatest value of each column of ``most`` under its new name, rows): the rows of each stretch by ``order``, a whole number, as one compressed value, in a table of the shared folder.

    Rows are shuffled and sorted this once, by a single number, which Spark does by radix; each further pass of a scan moves a value a stretch.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    by = [*keys, "_stretch"]
    body = [c for c in rows.columns if c not in by]
    out = T.StructType([*(rows.schema[k] for k in by), *(T.StructField(n, rows.schema[c].dataType) for n, c in most.items()), T.StructField("rows", T.BinaryType())])

    def one(part: pa.Table) -> list:
        at = part.column(order).to_numpy()
        part = part if (at[1:] >= at[:-1]).all() else part.take(np.argsort(at, kind="stable"))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.select(body).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(part.select(body).combine_chunks())
        return [*(part.column(k)[0] for k in by), *(pc.max(part.column(c)) for c in most.values()), pa.scalar(sink.getvalue().to_pybytes(), pa.binary())]

    def batch(held: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in column], kind) for column, kind in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = to_arrow_schema(out), []
        for found in _runs(batches, ["_run"]):
            for part in _apart(found, by):
                held.append(one(part))
                if len(held) == PACKED:
                    yield batch(held, schema)
                    held = []
        if held:
            yield batch(held, schema)

    numbered = rows.dropna(subset=by).withColumn("_run", F.xxhash64(*by))
    return cut(numbered.repartition("_run").sortWithinPartitions("_run").mapInArrow(run, out), "scan-rows")


def _apart(rows: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of a run; more than one only where different keys have one number."""
    differ = [k for k in keys if len(pc.unique(rows.column(k))) > 1]
    if not differ:
        yield rows
        return
    for value in pc.unique(rows.column(differ[0])).to_pylist():
        yield from _apart(rows.filter(pc.equal(rows.column(differ[0]), pa.scalar(value, rows.schema.field(differ[0]).type))), keys)


def _each_packed(table: DataFrame, keys: list[str], more: str, f: Callable[[pa.Table, Any], list[pa.Array]], out: T.StructType) -> DataFrame:
    """``f`` over the rows of each stretch, with the value of the column ``more`` beside them; it gives the columns behind the first of ``out``, which are keys or columns of the rows."""
    names = [x.name for x in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = pa.ipc.open_stream(batch.column("rows")[i].as_buffer()).read_all().combine_chunks()
                columns = f(rows, batch.column(more)[i].as_py())
                n = len(columns[0])
                first = [pa.repeat(batch.column(k)[i], n) if k in keys else rows.column(k).combine_chunks() for k in names[: len(names) - len(columns)]]
                if n:
                    yield pa.RecordBatch.from_arrays([*first, *columns], names)

    return table.mapInArrow(run, out)


def scanned_packed(rows: DataFrame, keys: list[str], order: str, machine: Machine, bound: str, fan: int = FAN, also: tuple[str, ...] = ()) -> DataFrame:
    """As ``scanned`` over rows with stretches, for a machine whose summary also reads as ``bound`` the greatest value of that column in all earlier stretches; rows are shuffled once."""
    by = [*keys, "_stretch"]
    held = packed(rows, keys, order, {"_most": bound})
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut(held.select(*by, F.max("_most").over(earlier).alias("bound")), "scan-ends")
    # By sorting: what Spark knows of a written table is the size of its compressed file, and these grow with the rows.
    bounded = held.join(ends.hint("merge"), by, "left")

    def summary(part: pa.Table, most: Any) -> list[pa.Array]:
        return [pa.array([json.dumps(machine.summary(part.append_column("bound", pa.repeat(pa.scalar(most, part.schema.field(bound).type), len(part)))))])]

    ways = cut(_each_packed(bounded, by, "bound", summary, _schema(rows, by, "way string")), "scan-maps")
    states = entries(ways, keys, machine, fan)
    return _each_packed(bounded.join(states.hint("merge"), by, "left"), by, "state", lambda part, state: machine.replay(part, json.loads(state)), _schema(rows, [*keys, *also, order], machine.out))


class Automaton:
    """A machine of finitely many states: ``step(state, symbol)`` gives the next state and what is counted on the way.

    All states that can be reached are numbered once, so that a stretch's map is an array, and rows' arrays compose in pairs.
    ``symbols`` turns rows into numbers of ``alphabet``.
    """

    out = ""

    def __init__(self, first: Any, alphabet: list[Any], step: Callable[[Any, Any], tuple[Any, tuple[int, ...]]], symbols: Callable[[pa.Table], np.ndarray]):
        self.states, number = [first], {first: 0}
        rows = []
        for state in self.states:  # grows while it is read
            row = []
            for symbol in alphabet:
                after, counted = step(state, symbol)
                if after not in number:
                    number[after] = len(self.states)
                    self.states.append(after)
                row.append((number[after], counted))
            rows.append(row)
        self.next = np.array([[x[0] for x in row] for row in rows], np.int32).T.copy()
        self.counted = np.array([[x[1] for x in row] for row in rows], np.int64).transpose(1, 0, 2).copy()
        self.symbols = symbols
        self.start = [0, [0] * self.counted.shape[2]]

    def summary(self, rows: pa.Table) -> Any:
        at = self.symbols(rows)
        after, counts = self.next[at], self.counted[at]
        while len(after) > 1:
            odd = len(after) % 2
            a, b = after[: len(after) - odd : 2], after[1::2]
            joined = np.take_along_axis(b, a, axis=1)
            sums = counts[: len(counts) - odd : 2] + np.take_along_axis(counts[1::2], a[:, :, None], axis=1)
            after, counts = (np.concatenate([joined, after[-1:]]), np.concatenate([sums, counts[-1:]])) if odd else (joined, sums)
        return [after[0].tolist(), counts[0].tolist()]

    def then(self, first: Any, second: Any) -> Any:
        return [[second[0][s] for s in first[0]], [[x + y for x, y in zip(c, second[1][s], strict=True)] for s, c in zip(*first, strict=True)]]

    def apply(self, way: Any, state: Any) -> Any:
        at, counts = state
        return [way[0][at], [x + y for x, y in zip(counts, way[1][at], strict=True)]]

