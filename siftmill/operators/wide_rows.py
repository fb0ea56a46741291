"""Sparse wide tables: long form, a row as text with names looked up, and question-answer examples from it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Beginnings of column names that hold parts of a composition and measured values.
PARTS, VALUES = ("comp_",), ("prop_", "t_", "d_")
_LISTED = ArrayType(StructType([StructField("name", StringType()), StructField("amount", DoubleType())]))
_CELLS = pa.list_(pa.struct([("name", pa.string()), ("amount", pa.float64())]))


_ODD = {math.inf: "Infinity", -math.inf: "-Infinity"}


def _fixed(x: float, places: int) -> str:
    """A number with ``places`` decimals; ties of the decimal form go away from zero."""
    if not math.isfinite(x):
        return _ODD.get(x, "NaN")
    said = repr(x)
    if "e" in said or abs(x) >= 1e15 or (said[-1] == "5" and len(said) - said.index(".") == places + 2):
        return format(Decimal(said).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP, _ROOM), "f")
    return f"{x:.{places}f}"  # no tie in decimal form: the binary value lies on the same side


_ROOM = Context(prec=400)


def _significant(x: float, digits: int) -> str:
    if not math.isfinite(x):
        return _ODD.get(x, "NaN")
    own = repr(x).partition("e")[0].replace(".", "").strip("-0")
    if len(own) == digits + 1 and own[-1] == "5":
        x *= 1 + 1e-12  # off the tie
    return f"{x:.{digits}g}" if x else "0"


def _said(numbers: pa.Array, say: Callable[[float], str]) -> pa.Array:
    """Numbers as texts; a value that recurs in a batch is printed once."""
    held = pc.dictionary_encode(numbers)
    return pa.array([say(v) for v in held.dictionary.to_pylist()], pa.string()).take(held.indices)


def significant(x: Column, digits: int = 4) -> Column:
    """A number with ``digits`` significant digits: no trailing zeros, an exponent below -4 and from ``digits`` on. Ties of the decimal form go up."""

    def say(numbers: pa.Array) -> pa.Array:
        return _said(numbers, lambda v: _significant(v, digits))

    return arrow_udf(say, "string")(x.cast("double"))


def long_form(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, value) of every cell that is not blank, values as trimmed text. No shuffle."""
    cells = rows.select(key, *[F.trim(F.col(c).cast("string")).alias(c) for c in columns])
    return cells.unpivot(key, list(columns), "field", "value").where("value <> ''")


def readable_names(names: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """``name (unit)`` by lower-case column, of a table (field, name, unit); only rows for ``columns`` are fetched, so at most one a column."""
    field, name, unit = (F.trim(c) for c in ("field", "name", "unit"))
    d = names.select(F.lower(field).alias("field"), name.alias("name"), unit.alias("unit")).where(F.col("field").isin([c.lower() for c in columns]) & (F.col("name") != ""))
    label = F.when(F.coalesce(F.col("unit"), F.lit("")).isin("", "nan"), F.col("name")).otherwise(F.concat("name", F.lit(" ("), "unit", F.lit(")")))
    return {r["field"]: r["label"] for r in d.groupBy("field").agg(F.min(label).alias("label")).collect()}


def described(rows: DataFrame, names: dict[str, str], most_parts: int = 20, most_values: int = 15, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds ``parts`` and ``values`` (array<struct<name,amount>>, amount null for a text) and their texts ``part_text`` and ``value_text``, in column order.

    Null and blank cells are left out, as are numbers of a composition that are not above 0. Numbers have two decimals in a composition and four
    significant digits else. A row without any cell has empty lists and texts. Of the columns of ``rows`` only ``keep`` stay, if given.
    """

    lists = [(("part", PARTS, most_parts), "parts", "part_text"), (("value", VALUES, most_values), "values", "value_text")]
    cells = {kind: [c for c in rows.columns if c.startswith(beginnings)] for (kind, beginnings, _), _, _ in lists}
    told = {"part": [c[5:].upper().replace("_", "") for c in cells["part"]], "value": [names.get(c.lower(), c) for c in cells["value"]]}
    say = {"part": lambda v: _fixed(v, 2) + "%", "value": lambda v: _significant(v, 4)}
    kept = list(rows.columns if keep is None else keep)

    def described_cells(kind: str, most: int, numbers: list[pa.Array], words: list[pa.Array], n: int) -> tuple[pa.Array, pa.Array]:
        if not numbers:
            return pa.array([[]] * n, _CELLS), pa.array([""] * n, pa.string())
        amount = np.array([x.to_numpy(zero_copy_only=False) for x in numbers]).T
        number, word = (np.array([x.is_valid().to_numpy(zero_copy_only=False) for x in given]).T for given in (numbers, words))
        holds = word | (number & ~(amount <= 0) if kind == "part" else number)
        row, column = np.nonzero(holds)
        made = pa.StructArray.from_arrays([pa.array(told[kind], pa.string()).take(pa.array(column)), pa.array(amount[row, column], pa.float64(), mask=~number[row, column])], ["name", "amount"])
        shown = holds & (np.cumsum(holds, axis=1) <= most)
        mark = ": " if kind == "part" else "="
        texts = [pc.if_else(pa.array(shown[:, i]), pc.binary_join_element_wise(", " + told[kind][i] + mark, pc.coalesce(words[i], _said(numbers[i], say[kind])), ""), "") for i in range(len(numbers))]
        offsets = np.concatenate([[0], np.cumsum(holds.sum(axis=1))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made), pc.utf8_slice_codeunits(pc.binary_join_element_wise(*texts, ""), 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, at = batch.columns[: len(kept)], len(kept)
            for (kind, _, most), _, _ in lists:
                size = len(cells[kind])
                columns += described_cells(kind, most, batch.columns[at : at + size], batch.columns[at + size : at + 2 * size], batch.num_rows)
                at += 2 * size
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(c for _, *two in lists for c in two)])

    def read(c: str) -> tuple[Column, Column]:
        if rows.schema[c].dataType == DoubleType():  # its text would be read as itself
            return F.col(c), F.lit(None).cast("string")
        text = F.trim(F.col(c).cast("string"))
        return text.try_cast("double"), F.when(text.try_cast("double").isNull(), F.nullif(text, F.lit("")))

    given = [x[of].alias(f"_{kind}_{of}_{i}") for kind in cells for of in (0, 1) for i, x in enumerate(map(read, cells[kind]))]
    schema = StructType([*(rows.schema[c] for c in kept), *(StructField(c, of) for _, *two in lists for c, of in zip(two, (_LISTED, StringType())))])
    return rows.select(*kept, *given).mapInArrow(run, schema)


def row_text(key: Column, title: str = "Glass #", between: str = " — ") -> Column:
    """The text of a described row; null without a cell."""
    labelled = lambda label, c: F.concat(F.lit(label), F.nullif(F.col(c), F.lit("")))
    return F.when((F.col("part_text") != "") | (F.col("value_text") != ""), F.concat_ws(between, F.concat(F.lit(title), key.cast("string")), labelled("Composition: ", "part_text"), labelled("Properties: ", "value_text")))


def row_examples(rows: DataFrame, key: str, asked: Sequence[str], about: Sequence[str], source: str, seed: str) -> DataFrame:
    """One or two examples (key, n, question, answer) of each described row with a cell.

    The first asks by a template of ``asked`` ({key}) for all of it. Half of the rows whose composition has a number get a second, by a template of ``about``
    ({component}, {value}, {system}) on the largest part (ties: the first) if a part is over 5, else on the composition. Choices are md5 buckets of the key and ``seed``.
    """
    names = ["n", "question", "answer"]

    def examples(own: str | None, parts: list[tuple[str, float | None]], part_text: str, value_text: str, text: str) -> Iterator[tuple[int, str | None, str]]:
        pick = lambda texts, salt: texts[_bucket(own, seed + salt) % len(texts)]
        yield 0, None if own is None else pick(asked, "q").replace("{key}", own), f"From the {source}:\n\n{text}"
        numbers = [(name, amount) for name, amount in parts if amount is not None]
        if own is None or not numbers or _bucket(own, seed + "h") % 100 >= 50:
            return
        largest = max(numbers, key=lambda p: (p[1] != p[1], p[1]))  # the first of equal ones; what is no number counts as the largest
        system = "-".join(sorted([name for name, amount in numbers if not amount <= 5][:4]))
        question = pick(about, "c").replace("{component}", largest[0]).replace("{value}", _fixed(largest[1], 1)).replace("{system}", system) if system else f"What is known about the composition of glass #{own}?"
        measured = f" Its measured properties include: {value_text}." if value_text else ""
        yield 1, question, f"Glass #{own} from the {source} has the following composition: {part_text}.{measured}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            flat, ends = batch.column(2).flatten(), np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)).tolist()
            parts = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist()))
            rest = zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5)))
            made = [(k, *e) for k, (lo, hi, (own, part_text, value_text, text)) in enumerate(zip([0, *ends], ends, rest)) for e in examples(own, parts[lo:hi], part_text, value_text, text)]
            row, n, question, answer = zip(*made) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int32()), pa.array(question, pa.string()), pa.array(answer, pa.string())], names=[key, *names])

    told = rows.where("part_text <> '' OR value_text <> ''").select(key, F.col(key).cast("string").alias("_own"), "parts", "part_text", "value_text", row_text(F.col(key), between=" -- ").alias("_text"))
    return told.mapInArrow(run, StructType([rows.schema[key], *(StructField(c, of) for c, of in zip(names, (IntegerType(), StringType(), StringType())))]))


def _bucket(key: str, seed: str) -> int:
    return int(hashlib.md5((key + seed).encode()).hexdigest()[:8], 16)
