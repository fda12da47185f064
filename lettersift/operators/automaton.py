"""Finding the terms of a large table in texts with one pass over each text.

The terms are compiled into an Aho-Corasick automaton in each Python worker, from a broadcast Arrow table; its nodes hold
only the places of the terms in that table. A text is read once however many terms there are, only the text column goes
to Python, and what is found comes back in the text's own row, as Arrow arrays or as sums: nothing is shuffled, no text is
joined, and no Python object is made for what is found.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of terms and their values in one automaton. A larger table is split over several passes, each with a part.
PASS_BYTES = 64_000_000
# A table that needs more passes is refused: use the joined forms, which have no such bound.
MAX_PASSES = 16
# Texts whose occurrences are held at once.
_TEXTS = 128

_compiled: dict[str, dict[int, _Automaton]] = {}


class _Automaton:
    """A part of a term table, sorted by its first column, and the automaton of its distinct terms."""

    def __init__(self, table: pa.Table):
        import ahocorasick

        self.table, terms = table.combine_chunks(), table.column(0).combine_chunks()
        self.built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # Rows of the place p are first[p] to first[p + 1] - 1.
        first, before, self.lengths = [], None, []
        for row, term in enumerate(terms):
            term = term.as_py()
            if term != before:
                self.built.add_word(term, len(first))
                first.append(row)
                self.lengths.append(len(term))
                before = term
        self.first = np.array([*first, len(terms)], np.int64)
        self.lengths = np.array(self.lengths, np.int64)
        self.built.make_automaton()

    def occurrences(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place of the term and last character of each occurrence, overlapping ones, too."""
        each = [np.fromiter(chain.from_iterable(self.built.iter(t)), np.int64) if t else np.empty(0, np.int64) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(e) // 2 for e in each])
        both = np.concatenate(each).reshape(-1, 2)
        return rows, both[:, 1], both[:, 0]

    def contained(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of the terms that each text contains, each once, in order."""
        rows, places, _ = self.occurrences(texts)
        return np.divmod(np.unique(rows * len(self.lengths) + places), len(self.lengths))

    def rows_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many rows of the table each place has, and the rows one after another."""
        n = self.first[places + 1] - self.first[places]
        return n, np.repeat(self.first[places] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _automaton(run: str, part: int, table) -> _Automaton:
    """The automaton of a broadcast part, built once in a worker. All parts of the run that is in use are kept."""
    if run not in _compiled:
        _compiled.clear()
        _compiled[run] = {}
    if part not in _compiled[run]:
        _compiled[run][part] = _Automaton(table.value)
    return _compiled[run][part]


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _in_chunks(size: int, make: Callable[[slice], pa.Array]) -> pa.Array:
    return pa.concat_arrays([make(slice(i, i + _TEXTS)) for i in range(0, max(size, 1), _TEXTS)])


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def _finder(run: str, part: int, table, schema: T.StructType):
    @F.arrow_udf(T.ArrayType(schema))
    def find(texts: pa.Array) -> pa.Array:
        built, texts = _automaton(run, part, table), texts.to_pylist()

        def make(chunk):
            rows, places = built.contained(texts[chunk])
            n, at = built.rows_of(places)
            found = built.table.take(at)
            counts = np.bincount(rows, n, len(texts[chunk])).astype(np.int64)
            return _lists(counts, pa.StructArray.from_arrays([c.combine_chunks() for c in found.columns], names=schema.names))

        return _in_chunks(len(texts), make)

    # Kept where it is: the optimiser would copy it into filters on what is found.
    return find.asNondeterministic()


def _summer(run: str, part: int, table, names: Sequence[str]):
    @F.arrow_udf("array<bigint>")
    def find(texts: pa.Array) -> pa.Array:
        built, texts = _automaton(run, part, table), texts.to_pylist()
        weights = [built.table.column(name).to_numpy() for name in names]

        def make(chunk):
            rows, places = built.contained(texts[chunk])
            n, at = built.rows_of(places)
            size, rows = len(texts[chunk]), np.repeat(rows, n)
            sums = np.stack([np.bincount(rows, w[at], size) for w in weights], axis=1).astype(np.int64)
            return _lists(np.full(size, len(names)), pa.array(sums.ravel()))

        return _in_chunks(len(texts), make)

    return find.asNondeterministic()


def _disjoint(groups: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """How many occurrences each group has, read from the left, without those that overlap the one counted before."""
    order = np.lexsort((starts, groups))
    groups, starts, ends = groups[order], starts[order], (starts + lengths)[order]
    counts = np.bincount(groups, minlength=size)
    crossing = np.unique(groups[1:][(groups[1:] == groups[:-1]) & (starts[1:] < ends[:-1])])
    for group, a, b in zip(crossing, np.searchsorted(groups, crossing), np.searchsorted(groups, crossing, "right"), strict=True):
        n, free = 0, 0
        for start, end in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True):
            if start >= free:
                n, free = n + 1, end
        counts[group] = n
    return counts


def _counter(run: str, part: int, table, schema: T.StructType):
    @F.arrow_udf(T.ArrayType(schema))
    def find(texts: pa.Array, borders: pa.Array) -> pa.Array:
        built, texts, borders = _automaton(run, part, table), texts.to_pylist(), borders.to_numpy(zero_copy_only=False)

        def make(chunk):
            rows, places, last = built.occurrences(texts[chunk])
            pairs, groups = np.unique(rows * len(built.lengths) + places, return_inverse=True)
            lengths = built.lengths[places]
            starts, border = last + 1 - lengths, borders[chunk][rows]
            counted = [
                _disjoint(groups[inside], starts[inside], lengths[inside], len(pairs))
                for inside in (last < border, starts > border, np.full(len(rows), True))]
            rows, places = np.divmod(pairs, max(1, len(built.lengths)))
            n, at = built.rows_of(places)
            found = built.table.take(at)
            values = [*(c.combine_chunks() for c in found.columns), *(pa.array(np.repeat(c, n), pa.int32()) for c in counted)]
            return _lists(np.bincount(rows, n, len(texts[chunk])).astype(np.int64), pa.StructArray.from_arrays(values, names=schema.names))

        return _in_chunks(len(texts), make)

    return find.asNondeterministic()


def split_terms(terms: DataFrame, term: str, others: Sequence[str], pass_bytes: int = PASS_BYTES) -> list[pa.Table]:
    """The distinct rows ``(term, *others)`` in parts of at most about ``pass_bytes``, read to the driver part by part.

    Reading them is a job, like reading rules from a file; they come as Arrow columns. Null and empty terms are left out.
    """
    rows = terms.select(term, *others).where(F.col(term) != "").distinct()
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in (term, *others)), F.lit(0))
    total = rows.agg(F.sum(size)).first()[0] or 0
    passes = -(-total // pass_bytes)
    if passes > MAX_PASSES:
        raise ValueError(f"{total} bytes of terms need {passes} passes; at most {MAX_PASSES} are made")
    part = F.pmod(F.xxhash64(term), F.lit(max(1, passes)))
    read = (rows.where(part == i).toArrow() for i in range(passes))
    return [t.sort_by([(c, "ascending") for c in t.column_names]) for t in read]


def _parts(df: DataFrame, terms: DataFrame, term: str, others: Sequence[str], pass_bytes: int) -> tuple[str, list]:
    """A name for the run and its parts, broadcast."""
    parts = split_terms(terms, term, others, pass_bytes)
    return uuid.uuid4().hex, [df.sparkSession.sparkContext.broadcast(p) for p in parts if p.num_rows]


def _with_arrays(df: DataFrame, arrays: list[Column], schema: T.StructType, out: str) -> DataFrame:
    empty = F.array().cast(T.ArrayType(schema))
    names = [f"_pass{i}" for i in range(len(arrays))]
    found = df.withColumns(dict(zip(names, arrays, strict=True))) if arrays else df
    return found.withColumn(out, F.concat(empty, *names)).drop(*names)


def with_found_terms(df: DataFrame, text: str, terms: DataFrame, term: str = "term", others: Sequence[str] = (),
                     out: str = "found", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Add ``out``: an array of ``(term, *others)`` rows of ``terms`` whose term the text contains, each once.

    Missing and empty texts contain nothing. The order within the array is that of the passes and terms.
    """
    schema = _nullable(terms.select(term, *others).schema)
    run, parts = _parts(df, terms, term, others, pass_bytes)
    return _with_arrays(df, [_finder(run, i, p, schema)(F.col(text)) for i, p in enumerate(parts)], schema, out)


def with_counted_terms(df: DataFrame, text: str, border: Column, terms: DataFrame, term: str = "term", others: Sequence[str] = (),
                       out: str = "found", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """:func:`with_found_terms` with the occurrences that do not overlap: ``before, after`` the character ``border`` and ``anywhere``.

    Occurrences that hold that character count only in ``anywhere``. They are counted where they are found, so that a text
    is not searched again for every term it contains.
    """
    schema = _nullable(terms.select(term, *others).schema)
    schema = T.StructType([*schema, *(T.StructField(name, T.IntegerType()) for name in ("before", "after", "anywhere"))])
    run, parts = _parts(df, terms, term, others, pass_bytes)
    return _with_arrays(df, [_counter(run, i, p, schema)(F.col(text), border) for i, p in enumerate(parts)], schema, out)


def with_sums(df: DataFrame, texts: dict[str, Sequence[str]], terms: DataFrame, term: str = "term", out: str = "_sums_{}",
              pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Add for each text column an array: the sums of some whole-number columns of ``terms`` over the rows whose term it contains.

    ``texts`` names those columns for each text column. Every text meets the same automatons, and what a text contains is
    summed where it is found: only the sums leave the worker.
    """
    used = sorted({c for columns in texts.values() for c in columns})
    run, parts = _parts(df, terms, term, used, pass_bytes)
    for text, columns in texts.items():
        arrays = [_summer(run, i, p, columns)(F.col(text)) for i, p in enumerate(parts)]
        names = [f"_pass{i}" for i in range(len(arrays))]
        zero = F.array(*[F.lit(0).cast("bigint") for _ in columns])
        total = zero
        for name in names:
            total = F.zip_with(total, F.col(name), lambda a, b: a + b)
        found = df.withColumns(dict(zip(names, arrays, strict=True))) if arrays else df
        df = found.withColumn(out.format(text), total).drop(*names)
    return df
