"""Arrow helpers for the items of a record: its metric, tag keys, tag values and key=value tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A task holds at most so many partial counts before it passes them on.
FLUSH_ROWS = 1_000_000


def map_parts(column: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(keys, values, row of each entry) of a map column; null maps have no entries."""
    lengths = pc.fill_null(pc.list_value_length(pc.cast(column, pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(pc.cast(column, pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))))
    return flat.field(0), flat.field(1), np.repeat(np.arange(len(column)), lengths)


def last_seen_counts(terms: pa.Array, rows: np.ndarray, shards: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, shards, occurrences, rows) of terms given in order of their rows; nulls are left out.
    Terms are counted apart for each shard, which all entries of a row share for one term.

    Each term's entries are looked at in order of the rows, and a row counts when it differs from the
    one last seen for that term, so no set of rows is ever kept for a term.
    """
    known = np.asarray(pc.is_valid(terms))
    encoded = terms.filter(pa.array(known)).dictionary_encode()
    codes, rows = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows[known]
    wide = 1 if shards is None or not len(shards) else int(shards.max()) + 1
    if wide > 1:
        codes = codes * wide + shards[known]
    order = np.argsort(codes, kind="stable")
    code, row = codes[order], rows[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    fresh = np.ones(len(code), np.int64)
    fresh[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    held = code[starts]
    return encoded.dictionary.take(pa.array(held // wide)), held % wide, np.diff(np.r_[starts, len(code)]), np.add.reduceat(fresh, starts) if len(starts) else fresh[:0]


def _batch_counts(field: str, terms: pa.Array, rows: np.ndarray, shards: np.ndarray | None) -> pa.Table:
    words, shard, occurrences, n_rows = last_seen_counts(terms, rows, shards)
    return pa.table({"field": pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(words), np.int8)), pa.array([field])).cast(pa.string()),
                     "term": words, "shard": shard.astype(np.int64), "occurrences": occurrences.astype(np.int64), "n_rows": n_rows.astype(np.int64)})


def counted(make: Callable[[pa.RecordBatch], Iterator[tuple]]):
    """A mapInArrow function: counts the (field, terms, rows) triples that make gives for each batch, perhaps
    with the shard of each entry as a fourth.

    Gives COUNTED, or with shards SHARDED. Counts of many batches are added up before they leave the
    task; no row spans two batches, so the sums are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, by_shard = 0, False
        for batch in batches:
            for field, terms, rows, *shards in make(batch):
                by_shard = by_shard or bool(shards)
                held.append(_batch_counts(field, terms, rows, shards[0] if shards else None))
                size += len(held[-1])
            if size > FLUSH_ROWS:
                yield from _added(held, by_shard).to_batches(max_chunksize=50_000)
                held, size = [], 0
        if held:
            yield from _added(held, by_shard).to_batches(max_chunksize=50_000)

    return run


COUNTED = "field string, term string, occurrences bigint, n_rows bigint"
SHARDED = "field string, term string, shard bigint, occurrences bigint, n_rows bigint"


def _added(held: list[pa.Table], by_shard: bool) -> pa.Table:
    keys = ["field", "term", "shard"] if by_shard else ["field", "term"]
    total = pa.concat_tables(held).group_by(keys).aggregate([("occurrences", "sum"), ("n_rows", "sum")])
    return total.select([*keys, "occurrences_sum", "n_rows_sum"]).rename_columns([*keys, "occurrences", "n_rows"])


def metric_and_tags(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Metrics, and tags written key=value. A tag with a null value is no item."""
    yield "metric", batch.column("metric"), np.arange(batch.num_rows)
    keys, values, rows = map_parts(batch.column("tags"))
    yield "tag", pc.binary_join_element_wise(keys, values, "="), rows
