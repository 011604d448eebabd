"""Draws of rows by position, moved in packs: a few bytes a draw instead of a row of a table.

* ``draws``   per chunk of requests and block of rows: which request takes which row of the block
* ``found``   per chunk and block: the rows taken, each with the requests that take it
* ``asked``   the requests of a chunk
* ``joined``  every request of a chunk with all its rows

Each is for `mapInArrow`. Chunks are runs of request numbers, blocks are runs of places in a table, so a
task holds one chunk or one block at a time. Packs do not depend on the order of the rows they are made of.
"""

from hashlib import sha256

import numpy as np
import pyarrow as pa

CHUNK = 32_768  # requests at most: their numbers within a chunk fit two bytes
ROWS_OUT = 2_048  # requests in a batch that leaves
BYTES_OUT = 4_000_000  # packs in a batch that leaves


def _runs(batches, *keys):
    """(values of the keys, table) for every run of neighbouring rows with equal keys, none of them NULL."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        turns = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        for start, end in zip([0, *turns], [*turns, batch.num_rows], strict=True):
            now = tuple(v[start] for v in values)
            if held and now != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = now
            held.append(batch.slice(start, end - start))
    if held:
        yield at, pa.Table.from_batches(held)


def _pack(table):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packs):
    return pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in packs])


def positions(keys, n_total, n):
    """`sampling.draw_positions` for many keys (bytes) at once: an array of n places a key, -1 where its table has fewer rows."""
    tails = [b"||%d" % j for j in range(n)]
    digests = b"".join([sha256(key + tail).digest() for key in keys for tail in tails])
    drawn = (np.frombuffer(digests, ">u8")[::4].astype(np.uint64) >> np.uint64(4)).astype(np.int64).reshape(len(keys), n)  # 15 hex digits
    size, out = np.minimum(n, n_total), np.full((len(keys), n), -1, np.int64)
    for j in range(n):
        last = n_total - size + j
        place = drawn[:, j] % np.maximum(last + 1, 1)
        taken = (out[:, :j] == place[:, None]).any(axis=1)
        out[:, j] = np.where(j < size, np.where(taken, last, place), -1)
    return out


def draws(schema, blocks, n, size, salts):
    """Requests (_chunk, _request, _table, _key, n_total) to packs of two arrays: the number of the request in its chunk, the place in the block.

    ``blocks`` has (table, name, rows) of all blocks, table by table in the order of their places.
    """
    starts = np.cumsum([0, *[b[2] for b in blocks]])
    first = {}
    for (table, _, _), start in zip(blocks, starts[:-1], strict=True):
        first.setdefault(table, start)

    def run(batches):
        for (chunk,), table in _runs(batches, "_chunk"):
            base = np.array([first[t] for t in table["_table"].to_pylist()])
            places = positions(table["_key"].cast(pa.binary()).to_pylist(), table["n_total"].to_numpy(), n)
            real = places >= 0
            numbers = np.repeat(table["_request"].to_numpy() % size, n).reshape(places.shape)[real].astype("<u2")
            places = (places + base[:, None])[real]
            order = np.argsort(places)
            numbers, places = numbers[order], places[order]
            cuts = np.searchsorted(places, starts)
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            packs = [numbers[cuts[b]:cuts[b + 1]].tobytes() + (places[cuts[b]:cuts[b + 1]] - starts[b]).astype("<u4").tobytes() for b in full]
            values = {"_block": [blocks[b][1] for b in full], "_salt": [int(chunk) % salts] * len(full), "_chunk": [int(chunk)] * len(full), "_pack": packs}
            yield pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(len(full), f.type) for f in schema], schema=schema)

    return run


def found(schema, columns):
    """Rows of a block in order (with _chunk -1), then its packs of draws, to packs of the rows taken."""
    def run(batches):
        out, size = [], 0
        for (_, _, chunk), table in _runs(batches, "_block", "_salt", "_chunk"):
            if chunk < 0:
                rows = table.select(columns).combine_chunks()
                continue
            packs = [p.as_py() for p in table["_pack"]]
            numbers = np.concatenate([np.frombuffer(p, "<u2", len(p) // 6) for p in packs])
            places = np.concatenate([np.frombuffer(p, "<u4", len(p) // 6, len(p) // 6 * 2) for p in packs])
            if len(packs) > 1:
                order = np.argsort(places)
                numbers, places = numbers[order], places[order]
            turns = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            taken = rows.take(pa.array(places[turns]))
            by = pa.ListArray.from_arrays(pa.array(np.append(turns, len(places)), pa.int32()), pa.array(numbers))
            out.append((int(chunk), _pack(taken.append_column("_by", by))))
            size += len(out[-1][1])
            if size >= BYTES_OUT:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    return run


def asked(schema):
    """Requests to a pack of each chunk of them, columns and all."""
    def run(batches):
        for (chunk,), table in _runs(batches, "_chunk"):
            yield _batch([(int(chunk), None, _pack(table.drop_columns(["_chunk"])))], schema)

    return run


def _batch(rows, schema):
    columns = [*zip(*rows, strict=True)]
    columns += [[None] * len(rows)] * (len(schema) - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def joined(schema, columns, size):
    """Packs of a chunk (_chunk, _found, _asked) to its requests, each with the array of the rows it takes as the last column."""
    def run(batches):
        for _, table in _runs(batches, "_chunk"):
            rows = _unpack(table["_found"].drop_null()).combine_chunks()
            requests = _unpack(table["_asked"].drop_null())
            requests = requests.take(pa.array(np.argsort(requests["_request"].to_numpy())))
            by = rows["_by"].combine_chunks()
            numbers = by.flatten().to_numpy()
            order = np.argsort(numbers, kind="stable")
            row = np.repeat(np.arange(len(by)), np.diff(by.offsets.to_numpy()))[order]
            sizes = np.bincount(numbers, minlength=size)[requests["_request"].to_numpy() % size]
            ends = np.cumsum([0, *sizes])
            for start in range(0, requests.num_rows, ROWS_OUT):
                part, cut = requests.slice(start, ROWS_OUT), ends[start:start + ROWS_OUT + 1]
                some = rows.take(pa.array(row[cut[0]:cut[-1]])).select(columns).combine_chunks()
                struct = pa.StructArray.from_arrays([some[c].combine_chunks() for c in columns], fields=list(schema.field("_rows").type.value_type))
                lists = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in part.select(schema.names[:-1]).columns], lists], names=schema.names)

    return run
