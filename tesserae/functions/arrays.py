"""Block arrays in Arrow batches: numpy over whole batches where array lambdas would be interpreted pixel by pixel.

Every function is a column expression over rows; Spark partitions and shuffles them.  A row
whose array is null, holds a null or has another length than its block gives null.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # the block library needs no installation on executors

INTS, LONGS, FLAGS = (T.ArrayType(t) for t in (T.IntegerType(), T.LongType(), T.BooleanType()))
#: Rows that are computed at once, so that a worker's memory does not follow the batch.
AT_ONCE = 2048


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` values, and which of them are there; the others are zero."""
    size = numbers(pc.fill_null(pc.list_value_length(column), 0))
    flat = column.flatten()
    ok = (size == width) & numbers(column.is_valid())
    start = np.cumsum(size) - size
    if flat.null_count:
        ok &= np.add.reduceat(np.append(numbers(flat.is_null()), False), start) == 0 if len(size) else ok
        flat = pc.fill_null(flat, False if pa.types.is_boolean(flat.type) else 0)
    values = numbers(flat)
    if ok.all():
        return values.reshape(len(ok), width), ok
    out = np.zeros((len(ok), width), dtype=values.dtype)
    out[ok] = values[start[ok][:, None] + np.arange(width)]
    return out, ok


def ragged(n: int, parts: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Array:
    """A list column from (row numbers, one row of values each); rows that no part names are null."""
    size = np.zeros(n, dtype=np.int64)
    mask = np.ones(n, dtype=bool)
    for rows, values in parts:
        size[rows], mask[rows] = values.shape[1], False
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if n else 0, dtype=parts[0][1].dtype if parts else np.int32)
    for rows, values in parts:
        out[(ends - size)[rows][:, None] + np.arange(values.shape[1])] = values
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(out, type=kind), mask=pa.array(mask) if mask.any() else None)


def binary(values: np.ndarray, ok: np.ndarray) -> pa.Array:
    """A binary column of equally long values; null where not ``ok``."""
    width = values.shape[1]
    wide = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(ok), [None, pa.py_buffer(np.ascontiguousarray(values, dtype=np.uint8).tobytes())])
    return pc.if_else(pa.array(ok), wide.cast(pa.binary()), pa.scalar(None, pa.binary()))


def bytes_matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column whose values have ``width`` of them, and which rows do."""
    ok = numbers(pc.fill_null(pc.equal(pc.binary_length(column), width), False))
    data = b"".join(v for v, good in zip(column.to_pylist(), ok) if good)
    out = np.zeros((len(ok), width), dtype=np.uint8)
    out[ok] = np.frombuffer(data, dtype=np.uint8).reshape(int(ok.sum()), width)
    return out, ok


def by_side(side: pa.Array):
    """(side, row numbers) of every block side of a batch, few rows at a time."""
    sides = numbers(side)
    for one in np.unique(sides):
        rows = np.flatnonzero(sides == one)
        for at in range(0, len(rows), AT_ONCE):
            yield int(one), rows[at:at + AT_ONCE]


def pixel_places(side: int, rows: np.ndarray, r: pa.Array, c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """y and x of every pixel of the blocks in ``rows``."""
    p = np.arange(side * side)
    return numbers(r)[rows][:, None] * side + p // side, numbers(c)[rows][:, None] * side + p % side


# -- payload -----------------------------------------------------------------

def low_bytes(block: int):
    """Pixels -> the bytes held in their two low bits."""

    @F.arrow_udf(T.BinaryType())
    def of(px: pa.Array) -> pa.Array:
        values, ok = matrix(px, block * block)
        pairs = (values & 3).astype(np.uint8).reshape(len(ok), block * block // 4, 4)
        return binary(pairs[:, :, 0] << 6 | pairs[:, :, 1] << 4 | pairs[:, :, 2] << 2 | pairs[:, :, 3], ok)

    return of


def high_bytes(block: int):
    """Pixels -> one byte each, the two low bits cleared."""

    @F.arrow_udf(T.BinaryType())
    def of(px: pa.Array) -> pa.Array:
        values, ok = matrix(px, block * block)
        return binary((values & 252).astype(np.uint8), ok)

    return of


def with_low_bytes(block: int):
    """Pixels whose two low bits are taken from bytes."""

    @F.arrow_udf(INTS)
    def of(px: pa.Array, data: pa.Array) -> pa.Array:
        values, ok = matrix(px, block * block)
        given, there = bytes_matrix(data, block * block // 4)
        pairs = np.stack([given >> 6, given >> 4 & 3, given >> 2 & 3, given & 3], axis=2).reshape(len(ok), block * block)
        rows = np.flatnonzero(ok & there)
        return ragged(len(ok), [(rows, (values[rows] & 252 | pairs[rows]).astype(np.int32))], pa.int32())

    return of


# -- backups -----------------------------------------------------------------

def whole(values: np.ndarray) -> np.ndarray:
    """Half-even rounding that ignores float noise past nine decimals."""
    return np.rint(np.round(values, 9))


def encoded_a(block: int, basis: np.ndarray, steps: tuple[int, ...]):
    """Pixels -> leading cosine coefficients of their upper planes in steps, as signed bytes."""

    @F.arrow_udf(T.BinaryType())
    def of(px: pa.Array) -> pa.Array:
        values, ok = matrix(px, block * block)
        coefficients = ((values & 252).astype(np.float64) - 128.0) @ basis.T[:, :len(steps)]
        return binary(np.clip(whole(coefficients / np.array(steps, dtype=np.float64)), -128, 127).astype(np.int8).view(np.uint8), ok)

    return of


def decoded_a(block: int, basis: np.ndarray, steps: tuple[int, ...]):
    """Such bytes -> pixels with cleared low bits."""

    @F.arrow_udf(INTS)
    def of(data: pa.Array) -> pa.Array:
        codes, ok = bytes_matrix(data, len(steps))
        rows = np.flatnonzero(ok)
        raw = (codes[rows].view(np.int8) * np.array(steps, dtype=np.float64)) @ basis[:len(steps)] + 128.0
        return ragged(len(ok), [(rows, np.clip(whole(raw), 0, 255).astype(np.int32) & 252)], pa.int32())

    return of


def encoded_b(block: int, width: int, shift: int):
    """Pixels -> 2x2 means of their upper planes, ``width`` bits each."""
    half = block // 2

    @F.arrow_udf(T.BinaryType())
    def of(px: pa.Array) -> pa.Array:
        values, ok = matrix(px, block * block)
        cells = (values & 252).reshape(len(ok), half, 2, half, 2).sum(axis=(2, 4)).reshape(len(ok), half * half) // 4 >> shift
        bits = cells[:, :, None] >> np.arange(width - 1, -1, -1) & 1
        return binary(np.packbits(bits.reshape(len(ok), half * half * width).astype(np.uint8), axis=1), ok)

    return of


def decoded_b(block: int, width: int, shift: int):
    """Such bits -> pixels with cleared low bits."""
    half = block // 2

    @F.arrow_udf(INTS)
    def of(data: pa.Array) -> pa.Array:
        stored, ok = bytes_matrix(data, width * half * half // 8)
        rows = np.flatnonzero(ok)
        bits = np.unpackbits(stored[rows], axis=1).reshape(len(rows), half, half, width).astype(np.int32)
        cells = (((bits << np.arange(width - 1, -1, -1)).sum(axis=3) << shift) + (1 << (shift - 1))) & 252
        return ragged(len(ok), [(rows, cells.repeat(2, axis=1).repeat(2, axis=2).reshape(len(rows), block * block).astype(np.int32))], pa.int32())

    return of


FIELDS_C = T.StructType([
    T.StructField("desc", T.BinaryType()), T.StructField("mode", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("saturated", "err0", "err1")],
])


def encoded_c(basis: np.ndarray, tables: list[tuple[tuple[int, ...], tuple[float, ...]]]):
    """Upper planes -> both bit tables tried, the one of smaller pixel error kept, the first on a tie."""

    @F.arrow_udf(FIELDS_C)
    def of(px: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in FIELDS_C.names]
        good = []
        for at in range(0, len(px), AT_ONCE):
            m, ok = matrix(px.slice(at, AT_ONCE), basis.shape[0])
            m = m.astype(np.int64)
            tried = []
            for mode, (widths, steps) in enumerate(tables):
                w = np.array(widths)
                s, half = np.where(w > 0, steps, 1.0), (1 << w) // 2
                raw = np.where(w > 0, whole(((m - 128.0) @ basis.T[:, :len(w)]) / s), 0).astype(np.int64)
                q = np.maximum(-half, np.minimum(half - (w > 0), raw))
                back = np.clip(whole((q * s) @ basis[:len(w)] + 128.0), 0, 255).astype(np.int64) & 252
                bits = [np.full((len(m), 1), mode)] + [q[:, [k]] >> np.arange(n - 1, -1, -1) & 1 for k, n in enumerate(widths) if n]
                tried.append((np.packbits(np.concatenate(bits, axis=1).astype(np.uint8), axis=1), (raw != q).sum(axis=1), ((back - m) ** 2).sum(axis=1)))
            detailed = tried[1][2] < tried[0][2]
            both = [np.where(detailed[:, None], tried[1][0], tried[0][0]), detailed.astype(np.int32), np.where(detailed, tried[1][1], tried[0][1]), tried[0][2], tried[1][2]]
            for column, part in zip(columns, both):
                column.append(part)
            good.append(ok)
        ok = np.concatenate(good) if good else np.zeros(0, dtype=bool)
        flat = [binary(np.concatenate(columns[0]), ok) if good else pa.array([], pa.binary())]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        flat += [pa.array(np.concatenate(c) if good else [], type=kind, mask=~ok) for c, kind in zip(columns[1:], kinds)]
        return pa.StructArray.from_arrays(flat, FIELDS_C.names)

    return of


def linear(transform: np.ndarray, before: float, after: float):
    """``(values + before) @ transform + after`` by the leading rows of ``transform``; null in, null out."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def of(values: pa.Array) -> pa.Array:
        parts = []
        for width, rows in by_area(values):
            given, ok = matrix(values.take(pa.array(rows)), width)
            parts.append((rows[ok], ((given[ok].astype(np.float64) + before) @ transform[:width] + after)))
        return ragged(len(values), parts, pa.float64())

    return of


# -- damage ------------------------------------------------------------------

@F.arrow_udf(FLAGS)
def inside_rectangle(r: pa.Array, c: pa.Array, block: pa.Array, y0: pa.Array, x0: pa.Array, y1: pa.Array, x1: pa.Array) -> pa.Array:
    """Pixels of a block inside a rectangle, its far ends excluded."""
    parts = []
    for side, rows in by_side(block):
        y, x = pixel_places(side, rows, r, c)
        a, b, l, h = (numbers(e)[rows][:, None] for e in (y0, y1, x0, x1))
        parts.append((rows, (y >= a) & (y < b) & (x >= l) & (x < h)))
    return ragged(len(block), parts, pa.bool_())


@F.arrow_udf(INTS)
def leading_bytes(data: pa.Array, block: pa.Array) -> pa.Array:
    """The first bytes of 64, one for each pixel."""
    values, ok = bytes_matrix(data, 64)
    parts = [(rows[ok[rows]], values[rows[ok[rows]], :side * side].astype(np.int32)) for side, rows in by_side(block)]
    return ragged(len(block), parts, pa.int32())


@F.arrow_udf(INTS)
def mixed(px: pa.Array, fill: pa.Array, truth: pa.Array, block: pa.Array) -> pa.Array:
    """``fill`` where ``truth`` holds, the pixels elsewhere."""
    parts = []
    for side, rows in by_side(block):
        (a, ok), (b, _), (t, _) = (matrix(v.take(pa.array(rows)), side * side) for v in (px, fill, truth))
        parts.append((rows[ok], np.where(t, b, a)[ok].astype(np.int32)))
    return ragged(len(block), parts, pa.int32())


def ring_sums(width: int):
    """Number, sum and sum of squares of the pixels in a ring around a rectangle, of all pixels, and of a field inside it."""

    @F.arrow_udf(LONGS)
    def of(px: pa.Array, field: pa.Array, r: pa.Array, c: pa.Array, block: pa.Array, y0: pa.Array, x0: pa.Array, y1: pa.Array, x1: pa.Array) -> pa.Array:
        parts = []
        for side, rows in by_side(block):
            y, x = pixel_places(side, rows, r, c)
            a, b, l, h = (numbers(e)[rows][:, None] for e in (y0, y1, x0, x1))
            in_y, in_x = (y >= a) & (y < b), (x >= l) & (x < h)
            near_y = ((y >= a - width) & (y < a)) | ((y >= b) & (y < b + width))
            near_x = ((x >= l - width) & (x < l)) | ((x >= h) & (x < h + width))
            (v, ok), (f, _) = (matrix(k.take(pa.array(rows)), side * side) for k in (px, field))
            v, f = v.astype(np.int64), f.astype(np.int64)
            sums = []
            for values, where in ((v, (near_y & in_x) | (near_x & in_y)), (v, np.ones(v.shape, dtype=bool)), (f, in_y & in_x)):
                sums += [where.sum(axis=1), (values * where).sum(axis=1), (values * values * where).sum(axis=1)]
            parts.append((rows[ok], np.stack(sums, axis=1)[ok].astype(np.int64)))
        return ragged(len(block), parts, pa.int64())

    return of


@F.arrow_udf(INTS)
def matched(field: pa.Array, block: pa.Array, pm: pa.Array, pd: pa.Array, bm: pa.Array, bs: pa.Array) -> pa.Array:
    """A field of mean pm and spread pd brought to bm and bs, down to whole values of 0..255; noise past six decimals is rounded first."""
    parts = []
    for side, rows in by_side(block):
        f, ok = matrix(field.take(pa.array(rows)), side * side)
        m, d, to_m, to_d = (numbers(v)[rows][:, None] for v in (pm, pd, bm, bs))
        value = (f - m) / d * to_d + to_m
        parts.append((rows[ok], np.clip(np.floor(np.floor(value * 1e6 + 0.5) / 1e6), 0, 255)[ok].astype(np.int32)))
    return ragged(len(block), parts, pa.int32())


def _discs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x and presence of the discs of each row."""
    size = numbers(pc.fill_null(pc.list_value_length(column), 0))
    flat, most = column.flatten(), int(size.max(initial=0))
    there = np.arange(most) < size[:, None]
    y, x = np.zeros(there.shape, dtype=np.int64), np.zeros(there.shape, dtype=np.int64)
    y[there], x[there] = numbers(flat.field("y")), numbers(flat.field("x"))
    return y, x, there


@F.arrow_udf(FLAGS)
def inside_discs(r: pa.Array, c: pa.Array, block: pa.Array, discs: pa.Array, radius: pa.Array) -> pa.Array:
    """Pixels of a block inside any of its row's discs."""
    parts = []
    dy, dx, there = _discs(discs)
    square = numbers(radius).astype(np.int64) ** 2
    for side, rows in by_side(block):
        y, x = pixel_places(side, rows, r, c)
        hit = np.zeros(y.shape, dtype=bool)
        for k in range(there.shape[1]):
            a, b = y - dy[rows, k][:, None], x - dx[rows, k][:, None]
            hit |= there[rows, k][:, None] & (a * a + b * b <= square[rows][:, None])
        parts.append((rows, hit))
    return ragged(len(block), parts, pa.bool_())


@F.arrow_udf(T.LongType())
def discs_area(discs: pa.Array, radius: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
    """Pixels of a picture inside any of its discs, counted a strip of rows at a time."""
    dy, dx, there = _discs(discs)
    out = []
    for row, (ri, h, w) in enumerate(zip(*(numbers(v) for v in (radius, height, width)))):
        total, x, strip = 0, np.arange(w), max(1, (1 << 18) // int(w))
        for top in range(0, int(h), strip):
            y = np.arange(top, min(top + strip, int(h)))[:, None]
            hit = np.zeros((len(y), int(w)), dtype=bool)
            for k in np.flatnonzero(there[row]):
                hit |= (y - dy[row, k]) ** 2 + (x - dx[row, k]) ** 2 <= int(ri) ** 2
            total += int(hit.sum())
        out.append(total)
    return pa.array(out, type=pa.int64())


#: Rows of the largest block; kept pixels are told as x * 256 + value.
ROWS, NONE_RIGHT = 8, np.int64(1) << 62


def _kept(px, truth, c, side, rows):
    (v, ok), (t, _) = (matrix(k.take(pa.array(rows)), side * side) for k in (px, truth))
    x = np.broadcast_to(numbers(c)[rows][:, None, None] * side + np.arange(side), (len(rows), side, side))
    v, t = v.reshape(-1, side, side).astype(np.int64), t.reshape(-1, side, side)
    return v, t, x, x * 256 + v, ok


@F.arrow_udf(LONGS)
def outermost_kept(px: pa.Array, truth: pa.Array, c: pa.Array, block: pa.Array) -> pa.Array:
    """For each of eight pixel rows the first kept pixel, then for each the last; -1 where there is none."""
    parts = []
    for side, rows in by_side(block):
        _, t, _, code, _ = _kept(px, truth, c, side, rows)
        first, last = np.where(t, NONE_RIGHT, code).min(axis=2), np.where(t, -1, code).max(axis=2)
        out = np.full((len(rows), 2 * ROWS), -1, dtype=np.int64)
        out[:, :side], out[:, ROWS:ROWS + side] = np.where(first == NONE_RIGHT, -1, first), last
        parts.append((rows, out))
    return ragged(len(block), parts, pa.int64())


@F.arrow_udf(INTS)
def filled_along(px: pa.Array, truth: pa.Array, c: pa.Array, block: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
    """Damaged pixels between the nearest kept ones of their row; ``left`` and ``right`` are those outside the block, -1 for none."""
    parts = []
    for side, rows in by_side(block):
        v, t, x, code, ok = _kept(px, truth, c, side, rows)
        (before, _), (after, _) = (matrix(k.take(pa.array(rows)), ROWS) for k in (left, right))
        low = np.maximum.accumulate(np.maximum(np.where(t, -1, code), before[:, :side, None]), axis=2)
        after = np.where(after < 0, NONE_RIGHT, after)[:, :side, None]
        high = np.minimum.accumulate(np.minimum(np.where(t, NONE_RIGHT, code), after)[:, :, ::-1], axis=2)[:, :, ::-1]
        lx, lv, hx, hv = low >> 8, low & 255, high >> 8, high & 255
        between = np.floor((lv * (hx - x) + hv * (x - lx)) / np.maximum(hx - lx, 1))
        some_low, some_high = low >= 0, high < NONE_RIGHT
        fill = np.where(some_low & some_high, between, np.where(some_low, lv, np.where(some_high, hv, 128)))
        parts.append((rows[ok], np.where(t, fill, v).reshape(len(rows), -1)[ok].astype(np.int32)))
    return ragged(len(block), parts, pa.int32())


def _moved(side, rows, r, c, ncols, dy, dx):
    """Index of the block under each pixel moved by (dy, dx), and the pixel in it."""
    y, x = pixel_places(side, rows, r, c)
    y, x = y + numbers(dy)[rows][:, None], x + numbers(dx)[rows][:, None]
    return (y // side) * numbers(ncols)[rows][:, None] + x // side, (y % side) * side + x % side


@F.arrow_udf(LONGS)
def blocks_under(r: pa.Array, c: pa.Array, block: pa.Array, ncols: pa.Array, dy: pa.Array, dx: pa.Array, truth: pa.Array) -> pa.Array:
    """Distinct indices of the blocks under a block's damaged pixels, moved by (dy, dx)."""
    out: list = [None] * len(block)
    for side, rows in by_side(block):
        under, _ = _moved(side, rows, r, c, ncols, dy, dx)
        t, _ = matrix(truth.take(pa.array(rows)), side * side)
        for at, one, hit in zip(rows, under, t):
            out[at] = np.unique(one[hit])
    return pa.array(out, type=pa.list_(pa.int64()))


@F.arrow_udf(INTS)
def taken_from(r: pa.Array, c: pa.Array, block: pa.Array, ncols: pa.Array, dy: pa.Array, dx: pa.Array, truth: pa.Array, source: pa.Array, px: pa.Array) -> pa.Array:
    """What a block's damaged pixels take from the donor block of index ``source``; -1 where they take nothing."""
    parts = []
    for side, rows in by_side(block):
        under, p = _moved(side, rows, r, c, ncols, dy, dx)
        (t, _), (v, ok) = (matrix(k.take(pa.array(rows)), side * side) for k in (truth, px))
        mine = t & (under == numbers(source)[rows][:, None])
        parts.append((rows[ok], np.where(mine, np.take_along_axis(v, p, axis=1), -1)[ok].astype(np.int32)))
    return ragged(len(block), parts, pa.int32())


@F.arrow_udf(INTS)
def overlaid(px: pa.Array, taken: pa.Array, block: pa.Array) -> pa.Array:
    """Pixels under up to four arrays of them laid end to end, in which -1 is nothing."""
    parts = []
    size = numbers(pc.fill_null(pc.list_value_length(taken), 0))
    for side, rows in by_side(block):
        area = side * side
        v, ok = matrix(px.take(pa.array(rows)), area)
        v = v.copy()
        for n in np.unique(size[rows]):
            if n:
                at = np.flatnonzero(size[rows] == n)
                over = matrix(taken.take(pa.array(rows[at])), int(n))[0].reshape(len(at), -1, area).max(axis=1)
                v[at] = np.where(over >= 0, over, v[at])
        parts.append((rows[ok], v[ok].astype(np.int32)))
    return ragged(len(block), parts, pa.int32())


# -- fidelity ----------------------------------------------------------------

def by_area(column: pa.Array):
    """(values, row numbers) of every length of array in a batch, few rows at a time."""
    size = numbers(pc.fill_null(pc.list_value_length(column), -1))
    for one in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == one)
        for at in range(0, len(rows), AT_ONCE):
            yield int(one), rows[at:at + AT_ONCE]


@F.arrow_udf(LONGS)
def errors(before: pa.Array, repaired: pa.Array, px: pa.Array, truth: pa.Array) -> pa.Array:
    """Damaged pixels, and squared errors of the repaired block, of the received one, and of the repaired one inside the damage."""
    parts = []
    for area, rows in by_area(px):
        (a, ok), (b, ok_b), (c, ok_c), (t, ok_t) = (matrix(v.take(pa.array(rows)), area) for v in (before, repaired, px, truth))
        d, e = (a.astype(np.int64) - b) ** 2, (a.astype(np.int64) - c) ** 2
        out = np.stack([t.sum(axis=1), d.sum(axis=1), e.sum(axis=1), (d * t).sum(axis=1)], axis=1).astype(np.int64)
        there = ok & ok_b & ok_c & ok_t
        parts.append((rows[there], out[there]))
    return ragged(len(px), parts, pa.int64())


@F.arrow_udf(LONGS)
def change_masks(px: pa.Array, before: pa.Array, truth: pa.Array) -> pa.Array:
    """Number of pixels of a block, bits of the damaged and of the unchanged ones (64 at most), and 1 where no upper plane changed."""
    parts = []
    for area, rows in by_area(px):
        (a, ok), (b, ok_b), (t, ok_t) = (matrix(v.take(pa.array(rows)), area) for v in (px, before, truth))
        bits = lambda m: np.packbits(np.pad(m.astype(bool), ((0, 0), (0, 64 - area))), axis=1, bitorder="little").view("<i8")[:, 0]
        out = np.stack([np.full(len(rows), area), bits(t), bits(a == b), (a & 252 == b & 252).all(axis=1)], axis=1).astype(np.int64)
        there = ok & ok_b & ok_t
        parts.append((rows[there], out[there]))
    return ragged(len(px), parts, pa.int64())


# -- structural similarity ---------------------------------------------------

def row_sums(side: int, window: int):
    """Sums of a, b, aa, bb and ab over ``window`` pixels along each row, one after another; -1 where they leave the page."""
    half = window // 2

    def padded(own, left, right):
        return [np.concatenate([m.reshape(-1, side, side)[:, :, cut] for m, cut in ((left, slice(side - half, None)), (own, slice(None)), (right, slice(0, half)))], axis=2)]

    @F.arrow_udf(INTS)
    def of(a_left: pa.Array, a: pa.Array, a_right: pa.Array, b_left: pa.Array, b: pa.Array, b_right: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(a), AT_ONCE):
            (al, l), (ao, ok), (ar, r), (bl, _), (bo, ok_b), (br, _) = (matrix(v.slice(at, AT_ONCE), side * side) for v in (a_left, a, a_right, b_left, b, b_right))
            x, y = padded(ao, al, ar)[0].astype(np.int32), padded(bo, bl, br)[0].astype(np.int32)
            there = np.concatenate([np.repeat(l[:, None], half, axis=1), np.ones((len(l), side), dtype=bool), np.repeat(r[:, None], half, axis=1)], axis=1)
            valid = np.logical_and.reduce([there[:, d:d + side] for d in range(window)])[:, None, :]
            out = [np.where(valid, sum(m[:, :, d:d + side] for d in range(window)), -1) for m in (x, y, x * x, y * y, x * y)]
            rows = np.flatnonzero(ok & ok_b)
            parts.append((rows + at, np.stack(out, axis=1).reshape(len(l), -1)[rows].astype(np.int32)))
        return ragged(len(a), parts, pa.int32())

    return of


SIMILARITIES = T.StructType([T.StructField(f"{name}_{of}", kind) for name in ("ssim", "opt", "pes") for of, kind in (("sum", T.DoubleType()), ("n", T.LongType()))])


def similarity_sums(side: int, window: int, c1: float, c2: float):
    """Sum and number of the similarities of a block's windows: all, those in the kept truth, those in the truth."""
    half, n = window // 2, window * window

    @F.arrow_udf(SIMILARITIES)
    def of(h_up: pa.Array, h: pa.Array, h_down: pa.Array, truth: pa.Array, keep: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(h), AT_ONCE):
            (up, u), (own, ok), (down, d) = (matrix(v.slice(at, AT_ONCE), 5 * side * side) for v in (h_up, h, h_down))
            up, own, down = (m.reshape(-1, 5, side, side) for m in (up, own, down))
            up, down = np.where(u[:, None, None, None], up, -1), np.where(d[:, None, None, None], down, -1)
            tall = np.concatenate([up[:, :, side - half:], own, down[:, :, :half]], axis=2)
            valid = ok[:, None, None] & np.logical_and.reduce([tall[:, 0, k:k + side] >= 0 for k in range(window)])
            sa, sb, saa, sbb, sab = (sum(tall[:, m, k:k + side].astype(np.float64) for k in range(window)) for m in range(5))
            var = lambda x, y, xy: (n * xy - x * y) / (n * (n - 1))
            ua, ub = sa / n, sb / n
            value = ((2 * ua * ub + c1) * (2 * var(sa, sb, sab) + c2)) / ((ua * ua + ub * ub + c1) * (var(sa, sa, saa) + var(sb, sb, sbb) + c2))
            hit = valid & matrix(truth.slice(at, AT_ONCE), side * side)[0].reshape(valid.shape).astype(bool)
            kept = hit & numbers(pc.fill_null(keep.slice(at, AT_ONCE), False)).astype(bool)[:, None, None]
            found.append([x for where in (valid, kept, hit) for x in (np.where(where, value, 0.0).sum(axis=(1, 2)), where.sum(axis=(1, 2)))])
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[]] * 6
        return pa.StructArray.from_arrays([pa.array(c, type=pa.float64() if k % 2 == 0 else pa.int64()) for k, c in enumerate(columns)], SIMILARITIES.names)

    return of
