"""Copies among images by local descriptors, also cropped or edited ones.

Corners are found at several scales, turned to the direction of their patch's centre of brightness, and described by 256
comparisons of two places each. Each 40 bits of a description are a key of one of six Hamming tables; a copy's corners each
keep some key with good odds, and a picture has many corners. All pairs of pictures with several common keys over all tables
are verified, whatever the size of their buckets: a bucket sends each of its pictures the smaller ones, packed, and a task
counts how often each comes. Corners are matched, and a match's position, scale and direction propose a similarity transform
that enough other matches must follow. For that, pictures are dealt into blocks, and a task gets those that it needs of two
blocks once, with all their pairs. The work grows with the square of a group's size, as do the links.

Images are binary PGM or PPM (P5, P6, 8 bits). Nulls and what can't be read have no corners and stand alone, as do images
with too few corners, unless their bytes are equal. Rows without id are left out; an id that repeats counts once, with its
smallest content hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blocks, checked, components, map_arrow, written

#: Corners at full size: CORNERS, or one for DENSE pixels if that is more. Scales go down by STEP while 16 pixels are left.
CORNERS, RADIUS, STEP, DENSE = 48, 15, 0.72, 85
#: Larger pictures are brought down to this, so that one takes a bounded part of a worker's memory.
MOST_PIXELS = 4 << 20
_rng = np.random.default_rng(20_240_115)
_TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (256, 4)), -RADIUS, RADIUS)
_HEAD = re.compile(rb"\s*(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def read_image(raw: bytes | None) -> np.ndarray | None:
    """Brightness as floats, of at most MOST_PIXELS (larger pictures by means of square blocks); None if it isn't a picture."""
    m = _HEAD.match(raw[:200]) if raw else None
    if not m or int(m[4]) != 255:
        return None
    w, h, deep = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    if len(raw) - m.end() < w * h * deep or not w * h:
        return None
    px = np.frombuffer(raw, np.uint8, w * h * deep, m.end()).reshape(h, w, deep)
    by = int(np.ceil((w * h / MOST_PIXELS) ** 0.5))
    if by > 1 and min(h, w) >= by:
        px = px[: h - h % by, : w - w % by]
        px = sum(px[y::by, x::by].astype(np.float32) for y in range(by) for x in range(by)) / by**2
    px = px.astype(np.float32)
    return px[:, :, 0] if deep == 1 else px @ np.array([0.299, 0.587, 0.114], np.float32)


def write_pgm(px: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (px.shape[1], px.shape[0]) + np.clip(np.round(px), 0, 255).astype(np.uint8).tobytes()


def resized(px: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, over the last two axes."""
    oh, ow = px.shape[-2:]
    y, x = np.clip((np.arange(h) + 0.5) * oh / h - 0.5, 0, oh - 1), np.clip((np.arange(w) + 0.5) * ow / w - 0.5, 0, ow - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, oh - 1), np.minimum(x0 + 1, ow - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0).astype(np.float32)
    rows = px[..., y0, :] * (1 - fy) + px[..., y1, :] * fy
    return rows[..., x0] * (1 - fx) + rows[..., x1] * fx


def _padded(a: np.ndarray, r: int) -> np.ndarray:
    """A stack of pictures with their edges drawn out by r."""
    _, h, w = a.shape
    return a[:, np.arange(-r, h + r).clip(0, h - 1)][:, :, np.arange(-r, w + r).clip(0, w - 1)]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means of squares; each picture of the stack by itself."""
    _, h, w = a.shape
    a = _padded(a, r)
    a = sum(a[:, i : i + h] for i in range(2 * r + 1))
    return sum(a[:, :, i : i + w] for i in range(2 * r + 1)) / np.float32((2 * r + 1) ** 2)


def _top(a: np.ndarray) -> np.ndarray:
    """The most within three places to all sides."""
    a = np.pad(a, ((0, 0), (3, 3), (3, 3)), constant_values=-np.inf)
    for axis in (1, 2):
        for by in (1, 2, 3):
            n = a.shape[axis] - by
            a = np.maximum(a.take(range(n), axis), a.take(range(by, n + by), axis))
    return a


def corners(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, direction) in the full picture's pixels, and 32 bytes of description, for the strongest corners."""
    return all_corners(px[None])[0]


def all_corners(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """corners() of pictures of one size."""
    owners, spots, words = [], [], []
    r = np.arange(-RADIUS, RADIUS + 1)
    dy, dx = (a.ravel() for a in np.meshgrid(r, r, indexing="ij"))
    inside = dy**2 + dx**2 <= RADIUS**2
    dy, dx = dy[inside], dx[inside]
    moments = np.stack([dy, dx], 1).astype(np.float32)
    tests, edge = _TESTS.astype(np.float32), RADIUS + 8
    for s in STEP ** np.arange(32):
        h, w = round(stack.shape[1] * s), round(stack.shape[2] * s)
        if min(h, w) < 16:
            break
        im = _box(stack if s == 1 else resized(stack, h, w), 1)
        gy, gx = np.gradient(im, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        force = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
        least = np.maximum(1e-3, 0.005 * force.max((1, 2), initial=0))
        own, y, x = np.nonzero((force == _top(force)) & (force > least[:, None, None]))
        order = np.lexsort((-force[own, y, x], own))
        place = np.arange(len(own)) - np.searchsorted(own, own)
        order = order[place < max(int(CORNERS * s), h * w // DENSE)]
        own, y, x = own[order], y[order], x[order]
        wide = _padded(im, edge)
        row, flat = wide.shape[2], wide.ravel()
        for at in range(0, len(own), 2048):
            o, v, u = (i[at : at + 2048] for i in (own, y, x))
            middle = (o * wide.shape[1] + v + edge) * row + u + edge
            patch = flat[middle[:, None] + (dy * row + dx)]
            turn = np.arctan2(*((patch - patch.mean(1, keepdims=True)) @ moments).T)
            c, n = np.cos(turn)[:, None], np.sin(turn)[:, None]
            ends = []
            for a, b in ((0, 1), (2, 3)):
                tx, ty = np.rint(tests[:, a] * c - tests[:, b] * n).astype(np.int32), np.rint(tests[:, a] * n + tests[:, b] * c).astype(np.int32)
                np.clip(ty, -edge - v[:, None], h + edge - 1 - v[:, None], out=ty)
                np.clip(tx, -edge - u[:, None], w + edge - 1 - u[:, None], out=tx)
                ends.append(flat[middle[:, None] + ty * row + tx])
            owners.append(o)
            words.append(np.packbits(ends[0] < ends[1], axis=1))
            spots.append(np.stack([(u + 0.5) / s, (v + 0.5) / s, np.full(len(u), 1 / s), turn], 1).astype(np.float32))
    if not owners:
        return [(np.zeros((0, 4), np.float32), np.zeros((0, 32), np.uint8))] * len(stack)
    own, spots, words = np.concatenate(owners), np.concatenate(spots), np.concatenate(words)
    order = np.argsort(own, kind="stable")
    cut = np.searchsorted(own[order], np.arange(1, len(stack)))
    return list(zip(np.split(spots[order], cut), np.split(words[order], cut), strict=True))


def _matches(da: np.ndarray, db: np.ndarray, starts: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a picture's descriptions and those of others, laid end to end from `starts`: (i, j) that are each other's closest,
    of equal ones the first, and at most `near` bits apart; by picture, then i."""
    a, b = np.ascontiguousarray(da).view("<u8"), np.ascontiguousarray(np.ascontiguousarray(db).view("<u8").T)
    # A distance and, below it, whose it is.
    kind, shift = (np.int32, 22) if max(a.shape[0], len(db)) < 1 << 22 else (np.int64, 40)
    rows, columns, step = np.arange(len(a), dtype=kind)[:, None], np.arange(len(db), dtype=kind), max(1, (1 << 15) // len(db))
    best, back = np.empty((len(a), len(starts)), kind), np.full(len(db), np.iinfo(kind).max, kind)
    for at in range(0, len(a), step):
        some = a[at : at + step]
        far = np.bitwise_count(some[:, 0, None] ^ b[0])
        for w in (1, 2):
            far += np.bitwise_count(some[:, w, None] ^ b[w])
        far = np.add(far, np.bitwise_count(some[:, 3, None] ^ b[3]), dtype=kind)
        far <<= shift
        np.minimum(back, (far | rows[at : at + step]).min(0), out=back)
        far |= columns
        np.minimum.reduceat(far, starts, axis=1, out=best[at : at + step])
    whose = (1 << shift) - 1
    j = best & whose
    ok = (best >> shift <= near) & (back[j] & whose == rows)
    picture, i = np.nonzero(ok.T)
    return i, j[i, picture].astype(int)


def _agreed(a: np.ndarray, b: np.ndarray, m: np.ndarray, k: slice, within: float) -> np.ndarray:
    """For each transform of the matches k of a pair, how many of its matches agree; all pairs of a stack. m: what is a match."""
    s, t = b[:, k, 2] / a[:, k, 2], b[:, k, 3] - a[:, k, 3]
    c, n = (s * np.cos(t))[..., None], (s * np.sin(t))[..., None]
    dx, dy = a[:, None, :, 0] - a[:, k, 0, None], a[:, None, :, 1] - a[:, k, 1, None]
    x = b[:, k, 0, None] + c * dx - n * dy - b[:, None, :, 0]
    y = b[:, k, 1, None] + n * dx + c * dy - b[:, None, :, 1]
    return ((x * x + y * y <= ((within * b[:, :, 2]) ** 2)[:, None]) & m[:, None]).sum(2) * m[:, k]


def _could(sa: np.ndarray, sb: np.ndarray, p: np.ndarray, q: np.ndarray) -> int:
    """How many corners could agree on the transform that takes p to q."""
    s, t = q[2] / p[2], q[3] - p[3]
    c, n = s * np.cos(t), s * np.sin(t)
    dx, dy = sa[:, 0] - p[0], sa[:, 1] - p[1]
    there = _inside(q[0] + c * dx - n * dy, q[1] + n * dx + c * dy, sa[:, 2] * s, sb)
    dx, dy, c, n = sb[:, 0] - q[0], sb[:, 1] - q[1], c / s**2, -n / s**2
    return min(there, _inside(p[0] + c * dx - n * dy, p[1] + n * dx + c * dy, sb[:, 2] / s, sa))


def _best(a: np.ndarray, b: np.ndarray, within: float) -> tuple[int, int]:
    """Of the matches of one pair, how many agree on the transform that most agree on, and whose that is."""
    best, at, step = 0, 0, max(1, (1 << 20) // len(a))
    for i in range(0, len(a), step):
        agreed = _agreed(a[None], b[None], np.ones((1, len(a)), bool), slice(i, i + step), within)[0]
        if agreed.max() > best:
            best, at = int(agreed.max()), i + int(agreed.argmax())
    return best, at


def consensus(sa: np.ndarray, da: np.ndarray, sb: np.ndarray, db: np.ndarray, *, near: int = 56, within: float = 3.0) -> tuple[int, int]:
    """How many matched corners agree on one similarity transform, and how many could: the fewer of either picture's corners
    that the transform puts inside the other's, at a scale that the other has."""
    if not len(sa) or not len(sb):
        return 0, 0
    i, j = _matches(da, db, np.zeros(1, int), near)
    if not len(i):
        return 0, 0
    best, at = _best(sa[i], sb[j], within)
    return (best, _could(sa, sb, sa[i[at]], sb[j[at]])) if best else (0, 0)


#: Pairs with up to so many matches are verified in stacks.
STACKS = (8, 12, 16, 24, 32, 48, 64)


def confirmed(sa: np.ndarray, da: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], agree: int, *, near: int = 56, within: float = 3.0) -> Iterator[tuple[int, int]]:
    """(k, n) of those other pictures with n, could = consensus(...) and n >= max(agree, 0.3 * could); no picture without corners."""
    sizes = np.array([len(s) for s, _ in others])
    starts = np.cumsum(sizes) - sizes
    sb = np.concatenate([s for s, _ in others])
    i, j = _matches(da, np.concatenate([d for _, d in others]), starts, near)
    picture = np.searchsorted(starts, j, "right") - 1
    n = np.bincount(picture, minlength=len(others))
    first, row = np.cumsum(n) - n, np.zeros(len(others), int)
    won: list[tuple[int, int, int]] = []
    least = max(agree, 1)
    for low, high in zip((least - 1, *STACKS), STACKS, strict=False):
        of = np.flatnonzero((n > max(low, least - 1)) & (n <= high))
        if not len(of):
            continue
        row[:] = -1
        row[of] = np.arange(len(of))
        at = np.flatnonzero(row[picture] >= 0)
        place = row[picture[at]], at - first[picture[at]]
        a, b, m = np.ones((len(of), high, 4), np.float32), np.ones((len(of), high, 4), np.float32), np.zeros((len(of), high), bool)
        a[place], b[place], m[place] = sa[i[at]], sb[j[at]], True
        agreed = _agreed(a, b, m, slice(None), within)
        won += zip(of.tolist(), agreed.max(1).tolist(), (first[of] + agreed.argmax(1)).tolist(), strict=True)
    for k in np.flatnonzero(n > STACKS[-1]).tolist():
        own = slice(first[k], first[k] + n[k])
        best, at = _best(sa[i[own]], sb[j[own]], within)
        won.append((k, best, int(first[k]) + at))
    for k, best, at in won:
        # No more could agree than either picture has corners.
        if best >= least and (best >= 0.3 * min(len(sa), sizes[k]) or best >= 0.3 * _could(sa, others[k][0], sa[i[at]], sb[j[at]])):
            yield k, best


def _inside(x: np.ndarray, y: np.ndarray, scale: np.ndarray, other: np.ndarray) -> int:
    """How many of these corners lie within the other picture's corners and scales."""
    low, high = other.min(0), other.max(0)
    return int(((x >= low[0]) & (x <= high[0]) & (y >= low[1]) & (y <= high[1]) & (scale >= 0.85 * low[2]) & (scale <= high[2] / 0.85)).sum())


def described(images: DataFrame) -> DataFrame:
    """(id, h1, h2, n, spots, words) of images (id, image)."""
    shape = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("spots", pa.binary()), ("words", pa.binary())])

    def run(batches):
        import xxhash

        for b in blocks(batches, "image", 32 << 20):
            raw = b.column("image").to_pylist()
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x or b"") for x in raw), np.int64).reshape(-1, 2)
            made, sizes = [(np.zeros((0, 4), np.float32), np.zeros((0, 32), np.uint8))] * len(raw), {}

            def describe(stack):
                for i, found in zip(stack, all_corners(np.stack(list(stack.values()))), strict=True):
                    made[i] = found

            for i, x in enumerate(raw):  # pictures of one size together, about half a million pixels at a time
                if (px := read_image(x)) is not None:
                    stack = sizes.setdefault(px.shape, {})
                    stack[i] = px
                    if len(stack) * px.size >= 1 << 19:
                        describe(sizes.pop(px.shape))
            for stack in sizes.values():
                describe(stack)
            yield batch(shape, [b.column("id"), h[:, 0], h[:, 1], [len(s) for s, _ in made], [s.tobytes() for s, _ in made], [w.tobytes() for _, w in made]])

    return map_arrow(images.where("id is not null").select(F.col("id").cast("long"), "image"), run, "id long, h1 long, h2 long, n int, spots binary, words binary")


#: Hamming tables: the first has bytes 0-4 of a description as its key, the next 5-9, and so on.
TABLES, KEY_BYTES = 6, 5


def _key(words: np.ndarray, table: int) -> np.ndarray:
    """A key of KEY_BYTES bytes and the table's number."""
    k = np.full(len(words), table + 1, np.uint64)
    for at in range(KEY_BYTES):
        k = k << np.uint64(8) | words[:, (KEY_BYTES * table + at) % 32]
    return k.view(np.int64)


def _of_images(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and descriptions of all corners of a batch."""
    raw = b.column("words").to_pylist()
    words = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 32)
    return np.repeat(b.column("id").to_numpy(), [len(r) // 32 for r in raw]), words


def _keys(rows: DataFrame) -> DataFrame:
    """(k0, id): the keys of all tables, each once for a picture."""
    shape = pa.schema([("k0", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for big in batches:
            for b in blocks([big], "words", 4 << 20):
                ids, words = _of_images(b)
                for t in range(TABLES):
                    k = _key(words, t)
                    order = np.lexsort((ids, k))
                    k, i = k[order], ids[order]
                    new = np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]))) if len(k) else np.zeros(0, bool)
                    yield batch(shape, [k[new], i[new]])

    return map_arrow(rows.select("id", "words"), run, "k0 long, id long")


def _order(o: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The order by o, which doesn't fall, and then by v; equal pairs in any order."""
    if not len(o):
        return np.zeros(0, int)
    r, low = np.cumsum(np.concatenate(([False], o[1:] != o[:-1]))), int(v.min())
    bits = (int(v.max()) - low).bit_length()
    if bits + int(r[-1]).bit_length() > 62:
        return np.lexsort((v, o))
    return np.argsort(r << bits | (v - low))  # one sort of single numbers takes a fraction of that time


#: A bucket's message to a picture names so many others at most; a picture that has more gets several.
NAMED = 512


def _sharing(keys: DataFrame, common: int) -> DataFrame:
    """(a, b), a > b: all pairs with so many common keys."""
    named = pa.schema([("a", pa.int64()), ("others", pa.binary())])
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def told(k: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole buckets: to each picture the smaller ones, as differences. Buckets of one size go together."""
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        n = np.diff(np.append(start, len(k)))
        out, held = [], 0
        for size in np.unique(n[n > 1]).tolist():
            all_of = start[n == size]
            step = max(1, (1 << 18) // size)
            for at in range(0, len(all_of), step):
                own = ids[all_of[at : at + step, None] + np.arange(size)]
                for j in range(1, size):
                    for low in range(0, j, NAMED):
                        some = own[:, low : min(j, low + NAMED)]
                        out.append((own[:, j], np.diff(some, axis=1, prepend=np.int64(0)).astype("<i8"), some.shape[1]))
                        held += some.size
                        if held > 1 << 19:
                            yield sent(out)
                            out, held = [], 0
        if out:
            yield sent(out)

    def sent(out: list) -> pa.RecordBatch:
        ends = np.cumsum(np.concatenate([[0], *(np.full(len(a), 8 * n) for a, _, n in out)])).astype("<i4")
        data = b"".join(x.tobytes() for _, x, _ in out)
        return batch(named, [np.concatenate([a for a, _, _ in out]), pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])])

    def tell(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("k0").to_numpy(), b.column("id").to_numpy()))
            if held[0][0][0] == held[-1][0][-1]:  # still one bucket
                continue
            k, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(k, k[-1]))
            yield from told(k[:cut], ids[:cut])
            held = [(k[cut:], ids[cut:])]
        if held:
            yield from told(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def count(batches):
        o, v, c = (np.zeros(0, np.int64) for _ in range(3))
        for big in batches:
            for b in blocks([big], "others"):
                raw = b.column("others").to_pylist()
                n = np.array([len(x) // 8 for x in raw], np.int64)
                total = np.cumsum(np.frombuffer(b"".join(raw), "<i8"))
                before = np.concatenate(([0], total))[np.cumsum(n) - n]
                o, v = np.append(o, np.repeat(b.column("a").to_numpy(), n)), np.append(v, total - np.repeat(before, n))
                c = np.append(c, np.ones(len(total), np.int64))
                order = _order(o, v)
                o, v, c = o[order], v[order], c[order]
                new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]))))
                o, v, c = o[new], v[new], np.add.reduceat(c, new)
                whole = o < o[-1]
                yes = whole & (c >= common)
                yield batch(pairs, [o[yes], v[yes]])
                o, v, c = o[~whole], v[~whole], c[~whole]
        yield batch(pairs, [o[c >= common], v[c >= common]])

    dealt = keys.repartition("k0").sortWithinPartitions("k0", "id")
    told_to = map_arrow(dealt, tell, "a long, others binary")
    return map_arrow(told_to.repartition("a").sortWithinPartitions("a"), count, "a long, b long")


def _verified(pairs: DataFrame, d: DataFrame, agree: int, *, block_bytes: int = 32 << 20) -> DataFrame:
    """Those pairs (a, b) that enough corners confirm, with their number."""
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_agree", pa.int32())])

    def run(batches):
        now, held = None, {}

        def of(a: int, wanted: list[int]) -> Iterator[tuple[int, int, int]]:
            """Those of some pairs (a, b), a few thousand corners at a time."""
            at = 0
            while at < len(wanted):
                end, n = at, 0
                while end < len(wanted) and (end == at or n < 2048):
                    n, end = n + len(held[wanted[end]][0]), end + 1
                for k, best in confirmed(*held[a], [held[b] for b in wanted[at:end]], agree):
                    yield a, wanted[at + k], best
                at = end

        for x in batches:
            out, a_now, wanted = [], None, []
            for task, a, b, spots, words in zip(*(x.column(c).to_pylist() for c in ("task", "a", "b", "spots", "words")), strict=True):
                if wanted and (task != now or a != a_now or b is None):
                    out += of(a_now, wanted)
                    wanted = []
                if task != now:
                    now, held = task, {}
                if b is None:
                    held[a] = np.frombuffer(spots, np.float32).reshape(-1, 4), np.frombuffer(words, np.uint8).reshape(-1, 32)
                    continue
                a_now = a
                wanted.append(b)
            if wanted:
                out += of(a_now, wanted)
            yield batch(shape, [list(z) for z in zip(*out, strict=True)] if out else [[], [], []])

    size = d.agg(F.sum(F.octet_length("spots") + F.octet_length("words"))).first()[0] or 0
    n = max(4, -(-size // block_bytes))
    x, y = (F.pmod(F.xxhash64(c), F.lit(n)) for c in ("a", "b"))
    dealt = pairs.select((F.least(x, y) * n + F.greatest(x, y)).alias("task"), "a", "b")
    needed = written(dealt.select("task", F.explode(F.array("a", "b")).alias("id")).distinct())
    needed = d.select("id", "spots", "words").join(checked(needed), "id")
    both = needed.select("task", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "spots", "words").unionByName(dealt, allowMissingColumns=True)
    return map_arrow(both.repartition("task").sortWithinPartitions("task", F.col("b").isNotNull(), "a"), run, "a long, b long, n_agree int")


def links(described_rows: DataFrame, *, common: int = 3, agree: int = 6) -> DataFrame:
    """Verified pairs (a, b, n_agree): all that have so many common keys and so many corners that agree."""
    return _verified(written(_sharing(_keys(described_rows), common)), described_rows, agree)


def classes(images: DataFrame) -> DataFrame:
    """id, class_id (smallest id of the class), n_corners, n_links (verified links of the picture to different ones)."""
    d = written(described(images))
    one = d.groupBy("id").agg(F.min_by(F.struct("h1", "h2", "n"), F.struct("h1", "h2")).alias("x")).select("id", "x.*")
    member = written(one.join(one.groupBy("h1", "h2").agg(F.min("id").alias("rep")), ["h1", "h2"]).select("id", "rep", "n"))
    reps = member.where("id = rep").join(one.select("id", "h1", "h2"), "id").select("id", "h1", "h2")
    pictures = d.join(checked(written(reps)), ["id", "h1", "h2"], "left_semi").where("n > 0")
    if d.groupBy("id").count().where("count > 1").head(1):
        pictures = written(pictures.dropDuplicates(["id"]))
    found = written(links(pictures))
    n = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = member.join(components(found).withColumnRenamed("node", "rep"), "rep", "left").join(n, "rep", "left")
    return out.select("id", F.coalesce("root", "rep").alias("class_id"), F.col("n").alias("n_corners"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def pictured(vectors: DataFrame, *, side: int = 64) -> DataFrame:
    """(id, image) from (vec_id, embedding): the test tables have no pictures, so a vector's values become the brightness of
    a square grid, drawn smoothly as a PGM. Null and empty vectors give null images; odd values count as 0."""
    shape = pa.schema([("id", pa.int64()), ("image", pa.binary())])

    def draw(v: list | None) -> bytes | None:
        if not v:
            return None
        x = np.nan_to_num(np.array([0 if i is None else i for i in v], np.float32), posinf=0, neginf=0)
        n = int(np.ceil(len(x) ** 0.5))
        grid = np.zeros(n * n, np.float32)
        grid[: len(x)] = x
        spread = float(np.abs(x).max()) or 1.0
        return write_pgm(resized(grid.reshape(n, n) / spread * 120 + 128, side, side))

    def run(batches):
        for b in batches:
            yield batch(shape, [b.column("vec_id"), [draw(v) for v in b.column("embedding").to_pylist()]])

    return map_arrow(vectors.select(F.col("vec_id").cast("long"), "embedding"), run, "id long, image binary")
