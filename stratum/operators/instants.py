"""Timestamps in mixed notations and zones, normalised to one instant each."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.runtime import saved, small, widened

MONTHS = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
LONG_MONTHS = "january february march april may june july august september october november december".split()
MONTHS |= {m: k + 1 for k, m in enumerate(LONG_MONTHS)} | {"sept": 9}
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_MON = "|".join(sorted(MONTHS, key=len, reverse=True))
_DAY = "|".join([*DAYS, "mon", "tues?", "wed", "thu(?:rs?)?", "fri", "sat", "sun"])
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap]\.?m\.?))?"
_ZONE = r"(?:\s*(?P<off>(?:(?:utc|gmt)\s*)?[+\-−]\d{1,2}(?::?\d{2})?)|\s*(?P<utc>z|utc|gmt))?(?:\s*\[(?P<zb>[A-Za-z0-9_+\-/]+)\]|\s+(?P<zn>[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+))?"
_TAIL = rf"(?:(?:\s*[tT]\s*|,?\s+){_CLOCK}{_ZONE})?"

# One pattern for each family of notations; "slash" has two readings.
FAMILIES = {
    "iso": rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}}){_TAIL}",
    "year_slash": rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}}){_TAIL}",
    "year_dot": rf"(?P<y>\d{{4}})\.(?P<m>\d{{1,2}})\.(?P<d>\d{{1,2}}){_TAIL}",
    "basic": rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[tT ](?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{_ZONE})?",
    "slash": rf"(?P<d>\d{{1,2}})/(?P<m>\d{{1,2}})/(?P<y>\d{{4}}){_TAIL}",
    "dotted": rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}}){_TAIL}",
    "day_dash": rf"(?P<d>\d{{1,2}})-(?P<mon>{_MON})-(?P<y>\d{{4}}){_TAIL}",
    "day_name": rf"(?:(?P<wd>{_DAY})\.?,?\s+)?(?P<d>\d{{1,2}})\.?\s+(?P<mon>{_MON})\.?,?\s+(?P<y>\d{{4}}){_TAIL}",
    "name_day": rf"(?:(?P<wd>{_DAY})\.?,?\s+)?(?P<mon>{_MON})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}",
    "asctime": rf"(?P<wd>{_DAY})\s+(?P<mon>{_MON})\s+(?P<d>\d{{1,2}})\s+{_CLOCK}(?:\s+(?P<utc>utc|gmt))?\s+(?P<y>\d{{4}})",
}
SCALE = {10: 1_000_000, 13: 1_000, 16: 1}
ASCII_ONLY = r"\A[\x00-\x7f−]+\z"
NUMBER_OF = np.array(list(MONTHS.values()))
DAY_US = 86_400_000_000
EPOCH = datetime(1970, 1, 1)
TABLED = ((1902 - 1970) * 365 * DAY_US, (2037 - 1970) * 365 * DAY_US)  # years whose changes of clocks are tabled; beyond, rules apply


def zone(name: str | None) -> str | None:
    """The name of a time zone, UTC for none, or None if there is no such zone."""
    if not name:
        return "UTC"
    try:
        return ZoneInfo(name).key
    except Exception:  # no such zone
        return None


def to_micros(t: datetime) -> int:
    d = t - EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def exact_utc(wall: datetime, tz: ZoneInfo) -> int:
    """Microseconds of a wall time: the first of two, and the next existing instant for none."""
    before, after = (wall.replace(tzinfo=tz, fold=k).utcoffset() for k in (0, 1))
    if before >= after:
        return to_micros(wall - before)
    lo, hi = to_micros(wall - after), to_micros(wall - before)  # the clocks change in between
    at = lambda us: (EPOCH + timedelta(microseconds=us)).replace(tzinfo=UTC).astimezone(tz).utcoffset()
    lo, hi = lo // 1_000_000 - 1, hi // 1_000_000 + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if at(mid * 1_000_000) >= after else (mid, hi)
    return hi * 1_000_000


def local_to_utc(wall: np.ndarray, tz: str) -> np.ndarray:
    """Microseconds of wall times (microseconds too): the first of two, and the next existing instant for none."""
    far = (wall < TABLED[0]) | (wall >= TABLED[1])
    out = pc.assume_timezone(pa.array(np.where(far, 0, wall)).cast(pa.timestamp("us")), tz, ambiguous="earliest", nonexistent="latest").cast(pa.int64()).to_numpy().copy()
    if far.any():
        key = ZoneInfo(tz)
        out[far] = [exact_utc(EPOCH + timedelta(microseconds=x), key) for x in wall[far].tolist()]
    return out


def _numbers(x: pa.Array) -> np.ndarray:
    """Digits as numbers; 0 for a group that isn't there."""
    return pc.cast(pc.if_else(pc.equal(x, ""), "0", x), pa.int64()).to_numpy(zero_copy_only=False)


def _walls(g: dict[str, pa.Array], y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds of the wall time, whether there is such a time)."""
    ok = (y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first, after = ((month + k).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) for k in (0, 1))
    ok &= d <= after - first
    us = (first + d - 1) * DAY_US
    if "h" in g:
        h, mi, sec = (_numbers(g[k]) for k in ("h", "mi", "s"))
        f = _numbers(pc.ascii_rpad(pc.utf8_slice_codeunits(g["f"], 0, 6), 6, "0")) if "f" in g else np.zeros(len(y), np.int64)
        if "ap" in g:
            half = pc.utf8_lower(pc.utf8_slice_codeunits(g["ap"], 0, 1)).to_numpy(zero_copy_only=False)
            ok &= (half == "") | (h >= 1) & (h <= 12)
            h = np.where(half == "", h, h % 12 + np.where(half == "p", 12, 0))
        midnight = (h == 24) & (mi == 0) & (sec == 0) & (f == 0)
        ok &= ((h < 24) | midnight) & (mi < 60) & (sec < 60) & ~(midnight & (y == 9999) & (m == 12) & (d == 31))
        us = us + ((h * 60 + mi) * 60 + sec) * 1_000_000 + f
    return us, ok


OFFSET = r"(?i)\A(?:(?:utc|gmt)\s*)?(?P<s>[+\-−])(?P<a>\d{1,2}?)(?::?(?P<b>\d{2}))?\z"


def _instants(g: dict[str, pa.Array], wall: np.ndarray, ok: np.ndarray, tz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wall times as instants: by their own offset, else their own zone, else ``tz``."""
    us, ok = wall.copy(), ok.copy()
    text = lambda k: g[k].to_numpy(zero_copy_only=False) if k in g else np.full(len(wall), "", dtype=object)
    off, utc, own = text("off"), text("utc"), text("zb")
    own = np.where(own == "", text("zn"), own)
    given = off != ""
    if given.any():
        o = pc.extract_regex(pa.array(off[given], pa.string()), OFFSET)
        hours, minutes = _numbers(o.field("a")), _numbers(o.field("b"))
        sign = np.where(o.field("s").to_numpy(zero_copy_only=False) == "+", 1, -1)
        us[given] -= sign * (hours * 60 + minutes) * 60_000_000
        ok[given] &= (hours <= 15) & (minutes < 60)
    rest = ok & ~given & (utc == "")
    names = np.where(own == "", tz, own)
    for name in set(names[rest].tolist()):
        at = rest & (names == name)
        key = zone(name)
        if key is None:
            ok[at] = False
        elif key != "UTC":
            us[at] = local_to_utc(us[at], key)
    return us, ok


def interpretations(texts: pa.Array, zones: pa.Array) -> pa.Array:
    """All valid (format, microseconds) readings of each text; none if it isn't a whole, existing date.

    Each family of notations reads all texts that no family before it reads; a text of several
    readings (day or month first) has them all.
    """
    n = len(texts)
    texts = pc.utf8_trim_whitespace(texts.cast(pa.string()))
    tz = np.array(["" if z is None else z for z in zones.to_pylist()], dtype=object)
    us, ok = np.zeros((n, 2), np.int64), np.zeros((n, 2), bool)
    form = np.full((n, 2), "", dtype=object)
    plain = pc.fill_null(pc.match_substring_regex(texts, ASCII_ONLY), False)
    left = np.flatnonzero(plain.to_numpy(zero_copy_only=False))

    part = texts.take(pa.array(left))
    size = pc.utf8_length(part).to_numpy(zero_copy_only=False)
    bare = pc.match_substring_regex(part, r"\A[0-9]+\z").to_numpy(zero_copy_only=False) & (size != 8)
    for k, scale in SCALE.items():
        at = bare & (size == k)
        us[left[at], 0] = _numbers(part.filter(pa.array(at))) * scale
        ok[left[at], 0], form[left[at], 0] = True, f"epoch{k}"
    left = left[~bare]
    for name, pattern in FAMILIES.items():
        if not len(left):
            break
        got = pc.extract_regex(texts.take(pa.array(left)), rf"(?i)\A(?:{pattern})\z")
        hit = got.is_valid().to_numpy(zero_copy_only=False)
        at, left = left[hit], left[~hit]
        if not len(at):
            continue
        got = got.filter(pa.array(hit))
        g = {f.name: got.field(f.name) for f in got.type}
        y, d = _numbers(g["y"]), _numbers(g["d"])
        m = NUMBER_OF[pc.index_in(pc.utf8_lower(g["mon"]), pa.array(list(MONTHS))).to_numpy()] if "mon" in g else _numbers(g["m"])
        for k, (x, z, label) in enumerate(((m, d, SLASH[0]), (d, m, SLASH[1])) if name == "slash" else ((m, d, name),)):
            us[at, k], ok[at, k] = _instants(g, *_walls(g, y, x, z), tz[at])
            form[at, k] = label
    count = ok.sum(1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(form[ok], pa.string()), pa.array(us[ok])], names=["format", "utc_us"]))


SLASH = ("slash_dmy", "slash_mdy")
INVALID = 1 << 32  # cost of a text that is no date under an order; more than any sum of steps back
INF = 1 << 61


def interpreted(raw: DataFrame, datasets: DataFrame) -> DataFrame:
    """Adds ``readings``, array<struct<format, utc_us>>, to (row_id, dataset_id, when_text).

    An unknown dataset or a null tz reads as UTC; a tz that names no zone gives readings only to
    texts with an offset or zone of their own.
    """
    zones = datasets.select("dataset_id", "tz").dropDuplicates(["dataset_id"])
    rows = widened(raw.select("row_id", "dataset_id", "when_text")).join(small(zones, 100_000), "dataset_id", "left")

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), interpretations(b.column(2), b.column(3))], names=["row_id", "dataset_id", "when_text", "readings"])

    return rows.select("row_id", "dataset_id", "when_text", "tz").mapInArrow(run, "row_id bigint, dataset_id string, when_text string, readings array<struct<format:string,utc_us:bigint>>")


def _costs(us: np.ndarray, none: np.ndarray, switch: int, back: int) -> np.ndarray:
    """Costs [row, from order, to order] of the steps between successive rows; us, none: [row, order]."""
    ahead, behind = us[1:, None, :], us[:-1, :, None]
    both = ~none[1:, None, :] & ~none[:-1, :, None]
    cost = np.where(both & (ahead < behind), back, 0).astype(np.int64)
    cost += np.where(none[1:, None, :], INVALID, 0)
    return np.minimum(INF, cost + np.array([[0, switch], [switch, 0]], dtype=np.int64))


def _plus_min(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of 2 x 2 matrices, saturating at INF."""
    return np.minimum(INF, (a[..., :, :, None] + b[..., None, :, :]).min(-2))


def _path_matrix(steps: np.ndarray) -> np.ndarray:
    """Cheapest cost from each first to each last state, by a balanced product of the steps."""
    total = steps
    if not len(total):
        return np.array([[0, INF], [INF, 0]], dtype=np.int64)
    while len(total) > 1:
        odd = total[-1:] if len(total) % 2 else total[:0]
        even = total[: len(total) - len(odd)]
        total = np.concatenate([_plus_min(even[0::2], even[1::2]), odd])
    return total[0]


def _joined(a: tuple, b: tuple, sw: int, back: int) -> tuple:
    """A stretch (matrix, first, last) of a source's rows followed by another."""
    link = _costs(np.stack([a[2][0], b[1][0]]), np.stack([a[2][1], b[1][1]]), sw, back)
    return _path_matrix(np.concatenate([a[0][None], link, b[0][None]])), a[1], b[2]


def _stretches(batches, sw: int, back: int):
    """(dataset_id, piece, matrix, first and last row) of each stretch of rows sorted by source, piece and row."""
    held, out = None, []  # held: (dataset, piece, last row_id, stretch)

    def rows(done) -> pa.RecordBatch:
        edge = lambda e: [None if e[1][x] else int(e[0][x]) for x in (0, 1)]
        cols = [[d for d, *_ in done], [p for _, p, *_ in done], [t[0].ravel().tolist() for *_, t in done], [edge(t[1]) for *_, t in done], [edge(t[2]) for *_, t in done]]
        kinds = [pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["dataset_id", "piece", "m", "first", "last"])

    for b in batches:
        if not b.num_rows:
            continue
        name, piece, row = b.column(0).fill_null("").to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
        void = b.column(0).is_null().to_numpy(zero_copy_only=False)
        us = np.stack([b.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (3, 4)], 1)
        none = np.stack([b.column(k).is_null().to_numpy(zero_copy_only=False) for k in (3, 4)], 1)
        new = np.array([True] + [x != y for x, y in zip(name, name[1:])]) | np.concatenate([[True], (piece[1:] != piece[:-1]) | (void[1:] != void[:-1])])
        starts = np.flatnonzero(new)
        for lo, hi in zip(starts, [*starts[1:], len(row)], strict=True):
            key = (None if void[lo] else name[lo], int(piece[lo]))
            same = held is not None and held[:2] == key
            keep = np.flatnonzero(np.concatenate([[not same or held[2] != row[lo]], row[lo + 1 : hi] != row[lo : hi - 1]])) + lo  # repeats once
            if len(keep):
                u, z = us[keep], none[keep]
                t = (_path_matrix(_costs(u, z, sw, back)), (u[0], z[0]), (u[-1], z[-1]))
                if same:
                    held = (*key, row[hi - 1], _joined(held[3], t, sw, back))
                else:
                    out += [(held[0], held[1], held[3])] if held else []
                    held = (*key, row[hi - 1], t)
        if len(out) >= 1_000:
            yield rows(out)
            out = []
    out += [(held[0], held[1], held[3])] if held else []
    if out:
        yield rows(out)


def slash_order(read: DataFrame, switch: int | None = None, back: int = 1, pieces: int | None = None) -> DataFrame:
    """(dataset_id, row_id, format): the order of day and month of each text with slashes.

    Viterbi over each source's texts in row_id order, those with one reading included. A text costs
    2^32 under an order in which it is no date, a step back in time costs ``back``, a change of order
    ``switch`` (None: not allowed, so that the order in which more texts are dates wins and steps back
    only break ties; equal again: day first). Rows are ranged by source and row_id over tasks, so that
    a source of any size, and with whatever gaps in its ids, is cut in pieces of about equal numbers
    of rows. Min-plus matrices of the paths through a piece combine associatively: matrices per
    piece, one pass over the pieces' matrices, then, if the order may change, a pass back in each piece.
    """
    sw = INF if switch is None else switch
    of = lambda f: F.expr(f"get(filter(readings, r -> r.format = '{f}'), 0).utc_us")
    one = F.expr("get(readings, 0).utc_us")
    slash = F.expr("exists(readings, r -> r.format like 'slash%')")
    rows = read.where("size(readings) > 0").select("dataset_id", "row_id", *[F.when(slash, of(f)).otherwise(one).alias(c) for f, c in zip(SLASH, ("dmy", "mdy"), strict=True)], slash.alias("slash"))
    ranged = rows.repartitionByRange(*[pieces] * (pieces is not None), "dataset_id", "row_id").sortWithinPartitions("dataset_id", "row_id")
    ranged = ranged.select("dataset_id", F.spark_partition_id().cast("bigint").alias("piece"), "row_id", "dmy", "mdy", "slash")
    if switch is not None:
        kept = saved(ranged.dropDuplicates(["dataset_id", "row_id"]), "pieces")
        ranged = kept.repartition("dataset_id", "piece").sortWithinPartitions("dataset_id", "piece", "row_id")
    mats = ranged.mapInArrow(lambda batches: _stretches(batches, sw, back), "dataset_id string, piece bigint, m array<bigint>, first array<bigint>, last array<bigint>")

    def pair(cells: list) -> tuple[np.ndarray, np.ndarray]:
        return np.array([[0 if x is None else x for x in c] for c in cells], dtype=np.int64), np.array([[x is None for x in c] for c in cells])

    def ends(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece")
        ms, firsts, lasts = t["m"].to_pylist(), t["first"].to_pylist(), t["last"].to_pylist()
        cost = np.array([INVALID if x is None else 0 for x in firsts[0]], dtype=np.int64)
        steps = []
        for k, m in enumerate(ms):
            if k:
                link = _costs(*pair([lasts[k - 1], firsts[k]]), sw, back)[0]
                steps.append(np.minimum(INF, cost[:, None] + link))
                cost = steps[-1].min(0)
            steps.append(np.minimum(INF, cost[:, None] + np.array(m, dtype=np.int64).reshape(2, 2)))
            cost = steps[-1].min(0)
        state, picks = int(cost.argmin()), []
        for k in range(len(ms) - 1, -1, -1):
            end = state
            start = int(steps[2 * k][:, end].argmin())
            picks.append((start, end))
            if k:
                state = int(steps[2 * k - 1][:, start].argmin())
        picks.reverse()
        return pa.table({"dataset_id": t["dataset_id"], "piece": t["piece"], "start": pa.array([p[0] for p in picks], pa.int32()), "end": pa.array([p[1] for p in picks], pa.int32())})

    # one row for each piece that a source has rows in
    fixed = mats.groupBy("dataset_id").applyInArrow(ends, "dataset_id string, piece bigint, start int, end int")
    if switch is None:
        by = fixed.groupBy("dataset_id").agg(F.min("start").alias("order")).select(F.col("dataset_id").alias("of"), F.when(F.col("order") == 0, SLASH[0]).otherwise(SLASH[1]).alias("format"))
        return rows.where("slash").select("dataset_id", "row_id").join(by, F.col("dataset_id").eqNullSafe(F.col("of"))).select("dataset_id", "row_id", "format")

    def path(t: pa.Table) -> pa.Table:
        t = t.sort_by("row_id")
        cols = [t["dmy"].combine_chunks(), t["mdy"].combine_chunks()]
        us, none = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in cols], 1), np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in cols], 1)
        start, end = t["start"][0].as_py(), t["end"][0].as_py()
        states = np.full(len(us), end)
        cost, steps = np.array([0 if x == start else INF for x in (0, 1)], dtype=np.int64), []
        for m in _costs(us, none, sw, back):
            steps.append(np.minimum(INF, cost[:, None] + m))
            cost = steps[-1].min(0)
        for k in range(len(steps) - 1, -1, -1):
            states[k] = steps[k][:, states[k + 1]].argmin()
        out = pa.table({"dataset_id": t["dataset_id"], "row_id": t["row_id"], "format": pa.array([SLASH[s] for s in states])})
        return out.filter(t["slash"])

    back_in = kept.alias("p").join(fixed.alias("f"), F.col("p.dataset_id").eqNullSafe(F.col("f.dataset_id")) & (F.col("p.piece") == F.col("f.piece"))).select("p.dataset_id", "p.piece", "row_id", "dmy", "mdy", "slash", "start", "end")
    return back_in.groupBy("dataset_id", "piece").applyInArrow(path, "dataset_id string, row_id bigint, format string")


def normalised(raw: DataFrame, datasets: DataFrame) -> DataFrame:
    """(row_id, utc_us, format): the one instant that each text means.

    A time's own offset counts first, then its own zone name, then the dataset's tz. A wall time that
    occurs twice is its first, one that doesn't exist is the next instant that does, a date alone is
    the start of its local day. Null, blank and other texts that aren't a whole, existing date give
    no row; exact repeats give one. A text may be of any length.
    """
    read = saved(interpreted(raw, datasets).where("size(readings) > 0"), "read")
    slash = F.expr("exists(readings, r -> r.format like 'slash%')")
    plain = read.where(~slash).select("row_id", F.expr("get(readings, 0).utc_us").alias("utc_us"), F.expr("get(readings, 0).format").alias("format"))
    order = slash_order(read).select("dataset_id", "format").distinct()  # one for each dataset
    r, o = read.where(slash).alias("r"), order.alias("o")
    chosen = r.join(small(saved(o, "order"), 100_000).alias("o"), F.col("r.dataset_id").eqNullSafe(F.col("o.dataset_id"))).select("r.row_id", F.expr("get(filter(r.readings, x -> x.format = o.format), 0)").alias("x")).where("x is not null").select("row_id", "x.utc_us", "x.format")
    return plain.unionByName(chosen).distinct()
