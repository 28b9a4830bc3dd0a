"""Template residue, filler and error or script notices, by character n-gram likelihood ratios."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm import residue_seeds as seeds
from stratum.runtime import process_cache

ORDER = 5  # characters of an n-gram of running text
SHAPE_ORDER = 4  # signs of an n-gram of shapes, in which a word or a number is one sign
BUCKETS = SHAPE_BUCKETS = 1 << 20
PROSE_FLOOR, RESIDUE_FLOOR = 1e-7, 5e-8  # share given to an n-gram that a model hasn't seen
SHAPE_FLOOR = 2e-6
UNSEEN_SIGN = 0.02  # share of a sign that the slot model hasn't seen among signs alike
DISCUSSED = 0.05  # share of the prose model that comes from sentences that talk about residue
DISCUSSED_SHAPES = 0.2  # the same for shapes: of sentences with names in code, lists, sets, tags and payloads
CLIP = 5.0
SEGMENT = 0.9  # mean log ratio from which a sentence or line is residue
WINDOWS = [(26, 1.75, True), (14, 3.2, False)]  # for residue inside a sentence: characters of a window, its mean log ratio, whether it slides or begins the sentence
WORD_WINDOW, IN_WORD = 6, 4.5  # for one word that stands for a missing value: its n-grams and their mean log ratio under the slot model
SLOT_WINDOW, IN_SLOT, SLOT_ODDS = 3, 4.5, 1.0  # for a slot: n-grams of shapes in a window, the sum of their log ratios, and the mean over the slot itself
HEAVY = 1e-3  # share of all segments that copies of one segment make up at most in the prose model
MIN_CHARS = 2  # characters of residue from which a document is left out
CHUNK = 200_000  # characters that are looked at at once

SEP = "\ue000"
_LETTER, _UPPER, _DIGIT, _SPACE = 97, 65, 48, 32


_ENDER, _CLOSER, _LEAD, _GAP, _ALPHA, _PAUSE = 1, 2, 4, 8, 16, 32


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, properties, kind of sign) of the characters below U+10000; those above count as signs."""
    held = process_cache().get("residue_tables")
    if held is None:
        kind, has = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.uint8)
        for k in range(1 << 16):
            c = chr(k)
            if c.isspace() or c == SEP:
                kind[k] = _SPACE
                has[k] = _GAP | _LEAD
            elif c.isalpha():
                kind[k] = _UPPER if c.isupper() else _LETTER
                has[k] = _ALPHA
            elif c.isdigit():
                kind[k] = _DIGIT
        for chars, flag in ((".!?…", _ENDER), ("\"')]", _CLOSER), ("\"')]-*>#", _LEAD), (".()«»“”„\"'", _PAUSE)):
            for c in chars:
                has[ord(c)] |= flag
        wide = np.full(1 << 16, 42, dtype=np.uint32)
        for c in ("{[<", "}]>"):
            wide[[ord(x) for x in c]] = ord(c[0])
        wide[[_SPACE, _LETTER, _UPPER, _DIGIT, 82, *map(ord, ",;:/.-'\"«»()&|")]] = 0  # stand for themselves
        held = process_cache()["residue_tables"] = (kind, has, wide)
    return held


class Page:
    """Texts side by side as arrays of characters: classes, segments and the n-grams of both models."""

    def __init__(self, texts: list[str]):
        clean = [t.replace(SEP, " ").replace("İ", "I") for t in texts]
        self.text = SEP + SEP.join(f" {t} " for t in clean) + SEP
        self.starts = np.cumsum([2, *(len(t) + 3 for t in clean)])[:-1]  # of each text
        self.code = np.frombuffer(self.text.encode("utf-32-le", "replace"), dtype=np.uint32)
        low = np.frombuffer(self.text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        kind, has, _ = _tables()
        at = np.minimum(self.code, 65_535)
        self.kind, self.has = kind[at], has[at]
        self.kind = np.where(self.code < 65_536, self.kind, self.code) if (self.code > 65_535).any() else self.kind
        self.plain = np.where((self.kind == _DIGIT) | (self.kind == _SPACE), self.kind, low if len(low) == len(self.code) else self.code)

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the pieces between ends of sentences, lines and tags, without bullets and the like."""
        c, k = self.code, self.kind
        n = len(c)
        p = np.flatnonzero(self.has & _ENDER)
        after = [np.where(p + j < n, self.has[np.minimum(p + j, n - 1)], _GAP) for j in (1, 2, 3)]
        gap, shut = [x & _GAP > 0 for x in after], [x & _CLOSER > 0 for x in after]
        stop = p[gap[0] | shut[0] & (gap[1] | shut[1] & gap[2])]
        cut = np.concatenate([stop + 1, np.flatnonzero((c == 10) | (c == 13) | (c == 0xE000)), *[list(x) for x in self._tags()]]).astype(np.int64)
        cut = np.unique(cut)
        a, b = cut[:-1].copy(), cut[1:].copy()
        lead = self.has & _LEAD > 0
        for _ in range(3):
            for _ in range(12):
                move = (a < b) & lead[np.minimum(a, n - 1)]
                if not move.any():
                    break
                a += move
            at = np.minimum(a, n - 6)
            note = (c[at] == 78) & (c[at + 1] == 111) & (c[at + 2] == 116) & (c[at + 3] == 101) & (c[at + 4] == 58)
            cited = (c[at] == 91) & (c[at + 1] == 80)
            digits = 2 + np.argmin(np.stack([c[np.minimum(at + j, n - 1)] - 48 < 10 for j in range(2, 7)]), axis=0)
            cited &= c[np.minimum(at + digits, n - 1)] == 93
            if not (note | cited).any():
                break
            a = np.where(a < b, np.minimum(b, a + np.where(note, 5, np.where(cited, digits + 1, 0))), a)
        for _ in range(12):
            move = (b > a) & (k[np.maximum(b - 1, 0)] == _SPACE)
            if not move.any():
                break
            b -= move
        ok = b > a
        return a[ok], b[ok]

    def _tags(self) -> list[tuple[int, int]]:
        out = []
        for p in np.flatnonzero(self.code == 60).tolist():
            e = self.text.find(">", p, p + 83)
            body = self.text[p + 1 : e].removeprefix("/") if e > 0 else ""
            if body[:1].isascii() and body[:1].isalpha() and not ("<" in body or "\n" in body or SEP in body):
                out.append((p, e + 1))
        return out

    def grams(self) -> np.ndarray:
        """Bucket of the n-gram of running text that begins at each character."""
        return _hashed(self.plain, ORDER, BUCKETS)

    def shapes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, bucket, bucket with signs alike) of the n-grams of shapes: words and numbers are one sign each, the rest stands for itself.

        Brackets, quotes and full stops beside a gap are part of it. A letter three or more times in a row is a sign of its own, as in runs of X.
        """
        k, c = self.kind, self.code
        gap = k == _SPACE
        left, right = np.concatenate([[True], gap[:-1]]), np.concatenate([gap[1:], [True]])
        k = np.where((self.has & _PAUSE > 0) & (left | right), np.uint32(_SPACE), k)
        word = (k == _UPPER) | (k == _LETTER) | (k == _DIGIT) | (k == _SPACE)
        k = np.where((k == _UPPER) & np.append(k[1:] == _LETTER, False), np.uint32(_LETTER), k)  # a capital that begins a word
        same = np.concatenate([[False], c[1:] == c[:-1]])
        run = same & np.append(same[1:], False) & ((k == _UPPER) | (k == _LETTER))
        run[:-1] |= run[1:]
        run[1:] |= run[:-1] & same[1:]
        k[run] = 82
        keep = np.concatenate([[True], k[1:] != k[:-1]]) | ~word & ~run
        at = np.flatnonzero(keep)
        k = k[at]
        wide = _tables()[2][np.minimum(k, 65_535)]  # any sign alike
        return at[: max(0, len(at) - SHAPE_ORDER + 1)], _hashed(k, SHAPE_ORDER, SHAPE_BUCKETS), _hashed(np.where(wide == 0, k, wide), SHAPE_ORDER, SHAPE_BUCKETS)

    def digests(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each piece [a, b), that case, digits and kinds of white space don't change."""
        power, inverse = _powers(len(self.plain) + 1)
        x = self.plain.astype(np.uint64)
        with np.errstate(over="ignore"):
            x = (x ^ np.uint64(0x9E37)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)])
            return (total[b] - total[a]) * inverse[a]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = process_cache().get("residue_powers")
    if held is None or len(held[0]) < n:
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            held = process_cache()["residue_powers"] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(v))]), dtype=np.uint64) for v in (base, pow(base, -1, 1 << 64)))
    return held


def _hashed(c: np.ndarray, order: int, size: int) -> np.ndarray:
    n = len(c) - order + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(order):
            h ^= c[k : k + n]
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
    return (h & np.uint32(size - 1)).astype(np.int64)


def pages(column: pa.Array):
    """(first row, Page) for runs of rows of at most about CHUNK characters; null texts are empty ones."""
    held, first, size = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        held.append(t or "")
        size += len(held[-1]) + 3
        if size >= CHUNK:
            yield first, Page(held)
            held, first, size = [], i + 1, 0
    if held:
        yield first, Page(held)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = Page(texts)
    return np.bincount(p.grams(), minlength=BUCKETS).astype(float), *(np.bincount(g, minlength=SHAPE_BUCKETS).astype(float) for g in p.shapes()[1:])


def _share(counts: np.ndarray) -> np.ndarray:
    return counts / max(1.0, counts.sum())


def _texts(documents: DataFrame, text: str) -> DataFrame:
    return documents.select(F.col(text).cast("string").alias(text)).where(f"{text} is not null and trim({text}) <> ''")


def heavy_segments(documents: DataFrame, text: str = "text", share: float = HEAVY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, weight, n): segments that make up more than ``share`` of all; at most 1 / share of them.

    weight: what an occurrence counts for, so that all of them together count as ``share``.
    """

    def run(batches):
        for b in batches:
            got = [p.digests(*p.segments()) for _, p in pages(b.column(0))]
            names, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.record_batch([pa.array([*names.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), int(n.sum())], pa.int64())], names=["digest", "n"])

    most = int(1 / share) + 1
    top = _texts(documents, text).mapInArrow(run, "digest bigint, n bigint").groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("digest")).limit(most + 1).collect()
    total = top[0]["n"] if top else 0  # the row of null, which counts all
    cap = max(share * total, 3)
    top = [r for r in top if r["digest"] is not None and r["n"] > cap]
    digest = np.array([r["digest"] for r in top], dtype=np.int64).view(np.uint64)
    weight = np.floor(cap / np.array([r["n"] for r in top], dtype=float) * 1024) / 1024  # of 1024ths, so that sums don't depend on their order
    order = np.argsort(digest)
    return digest[order], np.maximum(weight[order], 1 / 1024), np.array([r["n"] for r in top], dtype=float)[order]


def corpus_counts(documents: DataFrame, text: str = "text", heavy: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """n-gram counts of all documents, of running text and of shapes, and the texts of the ``heavy`` segments.

    Heavy segments count by their weight. Every partition adds up its own counts; what reaches the
    driver is bounded by the two tables of fixed size and the number of heavy segments.
    """
    digest, weight = heavy[:2] if heavy is not None else (np.empty(0, np.uint64), np.empty(0))
    shared = documents.sparkSession.sparkContext.broadcast((digest, weight))

    def run(batches):
        sums, held = [np.zeros(BUCKETS), np.zeros(SHAPE_BUCKETS)], {}
        digest, weight = shared.value
        for b in batches:
            for _, p in pages(b.column(0)):
                g, (at, s, _) = p.grams(), p.shapes()
                w = None
                if len(digest):
                    x, y = p.segments()
                    d = p.digests(x, y)
                    k = np.minimum(np.searchsorted(digest, d), len(digest) - 1)
                    hit = digest[k] == d
                    if hit.any():
                        step = np.zeros(len(p.code) + 1)
                        np.add.at(step, x[hit], weight[k[hit]] - 1)
                        np.add.at(step, y[hit], 1 - weight[k[hit]])
                        w = 1 + np.cumsum(step)
                        for j in np.flatnonzero(hit).tolist():
                            if k[j] not in held:
                                held[int(k[j])] = p.text[x[j] : y[j]]
                sums[0] += np.bincount(g, None if w is None else w[: len(g)], BUCKETS)
                sums[1] += np.bincount(s, None if w is None else w[at], SHAPE_BUCKETS)
        both = np.concatenate(sums)
        at = np.flatnonzero(both)
        names = np.concatenate([at, -1 - np.array(sorted(held), dtype=np.int64)]).astype(np.int32)
        yield pa.record_batch([pa.array(names), pa.array(np.concatenate([both[at], np.zeros(len(held))])), pa.array([None] * len(at) + [held[k] for k in sorted(held)], pa.string())], names=["bucket", "n", "segment"])

    rows = _texts(documents, text).mapInArrow(run, "bucket int, n double, segment string").groupBy("bucket").agg(F.sum("n").alias("n"), F.min("segment").alias("segment")).toPandas()
    both, seen = np.zeros(BUCKETS + SHAPE_BUCKETS), rows["bucket"].to_numpy()
    both[seen[seen >= 0]] = rows["n"].to_numpy()[seen >= 0]
    texts = dict(zip(seen[seen < 0].tolist(), rows["segment"][seen < 0], strict=True))
    return both[:BUCKETS], both[BUCKETS:], [texts.get(-1 - k) for k in range(len(digest))]


class Model:
    """Log ratios of residue to prose: n-grams of running text, of words that stand for a value, and of slot shapes."""

    def __init__(self, prose: np.ndarray, shapes: np.ndarray, wraps: list[tuple[str, str]] | None = None):
        about, about_shape, _ = _counted(seeds.discussion())
        bare, slot = _counted(seeds.bare()), _counted(seeds.slots(wraps))
        residue = np.max([_share(_counted(k)[0]) for k in (seeds.filler(), seeds.errors(), seeds.scripts())] + [_share(bare[0])], axis=0)
        self.text = self._ratio(residue, RESIDUE_FLOOR, (1 - DISCUSSED) * _share(prose) + DISCUSSED * _share(about), PROSE_FLOOR)
        self.word = self._ratio(_share(bare[0]), RESIDUE_FLOOR, (1 - DISCUSSED) * _share(prose) + DISCUSSED * _share(about), PROSE_FLOOR)
        log = lambda x: np.log(x + SHAPE_FLOOR).astype(np.float32)
        self.slot = log(np.maximum(_share(slot[1]), _share(bare[1])))
        self.any_slot = log(UNSEEN_SIGN * _share(slot[2]))
        self.no_slot = log((1 - DISCUSSED_SHAPES) * _share(shapes) + DISCUSSED_SHAPES * _share(about_shape))

    def shape(self, exact: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Log ratios of slots to prose; signs that the slot model hasn't seen have a share of what it has seen of signs alike."""
        return np.clip(np.maximum(self.slot[exact], self.any_slot[wide]) - self.no_slot[exact], -CLIP, CLIP)

    @staticmethod
    def _ratio(r: np.ndarray, r_floor: float, p: np.ndarray, p_floor: float) -> np.ndarray:
        return np.clip(np.log((r + r_floor) / (p + p_floor)), -CLIP, CLIP).astype(np.float32)


def fit(documents: DataFrame, text: str = "text", wraps: list[tuple[str, str]] | None = None) -> Model:
    """The models of residue and prose.

    Residue models are fitted on generated phrases (:mod:`residue_seeds`), one share each for filler,
    error notices, script notices and words that stand for a missing value, and on generated slots;
    the prose models on all documents and, for a small share, on sentences that talk about such
    things. A first model counts no segment for more than HEAVY of all, however many documents repeat
    it, so that frequent residue doesn't become prose; frequent segments that are no residue by that
    model count in full in the second.
    """
    heavy = heavy_segments(documents, text)
    prose, shapes, texts = corpus_counts(documents, text, heavy)
    first = Model(prose, shapes, wraps)
    for t, w, n in zip(texts, heavy[1], heavy[2], strict=True):
        if t:
            p = Page([t])
            g = p.grams()
            if len(g) < 3 or first.text[g].mean() < SEGMENT:
                prose += np.bincount(g, minlength=BUCKETS) * n * (1 - w)
                shapes += np.bincount(p.shapes()[1], minlength=SHAPE_BUCKETS) * n * (1 - w)
    return Model(prose, shapes, wraps)


OPENING, CLOSING = "'\"`“„‘‹", "'\"`”’›“"
FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)


def _quoted(text: str, a: int, b: int, marks: str = "«»") -> bool:
    """Whether text[a:b] stands in quotes, or in back-ticks that open and close on its line."""
    left, right = text[max(0, a - 9) : a].rstrip(" ")[-1:], text[b : b + 9].lstrip(" .,")[:1]
    if left and right and left in OPENING + marks[:1] and right in CLOSING + marks[1:]:
        return True
    if "`" not in text[max(0, a - 2_000) : a]:
        return False
    line = text.rfind("\n", 0, a) + 1
    return text.count("`", line, a) % 2 == 1 and "`" in text[b : (text.find("\n", b) + 1 or len(text) + 1)]


_MARK = r"[^\w\s.,:;\"'`«»“”„()/\\\-&]"
_INNER = rf"[^\W_](?:[\w.\-]|(?:: | |:|\[)(?=\w)|\](?=[^\s\]])|\] ?(?={_MARK})){{0,40}}?"
FORM = re.compile(rf"(?=(?P<all>%[a-z](?!\w)|(?P<one>[^\W\d]|_)(?P=one){{2,}}|(?<![\w:]):[\w.]+:(?![\w:])|(?P<open>&lt;|(?<!\w)_{{1,3}}|{_MARK}{{1,3}}\(?) ?=? ?{_INNER} ?(?P<close>&gt;|_{{1,3}}(?!\w)|\)[a-z]|{_MARK}{{1,3}})))")
MIRROR = dict(zip("{[<(;", "}]>)&", strict=True))


def _stands(text: str, a: int, b: int, word: bool, odds) -> list[tuple[int, int]]:
    """Exact check of a place where a model found slots: the slots in it.

    A slot has marks on both sides that mirror each other (or is a ``word`` that stands for a value, a
    sign and a letter, or one letter again and again) and is likelier a slot than prose by ``odds``,
    the mean log ratio of a place; it is no part of a word, isn't quoted or code, and is no variable
    of the system and no field of a log.
    """
    lo, hi = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    lo, hi = max(lo, a - 40), min(hi if hi >= 0 else len(text), b + 40)
    out, upto = [], 0
    for x, y, o, c in [(a, b, "", "")] if word else [(*m.span("all"), m["open"], m["close"]) for m in FORM.finditer(text, lo, hi) if m.end("all") > a and m.start() < b]:
        o = o.rstrip("=") if o else o
        if x < upto or o and MIRROR.get(o[-1], o[-1]) != c[0]:
            continue
        if not word and (x and text[x - 1].isalnum() or text[y : y + 1].isalnum() or odds(x, y) < SLOT_ODDS):
            continue
        upto = y
        if _quoted(text, x, y, "") or any(m.start() <= x < m.end() for m in (FENCE.finditer(text) if "```" in text else ())):
            continue
        name = re.sub(r"\W+", " ", text[x:y]).strip().split(" ")[0]
        if not (name in seeds.NOT_SLOTS or text[x : x + 2] == "%(" and name in seeds.LOGGED):
            out.append((x, y))
    return out


def _runs(hit: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """(first, last + reach) of runs of places no more than ``reach`` apart."""
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > reach) + 1
    return [(int(x[0]), int(x[-1]) + reach) for x in np.split(hit, cut)]


def _over(up: np.ndarray, size: int, least: float) -> np.ndarray:
    """Starts of windows of ``size`` n-grams whose log ratios add up to at least ``least``."""
    return np.flatnonzero(up[size:] - up[:-size] >= least) if len(up) > size else np.empty(0, dtype=np.int64)


def page_spans(p: Page, model: Model) -> list[tuple[int, int, int, str]]:
    """(text, begin, end, kind) of residue: ``notice`` (filler, errors, scripts) or ``slot``."""
    out: list[tuple[int, int, int, str]] = []
    g = p.grams()
    up = np.concatenate([[0.0], np.cumsum(model.text[g], dtype=np.float64)])
    a, b = p.segments()
    alpha = np.concatenate([[0], np.cumsum(p.has & _ALPHA > 0)])
    gaps = np.concatenate([[0], np.cumsum((p.kind[1:] != _SPACE) & (p.kind[:-1] == _SPACE)), [0]])
    begin, n = np.maximum(a - 1, 0), b - a - ORDER + 3
    letters = alpha[b] - alpha[a]
    ok = (n >= 3) & (letters >= 5) & (letters >= 0.4 * (b - a)) & (gaps[b - 1] - gaps[a] >= 1)
    a, b, begin, n = a[ok], b[ok], begin[ok], n[ok]
    mean = (up[np.minimum(begin + n, len(g))] - up[begin]) / n
    whole = mean >= SEGMENT
    spans = [(int(x), int(y)) for x, y in zip(a[whole], b[whole], strict=True) if not _quoted(p.text, int(x), int(y))]
    done = np.zeros(len(p.code) + 1, dtype=bool)
    for x, y in spans:
        done[x:y] = True
    rest = ~whole
    for size, least, anywhere in WINDOWS:
        m = size - ORDER + 1
        hits = _over(up, m, least * m)
        s = np.searchsorted(begin, hits, side="right") - 1
        s = np.maximum(s, 0)
        inside = (hits >= begin[s]) & (hits + size <= b[s] + 1) & rest[s] & (b[s] - a[s] > size) if len(begin) else np.zeros(len(hits), bool)
        inside &= anywhere | (hits - begin[s] < 2) if len(begin) else inside
        for x, y in _runs(hits[inside & ~done[hits]], size):
            if alpha[y] - alpha[x] >= 0.4 * (y - x) and not (_quoted(p.text, x, y) or any(c in p.text[x:y] for c in "\"`«“")):
                spans.append((x, y))
    word = np.concatenate([[0.0], np.cumsum(model.word[g], dtype=np.float64)])
    slots = [(x, y, True) for x, y in _runs(_over(word, WORD_WINDOW, WORD_WINDOW * IN_WORD), WORD_WINDOW + ORDER - 1)]
    at, exact, wide = p.shapes()
    near = np.concatenate([[0.0], np.cumsum(model.shape(exact, wide), dtype=np.float64)])
    for x, y in _runs(_over(near, SLOT_WINDOW, IN_SLOT), SLOT_WINDOW + SHAPE_ORDER - 2):
        slots.append((int(at[x]), int(at[y]) if y < len(at) else len(p.code), False))
    cut = np.append(p.starts, len(p.code) + 2)

    def odds(x: int, y: int) -> float:
        lo, hi = np.searchsorted(at, [x - 1, y - SHAPE_ORDER + 2])
        lo = max(0, lo - (2 if hi - lo < 2 else 0))  # a slot of one or two signs shows in what stands before it, too
        hi = min(max(hi, lo + 1), len(near) - 1)
        return float(near[hi] - near[lo]) / (hi - lo) if hi > lo else 0.0

    for x, y in spans:
        t = int(np.searchsorted(cut, x, side="right")) - 1
        out.append((t, x - int(cut[t]), min(y, int(cut[t + 1]) - 3) - int(cut[t]), "notice"))
    for x, y, is_word in slots:
        for t in range(max(0, int(np.searchsorted(cut, x, side="right")) - 1), int(np.searchsorted(cut, y - 1, side="right"))):
            lo, hi = int(cut[t]), int(cut[t + 1]) - 3
            u, v = max(x, lo), min(y, hi)
            while u < v and p.kind[u] == _SPACE:
                u += 1
            while u < v and p.kind[v - 1] == _SPACE:
                v -= 1
            if u < v:
                out += [(t, i, j, "slot") for i, j in _stands(p.text[lo:hi], u - lo, v - lo, is_word, lambda i, j, lo=lo: odds(i + lo, j + lo))]
    return out


def residue_spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of residue in one text."""
    return [(a, b, k) for _, a, b, k in page_spans(Page([text]), model)] if text and text.strip() else []


def _covered(spans: list[tuple[int, int]]) -> int:
    total, upto = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, least_coverage: float = 0.0, model: Model | None = None) -> DataFrame:
    """(key, kind, n_spans, n_chars, coverage): documents to leave out.

    ``kind``: ``slot``, ``notice`` or ``both``; coverage is the share of the text that is residue. A
    document is left out if residue covers at least ``min_chars`` characters and more than
    ``least_coverage`` of it. Null and blank texts, and texts of punctuation alone, are not.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents, text))  # tables of fixed size
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, kinds, counts, chars, shares = [], [], [], [], []
            for first, p in pages(b.column(1)):
                per: dict[int, list[tuple[int, int, str]]] = {}
                for t, x, y, what in page_spans(p, shared.value):
                    per.setdefault(t, []).append((x, y, what))
                ends = np.append(p.starts, len(p.code) + 2)
                for t, spans in sorted(per.items()):
                    n = _covered([(x, y) for x, y, _ in spans])
                    share = n / max(1, int(ends[t + 1] - ends[t]) - 3)
                    if n >= min_chars and share > least_coverage:
                        have = {k for _, _, k in spans}
                        at.append(first + t)
                        kinds.append("both" if len(have) > 1 else have.pop())
                        counts.append(len(spans))
                        chars.append(n)
                        shares.append(share)
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(counts, pa.int64()), pa.array(chars, pa.int64()), pa.array(shares, pa.float64())], names=[key, "kind", "n_spans", "n_chars", "coverage"])

    return documents.select(key, F.col(text).cast("string").alias(text)).where(f"{text} is not null").mapInArrow(run, f"{key} {kind}, kind string, n_spans bigint, n_chars bigint, coverage double")
