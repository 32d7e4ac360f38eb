"""Arithmetic on scalars and arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BUCKETS = ("trivial", "easy", "medium", "brick_wall")


def bucket(pass_rate: Column, k: Column) -> Column:
    """Difficulty by the number of right answers of k, rounded half to even."""
    right = F.bround(pass_rate * k)
    return (F.when((k <= 0) | (right <= 0), "brick_wall").when(right >= F.greatest(F.lit(1), F.floor(7 * k / 8)), "trivial")
            .when(right >= F.greatest(F.lit(1), F.floor(k / 2)), "easy").otherwise("medium"))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 1 if one text is empty, 0 if they are equal."""
    return F.when(a == b, 0.0).when((a == "") | (b == ""), 1.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def to_unit(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(hi <= lo, 0.0).otherwise(F.least(F.greatest(F.try_divide(x - lo, hi - lo), F.lit(0.0)), F.lit(1.0)))


def majority(left: Column, right: Column) -> Column:
    return F.when(left > right, "A").when(right > left, "B")


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of two boxes (x, y, width, height)."""
    w = F.greatest(F.lit(0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Touching edges do not."""
    return (a[0] < b[0] + b[2]) & (b[0] < a[0] + a[2]) & (a[1] < b[1] + b[3]) & (b[1] < a[1] + a[3])


def resized(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    scale = F.sqrt(F.lit(float(most)) / (w * h))
    small = w * h <= most
    return tuple(F.when(small, x).otherwise(F.floor(x * scale)).cast("long") for x in (w, h))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 luminance of sRGB components from 0 to 255, linearised."""
    def lin(c: Column) -> Column:
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)


def warp(x: Column, y: Column, h: list) -> tuple[Column, Column]:
    """A point under a 3 x 3 homography, given row by row."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def inverse3(m: list) -> list:
    """Inverse of a 3 x 3 matrix of Columns, row by row."""
    a, b, c, d, e, f, g, h, i = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [x / det for x in (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)]


def matmul3(p: list, q: list) -> list:
    return [sum((p[3 * r + k] * q[3 * k + c] for k in range(1, 3)), p[3 * r] * q[c]) for r in range(3) for c in range(3)]


def pixel(x: Column, size: Column) -> Column:
    return F.bround(x * size).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def kl_term(ref: Column, new: Column, longest: Column | float) -> Column:
    """Sum of exp(d) - d - 1 for d = ref - new held to +-20, NaN as 0, over the longest length."""
    def one(r: Column, n: Column) -> Column:
        d = F.nanvl(r - n, F.lit(0.0))
        d = F.least(F.greatest(d, F.lit(-20.0)), F.lit(20.0))
        return F.when(r.isNull() | n.isNull(), 0.0).otherwise(F.exp(d) - d - 1)
    return F.coalesce(F.aggregate(F.zip_with(ref, new, one), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), F.lit(0.0)) / longest


def surrogate(new: Column, old: Column, advantage: Column, longest: Column | float, clip: float = 0.2, clip_high: float = 0.0) -> Column:
    """The clipped policy loss of one completion."""
    high = clip_high if clip_high > 0 else clip
    def one(n: Column, o: Column) -> Column:
        ratio = F.exp(n - o)
        return F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + high)) * advantage)
    return -F.aggregate(F.zip_with(new, old, one), F.lit(0.0), lambda s, x: s + x) / longest


def aligned(ids: Column, logprobs: Column) -> Column:
    return F.coalesce((F.size(ids) == F.size(logprobs)) & (F.size(ids) > 0), F.lit(False))


def drop_ids(ids: Column, logprobs: Column, special: list[int]) -> tuple[Column, Column]:
    """Both arrays without the places where the id is special."""
    pairs = F.zip_with(ids, logprobs, lambda i, p: F.struct(i.alias("i"), p.alias("p")))
    kept = F.filter(pairs, lambda x: ~x["i"].isin(special))
    return F.transform(kept, lambda x: x["i"]), F.transform(kept, lambda x: x["p"])


def warmup(step: Column, steps: int, peak: float) -> Column:
    return F.lit(peak) if steps <= 0 else F.least(step / steps, F.lit(1.0)) * peak


def seeded(key: Column, seed: int = 42) -> Column:
    """A uniform order that depends on seed and key alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def shuffled_choices(key: Column, n: int, correct: Column) -> tuple[Column, Column]:
    """A permutation of 0..n-1 by hash, and where ``correct`` (from 0) has gone."""
    keyed = F.sort_array(F.array(*[F.struct(F.md5(F.concat_ws(":", key.cast("string"), F.lit(i)).cast("binary")).alias("h"), F.lit(i).alias("i")) for i in range(n)]))
    order = F.transform(keyed, lambda x: x["i"])
    return order, F.array_position(order, correct.cast("int")).cast("int") - 1
