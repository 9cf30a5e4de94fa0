"""Box arithmetic. A box is a tuple of four Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def named(b: Box, prefix: str = "") -> dict[str, Column]:
    return {f"{prefix}{c}": v for c, v in zip(("x1", "y1", "x2", "y2"), b)}


def area(b: Box, one: float = 0.0) -> Column:
    return (b[2] - b[0] + one) * (b[3] - b[1] + one)


def intersection(a: Box, b: Box, one: float = 0.0) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + one
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + one
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box, eps: float = 1e-7, inclusive: bool = False) -> Column:
    """Overlap over union; ``inclusive`` counts both border pixels."""
    one = 1.0 if inclusive else 0.0
    inter = intersection(a, b, one)
    return inter / (area(a, one) + area(b, one) - inter + eps)


def ioa(a: Box, b: Box, eps: float = 1e-7) -> Column:
    """Overlap over the area of ``b``."""
    return intersection(a, b) / (area(b) + eps)


def iou_family(a: Box, b: Box, eps: float = 1e-7) -> dict[str, Column]:
    """Plain, generalised, distance and complete IoU."""
    w1, h1 = a[2] - a[0], a[3] - a[1] + eps
    w2, h2 = b[2] - b[0], b[3] - b[1] + eps
    inter = intersection(a, b)
    union = w1 * h1 + w2 * h2 - inter + eps
    plain = inter / union
    cw = F.greatest(a[2], b[2]) - F.least(a[0], b[0])
    ch = F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    c2 = cw * cw + ch * ch + eps
    sx, sy = b[0] + b[2] - a[0] - a[2], b[1] + b[3] - a[1] - a[3]
    rho2 = (sx * sx + sy * sy) / 4
    turn = F.atan(w2 / h2) - F.atan(w1 / h1)
    v = (4 / math.pi ** 2) * turn * turn
    alpha = v / (v - plain + (1 + eps))
    hull = cw * ch + eps
    return {"iou": plain, "giou": plain - (hull - union) / hull, "diou": plain - rho2 / c2,
            "ciou": plain - (rho2 / c2 + v * alpha)}


def rotated_covariance(w: Column, h: Column, r: Column) -> tuple[Column, Column, Column]:
    a, b, c, s = w * w / 12, h * h / 12, F.cos(r), F.sin(r)
    return a * c * c + b * s * s, a * s * s + b * c * c, (a - b) * c * s


def rotated_iou(p: tuple, q: tuple, eps: float = 1e-7) -> Column:
    """Probabilistic IoU of rotated boxes (cx, cy, w, h, angle)."""
    return gaussian_iou((p[0], p[1], *rotated_covariance(*p[2:])), (q[0], q[1], *rotated_covariance(*q[2:])), eps)


def gaussian_iou(p: tuple, q: tuple, eps: float = 1e-7) -> Column:
    """The same from centres and covariances (cx, cy, a, b, c), which joins need once per box and not per pair."""
    a1, b1, c1 = p[2:]
    a2, b2, c2 = q[2:]
    a, b, c = a1 + a2, b1 + b2, c1 + c2
    det = a * b - c * c
    dx, dy = q[0] - p[0], p[1] - q[1]
    t1 = (a * dy * dy + b * dx * dx) / (det + eps) * 0.25
    t2 = c * dx * dy / (det + eps) * 0.5
    d1 = F.greatest(a1 * b1 - c1 * c1, F.lit(0.0))
    d2 = F.greatest(a2 * b2 - c2 * c2, F.lit(0.0))
    t3 = F.ln(det / (4 * F.sqrt(d1 * d2) + eps) + eps) * 0.5
    bd = F.least(F.greatest(t1 + t2 + t3, F.lit(eps)), F.lit(100.0))
    return 1 - F.sqrt(1.0 - F.exp(-bd) + eps)


# ---- conversions ------------------------------------------------------------------

def xyxy_to_xywh(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def xywh_to_xyxy(b: Box) -> Box:
    return b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2


def xywhn_to_xyxy(b: Box, w: float, h: float, padw: float = 0.0, padh: float = 0.0) -> Box:
    x, y, bw, bh = b
    return w * (x - bw / 2) + padw, h * (y - bh / 2) + padh, w * (x + bw / 2) + padw, h * (y + bh / 2) + padh


def xyxy_to_xywhn(b: Box, w: float, h: float, clip: bool = False, eps: float = 0.0) -> Box:
    if clip:
        b = clip_box(b, w - eps, h - eps)
    x, y, bw, bh = xyxy_to_xywh(b)
    return x / w, y / h, bw / w, bh / h


def xywh_to_ltwh(b: Box) -> Box:
    return b[0] - b[2] / 2, b[1] - b[3] / 2, b[2], b[3]


def xyxy_to_ltwh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def ltwh_to_xywh(b: Box) -> Box:
    return b[0] + b[2] / 2, b[1] + b[3] / 2, b[2], b[3]


def ltwh_to_xyxy(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def xywhr_corners(x: Column, y: Column, w: Column, h: Column, r: Column) -> list[tuple[Column, Column]]:
    """Corners of a rotated box, starting at centre + half width + half height."""
    ux, uy = w / 2 * F.cos(r), w / 2 * F.sin(r)
    vx, vy = -h / 2 * F.sin(r), h / 2 * F.cos(r)
    return [(x + ux + vx, y + uy + vy), (x + ux - vx, y + uy - vy),
            (x - ux - vx, y - uy - vy), (x - ux + vx, y - uy + vy)]


def clip_box(b: Box, w: float, h: float) -> Box:
    lim = lambda c, hi: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(hi)))
    return lim(b[0], w), lim(b[1], h), lim(b[2], w), lim(b[3], h)


def grow_to_min(b: Box, w: int, h: int, min_size: int) -> Box:
    """Crop box inside the image, widened to ``min_size`` pixels where it is smaller (integer pixels)."""
    cut = lambda c, lo, hi: F.least(F.greatest(c, lo), hi)
    out = []
    for lo, hi, size in ((b[0], b[2], w), (b[1], b[3], h)):
        lo = cut(lo, F.lit(0), F.lit(size - 1))
        hi = cut(hi, F.lit(0), F.lit(size))
        need = F.greatest(F.lit(min_size) - (hi - lo), F.lit(0))
        shift = F.least(F.floor(need / 2) + need % 2, lo)
        lo, hi = lo - shift, hi + need - shift
        lo = cut(lo, F.lit(0), F.lit(size - 1))
        hi = cut(hi, lo + 1, F.lit(size))
        out.append((lo, hi))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def near_edge(b: Box, w: float, h: float, margin: float = 0.05) -> Column:
    """Within the margin of the left, right or bottom edge; the top edge does not count."""
    return (b[0] <= w * margin) | (w - b[2] <= w * margin) | (h - b[3] <= h * margin)


def rect_to_relative(b: Box) -> Box:
    """Top-left box with size to (centre / size, log size)."""
    x, y, w, h = b
    return (x + 0.5 * w) / w, (y + 0.5 * h) / h, F.ln(w), F.ln(h)


def relative_to_rect(b: Box) -> Box:
    w, h = F.exp(b[2]), F.exp(b[3])
    return b[0] * w - 0.5 * w, b[1] * h - 0.5 * h, w, h


def round_to_divisor(c: Column, divisor: int) -> Column:
    return F.greatest(F.lit(divisor), (F.bround(c / divisor) * divisor).cast("int"))


def resized_hw(h: Column, w: Column, long_side: int, divisor: int = 28) -> tuple[Column, Column]:
    """Height and width scaled to a long side, each rounded to the divisor."""
    scale = F.lit(float(long_side)) / F.greatest(h, w)
    return (round_to_divisor(F.bround(h * scale), divisor), round_to_divisor(F.bround(w * scale), divisor))


def area_limited_hw(h: Column, w: Column, max_area: int, mod: int) -> tuple[Column, Column]:
    """Height and width of a fixed area at the aspect ratio, floored to a multiple."""
    ratio = h / w
    fit = lambda v: (F.floor(F.bround(F.sqrt(v)) / mod) * mod).cast("int")
    return fit(max_area * ratio), fit(max_area / ratio)


def make_divisible(c: Column, divisor: int) -> Column:
    return (F.ceil(c / divisor) * divisor).cast("int")
